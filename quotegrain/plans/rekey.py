"""Audited re-keying of legacy identities: plan, approve, apply, undo.

Every step is a function of whole tables. Nothing is updated in place: apply and undo return new
versions, which the caller writes beside the old ones and publishes only after reconciliation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.operators import fingerprint
from quotegrain.functions import text, vocab
from quotegrain.sources import releases

STRUCTURE = ["strength", "form", "route", "release_type", "rxcui", "term_type"]
CANONICAL = ["canonical_name", "normalized_key", *STRUCTURE]
MEDICATION = ["medication_id", "status", "superseded_by_id", *CANONICAL]


def unit_code(column):
    return text.lookup(text.alias_from_search(text.ascii_search_text(column)), vocab.QUANTITY_UNITS)


def plan_items(decisions: DataFrame) -> DataFrame:
    """One item per legacy identity from the decisions of its attached listings.

    ``decisions``: legacy_id, listing_id, listing_status, content_unit, status, reason, normalized_key,
    canonical_name and structure columns. Everything is a combinable aggregate, so an identity with very
    many listings is pre-reduced before the shuffle.
    """
    verified = (F.col("status") == "verified") & F.col("normalized_key").isNotNull()
    structure = F.struct(*STRUCTURE)
    no_unit = (
        (F.col("listing_status") == "verified")
        & F.col("content_unit").isNotNull()
        & unit_code(F.col("content_unit")).isNull()
    )
    review = F.col("status") == "needs_review"
    grouped = decisions.groupBy("legacy_id").agg(
        F.count(F.lit(1)).alias("evidence"),
        F.count_if(verified).alias("_verified"),
        F.min(F.when(verified, F.col("normalized_key"))).alias("_key"),
        F.max(F.when(verified, F.col("normalized_key"))).alias("_other_key"),
        F.min(F.when(verified, structure)).alias("_structure"),
        F.max(F.when(verified, structure)).alias("_other_structure"),
        F.min_by("canonical_name", F.when(verified, F.col("listing_id"))).alias("canonical_name"),
        F.count_if(F.col("listing_status") != "verified").alias("_unverified_listings"),
        F.count_if(no_unit).alias("_no_unit"),
        F.count_if(review).alias("_review"),
        F.min_by("reason", F.when(review, F.col("listing_id"))).alias("_review_reason"),
        F.min_by("reason", "listing_id").alias("_first_reason"),
    )
    agree = (F.col("_verified") == F.col("evidence")) & (F.col("_key") == F.col("_other_key"))
    same = F.col("_structure").eqNullSafe(F.col("_other_structure"))
    status = (
        F.when((F.col("_unverified_listings") > 0) | (F.col("_no_unit") > 0), "needs_review")
        .when(agree, F.when(same, "ready").otherwise("needs_review"))
        .when((F.col("_verified") > 0) | (F.col("_review") > 0), "needs_review")
        .otherwise("unmatched")
    )
    reason = (
        F.when(F.col("_unverified_listings") > 0, "attached_listing_not_verified")
        .when(F.col("_no_unit") > 0, "unsupported_quantity_unit")
        .when(agree, F.when(~same, "canonical_structure_conflict"))
        .when(F.col("_verified") > 0, "listing_identity_decisions_disagree")
        .when(F.col("_review") > 0, F.col("_review_reason"))
        .otherwise(F.coalesce("_first_reason", F.lit("no_normalization_candidate")))
    )
    ready = F.col("decision_status") == "ready"
    return grouped.withColumns({"decision_status": status, "reason": reason}).select(
        "legacy_id",
        "evidence",
        "decision_status",
        "reason",
        F.when(ready, F.col("_key")).alias("normalized_key"),
        F.when(ready, F.col("canonical_name")).alias("canonical_name"),
        *[F.when(ready, F.col(f"_structure.{c}")).alias(c) for c in STRUCTURE],
    )


def candidate_union(candidates: DataFrame) -> DataFrame:
    """Distinct sorted candidate ids per identity; repeats collapse before the ids meet."""
    return candidates.select("legacy_id", "rxcui").distinct().groupBy("legacy_id").agg(
        F.array_sort(F.collect_list("rxcui")).alias("candidates")
    )


def group_items(items: DataFrame, active: DataFrame) -> DataFrame:
    """Collision groups of ready items per key, survivor and approval status.

    ``active``: verified identities without a redirect. An existing row survives; else the smallest id does.
    """
    ready = items.where("decision_status = 'ready'")
    sizes = ready.groupBy("normalized_key").agg(
        F.count(F.lit(1)).alias("_size"),
        F.min("legacy_id").alias("_least"),
        F.min_by(F.struct(*STRUCTURE), "legacy_id").alias("_structure"),
    )
    existing = active.where("normalized_key IS NOT NULL").select(
        "normalized_key", F.col("medication_id").alias("_existing"), F.struct(*STRUCTURE).alias("_stored")
    )
    groups = sizes.join(existing, "normalized_key", "left").select(
        "normalized_key",
        F.coalesce("_existing", "_least").alias("_survivor"),
        (F.col("_size") + F.when(F.col("_existing").isNotNull(), 1).otherwise(0)).alias("_members"),
        (F.col("_existing").isNotNull() & ~F.col("_stored").eqNullSafe(F.col("_structure"))).alias("_conflict"),
    )
    joined = items.join(groups, "normalized_key", "left")
    conflict = F.coalesce("_conflict", F.lit(False))
    ready_now = (F.col("decision_status") == "ready") & ~conflict
    approval = (
        F.when(ready_now, F.when(F.col("_members") > 1, "collision_review").otherwise("pending"))
        .when(conflict | (F.col("decision_status") == "needs_review"), "requires_review")
        .otherwise("unmatched")
    )
    return joined.select(
        "legacy_id",
        "evidence",
        F.when(conflict, "needs_review").otherwise(F.col("decision_status")).alias("decision_status"),
        F.when(conflict, "active_canonical_collision_conflict").otherwise(F.col("reason")).alias("reason"),
        *[F.when(ready_now, F.col(c)).alias(c) for c in CANONICAL],
        F.when(ready_now, F.col("_survivor")).alias("survivor_id"),
        F.when(ready_now, F.col("_members")).otherwise(1).cast("long").alias("group_size"),
        approval.alias("approval_status"),
    )


def summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("legacy_medications"),
        F.count_if(F.col("decision_status") == "ready").alias("ready"),
        F.count_if(F.col("decision_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("decision_status") == "unmatched").alias("unmatched"),
        F.count_if(F.col("approval_status") == "collision_review").alias("collision_review"),
        F.sum("evidence").alias("target_listings"),
    )


def approve(items: DataFrame, collisions: bool = False) -> DataFrame:
    """Pending items become approved; collisions only when asked for."""
    open_states = ["pending", "collision_review"] if collisions else ["pending"]
    state = F.col("approval_status")
    return items.withColumn("approval_status", F.when(state.isin(open_states), "approved").otherwise(state))


def stage_problems(backup: DataFrame, planned: DataFrame, current: DataFrame) -> DataFrame:
    """One row (problems): why a plan must not be staged, empty when it may.

    ``backup``: database_state_hash, restore_verified, its newest record. ``planned`` and ``current``: fingerprints of
    the tables when planning began and now.
    """
    was = fingerprint.snapshot_hash(planned).select(F.col("snapshot_hash").alias("planned_hash"))
    now = fingerprint.snapshot_hash(current).select(F.col("snapshot_hash").alias("current_hash"))
    record = backup.select("database_state_hash", "restore_verified")
    facts = now.select(
        "current_hash", was.scalar().alias("planned_hash"), record.select("database_state_hash").scalar().alias("saved_hash"), record.select("restore_verified").scalar().alias("verified")
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = [
        F.when(~F.coalesce("verified", F.lit(False)), F.lit("restore_verified_backup_required")),
        F.when(~same("saved_hash", "planned_hash"), F.lit("backup_database_state_mismatch")),
        F.when(~same("planned_hash", "current_hash"), F.lit("snapshot_changed_during_planning")),
    ]
    return facts.select(F.array_compact(F.array(*checks)).alias("problems"))


def stage(items: DataFrame, backup: DataFrame, planned: DataFrame, current: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write a plan's items under its run and return the event: (run_id, items, problems).

    A run that exists is never written again. With a problem nothing is written.
    """
    problems = stage_problems(backup, planned, current).first()["problems"]
    spark, rows = items.sparkSession, 0
    if not problems:
        target = f"{path}/run_id={run_id}"
        items.write.mode("error").parquet(target)
        rows = spark.read.parquet(target).count()
    return spark.createDataFrame([(run_id, rows, ",".join(problems))], "run_id string, items long, problems string")


@dataclass(frozen=True)
class Rekeyed:
    medications: DataFrame
    listings: DataFrame
    components: DataFrame
    matches: DataFrame
    items: DataFrame | None = None


#: Columns of a component: one ingredient of a medication with its strength.
COMPONENT = ["sequence", "ingredient_name", "ingredient_rxcui", "numerator_value", "numerator_unit", "denominator_value", "denominator_unit"]


def apply_problems(medications: DataFrame, listings: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(legacy_id, problem): why approved items must not be applied to the tables as they are; empty when they may.

    Members of a group must name one key; its survivor must exist, not be a redirect, and if it is canonical already have the group's
    key and structure; the others must still be legacy; each of their verified listings needs a verified decision and a known unit.
    """
    approved = items.where("approval_status = 'approved'")
    groups = approved.groupBy("survivor_id").agg(
        F.min("normalized_key").alias("_key"), F.max("normalized_key").alias("_other"), F.min_by(F.struct(*STRUCTURE), "legacy_id").alias("_structure"))
    stored = medications.select(
        F.col("medication_id").alias("survivor_id"), F.col("superseded_by_id").alias("_moved"), F.col("normalized_key").alias("_stored_key"), F.struct(*STRUCTURE).alias("_stored"), F.lit(True).alias("_there"))
    judged = groups.join(stored, "survivor_id", "left")
    conflict = F.col("_stored_key").isNotNull() & ((F.col("_stored_key") != F.col("_key")) | ~F.col("_stored").eqNullSafe(F.col("_structure")))
    group_problem = (
        F.when(~F.coalesce(F.col("_key") == F.col("_other"), F.lit(False)), "group_decision_conflict")
        .when(F.col("_there").isNull() | F.col("_moved").isNotNull(), "survivor_not_active")
        .when(conflict, "survivor_conflict")
    )
    wrong = judged.select("survivor_id", group_problem.alias("problem")).where("problem IS NOT NULL")
    by_group = approved.select("legacy_id", "survivor_id").join(wrong, "survivor_id").select("legacy_id", "problem")
    now = medications.select(F.col("medication_id").alias("legacy_id"), F.col("normalized_key").alias("_stored_key"), F.col("superseded_by_id").alias("_moved"), F.lit(True).alias("_there"))
    others = approved.where("legacy_id <> survivor_id").select("legacy_id").join(now, "legacy_id", "left")
    changed = F.col("_stored_key").isNotNull() | F.col("_moved").isNotNull()
    by_item = others.select("legacy_id", F.when(F.col("_there").isNull(), "legacy_missing").when(changed, "legacy_changed").alias("problem")).where("problem IS NOT NULL")
    verified = decisions.where("status = 'verified'").select("listing_id", F.lit(True).alias("_decided"))
    held = listings.where("match_status = 'verified'").select("listing_id", F.col("medication_id").alias("legacy_id"), "content_unit")
    held = held.join(approved.select("legacy_id"), "legacy_id").join(verified, "listing_id", "left")
    no_unit = F.col("content_unit").isNotNull() & unit_code(F.col("content_unit")).isNull()
    by_listing = held.select("legacy_id", F.when(F.col("_decided").isNull(), "listing_decision_missing").when(no_unit, "listing_unit_missing").alias("problem"))
    return by_group.unionByName(by_item).unionByName(by_listing.where("problem IS NOT NULL").distinct())


def apply(medications: DataFrame, listings: DataFrame, items: DataFrame, decisions: DataFrame, run_id: str, stored_components: DataFrame | None = None):
    """New versions after approved items: survivors canonical, the rest redirects, listings repointed, items applied.

    Components come from the strengths of the canonical identity; a survivor that has components keeps them.
    """
    approved = items.where("approval_status = 'approved'")
    canonical = approved.groupBy("survivor_id").agg(
        F.min_by(F.struct(*CANONICAL), "legacy_id").alias("_canonical")
    )
    redirect = approved.where("legacy_id <> survivor_id").select(
        F.col("legacy_id").alias("medication_id"), F.col("survivor_id").alias("_to")
    )
    joined = medications.join(redirect, "medication_id", "left").join(
        canonical.withColumnRenamed("survivor_id", "medication_id"), "medication_id", "left"
    )
    takes = F.col("_canonical").isNotNull() & F.col("normalized_key").isNull()
    moved = F.col("_to").isNotNull()
    new_medications = joined.select(
        "medication_id",
        F.when(moved, "superseded").when(takes, "verified").otherwise(F.col("status")).alias("status"),
        F.coalesce("_to", "superseded_by_id").alias("superseded_by_id"),
        *[F.when(takes & ~moved, F.col(f"_canonical.{c}")).otherwise(F.col(c)).alias(c) for c in CANONICAL],
    )
    target = approved.select(F.col("legacy_id").alias("medication_id"), F.col("survivor_id").alias("_to"))
    repointed = listings.join(target, "medication_id", "left")
    touched = F.col("_to").isNotNull() & (F.col("match_status") == "verified")
    # Marks of earlier runs stay, else those could not be undone.
    earlier = F.col("rekey_run") if "rekey_run" in listings.columns else F.lit(None).cast("string")
    new_listings = repointed.select(
        *[c for c in listings.columns if c not in ("medication_id", "content_unit", "rekey_run")],
        F.when(touched, F.col("_to")).otherwise(F.col("medication_id")).alias("medication_id"),
        F.when(touched, unit_code(F.col("content_unit"))).otherwise(F.col("content_unit")).alias("content_unit"),
        F.when(touched, F.lit(run_id)).otherwise(earlier).alias("rekey_run"),
    )
    components = canonical.select(F.col("survivor_id").alias("medication_id"), "_canonical.*")
    components = with_component_columns(components).select("medication_id", *COMPONENT, F.lit(run_id).alias("rekey_run"))
    if stored_components is not None:
        components = stored_components.unionByName(components.join(stored_components.select("medication_id").distinct(), "medication_id", "left_anti"))
    matches = decisions.join(
        approved.select("legacy_id", "survivor_id"), "legacy_id"
    ).select("listing_id", "legacy_id", F.col("survivor_id").alias("selected_id"), "status", "reason", F.lit(run_id).alias("rekey_run"))
    state = F.col("approval_status")
    advanced = items.withColumn("approval_status", F.when(state == "approved", "applied").otherwise(state))
    return Rekeyed(new_medications, new_listings, components, matches, advanced)


def with_component_columns(canonical: DataFrame) -> DataFrame:
    """One row per ingredient strength of ``canonical``(canonical_name, rxcui, strength, ...): "5 mg", "10 mg/5 ml", parts joined by " / " or "-"."""
    number = r"([0-9]+(?:\.[0-9]+)?)\s*([a-z%]+)(?:\s*/\s*([0-9]+(?:\.[0-9]+)?)?\s*([a-z]+))?"
    parts = F.split(F.lower("strength"), r"\s+/\s+|-")
    rows = canonical.select("*", F.posexplode(parts).alias("_place", "_part"))
    pick = lambda k: F.regexp_extract("_part", number, k)
    given = lambda c: F.when(c != "", c)
    value = lambda c: given(c).cast("decimal(20,6)")
    alone = F.size(parts) == 1
    unit = given(pick(4))
    return rows.withColumns({
        "sequence": F.col("_place") + 1, "ingredient_name": F.trim(F.get(F.split("canonical_name", " / "), F.col("_place"))),
        "ingredient_rxcui": F.when(alone, F.col("rxcui")), "numerator_value": value(pick(1)), "numerator_unit": F.when(pick(2) == "%", "percent").otherwise(given(pick(2))),
        "denominator_value": F.when(unit.isNotNull(), F.coalesce(value(pick(3)), F.lit(1).cast("decimal(20,6)"))), "denominator_unit": unit,
    })


def apply_and_publish(spark, root: str, decisions: DataFrame, run_id: str) -> DataFrame:
    """Apply an approved run to the newest release under ``root`` and publish all its tables as one: (run_id, status, problems).

    The release holds medications, listings, components, matches, items and runs(run_id, status). With a problem nothing but the run's status
    changes. Another writer's release in between makes this fail, and nothing of it is seen.
    """
    before = releases.load(spark, root)
    tables = {name: releases.read(spark, before, name) for name in before.tables}
    problems = sorted(r[0] for r in apply_problems(tables["medications"], tables["listings"], tables["items"], decisions).select("problem").distinct().collect())
    status = "failed" if problems else "applied"
    frames = {"runs": tables["runs"].withColumn("status", F.when(F.col("run_id") == run_id, status).otherwise(F.col("status")))}
    if not problems:
        new = apply(tables["medications"], tables["listings"], tables["items"], decisions, run_id, tables["components"])
        frames |= {"medications": new.medications, "listings": new.listings, "components": new.components, "items": new.items}
        frames["matches"] = tables["matches"].unionByName(new.matches)
    releases.replace(spark, root, frames, before)
    return spark.createDataFrame([(run_id, status, ",".join(problems))], "run_id string, status string, problems string")


def run_status(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The row of one run, or of the newest by number."""
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id)
    return runs.orderBy(F.col("created").desc(), F.col("run_id").desc()).limit(1)


def undo_blockers(current_listings: DataFrame, original_listings: DataFrame, items: DataFrame, run_id: str):
    """Listings that stop an undo: changed since, or new references to a survivor."""
    approved = items.where("approval_status IN ('approved', 'applied')")
    targets = original_listings.join(
        approved.select(F.col("legacy_id").alias("medication_id"), "survivor_id"), "medication_id"
    ).select("listing_id", "survivor_id")
    now = current_listings.select("listing_id", F.col("medication_id").alias("_now"), "rekey_run")
    changed = targets.join(now, "listing_id", "left").where(
        ~F.col("_now").eqNullSafe(F.col("survivor_id")) | ~F.col("rekey_run").eqNullSafe(F.lit(run_id))
    ).select("listing_id", F.lit("listing_changed").alias("reason"))
    own = approved.select("legacy_id").join(
        approved.select(F.col("survivor_id").alias("legacy_id")).distinct(), "legacy_id", "left_semi"
    )
    foreign = (
        current_listings.join(own.select(F.col("legacy_id").alias("medication_id")), "medication_id", "left_semi")
        .join(targets.select("listing_id"), "listing_id", "left_anti")
        .select("listing_id", F.lit("new_reference").alias("reason"))
    )
    return changed.unionByName(foreign)


def undo(current: Rekeyed, raw_medications: DataFrame, raw_listings: DataFrame, items: DataFrame, run_id: str) -> Rekeyed:
    """Put back the raw rows of applied items; evidence and other runs' components stay, components of the run go."""
    touched = items.where("approval_status IN ('approved', 'applied')")
    ids = touched.select(F.col("legacy_id").alias("medication_id"))
    kept = current.medications.join(ids, "medication_id", "left_anti")
    medications = kept.unionByName(raw_medications.select(*kept.columns).join(ids, "medication_id", "left_semi"))
    back = raw_listings.join(ids, "medication_id", "left_semi")
    others = current.listings.join(back.select("listing_id"), "listing_id", "left_anti")
    listings = others.select(*raw_listings.columns).unionByName(back)
    components = current.components.where(~F.col("rekey_run").eqNullSafe(F.lit(run_id)))
    return Rekeyed(medications, listings, components, current.matches)
