"""Observations to current state and history, in arrival order.

The rules, per listing and in the order rows arrived:

* an observation that breaks a rule of its own, or whose run is not running for its source, is refused before it is looked at;
* an observation older than the newest accepted one is dropped (equal times pass);
* one whose identity disagrees with the stored identity is dropped and the listing goes to review; so is one whose listing is linked
  to a canonical identity and whose own decision names another one, or none;
* any other replaces the stored identity, nulls included; the first verified decision links the listing for good;
* a complete observation retires active offers it does not mention;
* a history row is written for a first sighting and for every change of state.

Acceptance depends on earlier acceptance, yet no listing is folded row by row: listings with one
identity need a running max only, and the runs of equal identity of the few others pass through one
sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.operators import ordered
from quotegrain.session import cut_lineage, in_buckets, in_files

IDENTITY = ["source_name", "sold_as", "content_quantity", "content_unit", "brand_name"]
#: What the newest decision of the observed identity said, if there was one: its status and canonical key.
DECISION = ["decision_status", "decision_key"]
STATE = ["price_cents", "availability", "active", "terms", "valid_until"]
LISTING = ["listing_id"]
#: Rows of one bucket of staged observations, and the least number of buckets.
BUCKET_ROWS = 250_000
LEAST_BUCKETS = 8


@dataclass(frozen=True)
class Ingested:
    decisions: DataFrame  # every observation with its outcome
    offers: DataFrame  # current offer state
    history: DataFrame  # change rows
    listings: DataFrame  # current listing identity and review flag


def _links() -> Column:
    """Canonical key that an accepted observation gives its listing."""
    return F.when(F.col("decision_status") == "verified", F.col("decision_key"))


def run_problem(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Add ``problem``: the run is unknown, belongs to another source or is not running. ``runs``: run_id, source_id, status, one row a run.

    A problem that a row already has stays.
    """
    known = runs.select("run_id", F.col("source_id").alias("_run_source"), F.col("status").alias("_run_status"))
    sound = (F.col("_run_source") == F.col("source_id")) & (F.col("_run_status") == "running")
    own = F.when(~F.coalesce(sound, F.lit(False)), "invalid_observation_run")
    before = F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")
    return rows.join(known, "run_id", "left").withColumn("problem", F.coalesce(before, own)).drop("_run_source", "_run_status")


def decided_as_of(observations: DataFrame, decisions: DataFrame, keys: list[str], order: list[str], rows_per_task: int | None = ordered.ROWS_PER_TASK) -> DataFrame:
    """Add the decision that was the newest when each observation was made.

    ``decisions``: keys, observed_at (when it was made), decision_status, decision_key. Both sides go through one ordered pass per key, decisions
    of the same moment first; a key with many rows is cut into slices like any other. ``order`` tells observations of one moment apart.
    """
    made = F.struct(*DECISION)
    sides = observations.select(*observations.columns, F.lit(1).alias("_side"), F.lit(None).cast(_kind(decisions.select(made.alias("x")))).alias("_made"))
    given = decisions.select(
        *[F.col(c) if c in (*keys, "observed_at") else F.lit(None).cast(observations.schema[c].dataType).alias(c) for c in observations.columns],
        F.lit(0).alias("_side"), made.alias("_made"))
    marked = ordered.last_value(sides.unionByName(given), keys, ["observed_at", "_side", *order], F.col("_made"), "_newest", rows_per_task)
    rows = marked.where("_side = 1")
    return rows.select(*observations.columns, *(F.col(f"_newest.{c}").alias(c) for c in DECISION))


def _kind(one: DataFrame) -> str:
    return one.schema["x"].dataType.simpleString()


def listing_sizes(rows: DataFrame) -> DataFrame:
    """(listing, _n): rows of each listing."""
    return rows.groupBy(*LISTING).agg(F.count(F.lit(1)).alias("_n"))


def buckets_for(rows: DataFrame, rows_per_task: int | None = ordered.ROWS_PER_TASK, sizes: DataFrame | None = None) -> int | None:
    """Buckets to stage ``rows`` in, or None when a listing is hot, so that its rows must be cut. One count, none when ``sizes`` are known."""
    sizes = listing_sizes(rows) if sizes is None else sizes
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if rows_per_task and (most or 0) > rows_per_task:
        return None
    return max(LEAST_BUCKETS, -(-(total or 0) // BUCKET_ROWS))


def number_arrivals(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add seq, the arrival number within the listing. Rows are dealt into the buckets that ``decide`` and ``apply`` stage them in."""
    buckets = buckets_for(rows)
    if buckets is None:
        return ordered.rank_rows(rows, LISTING, order, "seq")
    return ordered.rank_rows(rows.repartition(buckets, *LISTING), LISTING, order, "seq", None)


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("identity", F.struct(*IDENTITY, *DECISION))


def _stage(observations: DataFrame, buckets: int | None, rows_per_task: int | None, order: list[str] | None = None) -> tuple[DataFrame, int | None]:
    """Write the batch down once, since every step reads it, and see whether any listing is hot.

    Without a hot listing the rows lie in buckets of their listings, and no step shuffles them again. ``_mixed`` marks the rows of
    listings that were seen with several identities. An offer occurs at most once per observation, so no offer key is hot when no listing is.
    Rows in buckets also carry what their listing alone says of them: ``run_seq``, where their run of equal identity began, and ``_in_run``,
    the newest time before them in it. With ``order``, rows without seq are numbered here, in the same sort.
    """
    optional = {c: F.lit(None).cast("string") for c in (*DECISION, "problem") if c not in observations.columns}
    rows = observations.withColumns(optional)
    if buckets is None:
        staged = cut_lineage(rows)
        spread = _identified(staged.where("problem IS NULL")).groupBy(*LISTING).agg(F.min("identity").alias("_a"), F.max("identity").alias("_b"))
        mixed = spread.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*LISTING, F.lit(True).alias("_mixed"))
        marked = staged.join(mixed, LISTING, "left").withColumn("_mixed", F.coalesce("_mixed", F.lit(False)))
        return marked, ordered.split_limit(staged, LISTING, rows_per_task) if rows_per_task else None
    rows = rows.repartition(buckets, *LISTING)
    by = Window.partitionBy(*LISTING).orderBy(*(["_new", *order] if order else ["seq"]))
    earlier, so_far = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_new", F.col("seq").isNull().cast("long")) if order else rows
    sound = F.col("problem").isNull()
    own = F.when(sound, F.struct(*IDENTITY, *DECISION))
    number = {"seq": F.coalesce("seq", F.sum("_new").over(so_far))} if order else {}
    rows = rows.withColumns(number | {"_before": F.last(own, ignorenulls=True).over(earlier)})
    rows = rows.withColumn("_open", F.when(sound & ~F.col("_before").eqNullSafe(own), F.col("seq").cast("long"))).drop("_before")
    rows = rows.withColumn("run_seq", F.max("_open").over(so_far))
    # A later run has a larger number, so the largest pair is the newest time of the last run so far.
    rows = rows.withColumns({
        "_in_run": F.max(F.when(sound, F.struct("run_seq", "observed_at"))).over(earlier),
        "_mixed": ~F.min("_open").over(whole).eqNullSafe(F.max("_open").over(whole))})
    marked = rows.withColumn("_in_run", F.when(F.col("_in_run.run_seq") == F.col("run_seq"), F.col("_in_run.observed_at")))
    return in_buckets(marked.drop("_open", "_new"), LISTING, buckets, deal=False), None


def decide(observations: DataFrame, rows_per_task: int | None = ordered.ROWS_PER_TASK) -> DataFrame:
    """Add ``outcome``: accepted, older_observation, identity_conflict, or the problem the row came with.

    ``observations``: listing_id, seq (arrival number, unique in the listing), observed_at, identity fields; decision columns and
    problem where there are any.
    """
    buckets = buckets_for(observations, rows_per_task)
    staged, limit = _stage(observations, buckets, rows_per_task)
    return _decide(staged, limit) if buckets is None else _decide_in_buckets(staged, buckets)


def _decide(rows: DataFrame, limit: int | None) -> DataFrame:
    refused = rows.where("problem IS NOT NULL").withColumn("outcome", F.col("problem"))
    rows = rows.where("problem IS NULL")
    plain = ordered.running_max(
        rows.where("NOT _mixed"), LISTING, ["seq"], F.col("observed_at"), "_newest", limit
    ).withColumn(
        "outcome",
        F.when(F.col("_newest") > F.col("observed_at"), "older_observation").otherwise("accepted"),
    ).drop("_newest")
    return plain.unionByName(_decide_mixed(_identified(rows.where("_mixed")), limit)).unionByName(refused).drop("_mixed")


def _decide_in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """``_decide`` of rows staged in buckets: one scan and the short list of solved runs, so a reader of few columns reads only those."""
    runs = rows.where("problem IS NULL AND _mixed").groupBy(*LISTING, "run_seq").agg(
        F.first(F.struct(*IDENTITY, *DECISION)).alias("identity"), F.max("observed_at").alias("top")
    )
    solved = in_buckets(_solve(runs), LISTING, buckets)
    joined = rows.join(solved, [*LISTING, "run_seq"], "left").where("problem IS NOT NULL OR NOT _mixed OR agrees IS NOT NULL")
    # A listing with one identity is one run, which meets nothing stored.
    outcome = F.when(F.col("problem").isNotNull(), F.col("problem")).otherwise(_outcome(F.coalesce("agrees", F.lit(True))))
    return joined.select(*[c for c in rows.columns if c not in ("run_seq", "_in_run", "_mixed")], outcome.alias("outcome"))


def _outcome(agrees: Column) -> Column:
    newest = F.greatest(F.col("stored_top"), F.when(agrees, F.col("_in_run")))
    return F.when(newest > F.col("observed_at"), "older_observation").when(~agrees, "identity_conflict").otherwise("accepted")


def _decide_mixed(rows: DataFrame, rows_per_task: int | None) -> DataFrame:
    marked = ordered.previous(rows, LISTING, ["seq"], ["identity"], "_p", rows_per_task)
    opens = F.col("_p").isNull() | ~F.col("_p.identity").eqNullSafe(F.col("identity"))
    marked = marked.withColumn("_open", F.when(opens, F.col("seq"))).drop("_p")
    marked = ordered.last_value(marked, LISTING, ["seq"], F.col("_open"), "_earlier", rows_per_task)
    marked = marked.withColumn("run_seq", F.coalesce("_open", "_earlier")).drop("_open", "_earlier")
    if rows_per_task:
        marked = cut_lineage(marked)

    runs = marked.groupBy(*LISTING, F.col("run_seq").cast("long").alias("run_seq")).agg(
        F.first("identity").alias("identity"), F.max("observed_at").alias("top")
    )
    solved = _solve(runs)
    joined = marked.join(solved, [*LISTING, "run_seq"])
    joined = ordered.running_max(
        joined, [*LISTING, "run_seq"], ["seq"], F.col("observed_at"), "_in_run", rows_per_task
    )
    return joined.withColumn("outcome", _outcome(F.col("agrees"))).drop("run_seq", "agrees", "stored_top", "_in_run", "identity")


def _solve(runs: DataFrame) -> DataFrame:
    """``agrees``: whether each run agrees with what was stored when it began, and ``stored_top``: the newest time stored by then.

    A run changes the stored row when the last run that did so agrees with it and is not newer. Runs are changes of identity, so
    a listing has few of them however many rows it has. They pass through in order, as a sorted stream of which a task holds one
    batch and the stored run. The jobs are the same for any number of changes.
    """
    fields = [F.col(f"identity.{c}").cast("string").alias(f"_i{k}") for k, c in enumerate([*IDENTITY, *DECISION])]
    ordered_runs = runs.select(*LISTING, "run_seq", F.col("top").cast("timestamp_ntz").alias("top"), *fields)
    ordered_runs = ordered_runs.repartition(*LISTING).sortWithinPartitions(*LISTING, "run_seq")
    kind, time = (runs.schema[c].dataType.simpleString() for c in (LISTING[0], "top"))
    met = ordered_runs.mapInArrow(_met, f"{LISTING[0]} {kind}, run_seq long, agrees boolean, stored_top timestamp_ntz")
    return met.withColumn("stored_top", F.col("stored_top").cast(time))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of their listings to (listing, run, whether it agrees with the run stored when it began, that run's newest time)."""
    listing = top = linked = None
    first, identity = True, ()
    size = len(IDENTITY)
    for batch in batches:
        agreed, tops = [], []
        columns = [batch[LISTING[0]].to_pylist(), batch["top"].cast(pa.int64()).to_pylist()]
        names = zip(*(batch[f"_i{k}"].to_pylist() for k in range(size + len(DECISION))), strict=True)
        for own, own_top, own_identity in zip(*columns, names, strict=True):
            if own != listing:
                listing, first, top, linked, identity = own, True, None, None, ()
            status, key = own_identity[size:]
            agrees = first or (
                all(a is None or b is None or a == b for a, b in zip(identity, own_identity[:size], strict=True))
                and (linked is None or status is None or linked == key)
            )
            agreed.append(agrees)
            tops.append(top)
            if first or (top <= own_top and agrees):
                first, top, identity = False, own_top, own_identity[:size]
                if linked is None and status == "verified":
                    linked = key
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in LISTING), batch["run_seq"], pa.array(agreed, pa.bool_()), pa.array(tops, pa.int64()).cast(pa.timestamp("us"))],
            names=[*LISTING, "run_seq", "agrees", "stored_top"])


def expand_offers(accepted: DataFrame, stored: DataFrame | None = None, rows_per_task=ordered.ROWS_PER_TASK):
    """Accepted observations to offer rows, each with the next complete observation of its listing.

    ``stored`` offers join in as rows of the stored observation, which has seq < 0.
    """
    closing = F.when(F.col("complete"), F.struct("seq", "observed_at", "run_id"))
    marked = ordered.last_value(
        accepted, LISTING, ["seq"], closing, "closing", rows_per_task, forward=True
    )
    rows = marked.select(
        *LISTING, "seq", "observed_at", "run_id", "closing", F.explode("offers").alias("offer")
    ).select(*LISTING, "seq", "observed_at", "run_id", "closing", "offer.*")
    if stored is None:
        return rows
    # The stored row comes first, so what closes it is the first complete one; the wide rows are not read again for it.
    ends = accepted.groupBy(*LISTING).agg(F.min("seq").alias("seq"), F.min_by(closing, F.when(closing.isNotNull(), F.col("seq"))).alias("closing"))
    return rows.unionByName(stored.drop("seq").join(ends.where("seq < 0"), LISTING))


def stored_observations(listings: DataFrame, like: DataFrame) -> DataFrame:
    """Stored listing rows as the observation before the batch: seq -1, no offers, never complete, linked as they are.

    ``listings``: listing_id, identity fields, observed_at (newest accepted time), needs_review, canonical_key.
    """
    linked = F.col("canonical_key") if "canonical_key" in listings.columns else F.lit(None).cast("string")
    set_ = {
        "seq": F.lit(-1).cast(like.schema["seq"].dataType), "complete": F.lit(False), "offers": F.array().cast(like.schema["offers"].dataType),
        "decision_key": linked, "decision_status": F.when(linked.isNotNull(), "verified"), "_reviewed": F.coalesce("needs_review", F.lit(False)),
    }
    kept = (*LISTING, *IDENTITY, "observed_at")
    return listings.select(*[F.col(c) if c in kept else set_.get(c, F.lit(None).cast(like.schema[c].dataType)).alias(c) for c in like.columns])


def apply(
    observations: DataFrame,
    offer_key: list[str],
    stored_listings: DataFrame | None = None,
    stored_offers: DataFrame | None = None,
    rows_per_task: int = ordered.ROWS_PER_TASK,
    keep: bool = False,
    order: list[str] | None = None,
    sizes: DataFrame | None = None,
) -> Ingested:
    """One batch: decide, retire, detect changes. ``keep`` writes the offer rows down, for a caller that reads both state and history.

    ``observations``: listing_id, seq >= 0 (arrival number in the listing), observed_at, run_id, complete, identity fields, offers (array of
    key and state fields); decision columns and problem where there are any. Stored frames are what ``Ingested`` returned before.
    With ``order`` the rows have no seq and are numbered in that order where they are staged; ``sizes`` are their ``listing_sizes`` if known.
    """
    observations = observations.withColumns({c: F.lit(None).cast("string") for c in DECISION if c not in observations.columns})
    buckets = buckets_for(observations, rows_per_task, sizes)
    if order:
        unnumbered = F.lit(None).cast("long")
        observations = observations.withColumn("seq", unnumbered) if buckets else ordered.rank_rows(observations, LISTING, order, "seq", rows_per_task)
    arrived = observations.withColumn("_reviewed", F.lit(False))
    if stored_listings is not None:
        arrived = arrived.unionByName(stored_observations(stored_listings, arrived))
    staged, rows_per_task = _stage(arrived, buckets, rows_per_task, order)
    decided = _decide_in_buckets(staged, buckets) if buckets else cut_lineage(_decide(staged, rows_per_task))
    accepted = decided.where(F.col("outcome") == "accepted")
    keys = [*LISTING, *offer_key]
    rows = expand_offers(accepted, stored_offers, rows_per_task)
    rows = ordered.neighbours(
        rows, keys, ["seq"], [*STATE, "closing"], "prev", "next", rows_per_task, ["seq"]
    )
    retired_before = F.coalesce(F.col("prev.active") & (F.col("prev.closing.seq") < F.col("seq")), F.lit(False))
    kept = F.lit(True)
    for name in STATE:
        if name != "active":
            kept = kept & F.col(f"prev.{name}").eqNullSafe(F.col(name))
    was_active = F.col("prev.active") & ~retired_before
    changed = F.col("prev").isNull() | ~(kept & was_active.eqNullSafe(F.col("active")))
    retires = F.col("active") & F.col("closing").isNotNull() & (F.col("next").isNull() | (F.col("next.seq") > F.col("closing.seq")))
    columns = [*keys, *STATE, "observed_at", "run_id", "seq"]
    # Rows that neither open a state nor close one nor are the newest are in no result.
    rows = rows.select(*columns, "closing", (changed & (F.col("seq") >= 0)).alias("opens"), retires.alias("retires"), F.col("next").isNull().alias("last"))
    rows = rows.where("opens OR retires OR last")
    if keep:
        rows = in_files(rows)
    closed = {"active": F.lit(False)} | {c: F.col(f"closing.{c}") for c in ("observed_at", "run_id", "seq")}
    own, end = F.struct(*columns), F.struct(*(closed.get(c, F.col(c)).alias(c) for c in columns))
    events = F.filter(F.array(F.when(F.col("opens"), own), F.when(F.col("retires"), end)), lambda e: e.isNotNull())
    history = rows.select(F.explode(events).alias("event")).select("event.*")
    current = rows.where("last AND retires IS NOT NULL").select(F.when(F.col("retires"), end).otherwise(own).alias("event")).select("event.*")
    links = F.when(F.col("outcome") == "accepted", _links())
    listings = decided.groupBy(*LISTING).agg(
        F.max_by(F.struct(*IDENTITY, "observed_at"), F.when(F.col("outcome") == "accepted", F.col("seq"))).alias("_row"),
        F.bool_or((F.col("outcome") == "identity_conflict") | F.col("_reviewed")).alias("needs_review"),
        F.min_by(links, F.when(links.isNotNull(), F.col("seq"))).alias("canonical_key"))
    listings = listings.where(F.col("_row").isNotNull() & F.col(LISTING[0]).isNotNull()).select(*LISTING, "_row.*", "needs_review", "canonical_key")
    return Ingested(decided.where("seq >= 0").drop("_reviewed"), current, history, listings)
