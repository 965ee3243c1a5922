"""Resolve free-text drug identities to canonical ones, with a reason for every refusal.

Identity text repeats across millions of listings, so callers normalise distinct identities and
join the outcome back by ``input_hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.functions import text, vocab
from quotegrain.session import cut_lineage

RAW = ["name", "strength", "form", "route", "release_type", "brand_name", "ndc", "species"]
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
UNIT = r"[A-Za-zµμ%]+(?:\s+[A-Za-z]+)?"
STRENGTH = rf"(?i)^({NUMBER})\s*({UNIT})\s*(?:/\s*(?:({NUMBER})\s*)?({UNIT}))?$"


def _exact(number: Column) -> Column:
    """Canonical decimal text of a positive number, null for zero."""
    bare = F.regexp_replace(number, "^0+(?=[0-9])", "")
    short = F.regexp_replace(F.regexp_replace(bare, r"([.][0-9]*?)0+$", "$1"), "[.]$", "")
    return F.when(number.rlike("[1-9]"), short)


def _blank_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def _unit_text(unit: Column) -> Column:
    return F.coalesce(text.lookup(unit, vocab.UNIT_DISPLAY), unit)


def parse_strength(raw: Column) -> Column:
    """Struct of numerator, denominator, display and key; null when ambiguous, unknown or zero."""
    unit_key = lambda c: text.alias_from_search(text.ascii_search_text(c))

    def groups(s):
        part = lambda i: _blank_to_null(F.regexp_extract(s, STRENGTH, i))
        return F.struct(
            _exact(part(1)).alias("value"),
            unit_key(part(2)).alias("unit"),
            _exact(F.coalesce(part(3), F.lit("1"))).alias("below_value"),
            unit_key(part(4)).alias("below"),
        )

    def coded(g):
        litre = F.when(text.lookup(g["below"], vocab.STRENGTH_UNITS) == "l", F.lit("l"))
        return F.struct(
            g["value"].alias("numerator_value"),
            text.lookup(g["unit"], vocab.STRENGTH_UNITS).alias("numerator_unit"),
            F.when(g["below"].isNotNull(), g["below_value"]).alias("denominator_value"),
            F.coalesce(text.lookup(g["below"], vocab.QUANTITY_UNITS), litre).alias("denominator_unit"),
            g["below"].isNotNull().alias("divided"),
        )

    def finished(c):
        value, unit = c["numerator_value"], c["numerator_unit"]
        below_value, below = c["denominator_value"], c["denominator_unit"]
        good = (
            value.isNotNull() & unit.isNotNull() & (~c["divided"] | (below.isNotNull() & below_value.isNotNull()))
        )
        per = F.when(below_value == "1", "").otherwise(F.concat(below_value, F.lit(" ")))
        tail = F.when(below.isNotNull(), F.concat(F.lit("/"), per, _unit_text(below))).otherwise("")
        gap = F.when(unit == "percent", "").otherwise(" ")
        none = F.lit("")
        return F.when(
            good,
            F.struct(
                value.alias("numerator_value"),
                unit.alias("numerator_unit"),
                below_value.alias("denominator_value"),
                below.alias("denominator_unit"),
                F.concat(value, gap, _unit_text(unit), tail).alias("display"),
                F.concat_ws(":", value, unit, F.coalesce(below_value, none), F.coalesce(below, none)).alias("key"),
            ),
        )

    return text.bind(text.bind(text.bind(F.trim(text.nfkc(raw)), groups), coded), finished)


def input_hash() -> Column:
    """Hash of the raw identity in fixed field order with explicit nulls."""
    fields = [F.col(c) for c in RAW[:-1]] + [F.coalesce("species", F.array().cast("array<string>")).alias("species")]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def normalize(raw: DataFrame) -> DataFrame:
    """Add input_hash, norm_name, strength_value, form_code, route_code, release_code, norm_brand."""
    named = raw.withColumns(
        {
            "input_hash": input_hash(),
            "norm_name": text.search_text(F.col("name")),
            "norm_brand": text.search_text(F.coalesce("brand_name", F.lit(""))),
            "strength_value": parse_strength(F.col("strength")),
            "_form": text.alias_key(F.col("form")),
            "_route": text.alias_key(F.col("route")),
            "_release": text.alias_key(F.col("release_type")),
        }
    )
    return named.withColumns(
        {
            "form_code": text.form_code(F.col("_form")),
            "route_code": text.lookup(F.col("_route"), vocab.ROUTES),
            "release_code": text.lookup(F.col("_release"), vocab.RELEASES),
        }
    ).drop("_form", "_route", "_release")


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def gate_reason(terminology_available: bool = True) -> Column:
    """First check a normalised identity fails before any lookup, else null. Needs ``reviewed``."""
    unit = F.col("strength_value.numerator_unit")
    ladder = (
        F.when(F.coalesce(F.col("norm_name"), F.lit("")) == "", "missing_name")
        .when(F.col("strength_value").isNull(), "unsupported_or_ambiguous_strength")
        .when(unit.isin("ml", "l"), "volume_without_concentration")
        .when(F.col("form_code").isNull(), "unsupported_form")
        .when(_given("route") & F.col("route_code").isNull(), "unsupported_route")
        .when(_given("release_type") & F.col("release_code").isNull(), "unsupported_release_type")
        .when((F.size(F.coalesce("species", F.array().cast("array<string>"))) > 0) & ~F.col("reviewed"), "species_requires_review")
    )
    return ladder if terminology_available else ladder.otherwise("terminology_resolver_unavailable")


def local_key() -> Column:
    """Key of a reviewed identity without a terminology concept."""
    parts = F.array(
        "norm_name", F.col("strength_value.key"), "form_code", "route_code", "release_code", "norm_brand"
    )
    species = F.array_sort(F.coalesce("species", F.array().cast("array<string>")))
    joined = F.array_join(F.concat(parts, species), "|")
    return F.concat(F.lit("local:"), F.sha2(joined, 256))


def display_name() -> Column:
    release = F.col("release_code")
    words = F.array(
        text.title_case(F.col("norm_name")),
        F.col("strength_value.display"),
        text.title_case(F.col("route_code")),
        F.when(release.isin("immediate", "not_applicable"), "").otherwise(
            F.concat(text.title_case(release), F.lit(" Release"))
        ),
        text.title_case(F.col("form_code")),
    )
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def reviewed_fallback() -> Column:
    """True when a reviewed identity is complete enough to stand on its own."""
    return (
        F.col("reviewed")
        & (F.col("norm_name") != "")
        & F.col("strength_value").isNotNull()
        & F.col("form_code").isNotNull()
        & F.col("route_code").isNotNull()
        & F.col("release_code").isNotNull()
        & ~F.col("strength_value.numerator_unit").isin("ml", "l")
    )


def inferred_route(concept: Column, form: Column) -> Column:
    """First route word found anywhere in the concept text, in table order; else by form."""
    routes = [(r, r) for r in dict.fromkeys(vocab.ROUTES.values())]
    return F.coalesce(
        text.first_contained(concept, routes),
        F.when(form.isin(vocab.SOLID_FORMS), "oral").when(form == "patch", "transdermal"),
    )


def inferred_release(concept: Column, form: Column) -> Column:
    return (
        F.when(concept.rlike(r"\b(extended release|er|xr|xl|sr)\b"), "extended")
        .when(concept.rlike(r"\b(delayed release|dr|enteric coated|ec)\b"), "delayed")
        .when(form.isin(vocab.SOLID_FORMS), "immediate")
        .otherwise("not_applicable")
    )


def prepare_concepts(concepts: DataFrame) -> DataFrame:
    """Active product concepts with the text columns the match needs, one row per concept.

    Staged once: every lookup of the release reads it.
    """
    usable = concepts.where(F.col("active") & F.col("tty").isin("SCD", "SBD"))
    cleaned = usable.withColumn("concept_text", text.search_text(F.col("concept_name")))
    return cleaned.withColumns(
        {
            "concept_tokens": text.tokens(F.col("concept_text")),
            "concept_form": text.form_code(text.alias_from_search(F.col("concept_text"))),
        }
    ).select("rxcui", "concept_name", "tty", "concept_text", "concept_tokens", "concept_form").transform(cut_lineage)


def distinct_inputs(normalized: DataFrame) -> DataFrame:
    """Normalised distinct identities, staged once since every lookup step reads them."""
    return cut_lineage(normalized.dropDuplicates(["input_hash"]))


def lookup_text() -> Column:
    """Search text of an identity: the given fields in fixed order."""
    fields = [F.when(_given(c), F.col(c)) for c in ("name", "strength", "route", "release_type", "form", "brand_name")]
    return F.array_join(F.array_compact(F.array(*fields)), " ")


def _token_key(cleaned: Column) -> Column:
    return F.array_join(F.array_sort(text.tokens(cleaned)), " ")


def candidates(
    inputs: DataFrame, concepts: DataFrame, ndc_map: DataFrame, approximate: bool = True
) -> DataFrame:
    """(input_hash, rxcui, method): concepts of the first lookup that finds any.

    Order: product code, same text, same words, then (``approximate``) every concept that holds all words
    of the name. The last is joined on the rarest word of the name, so common words never pair up.
    """
    asked = inputs.select(
        "input_hash", "ndc", "norm_name",
        F.lower(F.trim(lookup_text())).alias("_text"),
    ).dropDuplicates(["input_hash"])
    ids = concepts.select("rxcui", "concept_name", "concept_text", "concept_tokens")

    by_code = (
        asked.where(F.col("ndc").rlike("^[0-9]{10,11}$"))
        .join(ndc_map, "ndc")
        .join(ids.select("rxcui"), "rxcui")
        .select("input_hash", "rxcui", F.lit(1).alias("rank"))
    )
    named = ids.select("rxcui", F.lower(F.trim("concept_name")).alias("_text"))
    by_text = asked.join(named, "_text").select("input_hash", "rxcui", F.lit(2).alias("rank"))
    words = asked.withColumn("_words", _token_key(text.search_text(F.col("_text"))))
    keyed = ids.select("rxcui", F.array_join(F.array_sort("concept_tokens"), " ").alias("_words"))
    by_words = words.join(keyed, "_words").select("input_hash", "rxcui", F.lit(3).alias("rank"))

    postings = ids.select("rxcui", "concept_tokens", F.explode("concept_tokens").alias("word"))
    spread = postings.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    names = asked.select("norm_name").distinct().select("norm_name", text.tokens(F.col("norm_name")).alias("name_tokens"))
    rarest = (
        names.select("norm_name", "name_tokens", F.explode("name_tokens").alias("word"))
        .join(spread, "word")
        .groupBy("norm_name", "name_tokens")
        .agg(F.min_by("word", F.struct("_df", "word")).alias("word"), F.count(F.lit(1)).alias("_known"))
        # A word no concept has means no concept holds them all.
        .where(F.col("_known") == F.size("name_tokens"))
    )
    held = rarest.join(postings, "word").where(text.subset(F.col("name_tokens"), F.col("concept_tokens")))
    found = by_code.unionByName(by_text).unionByName(by_words)
    if approximate:
        # Only inputs that nothing better found are looked up by name: a name may meet very many concepts.
        left = asked.select("input_hash", "norm_name").join(found.select("input_hash").distinct(), "input_hash", "left_anti")
        by_name = left.join(held.select("norm_name", "rxcui"), "norm_name").select("input_hash", "rxcui", F.lit(4).alias("rank"))
        found = found.unionByName(by_name)
    best = found.groupBy("input_hash").agg(F.min("rank").alias("rank"))
    method = text.lookup(
        F.col("rank").cast("string"),
        {"1": "ndc", "2": "rxnorm_exact", "3": "rxnorm_normalized", "4": "rxnorm_approximate"},
    )
    return (
        found.join(best, ["input_hash", "rank"]).select("input_hash", "rxcui", method.alias("method")).distinct()
    )


def compatible() -> Column:
    """A candidate says the same thing: words, strength, form, route, release and brand."""
    tokens = F.col("concept_tokens")
    strength = text.tokens(text.ascii_search_text(F.col("strength_value.display")))
    brand = text.tokens(F.col("norm_brand"))
    branded = _given("brand_name")
    return (
        text.subset(text.tokens(F.col("norm_name")), tokens)
        & text.subset(strength, tokens)
        & F.coalesce(F.col("concept_form") == F.col("form_code"), F.lit(False))
        & (~_given("route") | F.coalesce(F.array_contains(tokens, F.col("route_code")), F.lit(False)))
        & (
            ~_given("release_type")
            | F.coalesce(
                F.col("release_code") == inferred_release(F.col("concept_text"), F.col("form_code")), F.lit(False)
            )
        )
        & F.when(branded, (F.col("tty") == "SBD") & text.subset(brand, tokens)).otherwise(F.col("tty") == "SCD")
    )


def judged_candidates(
    inputs: DataFrame, concepts: DataFrame, ndc_map: DataFrame, approximate: bool = True
) -> DataFrame:
    """Candidates with their ``compatible`` flag and the input columns."""
    pairs = candidates(inputs, concepts, ndc_map, approximate)
    return (
        inputs.dropDuplicates(["input_hash"])
        .join(pairs, "input_hash")
        .join(concepts, "rxcui")
        .withColumn("compatible", compatible())
    )


def decision_log(inputs: DataFrame, concepts: DataFrame, ndc_map: DataFrame, version: str) -> DataFrame:
    """Evidence of decisions: every candidate of every lookup, approximate ones too, per input and version of the terms.

    (input_hash, rxcui, method, compatible, version). A product of the inputs with their candidates only; nothing is paired by common words.
    """
    open_inputs = inputs.where(gate_reason().isNull())
    judged = judged_candidates(open_inputs, concepts, ndc_map)
    return judged.select("input_hash", "rxcui", "method", F.coalesce("compatible", F.lit(False)).alias("compatible"), F.lit(version).alias("version"))


def new_evidence(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of inputs that the log does not hold in this version; a decision is written once."""
    return log.join(stored.select("input_hash", "version").distinct(), ["input_hash", "version"], "left_anti")


def decide(inputs: DataFrame, concepts: DataFrame, ndc_map: DataFrame) -> DataFrame:
    """One decision per input_hash: status, method, reason, key.

    ``inputs``: normalised distinct identities with ``reviewed``. Exactly one compatible concept verifies;
    an approximate lookup never does, so it need not run: an input no exact lookup answers goes to review.
    """
    gated = inputs.withColumn("gate", gate_reason())
    open_inputs = gated.where("gate IS NULL")
    judged = judged_candidates(open_inputs, concepts, ndc_map, approximate=False)
    good = F.col("compatible")
    counted = judged.groupBy("input_hash").agg(
        F.first("method").alias("lookup_method"),
        F.count_if(good).alias("fits"),
        F.max(F.when(good, F.struct("rxcui", "concept_name", "tty", "concept_text"))).alias("concept"),
    )
    joined = gated.join(counted, "input_hash", "left")
    route = F.coalesce("route_code", inferred_route(F.col("concept.concept_text"), F.col("form_code")))
    release = F.coalesce("release_code", inferred_release(F.col("concept.concept_text"), F.col("form_code")))
    approximate = F.coalesce(F.col("lookup_method") == "rxnorm_approximate", F.lit(True))
    species = F.col("gate") == "species_requires_review"
    fallback = F.col("gate").isNotNull() & ~species
    by_gate = (
        F.when(species, "needs_review")
        .when(fallback & reviewed_fallback(), "verified")
        .when(fallback & F.col("reviewed"), "needs_review")
        .when(fallback, "unmatched")
    )
    status = (
        F.when(F.col("gate").isNotNull(), by_gate)
        .when(approximate, "needs_review")
        .when(F.col("fits") > 1, "needs_review")
        .when(F.col("fits") == 0, "unmatched")
        .when(route.isNull() | release.isNull(), "needs_review")
        .otherwise("verified")
    )
    reason = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(approximate, "approximate_match_requires_review")
        .when(F.col("fits") > 1, "multiple_compatible_concepts")
        .when(F.col("fits") == 0, "no_compatible_concept")
        .when(route.isNull() | release.isNull(), "route_or_release_unresolved")
    )
    decided = joined.withColumns(
        {
            "status": status,
            "reason": reason,
            "route_final": route,
            "release_final": release,
        }
    )
    own = F.col("gate").isNotNull() & (F.col("status") == "verified")
    method = (
        F.when(own, "reviewed_input")
        .when(F.col("gate").isNotNull(), "none")
        .otherwise(F.coalesce("lookup_method", F.lit("rxnorm_approximate")))
    )
    key = F.when(own, local_key()).when(
        F.col("status") == "verified", F.concat(F.lit("rxnorm:"), F.col("concept.rxcui").cast("string"))
    )
    return decided.withColumns(
        {
            "method": method,
            "normalized_key": key,
            "canonical_name": F.when(own, display_name()).when(
                F.col("status") == "verified", F.col("concept.concept_name")
            ),
        }
    )


def canonical_rows(identities: DataFrame) -> DataFrame:
    """One row per normalized_key: smallest id, size, and whether the components agree."""
    parts = ["numerator_value", "numerator_unit", "denominator_value", "denominator_unit"]
    component = F.struct("norm_name", *[F.col(f"strength_value.{p}") for p in parts])
    return identities.groupBy("normalized_key").agg(
        F.min("medication_id").alias("medication_id"),
        F.count(F.lit(1)).alias("members"),
        F.min_by("canonical_name", "medication_id").alias("canonical_name"),
        (~F.min(component).eqNullSafe(F.max(component))).alias("component_conflict"),
    )


def listing_status(verified: Column, reused: Column, status: Column) -> Column:
    """Verified only with an identity and known content; otherwise the decision or unmatched."""
    known = F.col("content_quantity").isNotNull() & F.col("content_unit").isNotNull()
    return (
        F.when((verified | reused) & known, "verified")
        .when(status == "needs_review", "needs_review")
        .otherwise("unmatched")
    )


def sticky_review(old: Column, new: Column) -> Column:
    return F.when(old == "needs_review", "needs_review").otherwise(new)


def apply_reviews(listings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Attach reviewed identities to listings matching source, product key and package."""
    on = ["source_id", "product_key", "content_quantity", "content_unit"]
    proof = reviews.select(*on, F.col("medication_id").alias("_reviewed"), "proof")
    joined = listings.join(proof, on, "left")
    return joined.withColumns(
        {
            "medication_id": F.coalesce("_reviewed", "medication_id"),
            "match_status": F.when(F.col("_reviewed").isNotNull(), "verified").otherwise(F.col("match_status")),
        }
    ).drop("_reviewed")


def coverage(decisions: DataFrame) -> DataFrame:
    """Counts by source, status, version and reason, with totals of each level above and overall."""
    return decisions.rollup("source_id", "status", "version", "reason").agg(
        F.count(F.lit(1)).alias("inputs"), F.grouping_id().alias("level")
    )


def milligrams(amount: Column, unit: Column) -> Column:
    factor = text.lookup(F.lower(unit), vocab.MASS_TO_MG).cast("decimal(10,3)")
    return (amount.cast("decimal(20,9)") * factor).cast("decimal(30,9)")


MASS = r"((?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))\s*(mcg|mg|g)"


def resolve_components(requests: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Household-side resolution: exact product, else one ingredient with one equal mass strength.

    ``requests``: request_id, medication. ``concepts``: rxcui, concept_name, tty. ``relations``:
    rxcui, related_rxcui. Anything ambiguous stays unverified.
    """
    key = lambda c: _token_key(text.search_text(c))
    named = concepts.select("rxcui", "concept_name", "tty", key(F.col("concept_name")).alias("_key"))
    # A key shared by several concepts is ambiguous; only single ones may match.
    unique = named.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct("rxcui", "concept_name", "tty")).alias("hit")
    ).where("_n = 1").select("_key", "hit")
    asked = requests.withColumn("_key", key(F.col("medication")))
    exact = asked.join(unique, "_key", "left").select("request_id", "medication", "hit")

    pattern = rf"(?i)^([A-Za-z][A-Za-z -]*?)\s+{MASS}$"
    trimmed = F.trim("medication")
    loose = exact.where("hit IS NULL").where(trimmed.rlike(pattern)).select(
        "request_id",
        key(F.regexp_extract(trimmed, pattern, 1)).alias("_key"),
        milligrams(F.regexp_extract(trimmed, pattern, 2), F.regexp_extract(trimmed, pattern, 3)).alias("mg"),
    )
    base = loose.join(unique, "_key").where(F.col("hit.tty").isin("BN", "IN")).select(
        "request_id", "mg",
        F.col("hit.rxcui").alias("rxcui"),
        F.when(F.col("hit.tty") == "BN", "SBDC").otherwise("SCDC").alias("want"),
    )
    plain = rf"(?i)^[^0-9/\[\]]+\s+{MASS}(?:\s+\[[^\]]+\])?$"
    strengths = concepts.where(F.col("tty").isin("SBDC", "SCDC") & F.col("concept_name").rlike(plain)).select(
        F.col("rxcui").alias("related_rxcui"),
        F.struct("rxcui", "concept_name", "tty").alias("part"),
        milligrams(F.regexp_extract("concept_name", plain, 1), F.regexp_extract("concept_name", plain, 2)).alias("part_mg"),
    )
    parts = (
        base.join(relations, "rxcui")
        .join(strengths, "related_rxcui")
        .where((F.col("part.tty") == F.col("want")) & (F.col("part_mg") == F.col("mg")))
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("part").alias("part"))
        .where("_n = 1")
    )
    matched = exact.join(parts.select("request_id", "part"), "request_id", "left").select(
        "request_id", F.coalesce("hit", "part").alias("m")
    ).where(F.col("m.tty").isin("SCD", "SBD", "SCDC", "SBDC"))

    # A brand goes to its generic only when there is exactly one.
    kinds = concepts.select(F.col("rxcui").alias("related_rxcui"), F.struct("rxcui", "concept_name", "tty").alias("g"))
    want = F.when(F.col("m.tty") == "SBD", "SCD").otherwise("SCDC")
    generic = (
        matched.where(F.col("m.tty").isin("SBD", "SBDC"))
        .join(relations, F.col("m.rxcui") == F.col("rxcui"))
        .join(kinds, "related_rxcui")
        .where(F.col("g.tty") == want)
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("g").alias("g"))
        .where("_n = 1")
        .select("request_id", "g")
    )
    final = matched.join(generic, "request_id", "left").select(
        "request_id",
        F.col("m.rxcui").alias("matched_rxcui"),
        F.when(F.col("m.tty").isin("SBD", "SBDC"), F.col("g")).otherwise(F.col("m")).alias("p"),
    ).where("p IS NOT NULL")
    return requests.join(final, "request_id", "left").select(
        "request_id",
        F.coalesce("p.concept_name", "medication").alias("name"),
        F.col("p.rxcui").alias("rxcui"),
        F.when(F.col("p").isNotNull(), F.col("matched_rxcui")).alias("matched_rxcui"),
        F.when(F.col("p.tty") == "SCDC", "ingredient_strength").when(F.col("p").isNotNull(), "product").alias("scope"),
        F.when(F.col("p").isNotNull(), "verified").otherwise("unverified").alias("status"),
    )


def with_components(medications: DataFrame, components: DataFrame) -> DataFrame:
    """Identities with their ordered components; the status of an unkeyed one is ``legacy``.

    Components number one per ingredient, so the array of an identity is short.
    """
    fields = [c for c in components.columns if c not in ("medication_id", "sequence")]
    nested = components.groupBy("medication_id").agg(
        F.sort_array(F.collect_list(F.struct("sequence", *fields))).alias("components")
    )
    return medications.join(nested, "medication_id", "left").withColumn(
        "normalization_status", F.coalesce("normalization_status", F.lit("legacy"))
    )
