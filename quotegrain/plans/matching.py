"""Name matching between lists, always by an equi join on a key or word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.functions import text
from quotegrain.operators import ordered, paging


def scope_by_name(listings: DataFrame, entries: DataFrame) -> DataFrame:
    """Listings of ``listings``(label_id, drug_name) whose known drug has the key of some reference entry: (label_id, entry_key)."""
    keys = entries.select(text.drug_key(F.col("entry")).alias("entry_key")).where("entry_key <> ''").distinct()
    return listings.select("label_id", text.drug_key(F.col("drug_name")).alias("entry_key")).join(keys, "entry_key").select("label_id", "entry_key")


def in_scope(listings: DataFrame, entries: DataFrame) -> DataFrame:
    """(label_id, by): listings in the reference list, by the name of their drug if it is known and listed, else by their label."""
    named = scope_by_name(listings.where("drug_name IS NOT NULL"), entries).select("label_id", F.lit("name").alias("by"))
    labelled = scope_filter(listings.select("label_id", "label"), entries).select("label_id", F.lit("label").alias("by"))
    return named.unionByName(labelled.join(named, "label_id", "left_anti"))


def scope_filter(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Labels that hold every ingredient of some reference entry as whole words.

    ``labels``: label_id, label. ``entries``: entry. Labels explode into short word runs that meet the
    ingredients by equality. Only lengths that some ingredient has are made, so a long label gives few runs.
    """
    keys = entries.select(text.drug_key(F.col("entry")).alias("key")).where("key <> ''").distinct()
    parts = keys.select(text.key_parts(F.col("key")).alias("parts"))
    wanted = parts.select(
        F.array_join("parts", ";").alias("entry_key"), F.size(F.array_distinct("parts")).alias("need"),
        F.explode(F.array_distinct("parts")).alias("part"),
    )
    sizes = wanted.select(F.size(F.split("part", " ")).alias("size")).distinct()
    lengths = sizes.agg(F.sort_array(F.collect_list("size")).alias("sizes")).scalar()
    split = labels.select("label_id", text.label_words(F.col("label")).alias("words"), lengths.alias("sizes"))
    words = split.select("label_id", F.explode(text.word_runs(F.col("words"), F.col("sizes"))).alias("part"))
    return (
        words.join(wanted, "part")
        .groupBy("label_id", "entry_key", "need")
        .agg(F.count(F.lit(1)).alias("have"))
        .where("have = need")
        .groupBy("label_id")
        .agg(F.min("entry_key").alias("entry_key"), F.count(F.lit(1)).alias("entries"))
    )


def best_name_match(results: DataFrame) -> DataFrame:
    """Per search: a result with the same key, else the first that contains or is contained.

    ``results``: search_id, target, seq, drug_name.
    """
    # The same pairs of names come back in many searches, so each distinct pair is cleaned and judged once and met by its hash.
    pair = F.sha2(F.concat_ws("\x00", F.coalesce("target", F.lit("")), F.coalesce("drug_name", F.lit(""))), 256)
    keyed = results.select("target", "drug_name", pair.alias("pair")).dropDuplicates(["pair"]).select(
        "pair", text.search_key(F.col("target")).alias("target_key"), text.search_key(F.col("drug_name")).alias("result_key"))
    keyed = keyed.select("*", text.key_parts(F.col("target_key")).alias("target_parts"), text.key_parts(F.col("result_key")).alias("result_parts"))
    inside = F.forall("result_parts", lambda p: F.contains(F.col("target_key"), p)) | F.forall(
        "target_parts", lambda p: F.contains(F.col("result_key"), p)
    )
    judged = keyed.select("pair", F.when(F.col("result_key") == F.col("target_key"), 0).when(inside, 1).alias("rank")).where("rank IS NOT NULL")
    ranked = results.withColumn("pair", pair).join(judged, "pair")
    return ordered.earliest(ranked, ["search_id"], ["rank", "seq", "drug_name"], ["drug_name", "rank", "seq"])


def unique_links(products: DataFrame) -> DataFrame:
    """(name, strength) keys that lead to exactly one URL."""
    keyed = products.select(
        text.link_name(F.col("name")).alias("name_key"), text.link_strength(F.col("strength")).alias("strength_key"), "url"
    )
    return keyed.groupBy("name_key", "strength_key").agg(
        F.min("url").alias("url"), F.max("url").alias("_other")
    ).where("url = _other").drop("_other")


def link_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    keyed = lines.withColumns(
        {
            "name_key": text.link_name_with_form(F.col("rx_name"), F.col("rx_form")),
            "strength_key": text.link_strength(F.col("rx_strength")),
        }
    ).where("name_key <> '' AND strength_key <> ''")
    return keyed.join(unique_links(products), ["name_key", "strength_key"]).drop("name_key", "strength_key")


def _runs(column: Column, *sizes: int) -> Column:
    """Distinct runs of so many characters; a text shorter than that has none of them."""
    def of(n):
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(column) - (n - 1), F.lit(1))), lambda i: i + n - 1 <= F.length(column)), lambda i: F.substr(column, i, F.lit(n)))

    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def scored_search(catalog: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Best ``top`` catalogue rows per query by match kind, then name, then id.

    Distinct names and brands are listed under their runs of one to three characters. A query is looked up on the rarest of its own runs of three, on
    itself if it is shorter, so the list it meets is the shortest that can hold its matches, and a query with a run that no text has
    meets nothing. Equal queries are answered once. The full test follows. Rows of one name and brand score alike, so a query meets only the
    first ``top`` of them; the rank limit is applied before the last shuffle too.
    """
    texts = catalog.select(
        "medication_id", "name", text.catalog_text(F.col("name")).alias("n"),
        text.catalog_text(F.coalesce("brand_name", F.lit(""))).alias("b"),
    )
    distinct = texts.select("n", "b").distinct()
    listed = distinct.select("n", "b", F.explode(F.array_distinct(F.concat(_runs(F.col("n"), 1, 2, 3), _runs(F.col("b"), 1, 2, 3)))).alias("run"))
    lengths = listed.groupBy("run").agg(F.count(F.lit(1)).alias("length"))
    asked = queries.select("query_id", text.catalog_text(F.col("query")).alias("q")).where("q <> ''")
    own = F.when(F.length("q") < 3, F.array("q")).otherwise(_runs(F.col("q"), 3))
    met = asked.select("q").distinct().select("q", F.size(own).alias("need"), F.explode(own).alias("run")).join(lengths, "run")
    rarest = met.groupBy("q", "need").agg(F.min_by("run", F.struct("length", "run")).alias("run"), F.count(F.lit(1)).alias("have")).where("have = need")
    score = paging.search_score(F.col("n"), F.col("b"), F.col("q"))
    scored = rarest.select("q", "run").join(listed, "run").withColumn("score", score).where("score IS NOT NULL")
    alike = Window.partitionBy("n", "b").orderBy("name", "medication_id")
    first = texts.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= top).drop("_nth")
    hits = scored.select("q", "n", "b", "score").join(first, ["n", "b"])
    order = Window.partitionBy("q").orderBy("score", "name", "medication_id")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return asked.join(best, "q").select("query_id", "medication_id", "name", "score", "place")


def first_n_distinct(rows: DataFrame, group: str, key: str, position: str, most: int) -> DataFrame:
    """Distinct keys per group in first-seen order; those past ``most`` are marked, not dropped."""
    seen = rows.groupBy(group, key).agg(F.min(position).alias("first_seen"))
    order = Window.partitionBy(group).orderBy("first_seen", key)
    chosen = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return seen.join(chosen.select(group, key, "place"), [group, key], "left").withColumn(
        "status", F.when(F.col("place").isNull(), "skipped_limit").otherwise("selected")
    )
