"""Literal cases for text, money, URL, strength and capture expressions."""

import pytest
from pyspark.sql import functions as F

from quotegrain.functions import hashing, money, text, urls
from quotegrain.plans import capture, identity


def run(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_money(spark):
    assert run(spark, ["$1,234.50", "5.6", "7", "1.234", "1.230", "-3", "1e3", "", "$"], money.cents) == [
        123450, 560, 700, None, 123, None, None, None, None,
    ]
    assert run(spark, ["1.234", "-3", "2.50"], money.cents_reason) == ["non_cent_total", "invalid_money", None]
    assert run(spark, [5, 1234, 100], money.dollars, "long") == ["$0.05", "$12.34", "$1.00"]


def test_quantity(spark):
    canonical = lambda c: money.quantity_text(money.quantity(c))
    assert run(spark, ["30", "30.0", "0.50", "007", "0", "1e3", "1000000", "1000001", "-1", "1.1234567", "100"], canonical) == [
        "30", "30", "0.5", "7", None, None, "1000000", None, None, None, "100",
    ]


def test_search_text_folds_before_it_strips(spark):
    # The trademark sign becomes letters first; only the registered sign is really removed.
    assert run(spark, ["Zestril® 20MG", "Drug™ X", "10mg/5mL", "５ ｍｇ", "A--B"], text.search_text) == [
        "zestril 20 mg", "drugtm x", "10 mg / 5 ml", "5 mg", "a b",
    ]
    once = run(spark, ["Zestril® 20MG/5 mL"], text.search_text)[0]
    assert run(spark, [once], text.search_text) == [once]


def test_keys(spark):
    assert run(spark, ["Benazepril; Amlodipine 10 mg", "Metformin ER tablets", "", "A & B"], text.drug_key) == [
        "amlodipine;benazepril", "metformin", "", "a ; b",
    ]
    assert run(spark, ["Metformin Extended-Release (ER)", "Lisinopril"], text.link_name) == ["metformin er", "lisinopril"]
    assert run(spark, ["hello wORLD"], text.title_case) == ["Hello WORLD"]
    assert run(spark, ["CVS -- Pharmacy!"], text.slug) == ["cvs-pharmacy"]
    assert run(spark, ["ab", " abc ", "a\u0001bc"], text.valid_actor) == [False, True, False]


def test_forms(spark):
    form = lambda c: text.form_code(text.alias_key(c))
    assert run(spark, ["Tabs", "chewable tablets", "Oral Solution", "ER tablet film", "kit", "nasal sprays"], form) == [
        "tablet", "tablet", "solution", "tablet", None, "spray",
    ]


def test_strength(spark):
    shown = lambda c: identity.parse_strength(c)["display"]
    assert run(
        spark, ["20MG", "10 mg / mL", "100U/ml", "0.4%", "0 mg", "100-25 mg", "100 mg/25 mg", "5 mg/5 mL", "2.50 g", "5 stones"], shown
    ) == ["20 mg", "10 mg/mL", "100 units/mL", "0.4%", None, None, None, "5 mg/5 mL", "2.5 g", None]
    key = lambda c: identity.parse_strength(c)["key"]
    assert run(spark, ["20MG", "10 mg/mL"], key) == ["20:mg::", "10:mg:1:ml"]


def test_route_is_found_inside_words(spark):
    route = lambda c: identity.inferred_route(text.ascii_search_text(c), F.lit("cream"))
    assert run(spark, ["hypnotic cream", "plain cream"], route) == ["otic", None]


SITE = urls.Site(
    hosts=["www.shop.example", "shop.example"], host="www.shop.example", private_paths=["/cart"], scope_paths=None
)


@pytest.mark.parametrize(
    "raw, want, reason",
    [
        ("http://shop.example:8080/a?utm_source=x&b=1#top", "https://www.shop.example/a?b=1", None),
        ("https://SHOP.example", "https://www.shop.example/", None),
        ("https://shop.example/Cart/1", "https://www.shop.example/Cart/1", "private_or_transactional"),
        ("https://shop.example/cartoon", "https://www.shop.example/cartoon", None),
        ("https://shop.example/a/../b/./c.PNG", "https://www.shop.example/b/c.PNG", "asset"),
        ("https://me@shop.example/", None, None),
        ("https://other.example/", None, None),
        ("mailto:a@shop.example", None, None),
        ("https://shop.example/x?gclid=1", "https://www.shop.example/x", None),
    ],
)
def test_canonical_url(spark, raw, want, reason):
    got = run(spark, [raw], lambda c: urls.canonical(c, SITE))[0]
    assert (got and got["url"], got and got["reason"]) == (want, reason)


def test_resolve(spark):
    base = F.lit("https://shop.example/dir/page?x=1")
    assert run(spark, ["/a", "b", "?q=2", "//cdn.example/z", "javascript:void(0)", "http://h.example/"], lambda c: urls.resolve(c, base)) == [
        "https://shop.example/a", "https://shop.example/dir/b", "https://shop.example/dir/page?q=2",
        "https://cdn.example/z", None, "http://h.example/",
    ]


def test_first_party(spark):
    good = lambda c: urls.first_party(c, "cvs.example")
    assert run(spark, ["https://www.cvs.example/a", "http://cvs.example/", "https://evil-cvs.example/", "https://cvs.example:8/", "x"], good) == [
        True, False, False, False, False,
    ]


def test_titles_and_packages(spark):
    got = run(spark, ["Lisinopril (Zestril) 20mg ER Oral Tablets", "A 10-25 mg tablet", "Heartgard 68 mcg chewable tablet for dogs"], lambda c: capture.title_identity(c, F.lit(None).cast("string")))
    assert (got[0]["name"], got[0]["strength"], got[0]["form"], got[0]["route"], got[0]["release_type"]) == ("Lisinopril", "20mg", "tablet", "Oral", "ER")
    assert got[1] is None and got[2]["species"] == ["dog"]
    packs = run(spark, ["X tablets, 90 Count", "Y 10 ml vial", "Z 5mg tablet", "W cream"], lambda c: capture.package(c, F.lit("tablet")))
    assert [tuple(p) for p in packs] == [("pack", "90", "tablet"), ("vial", "10", "ml"), ("tablet", "1", "tablet"), ("tablet", "1", "tablet")]


def test_cash_price(spark):
    got = run(spark, ["Cash price: $1,012.50 for 30 tablets", "price $5", "cash price $3.99 / 5 mL"], capture.cash_price)
    assert [g and tuple(g) for g in got] == [(101250, "30", "tablet"), None, (399, "5", "ml")]


def test_canonical_json(spark):
    assert run(spark, ['{"b":1,"a":{"d":2,"c":[1, 2]}}', "nope", None], hashing.canonical_json) == ['{"a":{"c":[1,2],"d":2},"b":1}', None, None]


def test_json_ld_products():
    graph = {"@graph": [{"@type": ["Thing", "Product"], "sku": "1"}, {"@type": "Offer"}]}
    assert [x.get("@type") for x in capture.flatten_json_ld([graph, [{"@type": "Product"}]])] == [
        None, ["Thing", "Product"], "Offer", "Product",
    ]


def test_page_snapshot(spark):
    html = (
        '<html><head><title>T &amp; U</title><script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"S1","name":"N"}]}</script>'
        "<script>var x = '<a href=\"/no\">';</script></head><body><h1> One </h1><a href='/a'>a</a><a href=\"/a\">b</a><main>Hello\n  there</main></body></html>"
    )
    row = capture.page_snapshots(spark.createDataFrame([(1, "https://x.example/", html)], "page_id long, url string, html string")).first()
    assert (row["title"], row["h1"], row["links"], row["panel"]) == ("T & U", ["One"], ["https://x.example/a"], "Hello there")
    assert '"sku": "S1"' in row["product"] and row["reason"] is None


def test_page_snapshot_parts(spark):
    html = (
        "<title>T</title><article>left out</article><main><p>SKU: S1</p><div>Count <b>5</b></div><button aria-label='Select quantity 30' aria-pressed='true'> 30 </button>"
        "<a href='../y'>y</a><a href='/é b'>z</a><a href='http://[bad'>n</a></main>"
    )
    rows = [(1, "https://x.example/a/b/c", html), (2, "https://x.example/", "<p>text</p>"), (3, None, None), (4, "https://x.example/", "<title>t</title>" + '<script type="application/ld+json">' + "[" * 5000)]
    got = {r["page_id"]: r for r in capture.page_snapshots(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["links"] == ["https://x.example/a/y", "https://x.example/%C3%A9%20b"] and got[1]["panel"] == "SKU: S1\nCount 5\n30\nyzn"
    assert got[1]["buttons"][0].asDict() == {"text": "30", "label": "Select quantity 30", "pressed": "true"}
    assert [got[k]["reason"] for k in (1, 2, 3, 4)] == [None, "empty_or_non_html_page", "empty_or_non_html_page", None] and got[4]["product"] is None


PANEL = """Generic Alternative:
Lisinopril 20MG TABS
Mfr.
Lupin
30 Tablets
$33.35
90 Tablets
$41.10
Brand Name:
Zestril 20MG TABS
Mfr.
Almatica
30 Tablets
$402.00"""


def test_panel(spark):
    blocks = capture.panel_blocks(spark.createDataFrame([(1, PANEL)], "page_id long, panel string"))
    rows = {r["label"]: r for r in blocks.collect()}
    generic = rows["Generic Alternative"]
    assert (generic["parsed"]["name"], generic["parsed"]["strength"], generic["manufacturer"]) == ("Lisinopril", "20MG", "Lupin")
    assert [(o["quantity"], o["unit"], o["price_cents"]) for o in generic["offers"]] == [("30", "tablet", 3335), ("90", "tablet", 4110)]
    review = spark.createDataFrame([(1, "lisinopril", "20 mg", "tablet")], "page_id long, name string, strength string, form string")
    assert capture.panel_listings(blocks, review).first()["reason"] is None
    assert capture.panel_listings(blocks, review.limit(0)).first()["reason"] == "review_required"


def test_deep_json_is_passed_over(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = spark.createDataFrame([(1, deep), (2, '{"b":1,"a":2}'), (3, "x")], "id long, text string")
    got = {r["id"]: r["j"] for r in rows.select("id", hashing.canonical_json(F.col("text")).alias("j")).collect()}
    assert got == {1: None, 2: '{"a":2,"b":1}', 3: None}
    nested = [{"@type": "Product", "name": "x"}]
    for _ in range(5000):
        nested = [nested]
    assert len(capture.flatten_json_ld(nested)) == 1


def test_json_paths_merges_metadata(spark, tmp_path):
    """the query also merges what is stored of an event with what is new, as its SQL did at first."""
    import __spark_entry__ as entry

    rows = [(1, "click", '{"k": 7}'), (2, "error", '{"k": 8}'), (3, None, '{"k": 9}')]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["json_paths"](spark, str(tmp_path))
    got = {r["event_id"]: (r["k"], r["canonical"], r["merged"]) for r in found.collect()}
    assert got == {1: (7, '{"a":"click","k":7}', "kind=click,note=new"), 2: (8, '{"a":"error","k":8}', "kind=error,note=new"), 3: (9, None, None)}
    assert "merged" in entry.oracle_sql()["json_paths"]
