"""Raw captures to observations: pages, links, panels, catalogue quotes, validation."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quotegrain.functions import money, text, urls, vocab
from quotegrain.functions.hashing import sha256_text

# Words and formats of the captured pages, which readers must know as they are written there.
UNITS = ["mcg", "µg", "μg", "ug", "mg", "g", "u", "units?", "iu", "meq", "%"]
RELEASES = ["extended release", "delayed release", "immediate release", "ER", "XR", "XL", "SR", "DR", "EC"]
ROUTES = ["oral", "topical", "ophthalmic", "otic", "nasal", "inhalation", "rectal", "vaginal", "subcutaneous", "intramuscular", "intravenous", "transdermal"]
SPECIES = {"dog": ["dogs?", "canine"], "cat": ["cats?", "feline"]}
CONTAINERS = ["bottle", "vial", "tube"]
SOLIDS = ["tablet", "capsule"]
PER = ["ml", "l", "g", "tablet", "capsule", "dose"]
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
STRENGTH = rf"(?i)\b{NUMBER}\s*(?:{'|'.join(UNITS)})(?:\s*/\s*(?:{NUMBER}\s*)?(?:{'|'.join(PER)}))?"
# Two amounts before one unit, or one amount per another that is no volume or weight.
COMBINED = rf"(?i)\b{NUMBER}\s*(?:[-–/]\s*{NUMBER}\s*(?:{'|'.join(UNITS)})|(?:{'|'.join(UNITS)})\s*/\s*{NUMBER}\s*(?:{'|'.join(u for u in UNITS if u != 'g')}))"
VOLUME = rf"(?i)(?:^|[\s-])({NUMBER})\s*(ml|g)\s*(?:{'|'.join(CONTAINERS)}|$)"
PACK = r"(?i)(?:\b|,\s*)([0-9]+)\s*(?:Count|ct)\b"
PANEL_SKU = r"SKU:\s*([^\n]+)"
PANEL_SELECTED = rf"Selected quantity:\s*({NUMBER})"
PANEL_TOTAL = r"Total price updated to \$([0-9,.]+)"
PANEL_UNIT = r"Count\s*•\s*([^\n/$]+)\s*/"
BUTTON_QUANTITY = r"^Select quantity ([0-9.]+)"
CASH = r"(?i)cash price\s*[:\-]?\s*\$([0-9,]+\.[0-9]{2})\s*(?:for|/)\s*([0-9]+(?:\.[0-9]+)?)\s*(tablets?|capsules?|milliliters?|ml)\b"
AMOUNT = r"[0-9]+(?:\.[0-9]+)?(?:-[0-9]+(?:\.[0-9]+)?)?\s*(?:mg|mcg|g|gm|ml|%)(?:/[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|g|gm|ml))?"
ROW_NAME = rf"(?i)^(.+?)\s+({AMOUNT})\s+([A-Za-z]+)(?:\s+(.+))?$"
LABEL = "(?:Generic Alternative|Brand Name):"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def unescape(column: Column) -> Column:
    """The entities that occur inside links."""
    out = column
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def page_links(pages: DataFrame, site: urls.Site, same_host: bool = False) -> DataFrame:
    """Distinct canonical links per page, natively: (page_id, page_url, url, reason)."""
    found = pages.select(
        "page_id",
        F.col("url").alias("page_url"),
        F.explode(F.array_distinct(F.concat(
            F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), F.regexp_extract_all("html", F.lit(HREF), F.lit(2))
        ))).alias("href"),
    ).where("href <> ''")
    absolute = urls.resolve(unescape(F.col("href")), F.col("page_url"))
    own = F.col("page_url") if same_host else None
    linked = found.withColumn("link", urls.canonical(absolute, site, own)).where("link IS NOT NULL")
    return linked.select("page_id", "page_url", "link.*").dropDuplicates(["page_id", "url"])


def page_kind(url: Column, path: Column, has_product: Column, has_next: Column, product_paths: list[str], origin: str):
    return (
        F.when(has_product | path.isin(product_paths), "product")
        .when(
            has_next | url.endswith("/sitemap") | path.rlike(r"/medications/(categories/.*)?$") | (url == origin + "/"),
            "directory",
        )
        .when(url.rlike("privacy|terms|shipping|policy|hipaa"), "policy")
        .otherwise("content")
    )


def page_loops(states: DataFrame) -> DataFrame:
    """Pages whose pagination shows the same state twice. ``states``: page_id, state, range_text, links."""
    print_of = sha256_text(F.concat_ws("\n", F.coalesce("range_text", F.lit("")), F.array_join("links", "\n")))
    marked = states.select("page_id", print_of.alias("fingerprint"))
    return marked.groupBy("page_id", "fingerprint").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")


# Fixed values of HTML: elements that begin and end a line of shown text.
LINES = frozenset("address article aside blockquote br button dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Reader(HTMLParser):
    """Title, headings, links, buttons, main text and JSON-LD of one page."""

    SKIP = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.links, self.main, self.json_ld, self.buttons = [], [], [], [], [], []
        self.open: list[str] = []
        self.typed = False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"])
        if tag == "h1":
            self.h1.append("")
        if tag == "button":
            self.buttons.append(["", attrs.get("aria-label") or "", attrs.get("aria-pressed")])
        if tag == "script":
            self.typed = attrs.get("type") == "application/ld+json"
            if self.typed:
                self.json_ld.append("")
        if tag in LINES and "main" in self.open:
            self.main.append("\n")
        if tag in ("title", "h1", "main", "button", *self.SKIP):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in LINES and "main" in self.open:
            self.main.append("\n")
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "script" in self.open:
            if self.typed and self.json_ld:
                self.json_ld[-1] += data
            return
        if "style" in self.open:
            return
        if "title" in self.open:
            self.title.append(data)
        if "h1" in self.open and self.h1:
            self.h1[-1] += data
        if "button" in self.open and self.buttons:
            self.buttons[-1][0] += data
        if "main" in self.open:
            self.main.append(re.sub(r"\s+", " ", data))

    def panel(self) -> str:
        """Shown text of the main element, one line per block, blanks folded."""
        lines = (" ".join(line.split()) for line in "".join(self.main).split("\n"))
        return "\n".join(line for line in lines if line)


def _absolute(href: str, base: str) -> str | None:
    """Absolute link with other characters than a URL's own percent-coded; null when it cannot be read."""
    try:
        return quote(urljoin(base, href.strip()), safe="!#$%&'()*+,/:;=?@[\\]^_{|}~-.")
    except ValueError:
        return None


def flatten_json_ld(value) -> list[dict]:
    """Objects of lists and graphs, in document order, on a stack, so depth does not matter."""
    found, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            todo += reversed(item)
        elif isinstance(item, dict):
            found.append(item)
            todo.append(item.get("@graph"))
    return found


def _product(blocks: list[str]):
    """The one Product of a page, else None."""
    products = []
    for block in blocks:
        try:
            found = flatten_json_ld(json.loads(block))
        except (ValueError, RecursionError):  # no JSON, or nested deeper than the reader goes
            continue
        for item in found:
            kind = item.get("@type")
            if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                products.append(item)
    if len(products) != 1:
        return None
    keep = {k: products[0][k] for k in ("name", "sku", "brand", "offers", "productID") if k in products[0]}
    if "offers" in keep and not isinstance(keep["offers"], list):
        keep["offers"] = [keep["offers"]]
    return json.dumps(keep, ensure_ascii=False)


BUTTON = pa.struct([("text", pa.string()), ("label", pa.string()), ("pressed", pa.string())])
SNAPSHOT = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("h1", pa.list_(pa.string())), ("links", pa.list_(pa.string())),
    ("panel", pa.string()), ("buttons", pa.list_(BUTTON)), ("product", pa.string()), ("reason", pa.string()),
])


def snapshot(page_id, url: str | None, html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    title, panel = "".join(reader.title), reader.panel()
    links = (_absolute(href, url or "") for href in reader.links)
    return {
        "page_id": page_id, "url": url, "title": title, "h1": [h.strip() for h in reader.h1], "links": list(dict.fromkeys(x for x in links if x)),
        "panel": panel, "buttons": [{"text": t.strip(), "label": label, "pressed": pressed} for t, label, pressed in reader.buttons],
        "product": _product(reader.json_ld), "reason": None if title or panel else "empty_or_non_html_page",
    }


def page_snapshots(pages: DataFrame) -> DataFrame:
    """Parse whole pages with the standard HTML parser, in Arrow batches. A page without title and main text has a reason."""

    def parse(batches):
        for batch in batches:
            rows = [snapshot(*r) for r in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=SNAPSHOT)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, from_arrow_schema(SNAPSHOT))


PRODUCT = (
    "name string, sku string, offers array<struct<price:string,priceCurrency:string,availability:string,eligibleQuantity:struct<value:string>>>"
)


def offer_snapshots(snapshots: DataFrame) -> DataFrame:
    """Page snapshots in the shape that ``product_offers`` reads."""
    product = F.from_json("product", PRODUCT)
    rows = snapshots.where("reason IS NULL").select("page_id", "panel", product.alias("p"), F.col("buttons.label").alias("button_labels"))
    offers = F.transform(
        F.coalesce("p.offers", F.array().cast("array<struct<price:string,priceCurrency:string,availability:string,eligibleQuantity:struct<value:string>>>")),
        lambda o: F.struct(o["eligibleQuantity"]["value"].alias("quantity"), o["price"].alias("price"), o["priceCurrency"].alias("currency"), o["availability"].alias("availability")),
    )
    return rows.select("page_id", "p.sku", "p.name", "panel", "button_labels", offers.alias("offers"))


def review_overlay(base: DataFrame, reviews: DataFrame, key: str, plain: list[str], nullable: list[str]) -> DataFrame:
    """Reviewed fields over parsed ones. ``nullable`` fields honour an explicit null, told by ``has_<field>``."""
    r = reviews.select(key, F.lit(True).alias("_reviewed"), *[F.col(c).alias(f"_r_{c}") for c in plain + nullable],
                       *[f"has_{c}" for c in nullable], F.col("metadata").alias("_r_metadata"))
    joined = base.join(r, key, "left")
    merged = F.map_concat(
        F.map_filter("metadata", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("_r_metadata"), k), F.lit(False))),
        F.coalesce("_r_metadata", F.create_map().cast("map<string,string>")),
    )
    taken = {c: F.coalesce(f"_r_{c}", c) for c in plain}
    taken |= {c: F.when(F.coalesce(f"has_{c}", F.lit(False)), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in nullable}
    return joined.withColumns({**taken, "metadata": merged}).select(*base.columns)


def observation_reasons(observations: DataFrame) -> DataFrame:
    """Add ``reasons``: every rule an observation breaks, empty when it may be ingested.

    Offer keys are compared inside the row: the array is one observation's own tiers.
    """
    def parsed(q):
        quantity = money.quantity(q["quantity"])
        return F.struct(
            quantity.isNull().alias("invalid_quantity"),
            (q["price_cents"].isNotNull() & ~q["price_cents"].rlike("^[0-9]+$")).alias("invalid_cents"),
            (F.coalesce(q["currency"], F.lit("")) != "USD").alias("invalid_currency"),
            ((q["availability"] == "in_stock") & q["price_cents"].isNull()).alias("missing_price"),
            # A struct, since a joined text would take a null part and its neighbour for each other.
            F.struct(quantity.alias("quantity"), q["seller_key"], q["location_key"], q["program_key"], q["currency"]).alias("key"),
        )

    staged = observations.withColumn("_o", F.transform("offers", parsed))
    any_offer = lambda name: F.when(F.exists("_o", lambda q: F.coalesce(q[name], F.lit(False))), F.lit(name))
    keys = F.col("_o.key")
    checks = [
        F.when((F.coalesce("source_product_key", F.lit("")) == "") | (F.coalesce("source_name", F.lit("")) == ""), F.lit("missing_identity")),
        F.when(F.col("observed_at").isNull(), F.lit("invalid_observation_time")),
        F.when(F.size("_o") == 0, F.lit("no_offers")),
        *[any_offer(name) for name in ("invalid_quantity", "invalid_cents", "invalid_currency", "missing_price")],
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("duplicate_quantity_context")),
    ]
    return staged.withColumn("reasons", F.array_compact(F.array(*checks))).drop("_o")


def title_identity(title: Column, brand: Column) -> Column:
    """Identity candidate from a product title; null for combinations or when strength, form or name is missing.

    The first strength splits the title: what stands before it, less remarks in brackets and release words, is the name.
    """
    word = lambda words: F.regexp_extract(title, rf"(?i)\b({'|'.join(words)})\b", 1)
    given = lambda c: F.when(c != "", c)
    strength = F.regexp_extract(title, STRENGTH, 0)
    ahead = F.split(title, STRENGTH, 2)[0]
    name = F.trim(F.regexp_replace(F.regexp_replace(ahead, rf"(?i)\([^)]*\)|\b(?:{'|'.join(RELEASES)})\b", " "), r"\s+", " "))
    species = F.array_compact(F.array(*[F.when(word(words) != "", F.lit(animal)) for animal, words in SPECIES.items()]))
    candidate = F.struct(
        name.alias("name"), strength.alias("strength"), text.form_code(text.alias_key(title)).alias("form"), given(word(ROUTES)).alias("route"),
        given(word(RELEASES)).alias("release_type"), brand.alias("brand_name"), F.slice(species, 1, 1).alias("species"),
    )
    complete = lambda c: F.when((c["strength"] != "") & (c["name"] != "") & c["form"].isNotNull(), c)
    return F.when(~title.rlike(COMBINED), text.bind(candidate, complete))


def package(title: Column, unit: Column) -> Column:
    """Struct(sold_as, content_quantity, content_unit): the first that fits of a volume, a counted pack, a loose unit, the bare unit."""
    shape = lambda sold, quantity, content: F.struct(
        sold.alias("sold_as"), quantity.cast("string").alias("content_quantity"), content.cast("string").alias("content_unit"))
    part = lambda pattern, group: F.regexp_extract(title, pattern, group)
    container = F.coalesce(*[F.when(F.contains(F.lower(title), F.lit(c)), F.lit(c)) for c in CONTAINERS[1:]], F.lit(CONTAINERS[0]))
    solid = F.lower(part(rf"(?i)({'|'.join(reversed(SOLIDS))})s?", 1))
    has_capsule = F.contains(F.lower(title), F.lit(SOLIDS[1]))
    return F.coalesce(
        F.when(part(VOLUME, 0) != "", shape(container, part(VOLUME, 1), F.lower(part(VOLUME, 2)))),
        F.when((part(PACK, 0) != "") & (solid != ""), shape(F.lit("pack"), part(PACK, 1), F.when(has_capsule, F.lit(SOLIDS[1])).otherwise(F.lit(SOLIDS[0])))),
        F.when((part(PACK, 0) == "") & unit.isin(*SOLIDS), shape(unit, F.lit("1"), unit)),
        shape(unit, F.lit(None), F.lit(None)),
    )


def stock(value: Column) -> Column:
    return F.when(value.rlike("(?:OutOfStock|SoldOut|Discontinued)$"), "out_of_stock").when(
        value.rlike("InStock$"), "in_stock"
    ).otherwise("unknown")


def panel_form(word: Column) -> Column:
    w = F.lower(F.trim(word))
    return F.coalesce(text.lookup(w, vocab.PANEL_FORMS), F.regexp_replace(w, "s$", ""))




def row_name(value: Column) -> Column:
    """Struct(name, strength, form, suffix) of "name strength form suffix", null when it does not parse."""
    c = F.trim(F.regexp_replace(value, r"\s+", " "))
    strength = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, ROW_NAME, 2), r"(?i)\bgm\b", "g"), r"\s+", " "))
    suffix = F.trim(F.regexp_extract(c, ROW_NAME, 4))
    return F.when(
        c.rlike(ROW_NAME),
        F.struct(
            F.trim(F.regexp_extract(c, ROW_NAME, 1)).alias("name"),
            strength.alias("strength"),
            panel_form(F.regexp_extract(c, ROW_NAME, 3)).alias("form"),
            F.when(suffix != "", suffix).alias("suffix"),
        ),
    )




def panel_blocks(panels: DataFrame) -> DataFrame:
    """Price panel text to one row per label block with its tiers.

    ``panels``: page_id, panel. A panel is the text of one page, so its lines are handled in the row.
    """
    lines = F.filter(F.transform(F.split(F.replace(F.col("panel"), F.lit("\u00a0"), F.lit(" ")), r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(lines, "\n")
    blocks = F.filter(F.split(body, rf"(?m)(?i)(?=^{LABEL}$)"), lambda b: b.rlike(rf"(?i)^{LABEL}\n"))
    rows = panels.select("page_id", F.posexplode(blocks).alias("block", "body"))
    tier = r"(?m)^([0-9]+(?:\.[0-9]+)?)\s+([A-Za-z]+)\n(\$?[0-9,]+(?:\.[0-9]{2})?)$"
    listed = F.regexp_replace("body", r"(?i)\nMfr\.\n[^\n]*", "\nMfr.")
    groups = [F.regexp_extract_all(listed, F.lit(tier), F.lit(i)) for i in (1, 2, 3)]
    tiers = F.transform(
        F.arrays_zip(groups[0].alias("q"), groups[1].alias("u"), groups[2].alias("p")),
        lambda z: F.struct(
            money.quantity_text(money.quantity(z["q"])).alias("quantity"),
            panel_form(z["u"]).alias("unit"),
            money.cents(z["p"]).alias("price_cents"),
        ),
    )
    maker = F.regexp_extract("body", r"(?i)\nMfr\.\n([^\n]*)", 1)
    name = F.regexp_extract("body", rf"(?i)^{LABEL}\n([^\n]*)", 1)
    return rows.select(
        "page_id",
        "block",
        F.when(F.col("body").rlike("(?i)^Brand"), "Brand Name").otherwise("Generic Alternative").alias("label"),
        name.alias("source_name"),
        row_name(name).alias("parsed"),
        F.when(maker != "", maker).alias("manufacturer"),
        tiers.alias("offers"),
    )


def panel_listings(blocks: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per page: the only block matching its reviewed identity, or the reason there is none.

    ``reviews``: page_id, name, strength, form (no row means no review).
    """
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    bare = lambda c: F.regexp_replace(squeeze(c), " ", "")
    r = reviews.select("page_id", F.struct("name", "strength", "form").alias("review"))
    joined = blocks.join(r, "page_id", "left")
    same = (
        (squeeze(F.col("parsed.name")) == squeeze(F.col("review.name")))
        & (bare(F.col("parsed.strength")) == bare(F.col("review.strength")))
        & (squeeze(F.col("parsed.form")) == squeeze(F.col("review.form")))
    )
    fits = F.when(F.col("review").isNull(), True).otherwise(F.coalesce(same, F.lit(False)))
    units = F.array_distinct(F.transform("offers", lambda o: o["unit"]))
    row = F.struct("label", "source_name", "parsed", "manufacturer", "offers", units.alias("units"))
    judged = joined.groupBy("page_id").agg(
        F.count_if(fits).alias("matches"), F.bool_or(F.col("review").isNotNull()).alias("reviewed"),
        F.min_by(row, F.when(fits, F.col("block"))).alias("row"),
    )
    reason = (
        F.when(F.col("matches") != 1, F.when(F.col("reviewed"), "ambiguous_review_match").otherwise("review_required"))
        .when(F.col("row.parsed").isNull(), "unparsed_product_name")
        .when(F.size("row.offers") == 0, "no_offers")
        .when(F.size("row.units") > 1, "mixed_quantity_units")
    )
    return judged.select("page_id", reason.alias("reason"), F.when(reason.isNull(), F.col("row")).alias("row"))


def product_offers(snapshots: DataFrame) -> DataFrame:
    """Product page snapshots to listing and tiers, or a reason.

    ``snapshots``: page_id, sku, name, panel, button_labels, offers array<quantity, price, currency, availability>.
    """
    panel_sku = F.trim(F.regexp_extract("panel", PANEL_SKU, 1))
    selected = F.regexp_extract("panel", PANEL_SELECTED, 1)
    total = F.regexp_extract("panel", PANEL_TOTAL, 1)
    unit = F.lower(F.trim(F.regexp_extract("panel", PANEL_UNIT, 1)))
    choices = F.transform("button_labels", lambda b: F.regexp_extract(b, BUTTON_QUANTITY, 1))
    tiers = F.transform(
        F.filter("offers", lambda o: F.array_contains(choices, o["quantity"])),
        lambda o: F.struct(
            money.quantity_text(money.quantity(o["quantity"])).alias("quantity"),
            money.cents(o["price"]).alias("price_cents"),
            o["currency"].alias("currency"),
            stock(o["availability"]).alias("availability"),
        ),
    )
    staged = snapshots.select(
        "page_id", "sku", "name", panel_sku.alias("panel_sku"), selected.alias("selected"), total.alias("total"),
        F.when(unit != "", unit).otherwise("unknown").alias("unit"), tiers.alias("tiers"),
    )
    default = F.exists(
        "tiers",
        lambda t: F.coalesce((t["quantity"] == money.quantity_text(money.quantity(F.col("selected")))) & (t["price_cents"] == money.cents(F.col("total"))), F.lit(False)),
    )
    reason = (
        F.when((F.coalesce("sku", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == ""), "no_product")
        .when(F.col("panel_sku") != F.col("sku"), "sku_mismatch")
        .when(F.size("tiers") == 0, "no_validated_quantities")
        .when(F.exists("tiers", lambda t: t["currency"] != "USD"), "currency_mismatch")
        .when(~default, "default_price_mismatch")
    )
    return staged.withColumns({"reason": reason, "package": package(F.col("name"), F.col("unit"))})


ECHOED = ["medication_name", "strength", "form", "brand_name"]


def catalogue_quotes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requested (ndc, quantity) to its quote: exactly one echo with the identity unchanged.

    ``requests``: ndc, quantity (text), identity fields. ``responses``: ndc, requested_units, requested_quote,
    error_message, identity fields. Stock is not reported, so each quote is an estimate of unknown availability.
    """
    echo = responses.groupBy("ndc", F.col("requested_units").alias("quantity")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.struct("requested_quote", "error_message", *ECHOED)).alias("_r"),
    )
    joined = requests.join(echo, ["ndc", "quantity"], "left")
    changed = F.lit(False)
    for f in ECHOED:
        changed = changed | ~F.coalesce(F.col(f), F.lit("")).eqNullSafe(F.coalesce(F.col(f"_r.{f}"), F.lit("")))
    price = money.cents(F.col("_r.requested_quote"))
    reason = (
        F.when(~F.col("ndc").rlike("^[0-9]{10,11}$"), "invalid_catalogue_identity")
        .when(
            (F.coalesce("_n", F.lit(0)) != 1)
            | (F.coalesce("_r.error_message", F.lit("")) != "")
            | F.col("_r.requested_quote").isNull(),
            "ambiguous_or_missing_quote",
        )
        .when(changed, "quote_identity_mismatch")
        .when(price.isNull(), "invalid_money")
    )
    return joined.select(
        "ndc", "quantity", reason.alias("reason"), F.when(reason.isNull(), price).alias("price_cents"),
        F.lit("unknown").alias("availability"), F.lit("estimate").alias("quote_kind"),
        F.lit("not_provided_by_api").alias("availability_basis"),
    )




def cash_price(page_text: Column) -> Column:
    """Struct(price_cents, physical_quantity, content_unit) of the first cash price beside a quantity."""
    return F.when(
        page_text.rlike(CASH),
        F.struct(
            money.cents(F.regexp_extract(page_text, CASH, 1)).alias("price_cents"),
            F.regexp_extract(page_text, CASH, 2).alias("physical_quantity"),
            F.regexp_replace(F.lower(F.regexp_extract(page_text, CASH, 3)), "s+$", "").alias("content_unit"),
        ),
    )
