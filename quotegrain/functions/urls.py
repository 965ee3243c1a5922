"""URL resolution and canonical form as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegrain.functions.text import bind

# Campaign parameters, asset endings and the longest URL kept without review.
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|msclkid)(=.*)?$"
ASSETS = r"\.(jpg|jpeg|png|webp|gif|svg|ico|css|js|map|woff2?|ttf|pdf|zip|mp4|mp3)$"
MAX_LENGTH = 1800

PARTS = r"^(?i:(https?))://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


@dataclass(frozen=True)
class Site:
    """One source's rules: hosts that belong to it, the host they are written as, closed and allowed paths."""

    hosts: list[str] = field(default_factory=list)
    host: str | None = None
    private_paths: list[str] = field(default_factory=list)
    scope_paths: list[str] | None = None


def split_url(url: Column) -> Column:
    """Struct of scheme, user, host, port, path, query (with ``?``); null unless http or https."""
    authority = F.regexp_extract(url, PARTS, 2)
    parts = F.struct(
        F.lower(F.regexp_extract(url, PARTS, 1)).alias("scheme"),
        F.regexp_extract(authority, "^([^@]*)@", 1).alias("user"),
        F.lower(F.regexp_replace(F.regexp_replace(authority, "^[^@]*@", ""), ":[0-9]*$", "")).alias("host"),
        F.regexp_extract(authority, ":([0-9]+)$", 1).alias("port"),
        F.regexp_extract(url, PARTS, 3).alias("path"),
        F.regexp_extract(url, PARTS, 4).alias("query"),
    )
    return F.when(url.rlike(PARTS), parts)


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    empty = F.array().cast("array<string>")
    last = F.element_at(F.split(path, "/"), -1)

    def step(acc, segment):
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(segment == "..", up).when(segment == ".", acc).otherwise(F.array_append(acc, segment))

    folded = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    tail = F.when(last.isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.contains("/."), F.when(tail == "", "/").otherwise(tail)).otherwise(path)


def _percent(text: Column) -> Column:
    """Percent-encode characters outside ASCII, spaces and quotes; everything else stays."""
    pattern = "[^\\x21-\\x7E]|[\"<>`]"
    encoded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c == " ", "%20").when(c.rlike(pattern), F.url_encode(c)).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(pattern), encoded).otherwise(text)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``; null for other schemes."""
    h = F.trim(href)
    b = split_url(base)

    def absolute(s):
        h, b = s["h"], s["b"]
        origin = F.concat(b["scheme"], F.lit("://"), b["host"], F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise(""))
        path = F.when(b["path"] == "", "/").otherwise(b["path"])
        folder = F.regexp_replace(path, "[^/]*$", "")
        return (
            F.when(h.rlike("^(?i)https?://"), h)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, path, h))
            .when(h.startswith("#") | (h == ""), F.concat(origin, path, b["query"], h))
            .otherwise(F.concat(origin, folder, h))
        )

    return bind(F.struct(h.alias("h"), b.alias("b")), absolute)


def _clean_query(query: Column, drop_best_quantity: bool) -> Column:
    pairs = F.split(F.regexp_replace(query, r"^\?", ""), "&")
    kept = F.filter(
        pairs, lambda p: ~p.rlike(TRACKING) & ((p != "qty=best") if drop_best_quantity else F.lit(True))
    )
    text = F.array_join(kept, "&")
    return F.when((query == "") | (query == "?") | (F.size(kept) == 0) | (text == ""), "").otherwise(
        F.concat(F.lit("?"), text)
    )


def canonical(url: Column, site: Site, same_host_as: Column | None = None, drop_best_quantity: bool = False):
    """Struct(url, reason): https, no port, fragment or campaign parameters.

    Null when the URL does not belong to the site; ``reason`` names why a page of the site is not fetched.
    ``same_host_as`` accepts the host of that URL instead of a host list.
    """
    parts = split_url(url)
    base_host = split_url(same_host_as)["host"] if same_host_as is not None else F.lit(None).cast("string")

    def build(s):
        p, own = s["p"], s["own"]
        allowed = p["host"] == own if same_host_as is not None else p["host"].isin(site.hosts)
        host = F.lit(site.host) if site.host else p["host"]
        path = _percent(_fold_dots(F.when(p["path"] == "", "/").otherwise(p["path"])))
        whole = F.concat(F.lit("https://"), host, path, _percent(_clean_query(p["query"], drop_best_quantity)))
        ok = p.isNotNull() & (p["host"] != "") & (p["user"] == "") & allowed
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(whole.alias("url"), F.lower(path).alias("path")))

    def judged(c):
        return F.when(
            c.isNotNull(), F.struct(c["url"].alias("url"), _reason(c["path"], c["url"], site).alias("reason"))
        )

    return bind(bind(F.struct(parts.alias("p"), base_host.alias("own")), build), judged)


def _under(path: Column, roots: list[str]) -> Column:
    hit = F.lit(False)
    for root in roots:
        hit = hit | (path == root) | path.startswith(root + "/")
    return hit


def _reason(path: Column, url: Column, site: Site) -> Column:
    reason = F.when(_under(path, site.private_paths), "private_or_transactional")
    if site.scope_paths is not None:
        reason = reason.when(~_under(path, site.scope_paths), "out_of_source_scope")
    return reason.when(path.rlike(ASSETS), "asset").when(F.length(url) > MAX_LENGTH, "url_length_requires_review")


def first_party(url: Column, domain: str) -> Column:
    """https, the domain or its www host, and no user or port."""
    p = split_url(url)
    good = (p["scheme"] == "https") & (p["user"] == "") & (p["port"] == "") & p["host"].isin(domain, "www." + domain)
    return F.coalesce(good, F.lit(False))


def query_value(url: Column, *names: str) -> Column:
    """Value of the first named query parameter present."""
    return F.coalesce(*[F.try_parse_url(url, F.lit("QUERY"), F.lit(n)) for n in names])


def encode_component(text: Column) -> Column:
    """Percent-encoding of a component: spaces as %20, and the marks ``!'()*~`` left as they are."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
