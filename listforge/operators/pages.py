"""Page operators: visible text, title, meta tags, JSON blocks, links, classes, raw records.

``native_*`` are expressions for plain pages; ``parse_html`` reads any page
with an HTML parser in one Arrow pass and returns all of it as one struct.
"""

from __future__ import annotations

import html as html_lib
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.plans import rules

LINK_ATTRIBUTES = ("href", "src", "data-href", "data-url", "data-link", "data-src")
ENTITIES = (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def native_text(html: Column) -> Column:
    """Visible text: comments, script, style and noscript go, tags part words, common entities are read."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return S.clean_text(out)


def native_title(html: Column) -> Column:
    return S.clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def native_links(html: Column) -> Column:
    """Values of the link attributes, in page order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:href|src|data-href|data-url|data-link|data-src)\s*=\s*["']([^"']*)["']"""), 1)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.title = ""
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.blocks: list[str] = []
        self.inside: list[str] = []
        self.json = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        self.links += [own[a] for a in LINK_ATTRIBUTES if a in own]
        if tag == "meta":
            for kind in ("property", "name"):
                key = f"{kind}:{own.get(kind)}"
                if own.get(kind) and key not in self.meta:
                    self.meta[key] = " ".join(own.get("content", "").split())
        if tag in ("script", "style", "noscript", "title"):
            self.inside.append(tag)
            kind = own.get("type", "").lower()
            self.json = tag == "script" and ("ld+json" in kind or "json" in kind)

    def handle_endtag(self, tag: str) -> None:
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()
            self.json = False

    def handle_data(self, data: str) -> None:
        where = self.inside[-1] if self.inside else ""
        if where == "script" and self.json:
            self.blocks.append(data)
        if where not in ("script", "style", "noscript"):
            self.words.append(data)
        if where == "title" and not self.title:
            self.title = " ".join(data.split())


def json_pairs(blocks: list[Any]) -> list[tuple[str, Any]]:
    """(key, value) of every mapping in the blocks: outer mappings first, in document order. Depth is no matter."""
    found: list[tuple[str, Any]] = []
    waiting = [blocks]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            found.extend((str(k), v) for k, v in node.items())
        waiting.extend(reversed(list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []))
    return found


def json_values(pairs: list[tuple[str, Any]], *keys: str) -> list[Any]:
    """All values under any of the keys, whatever their case."""
    wanted = frozenset(map(str.lower, keys))
    return [v for k, v in pairs if k.lower() in wanted]


def json_scalar(pairs: list[tuple[str, Any]], *keys: str) -> str:
    """The first of these values that is a text or number and not blank."""
    plain = (" ".join(str(v).split()) for v in json_values(pairs, *keys) if isinstance(v, (str, int, float)))
    return next(filter(None, plain), "")


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def json_first(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """df with ``found``: the first scalar under any of the keys in its JSON column, empty if there is none."""
    at, names = df.columns.index(column), [*df.columns, "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json_scalar(json_pairs([_parsed(x or "")]), *keys) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names)

    return df.mapInArrow(run, f"{_fields(df)}, found string")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: Facts of a place, by the mapping that holds them.
PLACES = {"address": {"street": "streetAddress", "city": "addressLocality", "province": "addressRegion", "neighborhood": "addressSuburb"}, "geo": {"latitude": "latitude", "longitude": "longitude"}}


def _place(pairs: list[tuple[str, Any]]) -> dict[str, str]:
    """Facts of the first address and of the first geo, blank or not."""
    out: dict[str, str] = {}
    for holder, facts in PLACES.items():
        held = next((v for k, v in pairs if k == holder and isinstance(v, dict)), {})
        out |= {name: " ".join(str(held[key]).split()) for name, key in facts.items() if held.get(key) is not None}
    return out


FACTS = ("price", "currency", "name", "about", "street", "city", "province", "neighborhood", "latitude", "longitude")
PARSED = "struct<text:string,title:string,meta:map<string,string>,links:array<string>," + ",".join(f"json_{c}:string" for c in FACTS) + ">"


def facts_of(html: str | None) -> dict[str, Any] | None:
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    pairs = json_pairs([x for x in map(_parsed, page.blocks) if x is not None])
    out = {"text": " ".join(" ".join(page.words).split()), "title": page.title, "meta": list(page.meta.items()), "links": page.links}
    found = _place(pairs)
    for name, keys in {"price": ("price", "lowPrice", "highPrice"), "currency": ("priceCurrency", "currency"), "name": ("name", "headline"), "about": ("description",)}.items():
        found[name] = json_scalar(pairs, *keys)
    return out | {f"json_{c}": found.get(c) or None for c in FACTS}


def parse_html(pages: DataFrame) -> DataFrame:
    """pages with ``page``: everything that is read from its html, in one pass."""
    names = [*pages.columns, "page"]
    kind = pa.struct([("text", pa.string()), ("title", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string())), *[(f"json_{c}", pa.string()) for c in FACTS]])
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([facts_of(x) for x in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    return pages.mapInArrow(run, f"{_fields(pages)}, page {PARSED}")


def meta(*keys: str) -> Column:
    """First non-empty content: for each name the property, then the name."""
    tries = [F.nullif(F.try_element_at("page.meta", F.lit(f"{kind}:{k}")), F.lit("")) for k in keys for kind in ("property", "name")]
    return F.coalesce(*tries)


def described(pages: DataFrame) -> DataFrame:
    """Parsed pages with text, title and description, each from the first place that has one, and the json_* facts."""
    named = {"text": F.coalesce("page.text", F.lit("")), "title": F.coalesce(meta("og:title", "twitter:title"), F.nullif("page.title", F.lit("")), F.col("page.json_name"), F.lit(""))}
    named["description"] = F.coalesce(meta("og:description", "description", "twitter:description"), F.col("page.json_about"), F.lit(""))
    return pages.withColumns(named | {f"json_{c}": F.col(f"page.json_{c}") for c in FACTS})


def tidy_links(links: Column) -> Column:
    """Absolute, root-relative and dot-relative links of an array, without what often clings to them."""

    def tidy(x: Column) -> Column:
        for name, char in ENTITIES:
            x = F.replace(x, F.lit(name), F.lit(char))
        x = F.regexp_replace(F.replace(x, F.lit("\\/"), F.lit("/")), r"(?U)^\s+|\s+$", "")
        return F.btrim(x, F.lit("\"'()[]{}<>.,;"))

    # Trimming takes leading dots too: './x' and '../x' come out as '/x'.
    return F.array_distinct(F.filter(F.transform(links, tidy), lambda x: x.rlike(r"^(https?://|/)") & ~x.rlike(r"(?U)\s")))


def discovered(pages: DataFrame) -> DataFrame:
    """url, link: distinct same-site links of parsed pages, normalised; also those that only stand in scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            absolute = [[urljoin(base, html_lib.unescape(x)) for x in links or ()] for base, links in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(absolute, pa.list_(pa.string()))], ["url", "links"])

    plain = F.replace(F.replace(F.col("html"), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    raw = F.concat(F.regexp_extract_all(plain, F.lit(r"(https?://[^\"'<>\s)]+)"), 1), F.regexp_extract_all(plain, F.lit(r"""(?i)["'](/[^"'<>]*?(?:venta|inmuebles)[^"'<>]*?)["']"""), 1))
    links = tidy_links(F.concat("page.links", F.coalesce(raw, F.array())))
    found = pages.filter("url is not null").select("url", links.alias("links")).mapInArrow(run, "url string, links array<string>")
    out = found.select("url", F.explode("links").alias("link")).select("url", S.normalize_url(F.col("link")).alias("link"))
    return out.filter((F.col("link") != "") & S.same_domain(F.col("link"), F.col("url"))).distinct()


def page_class() -> Column:
    """empty, blocked, http_error, detail or search, in this order of precedence. Needs html, text, status_code, is_detail."""
    return F.when(F.col("html").isNull(), "empty").when(S.is_blocked(F.col("text")), "blocked").when(F.coalesce(F.col("status_code"), F.lit(0)) >= 400, "http_error").when(F.col("is_detail"), "detail").otherwise("search")


def raw_record(row: Column) -> list[Column]:
    return [F.col("url"), F.col("status_code"), F.sha2("text", 256).alias("text_sha256"), F.substring("text", 1, rules.RAW_TEXT_CHARS).alias("text"), row.alias("extracted_row")]
