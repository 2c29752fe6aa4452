"""Registered queries of the listing engine and their SQL.

The tables in hand hold no property listings, so the extractors run over text
that both sides compose from table columns and a list of phrases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.operators import listing, tables
from listforge.operators import pages as P
from listforge.plans import rules

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Phrases that, drawn by part key, make up a listing's text.
PHRASES = (
    "Departamento en venta en Palermo, Capital Federal", "3 ambientes y 2 dormitorios", "Casa de 4 dorms. con jardin", "1 bathroom, 2 cocheras", "superficie total 120 m2", "85,5 m2 cubierta", "expensas $ 45.000", "a estrenar", "en pozo", "monoambiente luminoso",
    "piso 7 al contrafrente", "parrilla y pileta", "orientacion: norte", "dueno directo", "inmobiliaria local", "3 cuadras del mar", "20 anos de antiguedad", "ascensor, balcon, seguridad 24 hs", "oficina reciclado", "penthouse con terraza", "acepta permuta", "2.5 rooms", "PH duplex", "ARS 90.000.000",
)


def listing_text(seed: str) -> Column:
    pick = lambda mult, add: F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col(seed) * mult + add, F.lit(len(PHRASES))) + 1).cast("int"))
    money = F.when(F.col(seed) % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("USD "), (F.col(seed) * 997 + 15000).cast("string")))
    return F.concat_ws(" ", pick(1, 0), money, pick(7, 3), pick(5, 11), pick(11, 2))


_LIST = "[" + ", ".join(map(quoted, PHRASES)) + "]"
_N = len(PHRASES)
TEXT_SQL = "(select p_partkey as k, " + "concat_ws(' ', " + f"{_LIST}[((p_partkey*1+0)%{_N})+1], case when p_partkey%5=0 then '' else 'USD '||cast(p_partkey*997+15000 as varchar) end, {_LIST}[((p_partkey*7+3)%{_N})+1], {_LIST}[((p_partkey*5+11)%{_N})+1], {_LIST}[((p_partkey*11+2)%{_N})+1]) as text from part)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tables.spread(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k")
    return keys.select("k", listing_text("k").alias("text"))


def rx(c: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({c}, {quoted(pattern)}, {group}, '{flags}'), '')"


def case_sql(c: str, ordered: tuple) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, {quoted(p)}, 'i') then {quoted(v)}" for p, v in ordered) + " else '' end"


def number_sql(c: str) -> str:
    m = f"nullif(regexp_extract({c}, '(-?[0-9][0-9.,]*)', 1), '')"
    return f"try_cast(case when contains({m}, ',') and contains({m}, '.') then replace(replace({m}, '.', ''), ',', '.') else replace({m}, ',', '.') end as double)"


def int_sql(c: str) -> str:
    return f"try_cast(round_even({number_sql(c)}, 0) as bigint)"


def price_sql(c: str) -> str:
    return f"try_cast(regexp_replace(nullif(regexp_extract({c}, '([0-9][0-9.,]*)', 1), ''), '[^0-9]', '', 'g') as bigint)"


def bucket_sql(c: str, limits: tuple) -> str:
    return f"case when {c} is null then '' " + " ".join(f"when {c} <= {u} then {quoted(v)}" for u, v in limits) + f" else {quoted(limits[-1][1])} end"


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), ';[^/]*$', '')"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
NORMAL_SQL = f"case when lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) in ('http','https') then lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {_HOST} || {_PATH} || case when regexp_matches({_QUERY}, '(^|[^\\p{{L}}\\p{{N}}_])(page|pagina|pag|offset)=', 'i') then '?' || {_QUERY} else '' end else '' end"
_END = "(?:$|[/?#])"
ID_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(url, '{p}{_END}', 1), '')" for p in ("--([0-9]{6,})", "-inmuebles-([0-9]{6,})", "/([0-9]{6,})", r"-([0-9]{6,})\.html")) + ", '')"


@query(f"select page_id, {NORMAL_SQL} as url, {_HOST} as host, regexp_replace({_HOST}, '^www\\.', '') as plain_host, {ID_SQL} as listing_id from pages")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", S.normalize_url(u).alias("url"), S.host(u).alias("host"), S.comparable_host(u).alias("plain_host"), S.listing_id(u).alias("listing_id"))


def _text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gis')"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'gs')"
    for name, char in P.ENTITIES:
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}\\x{{0085}}]+', ' ', 'g'))"


_TITLE = "trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\\s+', ' ', 'g'))"
_BLOCK = "|".join(rules.BLOCKED)


@query(f"with p as (select page_id, {NORMAL_SQL} as url, {_TITLE} as title, {_text_sql('html')} as text from pages) select page_id, url, title, length(text) as text_chars, sha256(text) as text_sha256, regexp_matches(substring(text, 1, 2000), {quoted(_BLOCK)}, 'i') as blocked from p qualify row_number() over (partition by url order by page_id) = 1")
def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url"), P.native_title(F.col("html")).alias("title"), P.native_text(F.col("html")).alias("text"))
    rows = rows.select("page_id", "url", "title", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"), S.is_blocked(F.col("text")).alias("blocked"))
    return tables.keep_first(rows, ["url"], ["page_id"])


_LINKS = r"""unnest(regexp_extract_all(html, '(?:href|src|data-href|data-url|data-link|data-src)\s*=\s*["'']([^"'']*)["'']', 1, 'i'))"""


@query(f"select page_id, link, count(*) as n from (select page_id, {_LINKS} as link from pages) where starts_with(link, '/') group by page_id, link")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = t(spark, sf_dir, "pages").select("page_id", F.explode(P.native_links(F.col("html"))).alias("link"))
    return links.filter(F.startswith("link", F.lit("/"))).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"with l as (select distinct regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link as url from (select url, {_LINKS} as link from pages) where starts_with(link, '/')) select url from l where url not in (select url from pages where url is not null)")
def frontier_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "pages")
    links = pages.select("url", F.explode(P.native_links(F.col("html"))).alias("link")).filter(F.startswith("link", F.lit("/")))
    return tables.unseen(links.select(F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), "link").alias("url")).distinct(), pages)


_SEEDS = " union all ".join(f"select {quoted('https://www.' + s['domain_key'])} || {quoted(p)} as seed, {quoted(s['name'])} as site, {i} as pos" for s in rules.SITES for i, p in enumerate(s["sale_paths"]))


@query(_SEEDS)
def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = spark.createDataFrame([(f"https://www.{s['domain_key']}/",) for s in rules.SITES] + [("https://elsewhere.example/",)], "url string")
    return tables.seeds(bases).select("seed", "site", "pos")


@query("select doc_id, lang, source, n_chars from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedupe_exact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_first(t(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


@query("select doc_id, lang, source, n_chars from documents qualify row_number() over (partition by source, lang, n_chars order by doc_id) = 1")
def dedupe_fallback_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_first(t(spark, sf_dir, "documents"), ["source", "lang", "n_chars"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


_NUM = "case o_orderkey % 4 when 0 then 'USD ' || cast(o_orderkey as varchar) || '.000' when 1 then '-' || cast(o_orderkey % 977 as varchar) || ',5' when 2 then cast(o_orderkey % 31 as varchar) || '.' || cast(o_custkey as varchar) || ',25 m2' else 'x ' || o_orderpriority end"


@query(f"select o_orderkey, {number_sql(_NUM)} as number, {int_sql(_NUM)} as whole, {price_sql(_NUM)} as price, try_cast(replace(nullif(regexp_extract(replace({_NUM}, ' ', ''), '(-?[0-9][0-9.]*)', 1), ''), '.', '') as bigint) as thousands, try_cast(nullif(regexp_extract({_NUM}, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as decimal_value from orders")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("USD "), k.cast("string"), F.lit(".000"))).when(k % 4 == 1, F.concat(F.lit("-"), (k % 977).cast("string"), F.lit(",5"))).when(k % 4 == 2, F.concat((k % 31).cast("string"), F.lit("."), F.col("o_custkey").cast("string"), F.lit(",25 m2"))).otherwise(F.concat(F.lit("x "), F.col("o_orderpriority")))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    x = F.col("text")
    return rows.select("o_orderkey", S.parse_number(x).alias("number"), S.parse_int(x).alias("whole"), S.parse_price(x).alias("price"), S.parse_thousands(x).alias("thousands"), S.parse_decimal(x).alias("decimal_value"))


_CUR = "case o_orderkey % 6 when 0 then 'USD' when 1 then 'U$S' when 2 then '$' when 3 then 'ARS' when 4 then 'UYU' else '$U' end"
_COUNTRY = "case when n_regionkey < 2 then 'AR' else 'UY' end"


@query(f"with o as (select o_orderkey, cast(floor(o_totalprice) as bigint) as amount, {_CUR} as currency, {_COUNTRY} as country from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) select o_orderkey, amount, currency, country, case when currency in ('USD','U$S') then amount when currency in ('ARS','$') and country='AR' then cast(round_even(amount/1500.0::double,0) as bigint) when currency in ('UYU','$U','$') and country='UY' then cast(round_even(amount/40.0::double,0) as bigint) else amount end as usd from o")
def currency_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    currency = F.when(k == 0, "USD").when(k == 1, "U$S").when(k == 2, "$").when(k == 3, "ARS").when(k == 4, "UYU").otherwise("$U")
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("amount"), currency.alias("currency"), F.when(F.col("n_regionkey") < 2, "AR").otherwise("UY").alias("country"))
    return rows.withColumn("usd", S.to_usd(F.col("amount"), F.col("currency"), F.col("country")))


def _price_case(i: int) -> str:
    p, c = rules.PRICES[i]
    amount = price_sql(rx("text", p))
    rest = _price_case(i + 1) if i + 1 < len(rules.PRICES) else "null"
    return f"case when {amount} > 0 then {{'amount': {amount}, 'currency': {quoted(c)}}} else {rest} end"


@query(f"with x as (select k, text, {_price_case(0)} as p from {TEXT_SQL}) select k, p.amount as price_original, p.currency as price_currency, case when p.currency in ('ARS', '$') then cast(round_even(p.amount/1500.0::double, 0) as bigint) else p.amount end as price_usd from x where p is not null")
def price_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    x = F.col("text")
    rows = texts(spark, sf_dir).select("k", S.pinned(S.let(S.folded(x), lambda low: listing.price(x, none, none, F.lit("AR"), low))).alias("p")).filter("p is not null")
    return rows.select("k", F.col("p.original").alias("price_original"), F.col("p.currency").alias("price_currency"), F.col("p.usd").alias("price_usd"))


def _counts_sql() -> str:
    cols = [f"{int_sql('coalesce(' + ', '.join(rx('text', p) for p in ps) + ')')} as {c}" for c, ps in rules.COUNTS.items()]
    any_ = r"(\d+(?:[.,]\d+)?)\s*(?:m2|m²|mts2|metros)"
    for c, labels in rules.AREAS.items():
        ls = "|".join(labels)
        area = int_sql("coalesce(" + rx("text", rf"(?:{ls})[^\d]{{0,25}}{any_}") + ", " + rx("text", rf"{any_}[^\n.]{{0,25}}(?:{ls})") + ")")
        cols.append((f"case when coalesce({area}, 0) <> 0 then {area} else coalesce({int_sql(rx('text', any_))}, {area}) end" if c == "covered_area_sqm" else area) + f" as {c}")
    return ", ".join(cols)


@query(f"select k, {_counts_sql()} from {TEXT_SQL}")
def counts_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.counts_and_areas(texts(spark, sf_dir)).drop("text")


@query(f"select k, {case_sql('text', rules.PROPERTY_TYPES)} as property_type, {case_sql('text', rules.SUBTYPES)} as property_subtype, {case_sql('text', rules.STAGES)} as construction_stage, {case_sql('text', rules.PUBLICATIONS)} as publication_type, upper({rx('text', 'orientaci[oó]n[^a-zA-Z0-9_]{0,10}(norte|sur|este|oeste|ne|no|se|so|n|s|e|o)')}) as orientation, {int_sql('coalesce(' + rx('text', 'distancia\\s+al\\s+mar[^0-9]{0,20}([0-9]+)') + ', ' + rx('text', '([0-9]+)\\s*cuadras?\\s+(?:del|al)\\s+mar') + ')')} as distance_to_sea_blocks from {TEXT_SQL}")
def types_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return texts(spark, sf_dir).select("k", S.case_of(x, rules.PROPERTY_TYPES).alias("property_type"), S.case_of(x, rules.SUBTYPES).alias("property_subtype"), S.case_of(x, rules.STAGES).alias("construction_stage"), S.case_of(x, rules.PUBLICATIONS).alias("publication_type"), listing.orientation(x).alias("orientation"), listing.distance_to_sea(x).alias("distance_to_sea_blocks"))


@query("select k, " + ", ".join(f"cast(regexp_matches(text, {quoted(p)}, 'i') as int) as {c}" for c, p in rules.FLAG_PATTERNS.items()) + f" from {TEXT_SQL}")
def flags_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("k", listing.flag_array(F.col("text"), S.folded(F.col("text"))).alias("found"))
    return found.select("k", *[F.get("found", F.lit(i)).alias(c) for i, c in enumerate(rules.FLAG_PATTERNS)])


_COUNTED = [c for c in rules.FLAG_PATTERNS if c.startswith("has_") and c not in rules.NOT_COUNTED]


@query("select k, " + " + ".join(f"cast(regexp_matches(text, {quoted(rules.FLAG_PATTERNS[c])}, 'i') as int)" for c in _COUNTED) + f" as amenity_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as words from {TEXT_SQL}")
def flag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return texts(spark, sf_dir).select("k", S.let(S.folded(x), lambda low: sum((S.matches(x, rules.FLAG_PATTERNS[c], low).cast("int") for c in _COUNTED), F.lit(0))).alias("amenity_count"), S.word_runs(x).cast("long").alias("words"))


_AREA, _AGE, _FLOOR, _BED = "cast(l_quantity * 60 as bigint)", "cast(l_suppkey * 3 as bigint)", "cast(l_linenumber * 2 - 2 as bigint)", "cast(l_partkey % 14 as bigint)"


@query(f"with b as (select l_orderkey, l_linenumber, case when {_AREA} between 0 and 2000 then {_AREA} end as area, case when {_AGE} between 0 and 250 then {_AGE} end as age, {_FLOOR} as floor_no, case when {_BED} between 0 and 10 then {_BED} end as beds from lineitem) select l_orderkey, l_linenumber, area, age, beds, {bucket_sql('area', rules.AREA_BUCKETS)} as area_bucket, {bucket_sql('age', rules.AGE_BUCKETS)} as age_bucket, {bucket_sql('floor_no', rules.FLOOR_BUCKETS)} as floor_bucket, case when beds is null then '' when beds <= 1 then '02_one_bedroom' when beds = 2 then '03_two_bedroom' when beds = 3 then '04_three_bedroom' else '05_four_plus_bedroom' end as room_bucket, cast(area is not null as int) + cast(age is not null as int) + cast(beds is not null as int) + 1 as core_feature_count, round_even(area::double / (beds + 1), 2) as area_per_room_sqm, round_even(beds::double / l_linenumber, 2) as bedrooms_per_bathroom from b")
def outliers_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's bounds and derived columns over numbers of line items."""
    q = lambda x: F.col(x).cast("bigint")
    own = {"covered_area_sqm": (F.col("l_quantity") * 60).cast("bigint"), "age_years": q("l_suppkey") * 3, "floor_number": q("l_linenumber") * 2 - 2, "bedrooms": q("l_partkey") % 14, "bathrooms": q("l_linenumber")}
    blank = {c: F.lit(None).cast("bigint") for c in ("total_area_sqm", "total_rooms", "parking_spaces")} | {c: F.lit("") for c in ("property_subtype", "title", "description", "country", "province", "city", "neighborhood")}
    rows = listing.derived(listing.bounded(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in (own | blank).items()])))
    return rows.select("l_orderkey", "l_linenumber", F.col("covered_area_sqm").alias("area"), F.col("age_years").alias("age"), F.col("bedrooms").alias("beds"), "area_bucket", "age_bucket", "floor_bucket", "room_bucket", "core_feature_count", "area_per_room_sqm", "bedrooms_per_bathroom")


@query("select c_custkey, concat_ws(' | ', nullif(r_name, ''), nullif(n_name, ''), nullif(c_mktsegment, '')) as location_key from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def location_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations, 5 regions
    return rows.select("c_custkey", listing.location_key(F.col("r_name"), F.col("n_name"), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("location_key"))


@query("with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,12}'))) as w from documents) select 'has_' || w as \"column\", count(*) as n from w group by 1 having count(*) >= 2")
def amenity_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})"), 1))
    return tables.support(t(spark, sf_dir, "documents").select(F.transform(words, lambda w: F.concat(F.lit("has_"), w)).alias("flags")))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.json_first(t(spark, sf_dir, "events").select("event_id", "props"), "props", "k").select("event_id", F.nullif("found", F.lit("")).alias("k"))


@query("select page_id, url, null::bigint as doc_id, null::varchar as lang from pages union all select null, null, doc_id, lang from documents")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.union_sources(t(spark, sf_dir, "pages").select("page_id", "url"), t(spark, sf_dir, "documents").select("doc_id", "lang"))


@query(f"select page_id, {_HOST} as host, row_number() over (partition by {_HOST} order by page_id) as rank from pages qualify rank <= 3")
def top_pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select("page_id", S.host(F.col("url")).alias("host"))
    return tables.top_per(rows, "host", ["page_id"], 3)


@query(f"select {_HOST} as host, count(*) as pages, count(distinct {NORMAL_SQL}) as urls, sum(cast(regexp_matches({_TITLE}, '.') as int)) as titled from pages group by 1")
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select(S.host(F.col("url")).alias("host"), S.normalize_url(F.col("url")).alias("url"), (P.native_title(F.col("html")) != "").cast("int").alias("titled"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"), F.sum("titled").alias("titled"))


_NORM = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"select doc_id, {_NORM} as norm_key, length(trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{0085}}]+', ' ', 'g'))) as clean_chars from documents")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", S.norm_key(F.col("text")).alias("norm_key"), F.length(S.clean_text(F.col("text"))).cast("long").alias("clean_chars"))


_EXPENSES = (r"(?:expensas|gastos\s+comunes)[^\d$U]{0,30}(U\$S|US\$|USD|ARS|AR\$|UYU|\$U|\$)?\s*([\d.,]+)", r"(U\$S|US\$|USD|ARS|AR\$|UYU|\$U|\$)?\s*([\d.,]+)\s*(?:de\s*)?(?:expensas|gastos\s+comunes)")


def usd_sql(amount: str, currency: str) -> str:
    """Of a page from AR."""
    c = f"replace(replace(upper({currency}), 'U$S', 'USD'), 'US$', 'USD')"
    return f"case when {c} in ('ARS', 'AR$', '$') then cast(round_even({amount}/1500.0::double, 0) as bigint) else {amount} end"


def _expenses_sql(i: int) -> str:
    amount, currency = price_sql(rx("text", _EXPENSES[i], 2)), f"upper(coalesce({rx('text', _EXPENSES[i])}, '$'))"
    usd = usd_sql(amount, currency)
    rest = _expenses_sql(i + 1) if i + 1 < len(_EXPENSES) else "null"
    return f"case when {amount} >= 100 and not ({amount} is not distinct from original or {usd} is not distinct from dollars) then {{'original': {amount}, 'currency': {currency}, 'usd': {usd}}} else {rest} end"


@query(
    f"with x as (select k, text, {_price_case(0)} as p from {TEXT_SQL}), y as (select k, text, p.amount as original, {usd_sql('p.amount', 'p.currency')} as dollars from x), "
    f"z as (select k, {_expenses_sql(0)} as e from y) select k, e.original as expenses_original, e.currency as expenses_currency, e.usd as expenses_usd from z where e is not null"
)
def expenses_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, none = F.col("text"), F.lit(None).cast("string")
    rows = texts(spark, sf_dir).withColumn("low", S.folded(x)).withColumn("p", S.pinned(S.let(F.col("low"), lambda low: listing.price(x, none, none, F.lit("AR"), low))))
    rows = rows.select("k", S.pinned(S.let(F.col("low"), lambda low: listing.expenses(x, F.lit("AR"), F.col("p.original"), F.col("p.usd"), low))).alias("e")).filter("e is not null")
    return rows.select("k", *[F.col(f"e.{c}").alias(f"expenses_{c}") for c in ("original", "currency", "usd")])


_MD = "(select p_partkey as k, '### Servicios' || chr(10) || '* ' || p_type || chr(10) || '*  ' || p_name || ' ' || chr(10) || case when p_partkey % 3 = 0 then '' else '### Ambientes' || chr(10) || '* ' || p_brand || chr(10) end || '### Fin' as md from part)"
_BULLETS = r"list_filter(list_transform(regexp_extract_all({}, '\*\s+([^\n*]+?)\s*(?:\n|$)', 1), lambda x: trim(x)), lambda x: x <> '')"


def _section_sql(name: str) -> str:
    return rf"regexp_extract(md, '###\s*{name}(.+?)(?:###|\z)', 1, 'si')"


@query(f"select k, array_to_string({_BULLETS.format(_section_sql('Servicios'))}, '|') as services, array_to_string({_BULLETS.format(_section_sql('Ambientes'))}, '|') as rooms, cast(len({_BULLETS.format('md')}) as int) as bullets from {_MD}")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda *x: F.concat(*x, F.lit("\n"))
    rooms = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(line(F.lit("### Ambientes\n* "), F.col("p_brand")))
    md = F.concat(line(F.lit("### Servicios")), line(F.lit("* "), F.col("p_type")), line(F.lit("*  "), F.col("p_name"), F.lit(" ")), rooms, F.lit("### Fin"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), md.alias("md"))
    listed = lambda c: F.array_join(S.bullets(c), "|")
    return rows.select("k", listed(S.section(F.col("md"), "Servicios")).alias("services"), listed(S.section(F.col("md"), "Ambientes")).alias("rooms"), F.size(S.bullets(F.col("md"))).alias("bullets"))


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read with the HTML parser; no SQL form."""
    rows = P.parse_html(t(spark, sf_dir, "pages"))
    return rows.select("page_id", F.col("page.title").alias("title"), F.sha2("page.text", 256).alias("text_sha256"), F.size("page.links").alias("links"))


Q["parsed_pages"] = parsed_pages


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """norm_key of whole documents; DuckDB has no compatibility forms, so no SQL: tests hold it against brute force."""
    return t(spark, sf_dir, "documents").select("doc_id", S.norm_key(F.col("text")).alias("norm_key"))


Q["norm_keys"] = norm_keys


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide listing extraction over composed texts; its parts have SQL, the whole is held against goldens in tests."""
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    rows = texts(spark, sf_dir).select(F.col("k").alias("crawl_seq"), F.concat(F.lit("https://www.argenprop.com/departamento-en-venta--"), (F.col("k") + 1000000).cast("string")).alias("url"), F.lit("argenprop").alias("site"), F.lit("AR").alias("country"), "text", F.substring("text", 1, 60).alias("title"), F.lit("").alias("description"), F.lit("2026-01-01T00:00:00+00:00").alias("scraped_at"), *none(*[f"json_{c}" for c in P.FACTS]))
    return tables.dedupe_listings(listing.extract(rows)).drop("crawl_seq")


Q["listing_rows"] = listing_rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
