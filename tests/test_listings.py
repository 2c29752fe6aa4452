"""Goldens, SQL differentials and properties of the listing engine."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.operators import listing, markdown, pages, tables
from listforge.plans import rules

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "column, cases",
    [
        (S.parse_thousands, {"45.5": 455, "45,5": 45, "1 200": 1200, "-3": -3, ".": None, None: None, "": None}),
        (S.parse_number, {"1.234,5": 1234.5, "110.000": 110.0, "1.234.567": None, "2,5": 2.5, "12.": 12.0, "x": None}),
        (S.parse_int, {"2,5": 2, "3,5": 4, "abc": None}),
        (S.parse_price, {"110.000": 110000, "110000.0": 1100000, "": None, "gratis": None}),
        (S.floor_number, {"pb": 0, "5": 5, "": None, " Planta Baja ": 0}),
        (S.norm_key, {"Cañería / Gas": "caneria_gas", None: "", "  ": ""}),
        (lambda c: S.amenity_column(c), {"bano": None, "pileta": "has_pool", "foo": "has_foo", "piso_3": None, "": None}),
        (S.normalize_url, {"http://A.com//x?page=2&r=1#t": "http://a.com/x?page=2&r=1", "http://a.com/x?utm=1": "http://a.com/x", "ftp://x": "", "": ""}),
        (S.listing_id, {"https://a/b--123456": "123456", "https://a/b--12345": "", "https://a/1234567?x": "1234567", "https://a/x-1234567.html": "1234567"}),
        (S.title_from_slug, {"punta-carretas-2": "Punta Carretas", "": ""}),
        (S.clean_location_part, {" Palermo. ": "Palermo", "x" * 71: "", "edificio nuevo": ""}),
        (S.clean_text, {"  a   b\n": "a b", None: ""}),
    ],
)
def test_scalar_goldens(spark, column, cases):
    assert values(spark, list(cases), column) == list(cases.values())


def test_currency_buckets_ratio(spark):
    rows = spark.createDataFrame([(3750, "$", "AR", 2), (100, "ARS", "UY", 100), (100, "$U", "UY", 2), (7, "u$s", "AR", 7)], "a long, c string, k string, want long")
    assert rows.filter(S.to_usd(F.col("a"), F.col("c"), F.col("k")) != F.col("want")).count() == 0
    b = spark.createDataFrame([(30, "01_tiny"), (31, "02_small"), (20000, "06_luxury_scale"), (None, "")], "v long, want string")
    assert b.filter(S.bucket(F.col("v"), rules.AREA_BUCKETS) != F.col("want")).count() == 0
    r = spark.createDataFrame([(10, 0), (10, 4)], "a long, b long").select(S.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x["r"] for x in r] == [None, 2.5]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_match_sql(spark):
    from listforge import queries

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    norm = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda d: sorted(repr([norm(v) for v in r]) for r in d[columns].astype(object).itertuples(index=False))
        assert rows(got) == rows(want), name


def test_norm_keys_of_whole_texts(spark, tmp_path):
    import re
    import unicodedata

    from listforge import queries

    texts = [None, "", "x" * 300 + " Größe Ångström e\u0301tage", "Straße " * 60 + "ﬁn ½ ㎏ ｗｉｄｅ 𝐀 İ K № ş ă ő ō 2º", "漢字 " * 90 + "Ω end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    forms = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    want = {i: re.sub(r"[^a-z0-9]+", "_", forms(s or "").lower()).strip("_") for i, s in enumerate(texts)}
    assert {r["doc_id"]: r["norm_key"] for r in queries.queries()["norm_keys"](spark, str(tmp_path)).collect()} == want


PAGE = """<html><head><title> Depto </title><meta property="og:title" content="Departamento en Palermo, Capital Federal">
<script type="application/ld+json">{"offers":{"lowPrice":"90.000","price":120000,"priceCurrency":"usd"},"address":{"streetAddress":"","addressLocality":"CABA"},"geo":{"latitude":-34.5,"longitude":"-58,4"}}</script>
<script type="application/ld+json">{broken</script><script>var x="</p>";</script></head>
<body><!-- hidden 9 ambientes --><p>3 ambientes, 2 dormitorios, 1 baño. 75 m² cubierta. Expensas $ 45.000 <b>pileta</b>
<a href="/departamento-en-venta--1234567">x</a><a href="javascript:void(0)">y</a><a href="foo.html">z</a></body></html>"""


def parsed(spark, html=PAGE):
    rows = spark.createDataFrame([(1, "https://www.argenprop.com/departamento-en-palermo--7654321", html), (2, "https://www.argenprop.com/x", None)], "crawl_seq long, url string, html string")
    return pages.parse_html(rows)


def test_html_parser_and_extraction(spark):
    rows = parsed(spark).filter("html is not null")
    got = rows.select("page.*").first()
    assert got["title"] == "Depto" and got["json_price"] == "90.000" and got["json_currency"] == "usd"
    assert got["json_street"] is None and got["json_city"] == "CABA"
    assert "hidden" not in got["text"] and "var x" not in got["text"] and "pileta" in got["text"]
    ready = rows.select("crawl_seq", "url", F.lit("argenprop").alias("site"), F.lit("AR").alias("country"), F.col("page.text").alias("text"), F.coalesce(pages.meta("og:title", "twitter:title"), F.col("page.title")).alias("title"), F.lit("").alias("description"), F.lit("t").alias("scraped_at"), *[F.col(f"page.json_{c}").alias(f"json_{c}") for c in pages.FACTS])
    r = listing.extract(ready).first().asDict()
    assert (r["price_usd"], r["total_rooms"], r["bedrooms"], r["bathrooms"], r["covered_area_sqm"]) == (90000, 3, 2, 1, 75)
    assert (r["expenses_original"], r["expenses_usd"], r["has_pool"], r["is_apartment"], r["has_coordinates"]) == (45000, 30, 1, 1, 1)
    assert (r["city"], r["neighborhood"], r["listing_id"], r["area_bucket"]) == ("CABA", "Palermo", "7654321", "03_medium")
    assert r["location_key"] == "AR | CABA | Palermo" and len(r) == 159


def test_links(spark):
    got = {r["link"] for r in pages.discovered(parsed(spark)).collect()}
    assert got == {"https://www.argenprop.com/departamento-en-venta--1234567"}


def test_dedupe_is_stable(spark):
    rows = spark.createDataFrame([(i, f"k{i % 7}" if i % 3 else None) for i in range(100)], "i int, k string")
    want = {r["i"] for r in tables.keep_first(rows.repartition(1), ["k"], ["i"]).collect()}
    assert want == {r["i"] for r in tables.keep_first(rows.repartition(8), ["k"], ["i"]).collect()} and 0 in want


MD_A = "1. [Argenprop](https://www.argenprop.com/) 2. [Venta](https://www.argenprop.com/v) 3. [Departamento](https://www.argenprop.com/d) 4. [Buenos Aires](https://www.argenprop.com/b) 5. [CABA](https://www.argenprop.com/c) 6. [Palermo](https://www.argenprop.com/p)\nUSD 150.000\n$ 45.000 expensas\n* 91 m² \n* Norte\n### Características\n* Cant. Ambientes: **3**\n* Cant. Dormitorios: **2**\n* **Pileta**\n* **hola_vi 3**\n### Servicios\n* Gas natural\n### Fin" + " relleno" * 80


def test_markdown(spark):
    item = "source_rank int, file string, pos int, url string, markdown string"
    a = spark.createDataFrame([(0, "f", i, f"https://www.argenprop.com/departamento-en-venta--{i}", MD_A) for i in range(2)] + [(0, "f", 9, "https://www.argenprop.com/alquiler--9", MD_A)], item)
    rows = markdown.parse_a(a).orderBy("pos").collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["province"], r["city"], r["neighborhood"], r["price_usd"], r["total_rooms"], r["bedrooms"], r["covered_area_sqm"], r["orientation"]) == ("Buenos Aires", "CABA", "Palermo", 150000, 3, 2, 91, "Norte")
    assert r["flags"] == {"has_pool": 1, "has_natural_gas": 1}
    md_b = "**Apartamento en Centro, Montevideo**\nU$S 155.000 **3 Dorms.** **2 Baños** con piscina y barbacoa\n•\n\nZona\n\n**Sur**\n•\n\nVivienda social\n\n**Sí**\n" + "texto " * 60
    b = spark.createDataFrame([(1, "g", 0, "https://x.uy/a/1234567", md_b), (1, "g", 1, "https://x.uy/venta/1", md_b)], item)
    r = markdown.parse_b(b).first()
    assert (r["property_type"], r["neighborhood"], r["city"], r["price_usd"], r["bedrooms"], r["bathrooms"]) == ("Apartamento", "Centro", "Montevideo", 155000, 3, 2)
    assert {"has_pool", "has_grill", "has_bbq_house", "is_social_housing"} <= set(r["flags"])
    out = markdown.ml_table(a, b, b.limit(0), least=1)
    assert out.count() == 2 and {"has_pool", "has_natural_gas"} <= set(out.columns) and out.filter("property_type = 'Apartment'").count() == 2


def test_empty_tables(spark):
    empty = parsed(spark).limit(0)
    assert pages.discovered(empty).count() == 0
    assert tables.support(spark.createDataFrame([], "flags map<string,int>")).count() == 0


def test_crawl(spark):
    from listforge.operators.crawl import crawl

    base = "https://www.argenprop.com"
    snap = spark.createDataFrame([(base + "/casas-en-venta", 200, '<a href="/casa-en-venta--1234567">a</a><a href="/casas-en-venta?page=2">n</a>'), (base + "/casa-en-venta--1234567", 200, "<p>USD 1</p>"), (base + "/casas-en-venta?page=2", 503, "<p>down</p>")], "url string, status_code int, html string")
    start = spark.createDataFrame([(base + "/casas-en-venta", "argenprop")], "url string, site string")
    got = {r["url"].removeprefix(base): r["page_class"] for r in crawl(start, snap).collect()}
    assert got == {"/casas-en-venta": "search", "/casa-en-venta--1234567": "detail", "/casas-en-venta?page=2": "http_error"}
    assert crawl(start, snap, max_pages=1).count() == 1


def test_crawl_moves_past_missing_pages(spark):
    from listforge.operators.crawl import crawl

    base = "https://www.argenprop.com"
    snap = spark.createDataFrame([(base + "/casas-en-venta", 200, "".join(f'<a href="/casa-en-venta--100000{i}">a</a>' for i in range(7))), (base + "/casa-en-venta--1000006", 200, "<p>USD 1</p>")], "url string, status_code int, html string")
    start = spark.createDataFrame([(base + "/casas-en-venta", "argenprop")], "url string, site string")
    got = {r["url"].removeprefix(base): (r["page_class"], r["crawl_seq"]) for r in crawl(start, snap, per_round=3).collect()}
    assert got == {"/casas-en-venta": ("search", 1)} | {f"/casa-en-venta--100000{i}": ("empty", i + 2) for i in range(6)} | {"/casa-en-venta--1000006": ("detail", 8)}
    assert crawl(start, snap, max_pages=5, per_round=2).count() == 5


def test_deep_json_and_all_values(spark):
    deep = '<script type="application/ld+json">' + '{"a":' * 3000 + "1" + "}" * 3000 + "</script><p>text</p>"
    far = '<script type="application/ld+json">' + "[" * 400 + '{"price": "5"}' + "]" * 400 + "</script>"
    got = [r["page"] for r in parsed(spark, deep).filter("html is not null").collect()] + [pages.facts_of(far)]
    assert got[0]["text"] == "text" and got[1]["json_price"] == "5"
    pairs = pages.json_pairs([{"Price": [1], "x": {"price": " "}}, {"price": "7  8", "name": True}])
    assert pages.json_values(pairs, "price") == [[1], " ", "7  8"] and pages.json_scalar(pairs, "PRICE") == "7 8"


def test_tidy_links(spark):
    got = spark.createDataFrame([(["\"/a\"", "./b", "x.html", "https:\\/\\/h.uy\\/c;", "/a b", "&quot;/a&quot;", None],)], "l array<string>").select(pages.tidy_links(F.col("l")).alias("l")).first()["l"]
    assert got == ["/a", "/b", "https://h.uy/c"]


def test_description_is_cut_and_time_is_given(spark):
    row = parsed(spark, PAGE.replace("</head>", '<meta name="description" content="' + "palabra " * 300 + '"></head>')).filter("html is not null")
    ready = listing.stamped(pages.described(row.withColumn("site", F.lit("argenprop")).withColumn("country", F.lit("AR"))))
    r = listing.extract(ready).first()
    assert len(r["description"]) == rules.DESCRIPTION_CHARS and r["description_length_chars"] == rules.DESCRIPTION_CHARS
    assert r["listing_title"] == "Departamento en Palermo, Capital Federal" and len(r["scraped_at"]) == 25 and r["scraped_at"].endswith("+00:00")
    assert listing.matches_mode(listing.extract(ready), True).count() == 1


def test_leftmost_floor_and_yes(spark):
    md = "**Casa en Centro, Montevideo**\nU$S 155.000 3° piso luego piso 5\n•\n\nBarrio privado\n\n**Yes**\n" + "texto " * 60
    r = markdown.parse_b(spark.createDataFrame([(1, "g", 0, "https://x.uy/a/1234567", md)], "source_rank int, file string, pos int, url string, markdown string")).first()
    assert r["floor_number"] == 3 and "is_gated_community" in r["flags"]


def test_harvest(spark):
    from listforge.operators.crawl import harvest

    base = "https://www.argenprop.com"
    page = lambda kind, extra="": f"<title>{kind} en venta</title><p>USD 120.000 3 ambientes</p>{extra}"
    link = lambda *paths: "".join(f'<a href="{p}">x</a>' for p in paths)
    snap = [("/deptos-en-venta", link("/departamento-en-venta--1000001", "/departamento-en-venta--1000002", "/casa-en-venta--1000003")), ("/departamento-en-venta--1000001", page("Departamento")), ("/departamento-en-venta--1000002", page("Departamento")), ("/casa-en-venta--1000003", page("Casa", link("/departamento-en-venta--1000004"))), ("/departamento-en-venta--1000004", page("Departamento"))]
    pages_ = spark.createDataFrame([(base + u, 200, h) for u, h in snap], "url string, status_code int, html string")
    start = spark.createDataFrame([(base + "/deptos-en-venta", "argenprop"), (base + "/casa-en-venta--1000003", "argenprop")], "url string, site string")
    ids = lambda rows: sorted(r["listing_id"] for r in rows.collect())
    read, rows = harvest(start, pages_)
    assert read.count() == 5 and ids(rows) == ["1000001", "1000002", "1000003", "1000004"]
    # In apartment mode the house gives no row, and its page no links.
    read, rows = harvest(start, pages_, apartments_only=True)
    assert ids(rows) == ["1000001", "1000002"] and read.filter("url like '%1000004'").count() == 0
    # A met budget of properties ends a site's rounds.
    read, rows = harvest(start, pages_, max_properties=1, per_round=1)
    assert rows.count() == 1 and read.count() < 5


def test_sources_and_sinks(spark, tmp_path):
    from listforge.sources import io

    (tmp_path / "seeds.md").write_text("# AR\n- https://b.com/\n- (https://a.com/x) https://b.com\n")
    assert [r["url"] for r in io.seed_list(spark, str(tmp_path / "seeds.md")).collect()] == ["https://a.com/x", "https://b.com"]
    urls = spark.createDataFrame([("https://a.com/private/1",), ("https://a.com/2",), ("https://c.com/private",)], "url string")
    assert sorted(r["url"] for r in io.allowed(urls, {"a.com": "User-agent: *\nDisallow: /private"}).collect()) == ["https://a.com/2", "https://c.com/private"]
    rows = spark.createDataFrame([(1, "a,\"b\"", None), (2, "", "x")], "i int, t string, z string")
    io.write_csv(rows, str(tmp_path / "csv"), ["t", "i"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["t", "i"] and {(r["t"], r["i"]) for r in back.collect()} == {('a,"b"', "1"), (None, "2")}
    io.write_jsonl(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert io.robots_texts(["http://127.0.0.1:9/"], timeout=0.5) == {}


def test_norm_key_of_rare_characters(spark):
    """A mark that has a form of marks alone goes as well, and the class that is tried for each character is a few ranges that leave nothing out."""
    import re

    assert values(spark, ["a\uff9eb", "\u0f73x", "½½ ㏂ Ǆ ß™", "İK"], S.norm_key) == ["ab", "x", "1_21_2_a_m_dz_tm", "ik"]
    near = re.findall(r"x\{(\w+)\}-", S._NEAR_SEVERAL.split("&&")[1])
    spans = [[int(x, 16) for x in r] for r in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", S._NEAR_SEVERAL.split("&&")[1])]
    assert len(near) < 60 and all(any(a <= ord(c) <= z for a, z in spans) for c in S._SEVERAL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_short_rows_are_spread_before_the_work(spark):
    from listforge import queries

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert queries.texts(spark, DATA).rdd.getNumPartitions() == parts > 1
    # No pattern is looked for below the exchange that spreads the rows, where a filter would be pushed.
    plan = queries.queries()["listing_rows"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "regexp_extract" in above and "regexp_extract" not in below


def test_gates_leave_no_match_out(spark):
    assert S.needles(r"(?:expensas|gastos\s+comunes)[^\d$U]{0,30}") == {"expensas", "comunes"} and S.needles(r"a?b*\d+|x") == set() and S.needles(r"(ab)?cd{0,2}e") == {"c"}
    patterns = [*rules.FLAG_PATTERNS.values(), *[p for ps in (*rules.COUNTS.values(), [p for p, _ in rules.PRICES + rules.PROPERTY_TYPES + rules.SUBTYPES + rules.STAGES + rules.PUBLICATIONS]) for p in ps]]
    texts = ["Jardín FONDO, BALCÓN al frente, Sótano", "aıre acondİcıonado 24 hs maſcotas", "Kitchen, play room, PLAYA, LOSA  radiante", "3 AMBİENTES, 2 baÑos, 7° pıſo, UſD 9, $u 5", "Á̈tico, DÚPLEX walK-in; superficie 5 M²", "", None]
    rows = spark.createDataFrame([(x,) for x in texts + [p.replace("\\b", "").replace("\\s+", " ").replace("\\s*", "") for p in patterns]], "x string")
    both = rows.select(F.array(*[F.col("x").rlike("(?iu)" + p) for p in patterns]).alias("want"), F.array(*[S.matches(F.col("x"), p, S.folded(F.col("x"))) for p in patterns]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in both) and sum(sum(map(bool, r["want"])) for r in both) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["flags_wide", "flag_count", "expenses_extract", "counts_areas", "price_extract"])
def test_patterns_are_gated_above_the_spread(spark, name):
    from listforge import queries

    above, below = queries.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "Contains(" in above and not any(x in below for x in ("RLIKE", "regexp_extract"))
