"""Markdown dump parsers: one row of fixed columns and a map of flags per listing.

Input: url, markdown and the order columns source_rank, file, pos. Two page
families; the third family is the second with another source name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.operators import tables
from listforge.plans import rules

ORDER = ("source_rank", "file", "pos")
_YES = ("si", "sí", "yes")
#: The leftmost of these is the floor.
_FLOOR = r"(?iu)piso\s+([0-9]+|PB)|([0-9]+)to\s+piso|([0-9]+)°\s*piso"


def pairs(c: Column, pattern: str) -> Column:
    """All (k, v) of a pattern of two groups."""
    at = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("v"))
    return F.transform(at, lambda x: F.struct(S.clean_ends(x["k"]).alias("k"), S.clean_ends(x["v"]).alias("v")))


def last(found: Column, test) -> Column:
    """v of the last pair whose key passes."""
    return F.try_element_at(F.filter(found, lambda x: test(x["k"])), F.lit(-1))["v"]


def first_pair(found: Column, test) -> Column:
    return F.get(F.filter(found, lambda x: test(x["k"])), F.lit(0))["v"]


def flag_map(keys: Column) -> Column:
    """Names to a map of ones; what is no flag is left out."""
    columns = F.array_distinct(F.filter(F.transform(keys, lambda k: S.amenity_column(S.norm_key(k))), lambda x: x.isNotNull()))
    return F.map_from_arrays(columns, F.transform(columns, lambda _: F.lit(1)))


def price(amount: Column, dollars: Column, per_usd: int) -> Column:
    """Half-even USD of at least the least sale price, else null."""
    usd = F.when(dollars, amount.cast("double")).otherwise(amount / float(per_usd))
    return F.when(usd >= rules.MIN_SALE_USD_DUMPS, F.bround(usd).cast("bigint"))


def parse_a(items: DataFrame) -> DataFrame:
    md, url = F.col("markdown"), F.col("url")
    rows = items.filter(url.rlike("--[0-9]+$") & (F.length(md) >= 500) & ~(F.lower(url).contains("alquiler") & ~F.lower(url).contains("/venta")))
    crumbs = F.transform(F.regexp_extract_all(md, F.lit(r"[0-9]+\.\s*\[([^\]]+)\]\(https://www\.argenprop\.com/"), 1), S.clean_ends)
    crumbs = F.filter(crumbs, lambda b: (F.lower(b) != "argenprop") & ~b.contains("#") & ~b.contains("\n"))
    mark, amount = F.upper(S.first(md, r"(USD|U\$S|\$)\s*([0-9.]+)", 1)), S.parse_thousands(S.first(md, r"(USD|U\$S|\$)\s*([0-9.]+)", 2))
    rows = rows.withColumn("_bc", crumbs).withColumn("price_usd", price(amount, mark.startswith("U"), rules.ARS_PER_USD)).filter("price_usd is not null")
    car = S.section(md, "Características")
    rows = rows.withColumn("_car", car).withColumn("_pairs", pairs(F.col("_car"), r"\*\s+([^:*\n]+):\s*\*\*([^*]+)\*\*"))
    bc = lambda i: F.coalesce(F.get("_bc", F.lit(i)), F.lit(""))
    sale = lambda g: S.clean_ends(F.regexp_extract(md, r"##\s*Venta\s+en\s+([^,\n]+),\s*([^\n]+)", g))
    or_else = lambda x, y: F.when(x == "", y).otherwise(x)
    city = or_else(bc(3), sale(2))
    near = or_else(F.coalesce(F.get("_bc", F.lit(4)), bc(3)), sale(1))
    # The labels are tested in this order; a pair belongs to the first that its key holds.
    labels = {"total_rooms": "Ambientes", "bedrooms": "Dormitorios", "bathrooms": "Baños|Banos", "parking_spaces": "Cocheras", "age_years": "Antig", "balcony_type": "Tipo de Balc", "view_type": "Tipo de Vista", "flooring_type": "Tipo de Piso", "number_of_floors_in_unit": "Plantas", "orientation": "Orientaci"}
    value, before = {}, []
    for column, label in labels.items():
        earlier = "|".join(before)
        text = last(F.col("_pairs"), lambda k, label=label, earlier=earlier: k.rlike(label) & (~k.rlike(earlier) if earlier else F.lit(True)))
        value[column] = text if column in ("balcony_type", "view_type", "flooring_type", "orientation") else S.parse_thousands(text)
        before.append(label)
    block = S.bullets(F.regexp_extract(md, r"(?s)\\?\+?\s*\$[0-9. ]+\s*expensas(.+?)###", 1))
    areas = F.filter(F.transform(block, F.lower), lambda b: b.rlike(r"[0-9]+(?:[.,][0-9]+)?\s*m[^\p{L}\p{N}_]?"))
    kind = lambda b: F.regexp_extract(b, r"([0-9]+(?:[.,][0-9]+)?)\s*m[^\p{L}\p{N}_]?\s*(cubierta|total|semi|descub)?", 2)
    size = lambda test: S.parse_thousands(F.get(F.transform(F.filter(areas, test), lambda b: F.regexp_extract(b, r"([0-9]+(?:[.,][0-9]+)?)\s*m", 1)), F.lit(0)))
    facing = F.get(F.filter(block, lambda b: b.isin("Norte", "Sur", "Este", "Oeste", "NE", "NO", "SE", "SO", "N", "S", "E", "O")), F.lit(0))
    mono = F.exists(block, lambda b: F.lower(b).contains("monoambiente"))
    names = F.concat(F.regexp_extract_all("_car", F.lit(r"\*\s+\*\*([^*]+)\*\*"), 1), S.bullets(S.section(md, "Servicios")), S.bullets(S.section(md, "Ambientes")))
    kind_of = F.regexp_extract(url, r"(?i)argenprop\.com/([a-z]+)-en-venta", 1)
    value["total_rooms"] = F.coalesce(value["total_rooms"], F.when(mono, F.lit(1).cast("bigint")))
    value["orientation"] = F.coalesce(value["orientation"], facing)
    return rows.select(
        *ORDER, F.lit("argenprop").alias("data_source"), F.lit("AR").alias("country"), F.initcap(kind_of).alias("property_type"), F.lit("").alias("property_subtype"), bc(2).alias("province"), city.alias("city"), near.alias("neighborhood"), "price_usd",
        S.floor_number(S.first(md, r"Piso\s+([0-9]+|PB|Pb|pb)", 1)).alias("floor_number"), *[v.alias(k) for k, v in value.items()],
        size(lambda b: ~kind(b).isin("total", "semi", "descub")).alias("covered_area_sqm"), size(lambda b: kind(b) == "total").alias("total_area_sqm"), size(lambda b: kind(b) == "semi").alias("semicovered_area_sqm"), size(lambda b: kind(b) == "descub").alias("uncovered_area_sqm"),
        flag_map(names).alias("flags"),
    )


def parse_b(items: DataFrame, source: str = "infocasas") -> DataFrame:
    md, url = F.col("markdown"), F.col("url")
    rows = items.filter((F.length(md) >= 300) & url.rlike("/[0-9]{6,}$") & ~url.rlike(r"/venta(?:/|\?|$)") & ~url.contains("/inmobiliarias/") & ~url.contains("/proyectos/"))
    if source == "gallito":
        rows = rows.filter(url.contains("/inmuebles"))
    usd = F.coalesce(S.first(md, r"U\$S\s*([0-9.]+)", 1), S.first(md, r"USD\s*([0-9.]+)", 1))
    amount = S.parse_thousands(F.coalesce(usd, S.first(md, r"\$\s*([0-9.]{6,})", 1)))
    rows = rows.withColumn("price_usd", price(amount, usd.isNotNull(), rules.UYU_PER_USD)).filter("price_usd is not null")
    found = F.filter(pairs(md, r"•\s*\n+\s*([^\n]+?)\n+\s*\*\*([^*]+)\*\*"), lambda x: ~x["v"].isin("¡Pregúntale!", "No aplica", "No"))
    rows = rows.withColumn("_pairs", F.transform(found, lambda x: F.struct(F.lower(x["k"]).alias("k"), x["v"].alias("v"))))
    p = F.col("_pairs")
    has = lambda w: last(p, lambda k: k.contains(w))
    same = lambda w: last(p, lambda k: k == w)
    kind = r"(?iu)\b(Casa|Apartamento|Local|Terreno|Oficina|PH|Quinta|Galp[oó]n|Campo|Hotel|Cochera|Garaje)\s+en\s+([^,\n]+),\s*([^\n*]+)"
    part = lambda g: S.clean_ends(F.regexp_extract(md, kind, g))
    near = F.when(part(2) != "", part(2)).otherwise(F.coalesce(first_pair(p, lambda k: k == "zona"), F.lit("")))
    dorms = same("dormitorios")
    number = lambda pattern: S.parse_thousands(S.first(md, pattern, 1))
    baths = F.coalesce(number(r"([0-9]+)\s*Ba[ñn]os?"), S.parse_thousands(first_pair(p, lambda k: k.isin("baños", "banos"))))
    bedrooms = F.coalesce(number(r"([0-9]+)\s*Dorms?\."), S.parse_thousands(F.when(~dorms.contains("Mono"), dorms)))
    mono = dorms.contains("Mono") | md.rlike(r"(^|[^\p{L}\p{N}_])Mono($|[^\p{L}\p{N}_])")
    floor = F.coalesce(*[S.first(md, _FLOOR, group) for group in (1, 2, 3)])
    garage = md.rlike(r"\b[Gg]ara(je|ge)\b|\b[Cc]ochera\b")
    spots = F.coalesce(F.when(garage, number(r"([0-9]+)\s*[Gg]araje")), S.parse_thousands(same("garajes")))
    yes = lambda w: F.lower(has(w)).isin(*_YES)
    low = F.lower(md)
    tests: dict[str, Column] = {}
    for pattern, column in rules.KEYWORDS.items():
        tests[column] = tests[column] | low.rlike("(?u)" + pattern) if column in tests else low.rlike("(?u)" + pattern)
    for column, test in {"has_garage_room": garage, "is_gated_community": yes("barrio privado"), "accepts_swap": yes("acepta permuta"), "is_social_housing": yes("vivienda social"), "professional_use_allowed": yes("apto para oficina"), "has_sea_view": yes("vista al mar"), "mortgage_eligible": yes("financiación")}.items():
        tests[column] = F.coalesce(test, F.lit(False)) | tests.get(column, F.lit(False))
    names = F.filter(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(
        *ORDER, F.lit(source).alias("data_source"), F.lit("UY").alias("country"), F.coalesce(has("tipo de propiedad"), F.initcap(part(1))).alias("property_type"), F.lit("").alias("property_subtype"), part(3).alias("province"), part(3).alias("city"), near.alias("neighborhood"), "price_usd",
        S.floor_number(floor).alias("floor_number"), F.when(mono, F.lit(1).cast("bigint")).alias("total_rooms"), bedrooms.alias("bedrooms"), baths.alias("bathrooms"), spots.alias("parking_spaces"), S.parse_thousands(has("antig")).alias("age_years"), has("orientación").alias("orientation"),
        number(r"([0-9]+)\s*m[^\p{L}\p{N}_]").alias("covered_area_sqm"), S.parse_thousands(first_pair(p, lambda k: k.contains("m² del terreno"))).alias("total_area_sqm"), F.map_from_arrays(names, F.transform(names, lambda _: F.lit(1))).alias("flags"),
    )


def ml_table(a: DataFrame, b: DataFrame, c: DataFrame, least: int = 2) -> DataFrame:
    """Union, keep-first dedupe, flags with enough support as columns, names and texts normalised."""
    rows = tables.dedupe_ml(tables.union_sources(parse_a(a), parse_b(b), parse_b(c, "gallito")))
    columns = sorted(r["column"] for r in tables.support(rows, least).select("column").collect())  # the names become the schema
    kind = F.lower(F.trim("property_type"))
    known = F.create_map(*[F.lit(x) for kv in rules.TYPE_NAMES.items() for x in kv])
    rows = rows.withColumn("property_type", F.coalesce(F.try_element_at(known, kind), F.col("property_type")))
    text = [S.clean_text(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in rules.ML_CATEGORICAL]
    number = [(F.col(c) if c in rows.columns else F.lit(None).cast("double" if c in ("latitude", "longitude") else "bigint")).alias(c) for c in rules.ML_NUMERIC]
    return tables.widen(rows.select(*text, *number, "flags"), columns)
