"""Listing extraction: from a page's text and structured facts to the wide row.

Input columns: url, site, country, text, title, description, scraped_at and the
json_* facts. Stages are DataFrame transforms; the flags stay in one array
until the last projection, which keeps earlier stages narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.plans import rules

_MONEY = r"(U\$S|US\$|USD|ARS|AR\$|UYU|\$U|\$)?"
_AREA = r"(\d+(?:[.,]\d+)?)\s*(?:m2|m²|mts2|metros)"


def price(text: Column, json_price: Column, json_currency: Column, country: Column, low: Column | None = None) -> Column:
    """struct(original, currency, usd) of the structured price, else of the first pattern with an amount; null if none. Here and below low is text folded, if given."""

    def made(amount: Column, currency: Column) -> Column:
        return S.let(amount, lambda a: F.when(a > 0, F.struct(a.alias("original"), currency.alias("currency"), S.to_usd(a, currency, country).alias("usd"))))

    own = made(S.parse_price(F.nullif(json_price, F.lit(""))), F.upper(F.coalesce(F.nullif(json_currency, F.lit("")), F.lit("USD"))))
    return F.coalesce(own, *[gated(low, p, made(S.parse_price(F.regexp_extract(text, "(?iu)" + p, 1)), F.lit(c))) for p, c in rules.PRICES])


def gated(low: Column | None, pattern: str, value: Column) -> Column:
    """value, which is null wherever the pattern isn't found; it is only looked for where it may be."""
    return value if low is None else F.when(S.may_match(low, pattern), value)


def expenses(text: Column, country: Column, price_original: Column, price_usd: Column, low: Column | None = None) -> Column:
    tries = []
    for p in (rf"(?:expensas|gastos\s+comunes)[^\d$U]{{0,30}}{_MONEY}\s*([\d.,]+)", rf"{_MONEY}\s*([\d.,]+)\s*(?:de\s*)?(?:expensas|gastos\s+comunes)"):
        currency, amount = F.upper(F.coalesce(S.first(text, p, 1, "(?iu)"), F.lit("$"))), S.parse_price(F.regexp_extract(text, "(?iu)" + p, 2))
        made = S.let(F.struct(amount.alias("original"), currency.alias("currency")), lambda m: F.struct(m["original"].alias("original"), m["currency"].alias("currency"), S.to_usd(m["original"], m["currency"], country).alias("usd")))
        tries.append(gated(low, p, S.let(made, lambda m: F.when((m["original"] >= 100) & ~(m["original"].eqNullSafe(price_original) | m["usd"].eqNullSafe(price_usd)), m))))
    return F.coalesce(*tries)


def area(text: Column, labels: tuple[str, ...], low: Column | None = None) -> Column:
    any_ = "|".join(labels)
    return number(text, low, rf"(?:{any_})[^\d]{{0,25}}{_AREA}", rf"{_AREA}[^\n.]{{0,25}}(?:{any_})")


def number(text: Column, low: Column | None, *patterns: str) -> Column:
    """The whole number that the first pattern with a match holds."""
    found = S.parse_int(S.first_of(text, patterns, low=low))
    return found if low is None else F.when(S.may_match(low, *patterns), found)


def counts_and_areas(df: DataFrame) -> DataFrame:
    """df with the numbers that its text states; _low is text folded, if df has it. All of them are in one let, see flag_array."""
    text = F.col("text")

    def found(low: Column) -> Column:
        values = {c: number(text, low, *p) for c, p in rules.COUNTS.items()} | {c: area(text, labels, low) for c, labels in rules.AREAS.items()}
        values["covered_area_sqm"] = S.let(values["covered_area_sqm"], lambda own: F.when(own != 0, own).otherwise(F.coalesce(number(text, low, _AREA), own)))
        return F.struct(*[v.alias(c) for c, v in values.items()])

    df = df.withColumn("_counts", S.let(F.col("_low") if "_low" in df.columns else S.folded(text), found))
    return df.withColumns({c: F.col(f"_counts.{c}") for c in (*rules.COUNTS, *rules.AREAS)}).drop("_counts")


def property_type(url: Column, title: Column, text: Column) -> Column:
    return S.case_of(F.concat_ws(" ", url, title, F.substring(text, 1, rules.TYPE_SAMPLE_CHARS)), rules.PROPERTY_TYPES)


def orientation(text: Column, low: Column | None = None) -> Column:
    return F.upper(S.first(text, r"orientaci[oó]n[^\w]{0,10}(norte|sur|este|oeste|ne|no|se|so|n|s|e|o)", 1, "(?iu)", low))


def distance_to_sea(text: Column, low: Column | None = None) -> Column:
    return number(text, low, r"distancia\s+al\s+mar[^\d]{0,20}(\d+)", r"(\d+)\s*cuadras?\s+(?:del|al)\s+mar")


def flags(text: Column, low: Column | None = None) -> list[Column]:
    """One 0/1 column for each flag rule."""
    return [S.matches(text, p, low).cast("int").alias(c) for c, p in rules.FLAG_PATTERNS.items()]


def flag_array(text: Column, low: Column) -> Column:
    """The values of all flag rules. The body of a let is evaluated as a tree: generated code for so many patterns is one method too long for the JVM to compile."""
    return S.let(low, lambda found: F.array(*flags(text, found)))


def locate(df: DataFrame) -> DataFrame:
    """city, neighborhood, province, street: structured, then 'en X, Y' in title and text, then the URL's slug."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({c: blank(f"json_{c}") for c in ("street", "city", "province", "neighborhood")})
    for source, gate in ((F.col("title"), F.lit(True)), (F.substring("text", 1, rules.LOCATION_SAMPLE_CHARS), F.col("city") == "")):
        p = r"\ben\s+([^,|]+),\s*([^,|]+)"
        near, city = (S.clean_location_part(F.regexp_extract(source, "(?iu)" + p, g)) for g in (1, 2))
        ok = gate & (near != "") & (city != "")
        df = df.withColumns({"neighborhood": F.when(ok & (F.col("neighborhood") == ""), near).otherwise(F.col("neighborhood")), "city": F.when(ok & (F.col("city") == ""), city).otherwise(F.col("city"))})
    path = F.btrim(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), F.lit("/"))
    slug = F.btrim(F.regexp_extract(path, r"(?iu)(?:apartamento|departamento|casa|terreno)-en-([^/]+?)(?:/\d{6,}|$)", 1), F.lit("-"))
    city, near = F.lit(""), F.lit("")
    for key, name in reversed(list(rules.CITY_SLUGS.items())):
        tail = F.endswith(slug, F.lit("-" + key))
        city = F.when((slug == key) | tail, name).otherwise(city)
        near = F.when(slug == key, "").when(tail, S.title_from_slug(F.btrim(F.regexp_replace(slug, f"-{key}$", ""), F.lit("-")))).otherwise(near)
    return df.withColumns({"city": F.when(F.col("city") == "", city).otherwise(F.col("city")), "neighborhood": F.when(F.col("neighborhood") == "", near).otherwise(F.col("neighborhood"))})


def bounded(df: DataFrame) -> DataFrame:
    """Impossible numbers become null; a studio has no bedroom."""
    out = {c: F.when(F.col(c).between(0, top), F.col(c)) for c, top in rules.MAXIMA.items() if c in df.columns}
    df = df.withColumns(out)
    return df.withColumn("bedrooms", F.when((F.col("property_subtype") == "Studio") | (F.col("total_rooms") == 1), F.lit(0).cast("bigint")).otherwise(F.col("bedrooms")))


def room_bucket(total_rooms: Column, bedrooms: Column, studio: Column) -> Column:
    return F.when((total_rooms == 1) | studio, "01_studio").when(bedrooms.isNull(), "").when(bedrooms <= 1, "02_one_bedroom").when(bedrooms == 2, "03_two_bedroom").when(bedrooms == 3, "04_three_bedroom").otherwise("05_four_plus_bedroom")


def location_key(*parts: Column) -> Column:
    """From the widest part to the narrowest, blank ones left out."""
    return F.concat_ws(" | ", *[F.nullif(x, F.lit("")) for x in parts])


def derived(df: DataFrame) -> DataFrame:
    """Areas, ratios, text sizes, buckets and the location key."""
    c = F.col
    some = lambda x: F.nullif(c(x), F.lit(0).cast("bigint"))
    df = df.withColumn("effective_area_sqm", F.coalesce(some("covered_area_sqm"), some("total_area_sqm"))).withColumn("_rooms", F.coalesce(some("total_rooms"), c("bedrooms") + 1))
    studio = F.coalesce((c("property_subtype") == "Studio") | (c("total_rooms") == 1), F.lit(False))
    return df.withColumns(
        {
            "area_per_room_sqm": S.ratio(c("effective_area_sqm"), c("_rooms")),
            "bedrooms_per_bathroom": S.ratio(c("bedrooms"), c("bathrooms")),
            "bathrooms_per_bedroom": S.ratio(c("bathrooms"), c("bedrooms")),
            "core_feature_count": sum((c(x).isNotNull().cast("int") for x in rules.CORE_FIELDS), F.lit(0)),
            "title_length_chars": F.length("title"),
            "description_length_chars": F.length("description"),
            "title_word_count": S.word_runs(c("title")),
            "description_word_count": S.word_runs(c("description")),
            "area_bucket": S.bucket(c("effective_area_sqm"), rules.AREA_BUCKETS),
            "age_bucket": S.bucket(c("age_years"), rules.AGE_BUCKETS),
            "floor_bucket": S.bucket(c("floor_number"), rules.FLOOR_BUCKETS),
            "room_bucket": room_bucket(c("total_rooms"), c("bedrooms"), studio),
            "location_key": location_key(*map(c, ("country", "province", "city", "neighborhood"))),
        }
    ).drop("_rooms")


def matches_mode(rows: DataFrame, apartments_only: bool) -> DataFrame:
    """The wide rows that the property mode asks for: all, or apartments by type or URL."""
    return rows.filter((F.lower("property_type") == "apartment") | S.apartment_url(F.col("source_url"))) if apartments_only else rows


def stamped(pages: DataFrame) -> DataFrame:
    """pages with scraped_at: this run's time in UTC, to the second."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return pages.withColumn("scraped_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def extract(pages: DataFrame) -> DataFrame:
    """The wide rows of all pages with a usable price: base columns, then 97 flags."""
    c = F.col
    rows = pages.withColumn("_low", S.folded(c("text")))
    rows = rows.withColumn("_price", S.pinned(S.let(c("_low"), lambda low: price(c("text"), c("json_price"), c("json_currency"), c("country"), low)))).filter("_price is not null and (_price.usd = 0 or _price.usd >= %d)" % rules.MIN_SALE_USD_PAGES)
    about = F.concat_ws(" ", "title", "description")
    rows = rows.withColumns({"price_original": c("_price.original"), "price_currency": c("_price.currency"), "price_usd": c("_price.usd"), "property_type": property_type(c("url"), c("title"), c("text")), "property_subtype": S.case_of(about, rules.SUBTYPES), "construction_stage": S.case_of(about, rules.STAGES), "publication_type": S.case_of(about, rules.PUBLICATIONS), "orientation": orientation(c("text"), c("_low")), "distance_to_sea_blocks": distance_to_sea(c("text"), c("_low"))})
    rows = rows.withColumn("description", F.substring(S.clean_text(c("description")), 1, rules.DESCRIPTION_CHARS))
    rows = rows.withColumn("_expenses", S.let(c("_low"), lambda low: expenses(c("text"), c("country"), c("price_original"), c("price_usd"), low))).withColumns({f"expenses_{x}": c(f"_expenses.{x}") for x in ("original", "currency", "usd")})
    rows = locate(counts_and_areas(rows)).withColumn("_near_sea", c("distance_to_sea_blocks").isNotNull())
    rows = rows.withColumns({"latitude": S.parse_number(c("json_latitude")), "longitude": S.parse_number(c("json_longitude"))})
    rows = derived(bounded(rows.withColumn("_flags", flag_array(c("text"), c("_low")))))
    names = list(rules.FLAG_PATTERNS)
    value = {n: F.get(c("_flags"), F.lit(i)) for i, n in enumerate(names)}
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    value |= {
        "is_apartment": one(c("property_type") == "Apartment"), "is_studio_apartment": one((c("property_subtype") == "Studio") | (c("total_rooms") == 1)), "is_duplex": one(c("property_subtype") == "Duplex"), "is_penthouse": one(c("property_subtype") == "Penthouse"),
        "is_new_construction": one(c("construction_stage") == "new"), "is_under_construction": one(c("construction_stage") == "under_construction"), "is_development_project": one(c("publication_type") == "developer"), "is_owner_direct": one(c("publication_type") == "owner_direct"),
        "is_high_floor": one(c("floor_number") >= 9), "has_coordinates": one((c("latitude") != 0) & (c("longitude") != 0)), "has_exact_address": one(c("street") != ""), "has_expenses": one(c("expenses_original") != 0), "has_description": one(c("description") != ""),
        "is_near_sea": F.greatest(value["is_near_sea"], one(c("_near_sea"))),
    }
    counted = [v for n, v in value.items() if n.startswith("has_") and n not in rules.NOT_COUNTED]
    base = {"source_url": c("url"), "source_domain": S.host(c("url")), "listing_id": S.listing_id(c("url")), "listing_title": c("title"), "data_source": c("site"), "operation_type": F.lit("Sale"), "amenity_count": sum(counted, F.lit(0))}
    columns = [base.get(n, c(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in rules.BASE_COLUMNS]
    return rows.select(*[x for x in ("crawl_seq",) if x in rows.columns], *columns, *[F.coalesce(value.get(n, F.lit(0)), F.lit(0)).alias(n) for n in rules.FLAG_COLUMNS])
