"""Relational operators: keep-first dedupe, support counts, unions, frontiers, per-group limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from listforge.functions import scalars as S
from listforge.plans import rules


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many tasks as a shuffle has. For short rows that much is made of: a file of few MB, or of one row group, is one task however long it takes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row, in order, of each key; nulls are equal. A limit on the window's rank prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def listing_key(df: DataFrame) -> Column:
    """Domain and listing id where the URL has one, else the URL and the stable facts."""
    own = F.coalesce("listing_id", S.listing_id(F.col("source_url"))) if "listing_id" in df.columns else S.listing_id(F.col("source_url"))
    text = lambda c: F.col(c).cast("string")
    facts = [F.when(own == "", text(c)) for c in ("source_url", "price_usd", "covered_area_sqm", "bedrooms", "bathrooms")]
    return F.struct(F.when(own != "", F.col("source_domain")).alias("a"), own.alias("b"), *[f.alias(f"f{i}") for i, f in enumerate(facts)])


def dedupe_listings(rows: DataFrame, order: str = "crawl_seq") -> DataFrame:
    return keep_first(rows, [listing_key(rows)], [order])


def dedupe_ml(rows: DataFrame, order: Sequence[str] = ("source_rank", "file", "pos")) -> DataFrame:
    return keep_first(rows, ["data_source", "neighborhood", "price_usd", "covered_area_sqm"], order)


def support(rows: DataFrame, least: int = 2) -> DataFrame:
    """column, n: flags that at least so many rows have; flags is a map column, or an array of the names of those set."""
    if isinstance(rows.schema["flags"].dataType, MapType):
        pairs = rows.select(F.explode("flags").alias("column", "value")).filter("value <> 0")
    else:
        pairs = rows.select(F.explode("flags").alias("column"))
    named = pairs.filter(F.col("column").rlike("^(" + "|".join(rules.FLAG_PREFIXES) + ")"))
    return named.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def widen(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One 0/1 column for each flag, missing 0; the map goes."""
    flags = [F.coalesce((F.try_element_at("flags", F.lit(c)) != 0).cast("int"), F.lit(0)).alias(c) for c in columns]
    return rows.select(*[c for c in rows.columns if c != "flags"], *flags)


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_per(df: DataFrame, group: str, order: Sequence[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def unseen(links: DataFrame, seen: DataFrame, on: str = "url") -> DataFrame:
    return links.join(seen.select(on).distinct(), on, "left_anti")


def site_table(spark: SparkSession) -> DataFrame:
    """The sites' rules: a fixed handful of rows."""
    rows = [(i, *[list(v) if isinstance(v, tuple) else v for v in s.values()]) for i, s in enumerate(rules.SITES)]
    return spark.createDataFrame(rows, "site_rank int, name string, domain_key string, country string, sale_paths array<string>, apartment_paths array<string>, detail_patterns array<string>, useful_words array<string>")


def match_site(df: DataFrame, url: str = "url") -> DataFrame:
    """df with site: the first site whose key is in the host, null if none. The rules are few and fixed, so this is one expression and no join."""
    out = F.lit(None).cast("string")
    for s in reversed(rules.SITES):
        out = F.when(S.host(F.col(url)).contains(s["domain_key"]), s["name"]).otherwise(out)
    return df.withColumn("site", out)


def wanted_sites(df: DataFrame, selected: Sequence[str] = (), url: str = "url") -> DataFrame:
    choices = [s.lower().removeprefix("www.") for s in selected]
    keys = {s["name"]: s["domain_key"] for s in rules.SITES}
    named = [n for n, k in keys.items() if n in choices or k in choices]
    return df if not choices else df.filter(F.col("site").isin(*named) | S.comparable_host(F.col(url)).isin(*choices))


def seeds(bases: DataFrame, apartments_only: bool = False) -> DataFrame:
    """url, site, pos, seed of each known site's start pages."""
    sites = site_table(bases.sparkSession).select(F.col("name").alias("site"), F.col("apartment_paths" if apartments_only else "sale_paths").alias("paths"))
    out = match_site(bases).join(F.broadcast(sites), "site").select("url", "site", F.posexplode("paths").alias("pos", "path"))
    return out.select("url", "site", "pos", F.concat(F.rtrim(F.col("url"), F.lit("/")), F.lit("/"), F.ltrim(F.col("path"), F.lit("/"))).alias("seed"))
