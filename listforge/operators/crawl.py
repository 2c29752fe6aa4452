"""Crawl over page snapshots: generations of a frontier, within budgets.

Each round takes every site's next pages (details before searches), joins them
with the snapshot, extracts, and adds what is unseen to the frontier. The
loop's state is four tables, checkpointed each round; nothing of it but one
emptiness test reaches the driver. Within a round pages are taken in the order
(class, generation, url), so a run is the same whatever the partitioning. A URL
that the snapshot lacks is a failed fetch: it is read, as an empty page, and
counts. The crawl ends when frontiers, page budgets or property budgets are
used up. A page whose row the property mode rejects yields no links.
"""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.operators import listing, tables
from listforge.operators import pages as P


def _shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="crawl-"))  # one machine alone: tests


def crawl(start: DataFrame, snapshot: DataFrame, max_pages: int = 300, per_round: int = 50, apartments_only: bool = False, rounds: int | None = None) -> DataFrame:
    """url, site, page_class, generation, crawl_seq of the pages read. start: url, site; snapshot: url, status_code, html."""
    return harvest(start, snapshot, max_pages, None, per_round, apartments_only, rounds)[0]


def harvest(
    start: DataFrame, snapshot: DataFrame, max_pages: int = 300, max_properties: int | None = 200, per_round: int = 50, apartments_only: bool = False, rounds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The pages read, as of ``crawl``, and their wide rows: matching the mode, once a listing, at most max_properties a site.

    A site whose budget of properties is met takes no further round.
    """
    spark = start.sparkSession
    _shared_folder(spark)
    sites = tables.site_table(spark).select(F.col("name").alias("site"), "country", "detail_patterns", "useful_words")  # a few fixed sites
    frontier = start.select("url", "site", F.lit(1).alias("rank"), F.lit(0).alias("generation")).distinct().checkpoint()
    read = frontier.limit(0).select("url", "site", "generation", F.lit("").alias("page_class"), F.lit(0).cast("long").alias("crawl_seq"))
    rows: DataFrame | None = None
    for generation in itertools.count(1) if rounds is None else range(1, rounds + 1):
        done = read.groupBy("site").agg(F.count("*").alias("n"))
        order = Window.partitionBy("site").orderBy("rank", "generation", "url")
        turn = frontier.join(tables.unseen(frontier.select("url"), read), "url").withColumn("turn", F.row_number().over(order)).join(done, "site", "left")
        turn = turn.filter((F.col("turn") <= per_round) & (F.coalesce("n", F.lit(0)) + F.col("turn") <= max_pages))
        if rows is not None and max_properties is not None:
            full = tables.dedupe_listings(rows).groupBy(F.col("data_source").alias("site")).count().filter(F.col("count") >= max_properties)
            turn = turn.join(full, "site", "left_anti")
        got = P.parse_html(turn.join(snapshot.select("url", "status_code", "html"), "url", "left").join(F.broadcast(sites), "site").withColumn("is_detail", S.detail_url(F.col("url"), F.col("detail_patterns"))))
        got = P.described(got).withColumn("page_class", P.page_class()).withColumn("crawl_seq", F.coalesce("n", F.lit(0)) + F.col("turn")).checkpoint()
        if got.isEmpty():
            break
        read = read.unionByName(got.select("url", "site", "generation", "page_class", "crawl_seq")).checkpoint()
        found = listing.extract(listing.stamped(got.filter("page_class = 'detail'"))).checkpoint()
        taken = listing.matches_mode(found, apartments_only)
        rows = (taken if rows is None else rows.unionByName(taken)).checkpoint()
        rejected = found.select(F.col("source_url").alias("url")).join(taken.select(F.col("source_url").alias("url")), "url", "left_anti")
        open_ = got.filter(F.col("page_class").isin("detail", "search")).join(rejected, "url", "left_anti")
        links = P.discovered(open_).join(open_.select("url", "site", "detail_patterns", "useful_words"), "url").filter(S.useful_url(F.col("link"), F.col("detail_patterns"), F.col("useful_words"), apartments_only))
        fresh = links.select(F.col("link").alias("url"), "site", F.when(S.detail_url(F.col("link"), F.col("detail_patterns")), 0).otherwise(1).alias("rank"), F.lit(generation).alias("generation")).distinct()
        frontier = frontier.unionByName(tables.unseen(fresh, frontier)).checkpoint()
    if rows is None:
        rows = listing.extract(listing.stamped(P.described(P.parse_html(start.limit(0).select("url", "site", F.lit("").alias("country"), F.lit(0).cast("long").alias("crawl_seq"), F.lit("").alias("html"))))))
    rows = tables.dedupe_listings(rows)
    return read, rows if max_properties is None else tables.top_per(rows, "data_source", ["crawl_seq"], max_properties).drop("rank")
