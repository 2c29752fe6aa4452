"""Sources and sinks: seed lists, JSON dumps, snapshots, robots rules, fetching, CSV and JSON lines."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from random import random
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"User-Agent": "listforge/1.0 (+research)", "Accept": "text/html,application/xhtml+xml", "Accept-Language": "es-AR,es;q=0.9,en;q=0.6"}
DUMP = "items array<struct<url:string,markdown:string,`metadata.title`:string>>"


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """url: distinct sorted URLs of a text file, without trailing slashes."""
    text = spark.read.text(path, wholetext=True)
    urls = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(https?://[^\s)]+)"), 1)).alias("url"))
    return urls.select(F.rtrim(F.trim("url"), F.lit("/")).alias("url")).distinct().orderBy("url")


def dumps(spark: SparkSession, path: str, source_rank: int) -> DataFrame:
    """source_rank, file, pos, url, markdown, title of all items; order is file name, then place in it."""
    raw = spark.read.schema(DUMP).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    items = raw.select("file", F.posexplode("items").alias("pos", "item"))
    text = lambda c: F.coalesce(F.col(f"item.`{c}`"), F.lit("")).alias(c.rpartition(".")[2])
    return items.select(F.lit(source_rank).alias("source_rank"), "file", "pos", text("url"), text("markdown"), text("metadata.title"))


def robots_texts(bases: Sequence[str], timeout: float = 20.0) -> dict[str, str]:
    """Host to robots.txt of some sites, for ``allowed``; a host whose file can't be read sets no bounds."""
    texts = {}
    for base in bases:
        parts = urlsplit(base)
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{parts.scheme}://{parts.netloc}/robots.txt", headers=HEADERS), timeout=timeout) as r:
                texts[parts.netloc.lower()] = r.read().decode("utf-8", "replace")
        except (OSError, ValueError):
            continue
    return texts


def allowed(urls: DataFrame, robots: dict[str, str], agent: str = "*") -> DataFrame:
    """Rows whose host's robots.txt lets them be read. robots: host to text; a host without one sets no bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = {}
        for host, text in robots.items():
            parsers[host] = RobotFileParser()
            parsers[host].parse(text.splitlines())
        at = names.index("url")
        for batch in batches:
            ok = [h not in parsers or parsers[h].can_fetch(agent, u) for u in batch.column(at).to_pylist() for h in [urlsplit(u or "").netloc.lower()]]
            yield batch.filter(pa.array(ok, pa.bool_()))

    names = urls.columns
    return urls.mapInArrow(run, urls.schema)


def fetch(urls: DataFrame, delay: float = 1.0, timeout: float = 20.0) -> DataFrame:
    """url, status_code, html: an error on the way gives nulls, a body that isn't HTML a null html. 

    A host's URLs go to one task, which waits delay and up to 35% more after
    each body, so no host is asked twice at a time. Write the result before
    using it: a plan that is run again fetches again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                status, html = None, None
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as r:
                        status = r.status
                        if "html" in r.headers.get("Content-Type", "").lower():
                            html = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                except urllib.error.HTTPError as e:
                    status = e.code
                    html = e.read().decode("utf-8", "replace") if "html" in e.headers.get("Content-Type", "").lower() else None
                except (OSError, ValueError):
                    pass
                rows.append((url, status, html))
                if html is not None:
                    time.sleep(delay * (1 + 0.35 * random()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))] if rows else [], ["url", "status_code", "html"])

    by_host = urls.select("url").repartition(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    return by_host.mapInArrow(run, "url string, status_code int, html string")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Only these columns, in this order, with a header; empty cells for nulls. As many files as partitions: a single file would go through one task."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
