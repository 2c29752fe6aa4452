"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Hosts are nested in registered domains and those in suffixes. Labelled page
outcomes are counted once per host; domain and suffix counts are sums of
those. Each level's beta prior has its parent's posterior mean and a strength
fitted by moments to the spread of the level's rates around their parents', so
an unlabelled host inherits its domain's reputation. A page is blocked when the
upper bound of its host's share of good pages, a quantile of the beta
posterior, lies below ``threshold``.

A suffix is the longest of ``suffixes`` that ends the host's name, else its
last label; the registered domain is one label more. Ports and user names are
no part of a name. An address (IPv4 or in brackets) is its own domain and
suffix.

All is DataFrame expressions but the quantile, one Arrow pass over hosts. Only
hosts' counts are shuffled; three prior strengths and one mean are the only
values that reach the driver.

Edge cases: a null url or one without ``://`` has empty host and path, and the
empty host is judged like any other. Urls of any length are read whole. Pages
or labels that are repeated count each time. Labels with a null outcome count
for nothing. Of rules that fit, the longest wins, of equally long ones the last
by code point; more than ``MOST_RULES`` rules raise. With no labels at all the
mean is one half and nothing is blocked but by rule. An empty table of pages
gives no rows. Extra columns of ``pages``, whatever their names, are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm._common import ascii_lower, durable

Rule = tuple[str, str, str]  #: verdict, host, path prefix
#: The chain of rules is unrolled into one expression.
MOST_RULES = 1000
LEVEL, THRESHOLD, WEAKEST, STRONGEST = 0.95, 0.5, 1.0, 1000.0
#: Suffixes of two labels under which names are registered; a parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.ar", "com.uy", "com.br", "com.mx", "com.au", "co.jp", "co.nz", "co.za", "co.in")


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host, path = F.regexp_extract(after, r"^[^/?#]*", 0), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", ascii_lower(host).alias("host"), path.alias("path"))


def matched_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def nested(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))
    address = name.rlike(r"^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    suffix, domain = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    for known in sorted(suffixes, key=lambda x: (x.count("."), x)):
        n = known.count(".") + 1
        fits = (name == known) | name.endswith("." + known)
        suffix, domain = F.when(fits, F.lit(known)).otherwise(suffix), F.when(fits, F.substring_index(name, ".", -(n + 1))).otherwise(domain)
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def strength(children: DataFrame) -> float:
    """Beta prior strength by moments. children: n, k and their parent's mean p.

    Counts spread around n p by n p (1 - p) (1 + (n - 1) / (strength + 1)).
    """
    p, n = F.col("p"), F.col("n")
    noise = n * p * (1 - p)
    row = children.filter("n > 0").agg(F.sum(F.pow(F.col("k") - n * p, 2)).alias("s"), F.sum(noise).alias("a"), F.sum(noise * (n - 1)).alias("b")).first()
    if not row["b"] or row["s"] <= row["a"]:
        return STRONGEST
    return min(max(row["b"] / (row["s"] - row["a"]) - 1, WEAKEST), STRONGEST)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction from the nearer end."""
    log_gamma = np.vectorize(lgamma, otypes=[float])
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            out *= d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(turned, 1 - front * out, front * out)


def beta_quantile(level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < level
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high


def reputation(split: DataFrame, labels: DataFrame, level: float = LEVEL, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, k, reputation (posterior mean), bound (upper) for every host."""
    good = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    marks = labels.select(F.col("doc_id").alias("labelled_id"), good.alias("good")).filter("good is not null")
    hosts = split.select("page_id", "host").join(marks, F.col("page_id") == F.col("labelled_id"), "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    domain, suffix = nested(F.col("host"), suffixes)
    hosts = durable(hosts.withColumns({"domain": domain, "suffix": suffix}))
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = durable(hosts.groupBy("domain", "suffix").agg(*counts))
    suffixes_ = domains.groupBy("suffix").agg(*counts)
    total = domains.agg(*counts).first()
    shrunk = lambda m: (F.col("k") + m * F.col("p")) / (F.col("n") + m)
    suffixes_ = suffixes_.withColumn("p", F.lit(((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)))
    by_suffix = suffixes_.select("suffix", shrunk(strength(suffixes_)).alias("p"))
    domains = domains.join(by_suffix, "suffix")
    by_domain = domains.select("domain", shrunk(strength(domains)).alias("p"))
    hosts = durable(hosts.select("host", "domain", "n", "k").join(by_domain, "domain"))
    m = strength(hosts)
    rated = hosts.select("host", "n", "k", (F.col("k") + m * F.col("p")).alias("a"), (F.col("n") - F.col("k") + m * (1 - F.col("p"))).alias("b"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(a / (a + b)), pa.array(beta_quantile(level, a, b))], ["host", "n", "k", "reputation", "bound"])

    return rated.mapInArrow(bounds, "host string, n long, k long, reputation double, bound double")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], level: float = LEVEL, threshold: float = THRESHOLD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, bound of every row of pages."""
    split = split_url(pages)
    rule, verdict = matched_rule(rules)
    # A hot host's pages meet one small row: AQE splits that side of the join.
    judged = split.join(reputation(split, labels, level, suffixes), "host", "left")
    own = F.when(F.col("bound") < threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("reputation", 6).alias("reputation"), F.round("bound", 6).alias("bound"))
