"""Mixing sources to target weights by entropy balancing.

Document rates r = min(3, exp(lam * size / scale)) are the exponential tilts
that stay nearest (in relative entropy) to taking every document once while a
source's expected words meet its target. One dual variable per source is
solved by safeguarded Newton steps, all sources at once: each iteration is one
aggregation over the (source, size) histogram joined with the current duals,
and the next duals are checkpointed. Rates then become whole copies: the whole
part, plus one for the documents whose hashed uniform lies below a per-source
cut, set so that the words taken come nearest to the target.

No Python runs on executors. A hot source is only ever summed (map-side
combined), and each row meets its source's few numbers by broadcast (up to
``FEW`` sources, checked) or over salts, so no task gets a whole source. Cuts
are found from 4096 bins a source, and only the one bin that a cut falls into
is sorted. Targets take one row for each source through a window.

Edge cases: a null text has size 0 and is taken with nothing; sources sort by
code point with the null source last; a source of no words has target 0;
repeated rows are rows of their own and tie in any order of equal outcome
(same id, same size). Empty tables give no rows. Other columns are not
carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm._common import durable, word_count

MOST = 3
BINS = 4096
ITERATIONS = 60
TOLERANCE = 1e-8
#: Sources up to which a row for each is broadcast (some MB); with more, joins are salted.
FEW, SALTS = 1 << 15, 64


def source_key() -> Column:
    """Never null, orders as the source."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col("source")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (never null, orders as the source), size in words."""
    return docs.select("doc_id", "source", source_key().alias("key"), word_count(F.col("text")).alias("size"))


def attach(rows: DataFrame, small: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns that small has for their key: by broadcast where sources are few, else by a join over salts, so that a hot source's rows stay in many tasks."""
    if few:
        return rows.join(F.broadcast(small), "key", how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return own.join(salted, ["key", "salt"], how).drop("salt")


def targets(histogram: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """key, source_size, target and moments: shares of all words by weight, none above 3 times the source.

    Filling up by weight under caps has one solution, min(cap, level * weight);
    the level follows from running sums in order of cap / weight. This window
    spans all sources: one row each.
    """
    n = F.col("size") * F.col("docs")
    by = histogram.groupBy("key").agg(F.sum(n).alias("source_size"), F.sum("docs").alias("docs"), F.sum(n * F.col("size")).alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    every = Window.partitionBy()
    named = by.withColumn("nulls", (F.col("key") == "n").cast("int"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("nulls", "key"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("w", w).withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("all_words", F.sum("source_size").over(every))
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "nulls", "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = named.withColumn("caps_before", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(up), F.lit(0))).withColumn("w_all", F.sum("w").over(every))
    level = (F.col("all_words") - F.col("caps_before")) / (F.col("w_all") - F.col("w_before"))
    # The first source, in this order, that the level leaves below its cap sets the level for all after it.
    fits = F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("nulls"), F.col("key"), level.alias("level")))
    found = rest.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return found.select("key", "source_size", "docs", "squares", "least", target.alias("target"))


def solve(histogram: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """key, source_size, docs, target, scale, lam: Newton on each source's dual, kept within a shrinking bracket."""
    # A source without words has no scale and no dual: try_divide leaves them null.
    ratio = F.try_divide("target", "source_size")
    x_least = F.try_divide("least", "scale")
    state = goals.withColumn("scale", F.try_divide("squares", "source_size")).withColumn("full", (F.col("source_size") > 0) & (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)))
    state = state.withColumn("lo", F.when(ratio < 1, F.try_divide(F.log(ratio), x_least)).otherwise(0.0)).withColumn("hi", F.when(ratio < 1, F.lit(0.0)).otherwise(F.try_divide(F.log(F.lit(float(MOST))), x_least)))
    state = state.withColumn("lam", F.when(ratio < 1, F.greatest(F.col("lo"), F.log(ratio))).otherwise(F.least(F.col("hi"), F.log(ratio)))).withColumn("gap", F.lit(1.0))
    state = durable(state.withColumn("done", F.col("full") | (F.col("source_size") == 0) | (F.col("target") <= 0)))
    keep = [c for c in state.columns if c not in ("lo", "hi", "lam", "gap", "done")]
    for _ in range(ITERATIONS):
        if state.filter(~F.col("done")).isEmpty():
            break
        x = F.try_divide("size", "scale")
        tilt = F.exp(F.col("lam") * x)
        words = F.col("size") * F.col("hist_docs")
        open_ = state.filter(~F.col("done")).select("key", "lam", "scale")
        sums = attach(histogram.withColumnRenamed("docs", "hist_docs"), open_, few).groupBy("key").agg(F.sum(words * F.least(F.lit(float(MOST)), tilt)).alias("f"), F.sum(F.when(tilt < MOST, words * tilt * x).otherwise(0.0)).alias("slope"))
        step = F.col("lam") - F.try_divide(F.col("f") - F.col("target"), F.col("slope"))
        lo, hi = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("f") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
        joined = (state.join(F.broadcast(sums), "key", "left") if few else state.join(sums, "key", "left")).withColumn("lo2", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi2", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        gap = F.try_divide(F.abs(F.col("f") - F.col("target")), F.col("target"))
        inside = (F.col("slope") > 0) & (step > F.col("lo2")) & (step < F.col("hi2"))
        stop = gap < TOLERANCE
        lam = F.when(F.col("done") | stop, F.col("lam")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = durable(joined.select(*keep, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), lam.alias("lam"), F.coalesce(gap, F.col("gap")).alias("gap"), (F.col("done") | stop | (F.col("hi2") - F.col("lo2") < 1e-14)).alias("done")))
    if not state.filter(~F.col("done")).isEmpty():
        raise ArithmeticError(f"a source has not met its target in {ITERATIONS} steps")
    # Sums of doubles depend on their order in the last bits; rounding makes reruns agree.
    return state.select("key", "source_size", "docs", "target", "scale", "full", F.round("lam", 9).alias("lam"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of docs."""
    rows = durable(sized(docs))
    histogram = durable(rows.groupBy("key", "size").agg(F.count("*").alias("docs")))
    goals = durable(targets(histogram, weights))
    few = goals.count() <= FEW
    solved = durable(solve(histogram, goals, few))
    rate = F.when(F.col("full"), F.lit(float(MOST))).when((F.col("target") <= 0) | F.col("lam").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.col("lam") * F.try_divide("size", "scale"))))
    rated = attach(rows, solved, few).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    uniform = F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = rated.withColumn("v", uniform - (F.col("rate") - F.col("whole"))).withColumn("spare", (F.col("whole") < MOST) & (F.col("size") > 0))
    # Documents above the mean size are decided by their hash, the smaller ones then make up what is missing.
    large = F.col("size") * F.col("docs") > F.col("source_size")
    bin_ = F.when(large & (F.col("v") < 0), -1).when(large, BINS).otherwise(F.floor((F.col("v") + 1) * (BINS // 2)).cast("int"))
    rated = rated.withColumn("bin", F.when(F.col("spare"), bin_))
    sums = rated.groupBy("key", "bin").agg(F.sum(F.col("whole") * F.col("size")).alias("whole_words"), F.sum("size").alias("bin_words"))
    owed = sums.groupBy("key").agg(F.sum("whole_words").alias("whole_words"))
    run = Window.partitionBy("key").orderBy("bin")
    upto = sums.filter("bin is not null").withColumn("upto", F.sum("bin_words").over(run))
    cuts = owed.join(upto.drop("whole_words"), "key", "left").join(solved.select("key", "target"), "key")
    miss = F.col("target") - F.col("whole_words")
    # The last bin that fits whole; what is then missing is taken from the next one.
    cuts = cuts.groupBy("key").agg(F.max(F.when(F.col("upto") <= miss, F.col("bin"))).alias("last_bin"), F.min(F.when(F.col("upto") > miss, F.col("bin"))).alias("cut_bin"), F.min(miss).alias("miss"), F.max(F.when(F.col("upto") <= miss, F.col("upto"))).alias("fitted"))
    cuts = durable(cuts.select("key", F.coalesce("last_bin", F.lit(-2)).alias("last_bin"), "cut_bin", (F.col("miss") - F.coalesce("fitted", F.lit(0))).alias("left_over")))
    placed = attach(rated, cuts, few)
    edge = placed.filter(F.col("bin") == F.col("cut_bin"))
    order = Window.partitionBy("key").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("more", (F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("left_over")).cast("long"))
    sure = placed.filter(F.col("bin").isNull() | F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).withColumn("more", F.coalesce((F.col("bin") <= F.col("last_bin")).cast("long"), F.lit(0)))
    both = sure.unionByName(edge)
    copies = F.col("whole") + F.col("more")
    return both.select("doc_id", "source", "size", "source_size", "target", F.round("rate", 9).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _alike(df: DataFrame, *columns: Column) -> DataFrame:
    """columns, and what rows share that the mix cannot tell apart: source, doc_id and size. None of these four is null."""
    own = F.col("doc_id")
    return df.select(*columns, F.col("key").alias("key"), own.isNull().alias("no_id"), F.coalesce(own, F.lit(0).cast(df.schema["doc_id"].dataType)).alias("id"), F.col("size").alias("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, columns unchanged.

    Rows of one source, doc_id and size have copies that differ by one at most;
    the rows of that kind that get one more are the first by their texts' hash.
    So each row has its own copies, also where the doc_id is null or shared.
    """
    group = ["key", "no_id", "id", "size"]
    taken = mix(docs, weights).withColumn("key", source_key())
    n = F.col("copies")
    copies = _alike(taken, n).groupBy(*group).agg(F.min(n).alias("each"), (F.sum(n) - F.count("*") * F.min(n)).alias("extra"))
    own = docs.select(F.struct("*").alias("doc"), "doc_id", source_key().alias("key"), word_count(F.col("text")).alias("size"))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(*group, F.xxhash64("doc.text")))
    rows = _alike(own, F.col("doc")).join(copies, group).withColumn("copies", F.col("each") + (turn <= F.col("extra")).cast("long")).filter("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
