"""Quality rules as weak supervision.

Each rule looks at a document's counts and votes good, bad or abstains. How
far each rule can be trusted is not set by hand: expectation-maximisation over
all documents' votes estimates, for each rule, how often it is right about good
and about bad documents, together with the share of good documents. A document
is kept if its posterior probability of being good reaches ``threshold``.

Votes are few per rule, so documents are summed into vote patterns (at most
3^rules, a bound that the input does not move); EM runs on those sums. The
posterior per pattern is one small table, joined back by broadcast.

Edge cases: a null or blank text has no words, fails the base rule and is not
kept. Very long texts are read whole. Repeated rows are judged one by one.
Extra columns are not carried by ``judge``; ``keep`` returns the columns of
documents alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm._common import durable, small_batches, trimmed

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
#: Frequent function words of the four languages in hand; a parameter of ``measure``.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "was", "de", "la", "et", "les", "des", "le", "que", "y", "el", "en", "los", "der", "die", "und", "das", "von", "zu")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_stop_words")
ROUNDS = 50
THRESHOLD = 0.5
#: How many rules ``votes`` has.
RULES = 8

def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def counts_of(text: str | None, stop_words: frozenset[bytes]) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII blanks only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    plain = raw.translate(None, b".,;:!?")
    stops = sum(w.lower() in stop_words for w in plain.split())
    marks = raw.count(b"!") + raw.count(b"?")
    upper, lower = (len(raw) - len(raw.translate(None, bytes(range(a, a + 26)))) for a in b"Aa")
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, lower, marks, stops)


def _measured(rows: DataFrame, held: str, texts: Callable[[pa.Array], pa.Array], stop_words: tuple[str, ...]) -> DataFrame:
    """The first column of rows, of which ``held`` is the schema, and COUNTS of the texts that are in the last one."""
    stops = frozenset(w.encode() for w in stop_words)
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counts_of(t.as_py(), stops) for t in texts(batch.columns[-1])]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [name, *COUNTS])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(trimmed(run), f"{held}, " + ", ".join(f"{c} long" for c in COUNTS))


def measure(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id and COUNTS of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _measured(rows, "doc_id long", lambda texts: texts, stop_words)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1).cast("int")


def votes() -> dict[str, Column]:
    """Rule name to its vote: 0 bad, 1 abstains, 2 good."""
    n, words = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_words")
    per_word = lambda c: F.col(c) / n
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / n
    return {
        "long_enough": _vote(words < 50, words >= 100),
        "few_symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "few_copied_lines": _vote(F.col("n_dup_lines") / lines > 0.2, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "few_repeats": _vote(per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.1),
        "word_length": _vote((length < 3) | (length > 12), (length >= 4) & (length <= 9)),
        "case": _vote(F.col("n_upper") / letters > 0.3, F.col("n_upper") / letters < 0.12),
        "few_marks": _vote(per_word("n_marks") > 0.2, per_word("n_marks") < 0.02),
        "function_words": _vote(per_word("n_stop_words") < 0.01, per_word("n_stop_words") > 0.05),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, per rule: how often right about bad, about good) by EM.

    A rule knows one fault, so it seldom votes against a bad document and hardly
    ever against a good one: EM starts there, and each rule carries ten
    imagined votes of that kind, which also fixes which class is which. An
    abstention says nothing.
    """
    m = len(patterns[0][0]) if patterns else 0
    share, right = 0.8, [(0.3, 0.97)] * m
    for _ in range(rounds):
        good, total, hit, cast = 8.0, 10.0, [[3.0, 9.7] for _ in range(m)], [[10.0, 10.0] for _ in range(m)]
        for pattern, n in patterns:
            p = posterior(pattern, share, right)
            good, total = good + p * n, total + n
            for j, v in enumerate(pattern):
                if v != 1:
                    cast[j][0] += (1 - p) * n
                    cast[j][1] += p * n
                    hit[j][v // 2] += ((1 - p) if v == 0 else p) * n
        share, right = good / total, [tuple(min(max(x / n, 0.001), 0.999) for x, n in zip(h, c)) for h, c in zip(hit, cast)]
    return share, right


def posterior(pattern: tuple[int, ...], share: float, right: list[tuple[float, float]]) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(share / (1 - share))
    for v, (bad, good) in zip(pattern, right):
        if v == 0:
            odds += math.log((1 - good) / bad)
        elif v == 2:
            odds += math.log(good / (1 - bad))
    return 1 / (1 + math.exp(-max(min(odds, 700), -700)))


def _coded(measured: DataFrame) -> DataFrame:
    """measured with pattern (its votes as one number) and base_failed."""
    code = sum((c * 3**j for j, c in enumerate(votes().values())), F.lit(0)).cast("int")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("pattern", code).withColumn("base_failed", base)


def _decode(pattern: int) -> tuple[int, ...]:
    return tuple(pattern // 3**j % 3 for j in range(RULES))


def _fitted(coded: DataFrame) -> tuple[list[int], float, list[tuple[float, float]]]:
    """The patterns that occur, and what ``fit`` finds in them."""
    found = [(r["pattern"], r["n"]) for r in coded.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()]  # 3^rules at most
    return [p for p, _ in found], *fit([(_decode(p), n) for p, n in found])


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, COUNTS, base_failed, p_good, kept of every row."""
    rows = durable(_coded(measure(docs)))
    found, share, right = _fitted(rows)
    scores = docs.sparkSession.createDataFrame([(p, posterior(_decode(p), share, right)) for p in found], "pattern int, p_good double")
    kept = ~F.col("base_failed") & (F.col("p_good") >= threshold)
    return rows.join(F.broadcast(scores), "pattern").select("doc_id", *COUNTS, "base_failed", F.round("p_good", 9).alias("p_good"), kept.alias("kept"))


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, columns unchanged. Each row is judged by its own text, whatever its doc_id: texts are measured twice, once to fit and once to filter, and no row is joined."""
    found, share, right = _fitted(_coded(measure(docs)))
    good = [p for p in found if posterior(_decode(p), share, right) >= threshold]
    at = docs.columns.index("text")
    doc = docs.select(F.struct("*").alias("doc"))
    held = _measured(doc, f"doc {doc.schema['doc'].dataType.simpleString()}", lambda d: d.field(at), STOP_WORDS)
    return _coded(held).filter(~F.col("base_failed") & F.col("pattern").isin(good)).select("doc.*")
