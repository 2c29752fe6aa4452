"""The pipeline's stages with null and shared doc_ids, against brute force."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from listforge.llm import bpe, minhash, mixing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in is that was a he it for on with as his at by from this".split()


def fixture():
    """A third of the rows under null, a third under one id, with near and exact copies, junk, nulls and blanks."""
    rng = np.random.default_rng(11)
    vocabulary = [f"word{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(3000)]

    def prose(n):
        return " ".join(COMMON[int(rng.integers(20))] if rng.random() < 0.3 else vocabulary[int(rng.integers(3000))] for _ in range(n)) + "\nend of it"

    texts = [prose(int(rng.integers(110, 240))) for _ in range(60)]
    texts += [t.replace(t.split()[7], "other", 1) for t in texts[:9]] + texts[9:15]
    texts += ["#" * 40 + " !!" * 30, "x", None, "", " \n ", None]
    return [([None, 7, 100 + i][i % 3], t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]


ROWS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_of(texts):
    """Group number of each text, None for empty sets, by brute force."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) if s else None for i, s in enumerate(sets)]


def test_quality_keeps_rows_by_their_own_text(docs):
    found = {}
    by_text = docs.select("text").distinct().collect()
    numbered = docs.sparkSession.createDataFrame([(i, r["text"]) for i, r in enumerate(by_text)], "doc_id long, text string")
    again = numbered.join(docs.select("text"), numbered["text"].eqNullSafe(docs["text"])).select("doc_id", numbered["text"])
    for r in quality.judge(again).collect():
        found[by_text[r["doc_id"]]["text"]] = r["kept"]
    want = collections.Counter(r for r in ROWS if found[r[1]])
    assert 0 < sum(want.values()) < len(ROWS) and counted(quality.keep(docs)) == want


def test_near_dedup_keeps_one_row_of_each_group(docs):
    groups = groups_of([r[1] for r in ROWS])
    got = counted(minhash.one_of_each(docs))
    assert not got - collections.Counter(ROWS)
    of = dict(zip((r[1] for r in ROWS), groups))
    kept = collections.Counter(of[r[1]] for r in got.elements())
    assert kept == collections.Counter({g: 1 for g in groups if g is not None}) + collections.Counter({None: groups.count(None)})


def test_mix_takes_each_row_as_often_as_planned(docs):
    planned = collections.Counter()
    for r in mixing.mix(docs).collect():
        planned[(r["source"], r["doc_id"], r["size"])] += r["copies"]
    got = collections.Counter()
    for r in mixing.mixed(docs).collect():
        got[(r["source"], r["doc_id"], len((r["text"] or "").split()))] += 1
    assert +planned == got and not set(counted(mixing.mixed(docs))) - set(ROWS)


def test_whole_pipeline(spark, docs, tmp_path):
    """Every stage on what the one before gave, and run(), by brute force."""
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def coded(doc_id, text):
        ids = np.array(own.encode_ordinary(text or ""), "<u4")
        return doc_id, len(ids), sha(ids.tobytes()), sha((text or "").encode())

    p = pii.Permutation(pii.KEY)
    rows, seen = list(ROWS), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
        if name == "byte_bpe":
            got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
            assert got == collections.Counter(coded(r[0], r[1]) for r in rows)
            break
        before, rows = rows, [tuple(r) for r in out.collect()]
        seen[name] = rows
        if name == "pii":
            assert collections.Counter(rows) == collections.Counter((i, pii.replaced(p, t)[0] if t else t, *rest) for i, t, *rest in before)
        elif name == "mixing":
            assert rows and set(rows) <= set(before)
        else:
            assert rows and not collections.Counter(rows) - collections.Counter(before)
        if name == "near_dedup":
            assert len(rows) == len({g for g in groups_of([r[1] for r in before]) if g is not None})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    able = {coded(i, pii.replaced(p, t)[0] if t else t): t for i, t, *_ in seen["quality_rules"]}
    assert set(got) <= set(able)
    texts = list({able[g] for g in got})
    groups = groups_of(texts)
    assert len(set(groups)) == len(groups)
    for shared in (None, 7):
        assert len({g for g in got if g[0] == shared}) > 5
