"""Decontamination, importance resampling and hard negatives against brute force and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import decontamination, fm_index, importance, negatives, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, source string, n_words int, spans string, items string, score double, able int, part int, place int"


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "x", "y", 0.5, 2, 3, 4) for r in rows], DOCS)


def test_suffixes_and_occurrences():
    rng = np.random.default_rng(0)
    for t in range(120):
        symbols = np.append(rng.integers(0, rng.integers(2, 5), rng.integers(1, 60)), 0)
        if t % 3 == 0:
            symbols = np.append(np.tile(symbols, 5), 0)
        ends = np.cumsum(symbols == 0)
        key = [(0, int(e)) if x == 0 else (1, int(x)) for x, e in zip(symbols, ends, strict=True)]
        order = sorted(range(len(symbols)), key=lambda i: key[i:])  # noqa: B023
        assert fm_index.suffix_array(symbols).tolist() == order
        index = fm_index.FMIndex(symbols, int(symbols.max()) + 1, 3)
        assert index.locate(np.arange(len(symbols))).tolist() == order
        for m in (1, 2, 3) if symbols.any() else ():
            patterns = rng.integers(1, symbols.max() + 1, (6, m))
            found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*index.search(patterns), strict=True)}
            for k, p in enumerate(patterns.tolist()):
                assert found.get(k, []) == [i for i in range(len(symbols)) if symbols[i : i + m].tolist() == p]


def test_slices_of_words():
    text = "Aa, b-c é1 " * 50 + "x" * 300 + " " * 40 + "end"
    assert [w.decode() for part in words.word_slices(text, 16) for w in part] == _words(text)
    for ahead in (0, 2, 7):
        parts = list(words.overlapping_slices(text, ahead, 16))
        assert [w.decode() for part, own in parts for w in part[:own]] == _words(text)
        assert all(len(part) - own == ahead for part, own in parts[:-1]) and parts[-1][1] == len(parts[-1][0])
    assert list(words.word_slices(None)) == [] and list(words.overlapping_slices("", 2)) == [([], 0)]


def _contaminated(docs, items, window=10):
    """Words, hit words and items of each text, and its words that are not hit, window by window."""
    phrases = collections.defaultdict(set)
    for item, text in items:
        said = _words(text) if item is not None else []
        for k in range(max(1, len(said) - window + 1) if said else 0):
            phrases[tuple(said[k : k + window])].add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for _, text in docs:
        said, hit, found = _words(text), set(), set()
        for k in range(len(said)):
            for n in sizes:
                items_of = phrases.get(tuple(said[k : k + n])) if k + n <= len(said) else None
                if items_of:
                    found |= items_of
                    hit |= set(range(k, k + n))
        out.append((len(said), len(hit), sorted(found), [w for k, w in enumerate(said) if k not in hit]))
    return out


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 40])
def test_decontamination_of_awkward_texts(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 12)
    rng = np.random.default_rng(1)
    long = " ".join(rng.choice(["ab", "ba", "é", "Q1"], 400))
    items = [(1, "a b c d e f g h i j k l"), (2, "A b, c d e f g h i j!"), (3, "short one"), (3, "other row of an item"), (4, None), (5, "..."), (None, "null id here"), (6, long[300:420]), (7, "zz"), (7, "zz")]
    rows = [
        (1, "x a b c d e f g h i j k l y"), (2, None), (3, ""), (None, "A-B-c d e f g h i j"), (5, "SHORT one, short  one short"), (5, "SHORT one, short  one short"),
        (6, "a b c d e f g h i x j"), (7, long), (8, "zz " * 500 + "other row of an item " * 3), (9, "null id here"), (10, "é🙂 other\nrow of an item🙂 ѐ other row of an item"),
    ]
    got = decontamination.decontaminate(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), texts=True).collect()
    want = collections.Counter((d, *map(str, x)) for (d, _), x in zip(rows, _contaminated(rows, items), strict=True))
    assert collections.Counter((r["doc_id"], *map(str, (r["n_words"], r["n_hit"], r["items"], _words(r["text"])))) for r in got if r["doc_id"] != 10) == want - collections.Counter({k: 1 for k in want if k[0] == 10})
    texts = dict(rows)
    for r in got:
        assert r["spans"] or r["text"] == texts[r["doc_id"]]
        for s in r["spans"]:
            assert _words(texts[r["doc_id"]][s["start"] : s["end"]]) == _words(texts[r["doc_id"]])[s["first"] : s["last"] + 1]
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["spans"][:-1], r["spans"][1:], strict=True))


def test_decontamination_without_rows(spark):
    docs, items = _docs(spark, [(1, "some text")]), spark.createDataFrame([(1, None)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.decontaminate(docs, items).collect()] == [(1, 2, 0, [], [])]
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


def _weights(docs, target):
    runs = lambda said: [" ".join(said[k : k + n]).encode() for n in (1, 2, 3) for k in range(len(said) - n + 1)]
    counts = []
    for texts in (docs, target):
        found = np.zeros(importance.BUCKETS, np.int64)
        for text in texts:
            for run in runs(_words(text)):
                found[zlib.crc32(run) % importance.BUCKETS] += 1
        counts.append(found.tolist())
    (s, t), big = counts, [sum(x) + importance.BUCKETS for x in counts]
    gains = [math.floor(1000 * math.log((b + 1) * big[0] / ((a + 1) * big[1]))) for a, b in zip(s, t, strict=True)]
    return [(len(runs(_words(x))), sum(gains[zlib.crc32(f) % importance.BUCKETS] for f in runs(_words(x)))) for x in docs]


def _drawn(docs, weights):
    scores = []
    for (doc_id, _), (n, weight) in zip(docs, weights, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scores.append((doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x, (_, text) in zip(scores, docs, strict=True) if len(_words(text)) >= 20), key=lambda x: (-x[3], x[0] is not None, x[0]))
    return scores, [(*x, k + 1) for k, x in enumerate(able[: 5 * len(able) // 100])]


def test_resampling(spark, sf_dir):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    target = [x for (x,) in con.execute(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    scores, ranked = _drawn(docs, _weights([x for _, x in docs], target))
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.op12_importance_resampling(spark, sf_dir).collect()]
    assert sorted(x[:4] for x in got) == sorted(scores)
    assert sorted((x for x in got if x[4]), key=lambda x: x[4]) == ranked


def test_resampling_of_awkward_texts(spark):
    rows = [(k % 60, "tie of words that all of them have " * 3) for k in range(240)] + [(900, None), (901, ""), (902, "one"), (903, "Two words"), (None, "no id " * 30), (904, "é🙂 x" * 9000)]
    target = spark.createDataFrame([("ties of WORDS",), (None,), ("no id",)], "text string")
    scores, ranked = _drawn(rows, _weights([x for _, x in rows], ["ties of WORDS", None, "no id"]))
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(_docs(spark, rows), target).collect()]
    assert collections.Counter(x[:4] for x in got) == collections.Counter(scores)
    assert sorted((x for x in got if x[4]), key=lambda x: x[4]) == ranked
    assert importance.resample(_docs(spark, rows).limit(0), target.limit(0)).count() == 0


def test_tries_of_shards(monkeypatch):
    monkeypatch.setattr(importance, "SHARD_WORDS", 7)
    monkeypatch.setattr(importance, "overlapping_slices", lambda text, ahead: words.overlapping_slices(text, ahead, 9))
    texts = ["a b a b a b a c", None, "", "a b a", "long " * 40, "b"]
    counts = np.zeros(1000, np.int64)
    sums = np.zeros((2, len(texts)), np.int64)
    gains = np.random.default_rng(0).integers(-50, 50, 1000)
    for of, own, trie in importance._tries(iter(texts)):
        counts += trie.bucket_counts(1000)
        np.add.at(sums[0], of, own)
        np.add.at(sums[1], of, trie.part_sums(gains)[1])
    want = np.zeros(1000, np.int64)
    for k, text in enumerate(texts):
        said = _words(text)
        runs = [zlib.crc32(" ".join(said[i : i + n]).encode()) % 1000 for n in (1, 2, 3) for i in range(len(said) - n + 1)]
        np.add.at(want, runs, 1)
        assert (sums[0, k], sums[1, k]) == (len(said), sum(gains[x] for x in runs))
    assert counts.tolist() == want.tolist()


def _negatives(rows, anchors):
    out = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        scores = [(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), b, k == label) for b, k, y in rows if b != a]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            inside = [s for s in scores if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, positive, k + 1, b, p, s) for k, (s, b, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("scale", [9, 10**9])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "UNIT_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.integers(-scale, scale, (6, 5))
    # a third of the rows has one label, many are equal
    rows = [(k, 0 if k % 3 == 0 else int(rng.integers(1, 4)), (centres[rng.integers(6)] + (rng.integers(-2, 3, 5) if k % 4 else 0)).tolist()) for k in range(400)]
    df = spark.createDataFrame([(a, b, [float(v) for v in x], "z", 1) for a, b, x in rows], "vec_id long, label long, vector array<double>, cell string, unit int")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = [(*x[:4], *(min(v, 2**63 - 1) for v in x[4:])) for x in _negatives(rows, set(range(0, 400, 10)))]
    if scale < 10:
        assert sorted(map(tuple, got.collect())) == want and want
    else:  # scores beyond what a double holds are exact as well
        assert sorted(map(tuple, got.collect())) == want and max(x[4] for x in want) > 2**55


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.7, 0.0]), (2, 2, [0.7, 0.0]), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]),
        (6, 2, None), (7, 2, [1.0, None]), (8, 2, []), (9, 2, [0.6]), (50, 3, [0.0, 0.0]), (51, 3, [0.0, 0.0]), (52, 1, [-0.1, 0.0]), (53, 4, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, negatives.mine(negatives.quantised(df), F.col("vec_id") % 50 == 0).collect()))
    # of 0 the positives are 1 and 52, the latter below 0; of 50 it is 51 at 0, and all are 0 to it
    assert got == [(0, 1, 1, 2, 65536, 45824), (50, 51, 1, 0, 0, 0), (50, 51, 2, 1, 0, 0), (50, 51, 3, 2, 0, 0)]
    assert negatives.mine(negatives.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    alone = negatives.quantised(df.where("vec_id = 0"))
    assert negatives.mine(alone, F.col("vec_id") % 50 == 0).count() == 0
