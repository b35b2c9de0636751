"""Values on awkward rows, hot groups and held-out rows, and independent versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import chat, fingerprints, licenses, mixing, near_dedup, neighbours, packing, pii, quality, registry, scratch, tokenizing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(result.fetchall())


def _replaced(spark, texts):
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    return [(r["text"], r["n_entities"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_pii_names_keep_their_references(spark):
    one, other, alone, plain = _replaced(spark, [
        "Mrs. Anna Smith met Ms. Smith. Anna Smith, then Dr. Anna Smith and Mr. ANNA Smith; smiths and Smithson stay.",
        "Dr. Anna Smith, and Herr Prof. Dr. Jan O'Brien-Müller; O'Brien-Müller. MR. J. SMITH",
        "Frau Weber und Frau Weber-Smith, Г-н Иванов и Иванов",
        "Anna Smith walked. Mister Brown and the doctor came; Missouri is far, Drachen fly.",
    ])
    found = re.fullmatch(r"Mrs\. (\w+) (\w+) met Ms\. (\w+)\. (\w+) (\w+), then Dr\. (\w+) (\w+) and Mr\. (\w+) (\w+); smiths and Smithson stay\.", one[0])
    given, surname = found[1], found[2]
    assert found.groups() == (given, surname, surname, given, surname, given, surname, given.upper(), surname) and one[1] == 5
    assert given in pii.GIVEN_NAMES["latin", "f"].split() and not {"Anna", "Smith"} & {given, surname}
    # a title that tells no gender takes it from elsewhere, and other documents' names are the same
    second = re.fullmatch(rf"Dr\. {given} {surname}, and Herr Prof\. Dr\. (\w+) (\w+); \2\. MR\. J\. {surname.upper()}", other[0])
    assert second and other[1] == 4 and second[1] in pii.GIVEN_NAMES["latin", "m"].split()
    third = re.fullmatch(r"Frau (\w+) und Frau (\w+), Г-н ([Ѐ-ӿ]+) и \3", alone[0])
    assert third and third[1] != third[2] and alone[1] == 4
    assert plain == ("Anna Smith walked. Mister Brown and the doctor came; Missouri is far, Drachen fly.", 0)


def test_pii_of_many_names_stays_distinct(spark):
    rng = np.random.default_rng(1)
    names = sorted({f"{a}{b} {c}{d}" for a, b, c, d in zip(*(rng.choice(["Ba", "Ke", "Lo", "Mi", "Nu", "Ra"], 400) if k % 2 == 0 else rng.choice(["lan", "tor", "vik", "son", "den", "mar"], 400) for k in range(4)), strict=True)})
    got = [re.fullmatch(r"Herr (\w+ \w+)", t)[1] for t, _ in _replaced(spark, [f"Herr {x}" for x in names])]
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_pii_numbers(spark):
    texts = [
        "+1 (469) 555-8958 or 469-555-8958, +44 20 7946 0958", "DE89370400440532013000 and DE89 3704 0044 0532 0130 00", "bad DE00370400440532013000 stays",
        "2001:db8::1 or 2001:DB8:0:0:0:0:0:1, fe80::1.", "std::vector at 12:30:45, 00:1a:2b:3c:4d:5e, a ratio 3:4", "123-45-6789 at 8.8.8.8",
    ]
    phones, ibans, bad, v6, clean, reserved = _replaced(spark, texts)
    found = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \1-\2-\3, \+44 \d\d \d{4} \d{4}", phones[0])
    assert found and found[1] != "469" and phones[1] == 3
    iban = re.fullmatch(r"(DE\d{20}) and ((?:\w{4} ){5}\d\d)", ibans[0])
    assert iban[1] == iban[2].replace(" ", "") and int(iban[1][4:] + "1314" + iban[1][2:4]) % 97 == 1 and iban[1] != "DE89370400440532013000"
    assert bad == (texts[2], 0) and clean == (texts[4], 0)
    six = re.fullmatch(r"(2001:db8(?::[0-9a-f]{1,4}){6}) or (2001:DB8(?::[0-9A-F]{1,4}){6}), (2001:db8(?::[0-9a-f]{1,4}){6})\.", v6[0])
    assert six and six[1] == six[2].lower() != six[3]
    assert re.fullmatch(r"9\d\d-\d\d-\d{4} at 24\d|25[0-4](?:\.\d+){3}", reserved[0]) or re.fullmatch(r"9\d\d-\d\d-\d{4} at 2[45]\d(?:\.\d+){3}", reserved[0])


def test_pii_of_clean_texts(spark):
    texts = ["", "no entity here: 12, 3.5 and 2024-05-01", "Miss", "version 1.2.3 of 10:20", "Sr. y Sra.", "word " * 50_000, "Mr. and Mrs. go", "é" * 100_000]
    assert _replaced(spark, texts) == [(t, 0) for t in texts]
    long = "x " * 100_000 + "joe@x.org"
    ((new, n),) = _replaced(spark, [long])
    assert n == 1 and new.startswith("x " * 100_000) and "joe@x.org" not in new


def test_license_operands():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES)
    tag = "SPDX-License-Identifier:"
    wanted = {
        f"{tag} NONE": ("", 0.0), f"{tag} NOASSERTION": ("", 0.0), f"{tag} see LICENSE": ("", 0.0), f"{tag} the file": ("", 0.0),
        f"{tag} LicenseRef-Own-1.0": ("licenseref-own-1.0", 1.0), f"{tag} GPL-2.0-only WITH Classpath-exception-2.0": ("gpl", 1.0),
        f"{tag} MIT (see LICENSE)": ("mit", 1.0), f"{tag} 0BSD OR BSD-3-Clause": ("0bsd,bsd", 1.0),
    }
    assert {text: (scanner.scan(text)[5], scanner.scan(text)[6]) for text in wanted} == wanted


def test_license_scan_of_awkward_texts(spark):
    rows = [(1, None), (2, ""), (None, "MIT License"), (4, "x " * 200_000 + "Apache\n--license"), (5, "mit licenseé"), (5, "CC-BY cc BY")]
    got = {(r["doc_id"], r["n_words"]): tuple(r[2:7]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, 0): (0, None, None, "", ""), (2, 0): (0, None, None, "", ""), (None, 2): (1, 0, 0, "mit", "mit"),
        (4, 200_002): (1, 200_000, 200_000, "apache", "apache"), (5, 2): (0, None, None, "", ""), (5, 4): (2, 0, 2, "cc-by", "cc-by"),
    }


def test_alike_pieces_are_dealt_to_all_groups(spark):
    rows = spark.range(4000).selectExpr("CAST(NULL AS long) doc_id", "0 piece", "0L start", "30L length", "7L ids_crc32")
    got = packing.pack(rows, capacity=100, group_pieces=500, most_rounds=1).toPandas()
    groups = collections.Counter((got.sequence_id // (1 << 24)).tolist())
    assert len(groups) == 8 and max(groups.values()) < 1000
    whole = packing.pack(rows, capacity=100, group_pieces=500)
    found = packing.certificate(whole, 100)
    assert found == packing.Certificate(1334, 1334) and found.gap == 0


def test_packing_of_awkward_texts(spark):
    rows = [(1, None), (1, None), (None, ""), (3, "word " * 9000)]
    got = sorted(map(tuple, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizing.word_bpe_path()).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
    end = zlib.crc32(np.array([1], "<u4").tobytes())
    ids = np.array([*tokenizing.encoder(tokenizing.word_bpe_path()).tokenizer.encode("word " * 9000, add_special_tokens=False).ids, 1], "<u4")
    parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
    wanted = [(1, 0, 0, 1, end)] * 2 + [(None, 0, 0, 1, end)] + [(3, k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]
    assert got == sorted(wanted, key=repr)


def _slow_digest(data: bytes) -> str:
    """The fingerprint byte by byte."""
    counts = [0] * 128
    table = fingerprints._TABLES.tolist()
    for at in range(len(data)):
        for (a, b, c), salt in (((0, 1, 2), 0), ((0, 1, 3), 41), ((0, 2, 3), 86)):
            if at + c < len(data):
                counts[(table[0][data[at + a]] ^ table[1][data[at + b]] ^ table[2][data[at + c]]) ^ salt] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    code = sum(((x > q1) + (x > q2) + (x > q3)) << (2 * k) for k, x in enumerate(counts))
    length = 0
    while length < 255 and (1 + len(data)) > 1.15 ** (length + 0.5):
        length += 1
    head = bytes([length, *((q1 * 15 // q3, q2 * 15 // q3) if q3 else (0, 0))])
    return (head + code.to_bytes(32, "little")).hex()


def test_fingerprints_byte_by_byte(spark, sf_dir):
    texts = [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{sf_dir}/documents.parquet' WHERE length(text) < 3000 ORDER BY doc_id LIMIT 60").fetchall()]
    for text in [*texts, None, "", "a", "abc", "abcd", "é🙂"]:
        assert fingerprints.digest(text) == _slow_digest((text or "").encode())


def test_followed_fingerprints_of_awkward_rows(spark):
    long = "ab " * 60_000
    rows = [(1, "one two"), (2, None), (3, ""), (None, "nobody follows"), (5, long), (5, "zz"), (9, "last")]
    got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in fingerprints.followed_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [(1, "one two"), (2, ""), (3, ""), (5, long), (5, "zz"), (9, "last")]
    wanted = {}
    for k, (doc_id, text) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        wanted[doc_id, len(text)] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    wanted[None, 14] = hashlib.sha256(b"nobody nobody ").hexdigest()
    assert got == wanted


def test_quality_of_held_out_rows(spark):
    """On rows that no label was learned from."""
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op8_quality_classifier(spark, folder).collect() if r["held_out"]}
    labels = duckdb.connect().execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    good, bad = ([rows[k]["score"] for k, q in labels if k in rows and q == want] for want in (1, 0))
    assert len(good) > 20 and len(bad) > 10
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    right = [s >= 0.3 for s in good] + [s < 0.3 for s in bad]
    assert np.mean([s >= 0.3 for s in good]) >= 0.97 and np.mean(right) >= 0.9


def test_quality_scores_are_of_whole_texts(monkeypatch):
    net = quality.Network.new(3)
    texts = [b"", b"a", b"abc " * 100, bytes(range(1, 256)) * 40, b"x" * 5000 + b"end of it"]
    whole = quality.scores(net, texts)
    monkeypatch.setattr(quality, "SLICE", 256)
    assert np.allclose(quality.scores(net, texts), whole)
    # the last chunk counts as much as the first
    assert quality.scores(net, [texts[4]])[0] != quality.scores(net, [texts[4][:-9]])[0]


def _fair(sizes, weights):
    """Targets by weight in exact fractions, none above 3 times its size: one source is settled at a time."""
    left, open_, out = Fraction(sum(sizes)), list(range(len(sizes))), {}
    while open_:
        share = left / sum(weights[k] for k in open_)
        k = min(open_, key=lambda k: Fraction(3 * sizes[k], weights[k]))
        if share * weights[k] <= 3 * sizes[k]:
            return [float(out[k]) if k in out else float(share * weights[k]) for k in range(len(sizes))]
        out[k] = Fraction(3 * sizes[k])
        left -= out[k]
        open_.remove(k)
    return [float(out[k]) for k in range(len(sizes))]


def test_targets_are_fair():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20):
        sizes = (10 ** rng.uniform(0, 6, n)).astype(int).tolist()
        weights = [1 + k % 3 for k in range(n)]
        assert mixing.targets(sizes, weights) == pytest.approx(_fair(sizes, weights))
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_taken_words_slot_by_slot(spark, sf_dir):
    """Every slot's words counted one by one, documents in the order of their hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    known = collections.defaultdict(list)
    for r in docs.select("source", "doc_id", "text", F.xxhash64("text").alias("t")).withColumn("h", F.xxhash64("doc_id", "t")).collect():
        known[r["source"]].append((r["h"], r["doc_id"], len(WORD.findall(r["text"] or ""))))
    sources = sorted(known, key=lambda s: (s is None, s or ""))
    plans = mixing.plan_mix(mixing.sized(docs))
    assert [p.source for p in plans] == sources and [p.target for p in plans] == pytest.approx(_fair([sum(n for *_, n in known[s]) for s in sources], [1 + k % 3 for k in range(len(sources))]))
    owners = []
    for s in sources:
        owners.append([doc_id for _, doc_id, n in sorted(known[s]) for _ in range(n)])
    taken, seen = collections.Counter(), collections.Counter()
    for r in mixing.slots(spark, plans).collect():
        taken.update(owners[r["number"]][128 * r["block"] : 128 * r["block"] + r["take"]])
        seen[r["number"], r["pass"], r["block"]] += 1
    assert set(seen.values()) == {1}
    assert {k: v for k, v in got.items() if v} == dict(taken)
    for p, words in zip(plans, owners, strict=True):
        assert abs(sum(taken[x] for x in set(words)) - p.target) <= 1


def test_running_sums_of_a_mix_in_three_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUM_ROWS", 4)
    docs = spark.createDataFrame([(k, "a " * (k % 5), "x" if k % 3 else None) for k in range(300)], "doc_id long, text string, source string")
    sizes = mixing.sized(docs)
    rows = mixing.placed(sizes, mixing.plan_mix(sizes)).collect()
    for number in (0, 1):
        some = sorted((r["start"], r["size"]) for r in rows if r["number"] == number and r["size"])
        assert [s for s, _ in some] == [0, *np.cumsum([n for _, n in some])[:-1].tolist()]


def test_a_mix_of_more_sources_than_are_drawn_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = [None, "", *(f"s{k:02d}é" for k in range(45))]
    sizes = [int(x) for x in 10 ** rng.uniform(0, 3.3, len(names))]
    sizes[5] = 30_000  # most words are of one source
    rows, n = [], 0
    for name, size in zip(names, sizes, strict=True):
        for part in (size // 3, size - size // 3, 0):
            rows.append((n, "w " * part, name))
            n += 1
    docs = spark.createDataFrame([*rows, (None, None, "s00é"), (10_000, "", "wordless")], "doc_id long, text string, source string")
    few = {r["doc_id"]: tuple(r) for r in mixing.taken_words(docs).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 7)
    monkeypatch.setattr(mixing, "PLAN_SLOTS", 16)
    got = {r["doc_id"]: tuple(r) for r in mixing.taken_words(docs).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in few.items()} and len(got) == len(few)
    assert all(got[k][3] == pytest.approx(v[3]) for k, v in few.items())
    known = sorted({*names, "wordless"}, key=lambda x: (x is None, x or ""))
    total = {name: 0 for name in known} | dict(zip(names, sizes, strict=True))
    wanted = dict(zip(known, mixing.targets([total[x] for x in known], [1 + k % 3 for k in range(len(known))]), strict=True))
    for name in names:
        ids = [k for k, _, source in rows if source == name]
        assert abs(sum(got[k][4] for k in ids) - wanted[name]) <= 1 and all(got[k][4] <= 3 * got[k][1] for k in ids)
    plans = mixing.plan_mix(mixing.sized(docs))
    slots = [tuple(r) for r in mixing.slots(spark, plans).collect()]
    assert len({x[:2] for x in slots}) == len(slots) == len({x[2:5] for x in slots})
    assert sorted(slots) == sorted(tuple(r) for r in mixing.slots(spark, plans).collect())
    # the large source is in all shards, in about its share of each
    large = next(r["number"] for r in plans.collect() if r["mix_source"] == names[5])
    shares = collections.Counter(x[0] for x in slots if x[2] == large)
    assert len(shares) == len({x[0] for x in slots})
    assert mixing.mixed_documents(docs).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(v[4] for v in got.values())


def test_near_dedup_of_very_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BATCH_BYTES", 1000)
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "q" * 300_000 + " a b c d e"), (4, "Q" * 300_000 + " A b c d e"), (1, long), (1, long), (7, "one")]
    got = collections.Counter(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == {(1, 59_996, 1, True): 1, (1, 59_996, 1, False): 2, (2, 59_997, 1, False): 1, (3, 2, 3, True): 1, (4, 2, 3, False): 1, (7, 1, 7, True): 1}


@pytest.mark.parametrize("clustered", [False, True])
def test_share_of_vectors_that_are_scored(clustered):
    """With several projections: recall of all queries by a coverage of 64 of them, with fewer vectors than all of them."""
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((20_000, 32))
    if clustered:
        vectors = rng.standard_normal((200, 32))[rng.integers(0, 200, 20_000)] + 0.3 * vectors
    asked = np.arange(0, 20_000, 100)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    norm = np.linalg.norm(vectors, axis=1).max()
    farthest = np.take_along_axis(scores, best[:, -1:], axis=1)[:, 0] / (norm * np.linalg.norm(vectors[asked], axis=1))
    hashing = neighbours.Hashing(32, norm, len(vectors), float(np.quantile(farthest[:64], neighbours.QUANTILE)))
    cells = hashing.cells(vectors)
    occupied = np.stack([np.bincount(c, minlength=9**hashing.count) for c in cells])
    hashing.coverage = neighbours.measured_coverage(hashing, vectors[asked[:64]], np.repeat(np.arange(64), 20), cells[:, best[:64].reshape(-1)].T, occupied)
    met = np.zeros(scores.shape, bool)
    for t in range(neighbours.TABLES):
        some = np.flatnonzero(occupied[t])
        visits, _ = neighbours.visited(hashing, vectors[asked], t, some, occupied[t][some], 41)
        met |= visits[:, np.searchsorted(some, cells[t])]
    found = np.take_along_axis(met, best, axis=1)
    assert hashing.count == 4 and found[:64].mean() >= neighbours.LEAST_RECALL and found.mean() >= 0.9
    assert met.mean() < (0.5 if clustered else 0.9), (met.mean(), hashing.cosine)


def test_vectors_met_in_one_table_are_passed_over_in_the_next(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    monkeypatch.setattr(neighbours, "LEAST_RECALL", 1.0)
    scored = spark.sparkContext.accumulator(0)
    best = neighbours._best

    def counting(queries, vectors, ids, allowed, k):
        scored.add(int(allowed.sum()))
        return best(queries, vectors, ids, allowed, k)

    monkeypatch.setattr(neighbours, "_best", counting)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    for q in range(0, 600, 10):
        scores = vectors @ vectors[q]
        assert [got[q][k] for k in range(1, 6)] == [j for j in np.argsort(-scores, kind="stable").tolist() if j != q][:5]
    assert scored.value <= 60 * 600


def test_nearest_in_small_units(spark, monkeypatch):
    """Cells over several units, hot units met by blocks of queries, extra columns and repeated ids."""
    monkeypatch.setattr(neighbours, "UNIT_VECTORS", 64)
    monkeypatch.setattr(neighbours, "UNIT_QUERIES", 16)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 12))
    vectors = (centres[rng.integers(0, 30, 900)] + 0.1 * rng.standard_normal((900, 12))).round(6)
    rows = [(k, v.tolist(), "u", 1.0) for k, v in enumerate(vectors)] + [(5, vectors[5].tolist(), "again", 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 5 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 5):
        scores = (vectors * vectors[q]).sum(axis=1)
        best = [k for k in np.lexsort((np.arange(900), -scores)) if k != q][:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21)) and len({v for _, v, _ in mine}) == 20
        assert all(s == pytest.approx(scores[v]) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(best))
    assert hits >= 0.9 * 180 * 20


def test_nearest_of_rare_kinds_of_rows(spark, monkeypatch):
    """Few rows without structure beside tight clusters, and lengths of two magnitudes: every query's rows are those of brute force."""
    monkeypatch.setattr(neighbours, "UNIT_VECTORS", 512)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 32))[rng.integers(0, 60, 2000)] + 0.1 * rng.standard_normal((2000, 32))
    vectors[::40] = rng.standard_normal((50, 32))
    vectors[1::9] *= 3
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 2000, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        best = [k for k in np.lexsort((np.arange(2000), -scores)).tolist() if k != q][:20]
        assert [got[q][k] for k in range(1, 21)] == [(k, pytest.approx(scores[k])) for k in best], q


def test_what_the_first_pass_leaves_out_is_found(spark, monkeypatch):
    """With next to no coverage in the first pass, the check finds the rest, and tells vectors of one score by their ids."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    monkeypatch.setattr(neighbours, "LEAST_RECALL", 0.0)
    monkeypatch.setattr(neighbours, "UNIT_VECTORS", 64)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (700, 6)).astype(float)
    vectors[0] = [1, 0, 0, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 7).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    for q in range(0, 700, 20):
        scores, some = vectors @ vectors[q], vectors.any(axis=1)
        best = [k for k in np.lexsort((np.arange(700), -scores)).tolist() if k != q and some[k]][:7]
        assert [got[q][k] for k in range(1, 8)] == best, q


def test_nearest_beside_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 1.0])] * 30 + [(k, [1.0, 1.0]) for k in range(2, 6)] + [(9, [1.0, 0.0]), (10, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in neighbours.nearest(df, df.where("vec_id = 9")).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 10)]


def test_chat_beside_clashing_columns(spark):
    rows = [(1, 1, "assistant", "b\\<|end|>", "x", 3), (1, 0, "user", "a", "y", 4), (2, 0, "assistant", "y" * 50_000, "z", 5), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, token_ids int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.conversation_digests(chat.format_conversations(df, chat.byte_bpe_path())).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {
        1: (2, sha("user\na\nassistant\nb\\<|end|>\n"), 9, sha("b\\<|end|>")),
        2: (1, sha("assistant\n" + "y" * 50_000 + "\n"), 50_000, sha("y" * 50_000)), 3: (1, sha("\n\n"), 0, sha("")),
    }


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, n_entities int, score double, row string, size int, spans string"


def test_pipeline_on_empty_and_clashing_tables(spark, sf_dir):
    import corpus_pipeline

    texts = [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{sf_dir}/documents.parquet' JOIN '{sf_dir}/labels.parquet' USING (doc_id) WHERE quality = 1 ORDER BY doc_id LIMIT 12").fetchall()]
    rows = [(k, t + " joe@x.org", "en", "s", 1, 99, 0.5, "r", 9, "s") for k, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None, None, None), (50, "", None, None, 0, 1, 0.0, "", 0, "")]
    for docs in (spark.createDataFrame(rows, PIPELINE), spark.createDataFrame([], PIPELINE)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < 4:
                docs = scratch.written(docs, "stage")
                assert docs.columns == [x.split()[0] for x in PIPELINE.split(", ")]
                if k == 2 and not docs.isEmpty():
                    kept = docs.where("text <> ''").collect()
                    assert {r["n_entities"] for r in kept} == {99} and all(r["n_chars"] == len(r["text"]) and "joe@x.org" not in r["text"] for r in kept)
        docs.count()


def test_pipeline_clears_its_tables(spark, sf_dir):
    import corpus_pipeline

    scratch.clear(spark)
    assert scratch.standing(spark) == []
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    last = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch.standing(spark)]
    assert set(last) <= {"pipeline-3", *(f"packed-{k}" for k in range(4))}
    scratch.clear(spark)
    assert scratch.standing(spark) == []


def test_license_exceptions():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES)
    tag = "SPDX-License-Identifier:"
    wanted = {
        f"{tag} LLVM-exception": ("", 0.0), f"{tag} Banana-exception": ("", 0.0), f"{tag} MIT WITH Apache-2.0": ("", 0.0), f"{tag} MIT WITH Banana-exception": ("", 0.0),
        f"{tag} Apache-2.0 WITH SHL-2.1": ("apache", 1.0), f"{tag} Apache-2.0 WITH LLVM-exception OR MIT": ("apache,mit", 1.0), f"{tag} LLVM-exception WITH MIT": ("", 0.0),
        f"{tag} MIT OR LLVM-exception": ("", 0.0), f"{tag} (GPL-2.0-only OR MIT) WITH Linux-syscall-note": ("gpl,mit", 1.0), f"{tag} MIT WITH AdditionRef-own": ("mit", 1.0),
        f"{tag} MIT/Apache-2.0": ("apache,mit", 1.0), f"/* {tag} MIT */ int x;": ("mit", 1.0), f"// {tag} MIT // y": ("mit", 1.0), f"{tag} MIT/ x": ("mit", 1.0),
    }
    assert {text: (scanner.scan(text)[5], scanner.scan(text)[6]) for text in wanted} == wanted


def test_pii_forms_that_are_found(spark):
    found = [
        "+15551234567", "+442079460958", "tel 5551234567", "Phone: 5551234567", "(030) 1234567", "+49 30 1234567", "+49 (0)30 1234567", "123 45 6789", "ghp_" + "aB3" * 12,
        "a@b.c.d.e.f.g.h.i.j.k.l.example.com", "müller@x.de", "joe@x.com.", "joe@x.com.123", "x" * 3000 + "@" + "a." * 3000 + "com", "Ms. Anna Maria Luisa Smith", "überweisung@x-y.co.uk, z",
    ]
    got = _replaced(spark, found)
    assert [(t, r) for t, r in zip(found, got, strict=True) if r[1] != 1 or r[0] == t] == []
    assert not re.search("Anna|Maria|Luisa|Smith", got[14][0]) and len(got[14][0].split()) == 5 and re.fullmatch(r"[a-z]ü[a-z]{4}@\S+", got[10][0]) and got[15][0].endswith(", z")
    assert re.fullmatch(r"\+1\d{10}", got[0][0]) and re.fullmatch(r"\(\d{3}\) \d{7}", got[4][0]) and re.fullmatch(r"9\d\d \d\d \d{4}", got[7][0]) and re.fullmatch(r"ghp_(?:[a-z][A-Z]\d){12}", got[8][0])
    same = _replaced(spark, ["+1 555 123 4567", "+15551234567", "(555) 123-4567"])
    assert len({re.sub(r"^\+1|\D", "", t) for t, _ in same}) == 1


def test_pii_forms_that_are_left_alone(spark):
    clean = ["+123", "a + 1234567", "5551234567", "1 123 45 6789", "123 45 6789 0", "x ghp_short", "hotel 1234567", "@x.com and a@b", "page (12) 34", "1 + 2 (3) 4", "a@-.-"]
    assert [(t, r) for t, r in zip(clean, _replaced(spark, clean), strict=True) if r != (t, 0)] == []
