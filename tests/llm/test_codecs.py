"""Pure functions of the operators: codes, digests, masks, sketches, packing, permutations, expressions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import chat, fingerprints, licenses, mixing, near_dedup, packing, quality, simple8b, tokenizing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    data = simple8b.encode(x)
    assert (simple8b.decode(data) == x).all()
    for block in range(-(-len(x) // simple8b.BLOCK)):
        assert (simple8b.decode_block(data, block) == x[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcXYZ'sStdmlvre 0129.,!?\n\té ÀßÿŸ×÷ÖØª\x1c日🙂<|>", max_size=60))
def test_ids_are_those_of_the_library(s):
    encoder = tokenizing.encoder(tokenizing.word_bpe_path())
    assert list(encoder.encode(s)) == encoder.tokenizer.encode(s, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>", ""]), st.text(alphabet="ab\\<|>[]/INSTs🙂 \n", max_size=25)), max_size=5))
def test_chat_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    encoded = chat.chat_tokenizer(chat.byte_bpe_path()).encode(text, add_special_tokens=False)
    edges = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    mask = chat.loss_mask(encoded.offsets, spans)
    assert chat.masked_text(text, edges[:, 0], edges[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


def test_digest_likeness():
    a, b = "one two three four five six " * 40, "completely other words here " * 50
    assert fingerprints.likeness(fingerprints.digest(a), fingerprints.digest(a)) == 1.0
    near = fingerprints.likeness(fingerprints.digest(a), fingerprints.digest(a[:-20]))
    far = fingerprints.likeness(fingerprints.digest(a), fingerprints.digest(b))
    assert 0 <= far < near <= 1
    assert fingerprints.digest(None) == fingerprints.digest("")
    naive = np.zeros(fingerprints.BUCKETS, int)
    data = a.encode()
    for offsets, salt in fingerprints._KINDS:
        for i in range(len(data) - offsets[2]):
            x, y, z = (fingerprints._TABLES[k][data[i + o]] for k, o in enumerate(offsets))
            naive[(x ^ y ^ z) ^ salt] += 1
    assert (fingerprints.bucket_counts(data) == naive).all()


def test_license_expressions():
    said = "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */ int main"
    assert licenses.to_postfix(licenses.tag_expressions(said)[0]) == ["MIT", "Apache-2.0", "or", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and"]
    assert licenses.evaluate(licenses.tag_expressions(said)[0]) == ({"mit", "apache", "gpl"}, licenses.FREEDOM["gpl"])
    for bad in (["MIT", "OR"], ["(", "MIT"], ["MIT", "MIT"], ["AND", "MIT"], ["MIT", ")"]):
        with pytest.raises(ValueError):
            licenses.to_postfix(bad)
    scan = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES).scan
    assert scan("MIT license; MIT-License, x mit\nlicense")[:6] == (7, 3, 0, 5, "mit", "mit")
    assert scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    assert scan(said)[5] == "apache,gpl,mit" and scan(None)[:6] == (0, 0, None, None, "", "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_packing_bounds(lengths):
    x = np.array(lengths)
    bins, offsets = packing.best_fit_decreasing(x, 30)
    fill = np.bincount(bins, x)
    assert fill.max() <= 30 and packing.lower_bound(np.bincount(x, minlength=31), 30) <= len(fill)
    for b in range(len(fill)):
        order = np.argsort(offsets[bins == b])
        ends = np.cumsum(x[bins == b][order])
        assert (offsets[bins == b][order] == ends - x[bins == b][order]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_and_inverse(n):
    p = mixing.permuted(np.arange(n), n, (5, 1, 2))
    assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, (5, 1, 2), inverse=True) == np.arange(n)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_shard_counts_add_up_and_can_be_found_alone():
    totals = np.array([700, 0, 41, 2300])
    whole = list(mixing.shard_counts(totals, 64, range(0, 48), 3))
    assert (sum(c for *_, c in whole) == totals).all() and all(c.sum() == 64 for *_, c in whole[:-1])
    ((shard, before, counts),) = mixing.shard_counts(totals, 64, range(20, 21), 3)
    assert shard == 20 and (before == whole[20][1]).all() and (counts == whole[20][2]).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400, 5000):
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(base[: n + n // 2]), np.unique(base[n // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
        assert abs(equal - true) < 0.2
        assert (near_dedup.sketch(a) == near_dedup.sketch(a.copy())).all()


def test_shingles():
    assert len(near_dedup.shingle_set("a b c d e", 4)) == 2
    assert (near_dedup.shingle_set("A  b\tC", 4) == near_dedup.shingle_set("a B c", 4)).all()
    assert len(near_dedup.shingle_set(" \n", 4)) == len(near_dedup.shingle_set(None, 4)) == 0
    assert len(near_dedup.shingle_set("É b c d", 4)) == 1
    assert near_dedup.shingle_set("É b c d", 4)[0] != near_dedup.shingle_set("é b c d", 4)[0]


def test_network_slices_cover_long_texts(monkeypatch):
    net = quality.Network.new(3)
    text = bytes(np.random.default_rng(0).integers(32, 127, 9000, dtype=np.uint8))
    whole = quality.scores(net, [text])
    monkeypatch.setattr(quality, "SLICE", 1024)
    assert np.allclose(quality.scores(net, [text, b""])[0], whole[0], atol=1e-5)
