"""Near-duplicates by HyperMinHash, against brute force over full sets."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import families, hyperminhash

from .helpers import clashing, corpus, frame, prose
from .test_free import brute_roots, links


def pair(rng, n, num, den):
    """Two sets of random keys, the larger of n, just above the threshold."""
    shared = -(-num * n // den)
    both = rng.integers(0, 2**63, shared, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, shared, dtype=np.uint64)
    more = rng.integers(0, 2**63, n - shared, dtype=np.uint64) * np.uint64(2)
    return np.unique(both), np.unique(np.append(both, more))


def one(keys):
    return hyperminhash.registers(keys, np.array([0, len(keys)]))[0]


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (95, 100)])
def test_linked_sets_share_a_key(num, den):
    """Pairs at the threshold of every size, those on both sides of a layout's bound among them."""
    rng = np.random.default_rng(1)
    deal = [hyperminhash.dealings(c, num, den) for c in range(len(hyperminhash.LAYOUTS) + 1)]

    def keys_of(s):
        firsts = s[: len(s) - hyperminhash.need(len(s), num, den) + 1]
        return set(hyperminhash.band_keys(len(s), one(s), firsts, deal, num, den).tolist())

    for n in [*range(1, 90), *range(90, 700, 7), 1500, 5000]:
        for _ in range(4):
            a, b = pair(rng, n, num, den)
            assert keys_of(a) & keys_of(b), n
    # unrelated sets of any size share none
    lone = [keys_of(pair(rng, n, num, den)[1]) for n in (5, 63, 64, 70, 127, 128, 130, 255, 256, 300, 511, 512, 2000) for _ in range(20)]
    assert len(set().union(*lone)) == sum(map(len, lone))


def test_registers_and_estimate():
    rng = np.random.default_rng(2)
    assert hyperminhash.compress(np.array([0, 1, 2**55, 2**56 - 1, 2**55 + 2**54, 5], np.uint64)).tolist() == [56 << 10, 56 << 10, 1 << 10, (1 << 10) + 1023, (1 << 10) + 512, (54 << 10) + 256]
    # of unrelated sets, those of many n-grams agree by collision as often as expected
    for n in (300, 3000, 30_000):
        sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(120)]
        regs = np.stack([one(s) for s in sets])
        hits = [((regs[a] == regs[b]) & (regs[a] > 0)).sum() for a in range(120) for b in range(a)]
        assert abs(np.mean(hits) - hyperminhash.expected_collisions(hyperminhash.octave_chances(np.array(n)), hyperminhash.octave_chances(np.array([n])))[0]) < 0.02
    for n in (80, 500, 5000):
        told = []
        for _ in range(60):
            a, b = pair(rng, n, 85, 100)
            x, y = one(a), one(b)[None]
            chances = hyperminhash.octave_chances(np.array([len(a), len(b)]))
            told.append(hyperminhash.estimate(chances[0], x, chances[1:], y, np.count_nonzero(y, axis=1))[0][0])
        assert abs(np.mean(told) - 0.85) < 0.015 and np.std(told) < 0.06


def test_keys_of_documents_in_any_grouping():
    """A text's keys don't depend on the texts beside it; chunks put batches apart by size."""
    texts = [t for _, t, *_ in corpus()]
    keys, bounds = hyperminhash.documents_keys(texts, 3)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        alone, _ = hyperminhash.documents_keys([t], 3)
        assert alone.tolist() == keys[a:b].tolist()
    batch = pa.record_batch({"text": [*texts, "x" * 20_000_000, None, "y"]})
    parts = list(hyperminhash.chunks(iter([batch]), "text"))
    assert len(parts) > 1 and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_search_of_a_family(monkeypatch):
    rng = np.random.default_rng(3)
    bases = [pair(rng, 60 + 200 * k, 85, 100)[1] for k in range(3)]
    sets = []
    for k in range(90):
        s = bases[k % 3].copy()
        at = rng.integers(0, len(s), len(s) * (k % 8) // 50)
        s[at] = rng.integers(0, 2**62, len(at))
        sets.append(np.unique(s))
    payloads = [one(s).tobytes() + s.tobytes() for s in sets]
    for pilots in (1, 16):
        monkeypatch.setattr(families, "PILOTS", pilots)
        forest = families.search_family(np.array([len(s) for s in sets]), payloads, partial(hyperminhash.Sketches, 85, 100))
        assert [forest.root(x) for x in range(90)] == brute_roots(sets, 85, 100)


def near_copies():
    """Copies with a growing number of changed words, of texts of 20 to 900 words, so that some link and some don't."""
    r, docs = random.Random(4), []
    for k, size in enumerate((20, 45, 70, 80, 140, 260, 530, 900)):
        base = prose(900 + k, size).split()
        for c in range(12):
            own = list(base)
            for at in r.sample(range(size), max(1, size * c // 220)):
                own[at] = f"v{k}{c}{at}"
            docs.append((1000 + 100 * k + c, " ".join(own), "en", "s", 0))
    return docs


@pytest.mark.parametrize(("n", "num", "family_keys"), [(3, 85, 1_000_000), (5, 80, 600)])
def test_join(spark, n, num, family_keys):
    docs = corpus() + near_copies()
    got = hyperminhash.join(clashing(spark, docs).repartition(3), n=n, num=num, family_keys=family_keys).collect()
    want = links(docs, n, num, 100)
    assert len(got) == len(docs) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(i != c for i, (_, c) in want.items()) >= 20


def test_join_of_odd_input(spark):
    docs = frame(spark, corpus())
    assert hyperminhash.join(docs.where("false")).collect() == []
    text = prose(5, 100)
    rows = [(None, text, None, None, 0), (None, None, None, None, 0), (5, text, None, None, 0), (9, text, None, None, 0), (9, text, None, None, 0), (9, prose(6, 50), None, None, 0), (2, prose(6, 50), None, None, 0), (7, None, None, None, 0)]
    got = sorted((tuple(r) for r in hyperminhash.join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 96, None, True), (None, 0, None, True), (5, 96, 5, True), (9, 96, 5, False), (9, 96, 5, False), (9, 46, 2, False), (2, 46, 2, True), (7, 0, 7, True)], key=str)
    with pytest.raises(ValueError, match="0.8"):
        hyperminhash.join(docs, num=70)
    with pytest.raises(TypeError, match="integers"):
        hyperminhash.join(docs.selectExpr("'a' as doc_id", "text"))


def test_join_of_a_very_long_text(spark):
    long = prose(7, 200_000)
    rows = [(1, long, None, None, 0), (2, long.replace(" the ", " teh ", 300), None, None, 0), (3, long[: len(long) // 2], None, None, 0)]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.join(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
