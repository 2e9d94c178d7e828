"""The operators with Python inside tasks: against brute force, libraries and exact round trips."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from panelcast.llm import bpe, chunk_dedup, components, exact_dedup, families, lm_score, ngram_join, token_store

from .helpers import clashing, corpus, frame, prose, untouched

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def write(f, tmp_path, name="docs.parquet"):
    f.write.parquet(str(tmp_path / name))
    return str(tmp_path / name)


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup(spark, tmp_path, digest_chars):
    docs = corpus() + [(99, corpus()[0][1], "en", "s", 0), (None, corpus()[0][1], "en", "s", 0)]
    path = write(clashing(spark, docs), tmp_path)
    got = exact_dedup.dedup(spark, path, digest_chars=digest_chars, files_per_batch=1).collect()
    assert len(got) == len(docs)
    body = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in docs}
    groups = defaultdict(list)
    for i, b in body.items():
        groups[b].append(i)
    for r in got:
        own = groups[body[r["doc_id"]]]
        first = min(i for i in own if i is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first, len(own), r["doc_id"] == first)
        assert r["text_sha256"] == hashlib.sha256(body[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup_state_outlives_a_call(spark, tmp_path, digest_chars):
    """A second call, and a third on a table that has grown, against the state of the first."""
    texts = [prose(k, 20) for k in range(6)]
    row = lambda i, k: (i, texts[k], None, None, 0)
    tables = [[row(10, 0), row(11, 1), row(12, 1), row(13, 2)], [row(20, 1), row(9, 0), row(21, 3), row(22, 3), row(23, 4)]]
    later = [row(30, 4), row(31, 5), row(8, 2)]
    state = str(tmp_path / "state")
    seen = []
    for n, rows in enumerate([*tables, later]):
        path = str(tmp_path / f"t{min(n, 1)}.parquet")
        frame(spark, rows).repartition(2).write.mode("append").parquet(path)
        seen += rows
        table = rows if n < 2 else tables[1] + later
        got = exact_dedup.dedup(spark, path, state=state, digest_chars=digest_chars, files_per_batch=1).collect()
        groups = defaultdict(list)
        for i, t, *_ in seen:
            groups[t].append(i)
        want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t, *_ in table)
        assert sorted(tuple(r)[:4] for r in got) == want


def test_exact_dedup_repeated_rows_and_empty(spark, tmp_path):
    path = write(frame(spark, [(1, "a", None, None, 1)] * 3 + [(2, "b", None, None, 1)]).coalesce(1), tmp_path)
    got = sorted((r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(spark, path).collect())
    assert got == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]
    assert exact_dedup.dedup(spark, write(frame(spark, []), tmp_path, "none.parquet")).count() == 0


def test_exact_dedup_tells_files_by_their_path(spark, tmp_path):
    """Other spellings of a table, a trailing slash and a pattern over earlier tables each give all rows, against one state."""
    texts = [prose(k, 12) for k in range(4)]
    one, two = [(k, texts[k % 3], None, None, 0) for k in range(10)], [(k + 100, texts[k % 4], None, None, 0) for k in range(10)]
    for name, rows in (("t0", one), ("t 1[x]", two)):
        frame(spark, rows).repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    state = str(tmp_path / "state")
    call = lambda path: exact_dedup.dedup(spark, path, state=state).collect()
    first = sorted(map(tuple, call(str(tmp_path / "t0.parquet"))))
    assert len(first) == 10 and {r[1] for r in first} == {0, 1, 2}
    for spelling in (f"./{os.path.relpath(tmp_path)}/t0.parquet", f"file:{tmp_path}/t0.parquet", f"{tmp_path}//t0.parquet/", f"{tmp_path}/t0*"):
        assert sorted(map(tuple, call(spelling))) == first
    both = call(str(tmp_path / "t*.parquet"))
    assert len(both) == 20 and {(r["keep_id"], r["group_size"]) for r in both} == {(0, 7), (1, 6), (2, 5), (103, 2)}


def test_exact_dedup_reads_hit_files_only(spark, tmp_path, monkeypatch):
    """Texts are read again only from files that hold hits."""
    same, state = prose(1, 20), str(tmp_path / "state")
    for k in range(4):
        frame(spark, [(10 * k, same if k in (0, 3) else prose(50 + k, 20), None, None, 0), (10 * k + 1, prose(90 + k, 20), None, None, 0)]).coalesce(1).write.parquet(str(tmp_path / f"t{k}.parquet"))
    seen, real = [], exact_dedup._paths
    monkeypatch.setattr(exact_dedup, "_paths", lambda files: seen.append(real(files)) or seen[-1])
    for k in range(4):
        got = exact_dedup.dedup(spark, str(tmp_path / f"t{k}.parquet"), state=state).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {30: 0, 31: 31}
    assert [len(x) for x in seen] == [1, 0, 1, 0, 1, 0, 1, 2] and all(any(f"t{k}.parquet" in f for f in seen[-1]) for k in (0, 3))


def test_exact_dedup_of_very_long_texts(spark, tmp_path):
    long = prose(3, 150_000)
    rows = [(1, long, None, None, 0), (2, long.replace(" ", "\t\n"), None, None, 0), (3, long + " more", None, None, 0), (4, None, None, None, 0), (5, "", None, None, 0)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(spark, write(frame(spark, rows), tmp_path)).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False)}


def links(docs, n, num, den):
    sets = {}
    for i, t, *_ in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "family_keys"), [(4, 85, 3_000_000), (5, 80, 150)])
def test_ngram_join(spark, n, num, family_keys):
    docs = corpus()
    words = prose(77, 90).split()
    docs += [(200 + k, " ".join([*words[: 3 * k], *(f"x{k}{j}" for j in range(k % 4)), *words[3 * k + k % 4 :]]), None, None, 0) for k in range(25)]  # a family with and without links
    got = ngram_join.join(clashing(spark, docs).repartition(3), n=n, num=num, block_words=700, family_keys=family_keys).collect()
    want = links(docs, n, num, 100)
    assert len(got) == len(docs) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sum(i != c for i, (_, c) in want.items()) >= 5


def brute_roots(sets, num, den):
    up = list(range(len(sets)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(sets))]


def some_sets(rng, m):
    """Near copies of a few bases and sets of their own, all over one small vocabulary."""
    bases = [rng.choice(3_000, 60, replace=False).astype(np.uint64) for _ in range(3)]
    sets = []
    for k in range(m):
        s = bases[k % 5].copy() if k % 5 < 3 else rng.choice(3_000, 60, replace=False).astype(np.uint64)
        s[rng.integers(0, 60, k % 9)] = rng.integers(20_000, 20_050, k % 9)
        sets.append(np.unique(s))
    return sets


@pytest.mark.parametrize("probe", [1e-6, 0.01, 0.3, 100.0])
def test_divide_skip_finds_every_link_itself(monkeypatch, probe):
    """From all lists long but one to all lists short: the search alone gives each set's links, and they alone make the components."""
    monkeypatch.setattr(ngram_join, "PROBE", probe)
    sets = some_sets(np.random.default_rng(3), 80)
    sizes = np.array([len(s) for s in sets])
    payloads = [s.tobytes() for s in sets]
    index = partial(ngram_join.Lists, 80, 100)
    lists = index(sizes, payloads)
    links = 0
    for q, s in enumerate(sets):
        want = [x for x, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))]
        assert sorted(lists.search(len(s), payloads[q]).tolist()) == want
        assert sorted(lists.search(len(s), payloads[q], 33).tolist()) == [x for x in want if x >= 33]
        links += len(want) - 1
    assert links > 200
    for pilots in (1, 16):
        monkeypatch.setattr(families, "PILOTS", pilots)
        found = []
        forest = families.search_family(sizes, payloads, index, found)
        want = brute_roots(sets, 80, 100)
        assert [forest.root(x) for x in range(80)] == want and len(found) == 80 - len(set(want))


def test_two_equal_groups_take_linear_steps():
    """Members of a group don't walk their own group's lists: twice the members take about twice the steps."""

    class Steps(ngram_join.Lists):
        taken = 0

        def search(self, size, payload, after=0):
            keys = np.frombuffer(payload, np.uint64)
            place = np.searchsorted(self.keys, keys)
            Steps.taken += int((self.end[place] - np.searchsorted(self.pairs, place * self.m + after)).sum())
            return super().search(size, payload, after)

    def steps(m):
        rng = np.random.default_rng(8)
        bases = [np.append(rng.choice(10**6, 290, replace=False), np.arange(10)).astype(np.uint64) for _ in range(2)]  # ten keys stand in both groups
        sets = []
        for k in range(2 * m):
            s = bases[k % 2].copy()
            s[rng.integers(0, 290, 8)] = rng.integers(2 * 10**6, 2**60, 8)
            sets.append(np.unique(s))
        Steps.taken = 0
        forest = families.search_family(np.array([len(s) for s in sets]), [s.tobytes() for s in sets], partial(Steps, 80, 100))
        assert [forest.root(x) for x in range(2 * m)] == [k % 2 for k in range(2 * m)]
        return Steps.taken / m

    few, many = steps(100), steps(400)
    # the ten shared keys have lists as long as the other group; all of a member's own would be 300 such lists
    assert many < 0.1 * 300 * 400 + 2 * few


@pytest.mark.parametrize("family_keys", [40, 200])
def test_many_seekers_of_one_key_come_in_blocks(spark, monkeypatch, family_keys):
    """No group of a large family holds more than a bounded number of keys of members or of seekers."""
    monkeypatch.setattr(families, "PILOTS", 2)
    monkeypatch.setattr(families, "ROUNDS", 1)
    most, rng = [], np.random.default_rng(9)
    sets = [np.unique(np.append(rng.choice(10**6, 15, replace=False), 7)).astype(np.uint64) for _ in range(120)]  # all share one key, few link
    for k in range(0, 120, 4):
        sets[k] = sets[k // 8].copy()
    rows = [(0, k, len(s), bytearray(s.tobytes()), [7]) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "family bigint, id bigint, n bigint, keys binary, prefix array<bigint>")
    real = families.search_parts

    def watched(dealt, index):
        size = dealt.groupBy("grp").agg(F.sum((F.col("listed").cast("int")) * F.col("n")).alias("l"), F.sum((F.col("seeks").cast("int")) * F.col("n")).alias("s")).agg(F.max("l"), F.max("s")).first()
        most.append(max(x or 0 for x in size))
        return real(dealt, index)

    monkeypatch.setattr(families, "search_parts", watched)
    roots = families.search(table, partial(ngram_join.Lists, 80, 100), family_keys).groupBy("id").agg(F.min("root").alias("root"))
    got = {r["id"]: r["root"] for r in roots.collect()}
    assert [got.get(k, k) for k in range(120)] == brute_roots(sets, 80, 100)
    assert max(most) < 4 * family_keys + 200


def test_merge_skip():
    rng = np.random.default_rng(4)
    for n in range(1, 12):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).tolist() for _ in range(n)]
        times = Counter(x for one in lists for x in one)
        for least in range(1, n + 2):
            assert list(ngram_join.merge_skip(lists, least)) == sorted((x, k) for x, k in times.items() if k >= least)


@pytest.mark.parametrize(("pilots", "rounds"), [(16, 3), (1, 1)])
def test_ngram_join_of_families_of_many_parts(spark, monkeypatch, pilots, rounds):
    """A large group of near copies, two small ones and others that share some of their words, all in families of many parts."""
    monkeypatch.setattr(families, "PILOTS", pilots)
    monkeypatch.setattr(families, "ROUNDS", rounds)
    rng = np.random.default_rng(6)
    bases = [prose(1300 + k, 100).split() for k in range(4)]
    docs = []
    for k in range(90):
        own = list(bases[0 if k % 3 else 1 + k // 3 % 2])
        for at in rng.integers(0, 100, k % 4):
            own[at] = f"w{k}{at}"
        if k % 10 == 9:
            own = own[:45] + bases[3][:55]
        docs.append((k, " ".join(own), None, None, 0))
    got = ngram_join.join(frame(spark, docs).repartition(3), n=4, num=85, block_words=2_000, family_keys=600).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == links(docs, 4, 85, 100)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (200, 200)]
    got = {r["id"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 50, 50: 50, 70: 50}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("mus", [(500.0,), (500.0, 50.0), (7.0, 3.0, 2.0)])
def test_lm_score(spark, mus):
    docs = corpus() + corpus()[:1]
    got = lm_score.score(clashing(spark, docs).repartition(2), block_words=300, mus=mus).collect()
    tok = [(i, [0, *(t or "").encode().lower().split(), 0]) for i, t, *_ in docs]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tok}
    c, after = Counter(), Counter()
    for i, ws in tok:
        if not held[i]:
            for t in range(1, len(ws)):
                for k in range(len(mus) + 1):
                    if t - k >= 0:
                        c[tuple(ws[t - k : t + 1])] += 1
                        after[tuple(ws[t - k : t])] += 1
    n, v = after[()], sum(len(x) == 1 for x in c)

    def automaton(context, w):
        """Failure arcs are followed until a state has an arc."""
        if not context:
            return math.log10((c[w,] + 1) / (n + v + 1))
        mu = mus[len(context) - 1]
        if c[*context, w]:
            return math.log10((c[*context, w] + mu * 10 ** automaton(context[1:], w)) / (after[context] + mu))
        return (math.log10(mu / (after[context] + mu)) if after[context] else 0) + automaton(context[1:], w)

    want = {}
    for i, ws in tok:
        base = sum(math.log10((c[w,] + 1) / (n + v + 1)) for w in ws[1:])
        want[i] = (held[i], len(ws) - 1, sum(c[w,] > 0 for w in ws[1:]), n, base, sum(automaton(tuple(ws[max(0, t - len(mus)) : t]), ws[t]) for t in range(1, len(ws))))
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[:5][1:] == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4]) and r["score"] == pytest.approx(want[r["doc_id"]][5])
    # a state's arcs and failure arc share out all of its weight
    for h in [x for x in after if 0 < len(x)][:40]:
        unseen = 1 - sum(10 ** automaton(h[1:], w) for (w,) in (x for x in c if len(x) == 1))
        assert sum(10 ** automaton(h, w) for (w,) in (x for x in c if len(x) == 1)) + unseen * mus[len(h) - 1] / (after[h] + mus[len(h) - 1]) == pytest.approx(1)


@pytest.mark.parametrize("mus", [(), (500.0,), (500.0, 50.0, 5.0)])
def test_lm_model_scores_texts_that_it_never_saw(spark, tmp_path, mus):
    """A model fitted on the training rows scores all rows as the one exchange does, and texts of new words by the root and failure arcs."""
    docs = corpus()
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    model = lm_score.fit(frame(spark, train).repartition(3), str(tmp_path / "model"), mus=mus, block_words=200)
    assert lm_score.open_model(spark, str(tmp_path / "model")) == model
    fields = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    told = lambda f, **how: {r["doc_id"]: [r[c] for c in fields] for r in lm_score.score(f, mus=mus, **how).collect()}
    apart, at_once = told(frame(spark, docs).repartition(2), model=model, block_words=500), told(frame(spark, docs), block_words=300)
    assert apart.keys() == at_once.keys() and all(apart[i] == pytest.approx(at_once[i]) for i in apart)
    new = told(frame(spark, [(900, "zzzz yyyy zzzz", None, None, 0), (901, train[0][1] + " zzzz", None, None, 0)]), model=model)
    assert new[900][1:3] == [4, 1] and new[901][2] == new[901][1] - 1 and new[900][5] < 0
    empty = lm_score.fit(frame(spark, train).where("false"), mus=mus)
    assert (empty.tokens, empty.kinds) == (0, 0) and told(frame(spark, docs[:1]), model=empty)[docs[0][0]][2] == 0


@pytest.mark.parametrize("stretch", [1, 3, 7, 50])
def test_a_carried_state_is_that_of_the_whole_text(spark, stretch):
    """Stretches of any length give the scores of texts traversed whole."""
    docs = frame(spark, corpus())
    whole = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
    blocks, _ = lm_score.staged_pack(docs, "doc_id", "text", lm_score.held_out(F.col("doc_id")))
    row = [r.asDict() for r in blocks.collect()]
    streams = [lm_score.Stream(lm_score.Block(r), 3) for r in row]
    keys = [np.concatenate([s.grams[k] for s in streams]) for k in range(3)]
    counts = [dict(zip(*(x.tolist() for x in (np.unique(k), np.bincount(np.unique(k, return_inverse=True)[1], np.concatenate([s.counts(j + 1) for s in streams]))))))for j, k in enumerate(keys)]
    tokens, kinds = int(sum(counts[0].values())), sum(v > 0 for v in counts[0].values())
    got = {}
    for r, s in zip(row, streams, strict=True):
        seen = [np.array([int(counts[k][x]) for x in s.grams[k].tolist()]) for k in range(3)]
        got |= dict(zip(r["ids"], lm_score.Automaton(s, seen, tokens, kinds, lm_score.MUS).traverse(stretch).tolist(), strict=True))
    assert got == pytest.approx(whole)


def test_bpe(spark):
    docs = corpus()
    lib = Tokenizer.from_file(WORD_FILE)
    told = bpe.decode(bpe.encode(clashing(spark, docs), WORD_FILE), WORD_FILE)
    untouched(told, clashing(spark, docs), "ids")
    rows = told.collect()
    sums = {r["doc_id"]: r for r in bpe.encode_digests(frame(spark, docs), WORD_FILE).collect()}
    text = {i: t for i, t, *_ in docs}
    both = bpe.round_trip(clashing(spark, docs), WORD_FILE)
    untouched(both, clashing(spark, docs), "text", "ids")
    once = {r["doc_id"]: r for r in both.collect()}
    assert len(rows) == len(sums) == len(once) == len(docs)
    for r in rows:
        ids = lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        told = lib.decode(ids, skip_special_tokens=False)
        assert list(r["ids"]) == ids and r["decoded"] == told
        s = sums[r["doc_id"]]
        assert (s["n_tokens"], s["ids_sha256"], s["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())
        assert (list(once[r["doc_id"]]["ids"]), once[r["doc_id"]]["decoded_sha256"]) == (ids, s["decoded_sha256"])


def test_pipeline_decodes(spark):
    import corpus_pipeline

    lib = Tokenizer.from_file(WORD_FILE)
    texts = {i: t or "" for i, t, *_ in corpus()}
    rows = corpus_pipeline.bpe_encode(spark, frame(spark, corpus()), "").collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = lib.encode(texts[r["doc_id"]], add_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded_sha256"]) == (found.ids, len(found.ids), hashlib.sha256(" ".join(found.tokens).encode()).hexdigest())


def store_rows(docs):
    lib = Tokenizer.from_file(BYTE_FILE)
    raw = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in docs]
    return sorted(raw, key=lambda x: (x[0] is not None, x[0] or 0))


def test_token_store(spark, tmp_path):
    docs = corpus() + corpus()[:1] + [(None, "no id", None, None, 0)]
    path = str(tmp_path / "store")
    token_store.write(clashing(spark, docs).repartition(3), path, BYTE_FILE, 0, shard_docs=10)
    got = sorted(token_store.documents(spark, path).collect(), key=lambda r: r["start"])
    whole = sorted(token_store.read_ids(spark, path).collect(), key=lambda r: r["start"])
    start = 0
    for (i, ids), r, w in zip(store_rows(docs), got, whole, strict=True):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(w) == (i, start, ids)
        start += len(ids)
    names = [bytes(r[0]) for r in spark.read.schema(token_store.BLOBS).parquet(f"{path}/blobs").where("kind = 'chunk'").select("names").collect()]
    chunks = [n[k : k + 16] for n in names for k in range(0, len(n), 16)]
    assert len(chunks) == len(set(chunks))  # stored once
    manifest = spark.read.parquet(f"{path}/manifest")
    assert token_store.verify(spark, path).count() == 0 and manifest.where("kind = 'shard'").count() > 1


def test_token_store_notices_every_change(spark, tmp_path):
    passage = prose(88, 120)
    docs = [(k, f"{prose(60 + k, 150)} {passage}", None, None, 0) for k in range(6)]
    path = str(tmp_path / "store")
    token_store.write(frame(spark, docs), path, BYTE_FILE)
    rows = {r["id"]: r.asDict() for r in spark.read.schema(token_store.MANIFEST).parquet(f"{path}/manifest").where("kind = 'recipe'").collect()}
    shards = [r.asDict() for r in spark.read.schema(token_store.MANIFEST).parquet(f"{path}/manifest").where("kind = 'shard'").collect()]
    blobs = [r.asDict() for r in spark.read.schema(token_store.BLOBS).parquet(f"{path}/blobs").where("kind = 'chunk'").collect()]

    def recipes(change):
        new = {k: dict(v) for k, v in rows.items()}
        change(new)
        return [*new.values(), *shards]

    def swap(new, *columns):
        for c in columns:
            new[0][c], new[1][c] = new[1][c], new[0][c]

    def turn(new):
        d = new[2]["digests"]
        new[2]["digests"] = d[16:32] + d[:16] + d[32:]

    def forge(new):  # a recipe with a sound root, but not the one of its shard
        swap(new, "digests", "sizes", "n_tokens", "root")

    def longer(new):
        new[3]["n_tokens"] += 1

    def sizes(new):
        s = np.frombuffer(new[4]["sizes"], "<u2").copy()
        s[0], s[1] = s[0] - 1, s[1] + 1
        new[4]["sizes"] = s.tobytes()

    changes = {
        "digests of another": recipes(lambda new: swap(new, "digests", "sizes", "n_tokens")), "order": recipes(turn), "forged": recipes(forge), "length": recipes(longer), "sizes": recipes(sizes),
        "root": recipes(lambda new: new[5].update(root=b"0" * 16)), "place": recipes(lambda new: new[5].update(within=new[5]["within"] + 1)), "gone": recipes(lambda new: new.pop(3)), "id": recipes(lambda new: new[2].update(id=77)),
        "shard root": [*rows.values(), *(dict(x, root=b"1" * 16) for x in shards)], "shard ids": [*rows.values(), *(dict(x, n_tokens=x["n_tokens"] + 5) for x in shards)], "no shard": list(rows.values()),
    }

    def put(name, manifest, packs):
        bad = str(tmp_path / name.replace(" ", "-"))
        spark.createDataFrame([tuple(r[c.split()[0]] for c in token_store.MANIFEST.split(", ")) for r in manifest], token_store.MANIFEST).write.parquet(f"{bad}/manifest")
        spark.createDataFrame([tuple(r[c.split()[0]] for c in token_store.BLOBS.split(", ")) for r in packs], token_store.BLOBS).write.partitionBy("kind").parquet(f"{bad}/blobs")
        return bad

    assert token_store.documents(spark, put("same", [*rows.values(), *shards], blobs)).count() == 6
    for name, manifest in changes.items():
        with pytest.raises(Exception, match="doesn't hold what its root says"):
            token_store.documents(spark, put(name, manifest, blobs)).collect()
    def flip(x, at):
        return x[:at] + bytes([x[at] ^ 1]) + x[at + 1 :]

    for name, packs, error in (
        ("payload", [dict(r, payload=flip(bytes(r["payload"]), 9)) for r in blobs], "digest"), ("names", [dict(r, names=flip(bytes(r["names"]), 3)) for r in blobs], "digest"),
        ("missing", [dict(r, names=bytes(r["names"])[16:], sizes=bytes(r["sizes"])[2:], payload=bytes(r["payload"])[:1] + bytes(r["payload"])[1 + 2 * int.from_bytes(bytes(r["sizes"])[:2], "little") :], key=token_store.digest(bytes(r["names"])[16:])) for r in blobs], "missing"),
    ):
        bad = put(name, [*rows.values(), *shards], packs)
        for reader in (token_store.documents, token_store.read_ids):
            with pytest.raises(Exception, match=error):
                reader(spark, bad).collect()


def store_chunks(ids):
    ends, counts = token_store.cuts(ids, np.array([0, len(ids)]))
    assert counts.tolist() == [len(ends)] and ends[-1] == len(ids) and max(np.diff(ends, prepend=0)) <= token_store.MOST
    return {ids[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)}


def test_store_chunks_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    b = np.concatenate([a[:777], rng.integers(0, 50_000, 5).astype(np.uint32), a[777:]])
    parts = [store_chunks(x) for x in (a, b)]
    assert len(parts[0] & parts[1]) >= len(parts[0]) - 4
    leaves = [bytes([k]) * 16 for k in range(200)]
    root = lambda x: token_store.merkle_root(b"".join(x), b"shard")
    assert len({root(x) for x in ([], leaves[:1], leaves[:64], leaves[:65], leaves, leaves[::-1], [*leaves[:64], *leaves[64:0:-1]])}) == 7
    assert root(leaves[:1]) != leaves[0] and root(leaves) != token_store.merkle_root(b"".join(leaves), b"recipe")


def test_store_crc():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, token_store.MOST + 1, 60)
    bounds = np.array([0, 1, 7, 7 + 30, 60])
    parts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in sizes]
    got = token_store.joined_crc(sizes, np.array([zlib.crc32(x.tobytes()) for x in parts], np.uint32), bounds)
    assert got.tolist() == [zlib.crc32(np.concatenate(parts[a:b]).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_store_shares_short_passages(spark, tmp_path):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 50_000, n).astype(np.uint32)
    for n, least in ((1000, 0.9), (300, 0.7), (100, 0.2)):
        once = 0
        for _ in range(100):
            passage = draw(n)
            parts = [store_chunks(np.concatenate([draw(200), passage, draw(200)])) for _ in range(2)]
            once += sum(map(len, parts[0] & parts[1])) // 4
        assert once >= least * n * 100, (n, once / n / 100)
    # the same in a store, whose chunks don't take a row each
    passage = prose(77, 150)
    docs = [(k, f"{prose(9000 + k, 60)} {passage} {prose(9500 + k, 60)}", None, None, 0) for k in range(20)]
    path = str(tmp_path / "store")
    token_store.write(frame(spark, docs).repartition(4), path, BYTE_FILE)
    facts = [np.frombuffer(r["facts"], token_store.FACT) for r in token_store.stored_chunks(spark, path).collect()]
    ids = lambda t: len(Tokenizer.from_file(BYTE_FILE).encode(t, add_special_tokens=False).ids)
    total = sum(r["n_tokens"] for r in token_store.documents(spark, path).collect())
    assert sum(f["n"].sum() for f in facts) < total - 19 * 0.6 * ids(passage) and sum(map(len, facts)) > 2 * len(facts)


def test_chunk_dedup(spark):
    passage = prose(900, 60)
    docs = [(k, f"{prose(500 + k, 150)} {passage} {prose(700 + k, 90)}", None, None, 0) for k in range(4)]
    docs += [(10, prose(20, 400), None, None, 0), (11, None, None, None, 0), (12, "", None, None, 0), (None, passage, None, None, 0), (13, "é" * 500, None, None, 0), (14, "the " * 300, None, None, 0), (15, "the " * 200, None, None, 0)]
    got = chunk_dedup.repeats(clashing(spark, docs), block_bytes=2_000).collect()
    text = {i: (t or "").encode() for i, t, *_ in docs if i is not None}
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(1, 0), (2, 0), (3, 0), (15, 14)}
    for r in got:
        span = text[r["doc_id"]][r["start"] : r["end"]]
        assert span in text[r["first_doc_id"]] and span.decode() and (r["doc_id"] == 15 or r["n_words"] > 30)
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.cut_repeats(clashing(spark, docs)).collect()}
    assert cut[0] == docs[0][1] and len(cut[1]) < len(docs[1][1]) - 150 and cut[10] == docs[4][1] and cut[11] is None and cut[12] == ""
    assert set(clashing(spark, docs).columns) == set(chunk_dedup.cut_repeats(clashing(spark, docs)).columns)


def test_chunk_dedup_passage_of_which_earlier_documents_hold_pieces(spark):
    docs, passages = [], {}
    for n in range(12):
        words = prose(2000 + n, 54).split()
        whole = " ".join(words)
        around = lambda k, part: f"{prose(3000 + 10 * n + k, 40)} {part} {prose(5000 + 10 * n + k, 40)}"  # noqa: B023, E731
        docs += [(10 * n + k, around(k, " ".join(words[18 * k : 18 * k + 18])), None, None, 0) for k in range(3)]
        docs += [(10 * n + k, around(k, whole), None, None, 0) for k in (5, 7)]
        passages[10 * n + 7] = whole
    got = chunk_dedup.repeats(frame(spark, docs), block_bytes=3_000).collect()
    # pieces of 18 words are no repeats, also not three of them in a row
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(i, i - 2) for i in passages}
    text = {i: t.encode() for i, t, *_ in docs}
    for r in got:
        span = text[r["doc_id"]][r["start"] : r["end"]]
        assert span in text[r["first_doc_id"]] and r["n_words"] == len(span.split()) >= chunk_dedup.MIN_WORDS


@pytest.mark.parametrize("min_words", [6, 24])
def test_chunk_dedup_finds_all_runs(spark, min_words):
    """Against brute force over the chunks: which chunks lie in a run that one smaller id holds in a row, with enough words."""
    pieces = [prose(7000 + k, n) for k, n in enumerate((3, 9, 14, 20, 26, 33, 50))] + ["x" * 400, "the " * 60, " \n " * 40]
    rng = np.random.default_rng(5)
    docs = [(k, " ".join([pieces[j] for j in rng.integers(0, len(pieces), 6)] + [prose(8000 + k, 12)]), None, None, 0) for k in range(40)]
    data = {i: t.encode() for i, t, *_ in docs}
    cut = {i: [0, *next(iter(chunk_dedup.bounds_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))))] for i, t in data.items()}
    runs = defaultdict(set)
    for i, t in data.items():
        for a in range(len(cut[i]) - 1):
            for b in range(a + 1, len(cut[i])):
                runs[tuple(t[x:y] for x, y in zip(cut[i][a:b], cut[i][a + 1 : b + 1], strict=True))].add(i)
    want = defaultdict(set)
    for i, t in data.items():
        for a in range(len(cut[i]) - 1):
            for b in range(a + 1, len(cut[i])):
                if len(t[cut[i][a] : cut[i][b]].split()) >= min_words and min(runs[tuple(t[x:y] for x, y in zip(cut[i][a:b], cut[i][a + 1 : b + 1], strict=True))]) < i:
                    want[i].update(range(cut[i][a], cut[i][b]))
    have = defaultdict(set)
    for r in chunk_dedup.repeats(frame(spark, docs), min_words=min_words, block_bytes=4_000).collect():
        have[r["doc_id"]].update(range(r["start"], r["end"]))
    assert want and have == want


def test_very_long_texts_and_text_ids(spark, tmp_path):
    long = prose(41, 20_000)
    docs = [(1, long, None, None, 0), (2, long + " more", None, None, 0), (3, long, None, None, 0)]
    f = frame(spark, docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(f, block_words=5_000).collect()} == links(docs, 5, 80, 100)
    assert [r["n_tokens"] for r in lm_score.score(f, block_words=5_000).orderBy("doc_id").collect()] == [20_001, 20_002, 20_001]
    path = str(tmp_path / "store")
    token_store.write(f, path, BYTE_FILE)
    assert [tuple(r)[1:] for r in token_store.read_ids(spark, path).orderBy("start").select("start", "doc_id", "ids").collect()] == store_rows(docs)
    assert {(r["doc_id"], r["first_doc_id"]) for r in chunk_dedup.repeats(f, block_bytes=20_000).collect()} == {(2, 1), (3, 1)}
    lib = Tokenizer.from_file(WORD_FILE)
    assert bpe.encode(f, WORD_FILE).where("doc_id = 2").first()["ids"] == lib.encode(docs[1][1], add_special_tokens=False).ids
    named = f.selectExpr("cast(doc_id as string) as doc_id", "text")
    for run in (ngram_join.join, lm_score.score, chunk_dedup.repeats, lambda d: token_store.write(d, str(tmp_path / "no"), BYTE_FILE)):
        with pytest.raises(TypeError, match="ids must be integers"):
            run(named)


def test_empty(spark, tmp_path):
    none = frame(spark, [])
    assert ngram_join.join(none).count() == 0 and lm_score.score(none).count() == 0 and chunk_dedup.repeats(none).count() == 0
    assert bpe.encode_digests(none, WORD_FILE).count() == 0
    token_store.write(none, str(tmp_path / "s"), BYTE_FILE)
    assert token_store.documents(spark, str(tmp_path / "s")).count() == 0
    blank = frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])
    assert sorted(tuple(r) for r in ngram_join.join(blank).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert chunk_dedup.repeats(blank).count() == 0 and lm_score.score(blank).count() == 2


def test_rows_without_ids_and_repeated_ids(spark):
    """Null ids in the n-gram join, the LM scores and the license scan; rows of one id, with one text and with several, in the substring search."""
    from panelcast.llm import license_scan

    text = prose(8, 120)
    rows = [(None, text, None, None, 0), (None, text + " All rights reserved.", None, None, 0), (3, text, None, None, 0), (5, text, None, None, 0), (5, text, None, None, 0), (5, prose(9, 40), None, None, 0), (None, None, None, None, 0)]
    docs = frame(spark, rows)
    told = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect() if r["doc_id"] is not None)
    assert told == [(3, 116, 3), (5, 36, 5), (5, 116, 3), (5, 116, 3)] and ngram_join.join(docs).where("doc_id is null and component_id is null").count() == 3
    scores = lm_score.score(docs).collect()
    assert len(scores) == len(rows) and all(r["score"] is not None for r in scores)
    assert {r["held_out"] for r in scores if r["doc_id"] is None} == {zlib.crc32(b"") % 7 == 2}
    scans = license_scan.scan_licenses(docs).collect()
    assert len(scans) == len(rows) and [r["base_labels"] for r in scans if r["doc_id"] is None and r["n_base"]] == ["reserved"]
    found = chunk_dedup.repeats(docs.where("doc_id is not null"))
    assert {r["doc_id"] for r in found.collect()} <= {3, 5} and found.columns == chunk_dedup.repeats(docs.where("doc_id = 3")).columns


def test_matches_of_any_length_are_told_apart_and_encode_as_in_the_library():
    """Runs around and beyond the lengths that arrays compare, null bytes, repeats, and letters beyond ASCII."""
    runs = [b"\0" * n for n in range(1, 40)] + [b"a" * n for n in (1, 7, 8, 9, 31, 32, 33, 40)] + [b"b" * 39 + x for x in (b"1", b"2")] + [b"a" * 33, b"\0\0"]
    size = np.array([len(x) for x in runs], np.int32)
    which, first = token_store.tell_apart(b"".join(runs) + bytes(token_store.SHORT), np.cumsum(size, dtype=np.int32) - size, size)
    assert [runs[first[k]] for k in which] == runs and len(first) == len(set(runs))
    assert sorted(first.tolist()) == sorted({x: k for k, x in reversed(list(enumerate(runs)))}.values())
    texts = ["", " ", "x" * 5_000, " " * 3_000 + "end", "straße " * 400, "语言模型" * 50, "a\0\0b \0", "\t\n  x\r\n\r\n y ", "don't we'll 'tis ' re", "é" * 31 + " " + "é" * 32, "end<|endoftext|>end"]
    whole = Tokenizer.from_file(BYTE_FILE)
    got = list(token_store.PieceEncoder(BYTE_FILE).encode(texts * 2))
    assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts * 2]


def test_known_matches_are_found_by_their_keys(monkeypatch):
    """Matches of earlier calls aren't learnt again; matches of one key, a small cache and long matches encode as in the library."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcé'1. ") for _ in range(r.choice((1, 3, 9, 40)))) for _ in range(60)) for _ in range(40)]
    whole = Tokenizer.from_file(BYTE_FILE)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc = token_store.PieceEncoder(BYTE_FILE)
    assert list(enc.encode(texts)) == want
    kept = enc.keys.copy()
    assert len(kept) > 500 and (kept[1:] > kept[:-1]).all()
    monkeypatch.setattr(enc, "_learn", None)
    assert list(enc.encode(texts[::-1])) == want[::-1] and np.array_equal(enc.keys, kept)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 200)
    few = token_store.PieceEncoder(BYTE_FILE)
    assert [x for t in texts for x in few.encode([t])] == want and few.used < 600
    monkeypatch.setattr(token_store, "CACHE_WORDS", 10**6)
    full = token_store.spelled
    monkeypatch.setattr(token_store, "spelled", lambda *a: (full(*a)[0] % token_store.U64(50), full(*a)[1]))
    clash = token_store.PieceEncoder(BYTE_FILE)
    assert [x for t in texts for x in clash.encode(t.split("."))] == [x for t in texts for x in (np.array(whole.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in t.split("."))]
    assert len(clash.keys) <= 50
    words = ["ab", "cd", "efg", "hi", "é"]  # a match a call: keys clash between calls, not within one
    monkeypatch.setattr(token_store, "spelled", lambda *a: (np.where(full(*a)[1][0][1] == 255, full(*a)[0], token_store.U64(7)), full(*a)[1]))
    clash = token_store.PieceEncoder(BYTE_FILE)
    assert [x for w in words * 2 for x in clash.encode([w])] == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words * 2] and len(clash.keys) == 1


def test_what_several_calls_had_outlives_a_full_cache(monkeypatch):
    """Matches that come again and again are learnt once, however many others fill the cache; what is kept encodes as in the library."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdeé1") for _ in range(k))
    common = [word(k) for k in (3, 5, 8, 9, 17, 33, 60) for _ in range(10)]
    texts = [" ".join(r.sample(common, len(common)) + [word(12) for _ in range(100)]) for _ in range(30)]
    whole = Tokenizer.from_file(BYTE_FILE)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 1_000)
    enc, learnt = token_store.PieceEncoder(BYTE_FILE), Counter()
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda *a: learnt.update(a[0] + a[1]) or learn(*a))
    most = 0
    for t in texts:
        assert list(enc.encode([t])) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        most = max(most, enc.used)
    whole_words = {b" " + w.encode() for w in common if w.isalpha()}
    assert len(whole_words) > 10 and {learnt[w] for w in whole_words} == {1} and len(learnt) > 3_000 and most < 1_700
    monkeypatch.setattr(token_store, "CACHE_WORDS", 20)  # fewer than the calls have in common
    assert [x for t in texts[:5] for x in enc.encode([t])] == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:5]]


def test_new_matches_of_one_row_do_not_join(tmp_path):
    """Tokens with a blank inside, and vocabularies without a byte that ends matches, give the library's ids all the same."""
    units = [token_store.BYTE_CHARS[b] for b in range(256)]
    texts = ["ab cd. ab", " ab ab cdb x1!! b", "cd\n\nab  cd é ÿ b b"]
    for name, alphabet, merges in (("joins", units, [("b", "Ġ"), ("Ġ", "c"), ("c", "d")]), ("no-stop", units[:0xC0] + units[0xC2:0xF5], [("a", "b"), ("Ġ", "ab")]), ("taken", units, [("ÿ", "b"), ("Ġ", "b")])):
        vocabulary = {t: k for k, t in enumerate([*alphabet, *(x + y for x, y in merges)])}
        made = Tokenizer(models.BPE(vocabulary, merges))
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        made.save(path := str(tmp_path / f"{name}.json"))
        enc = token_store.PieceEncoder(path)
        assert list(enc.encode(texts)) == [np.array(made.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert (enc.stop is None) == (name == "no-stop")


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_known_matches_are_looked_up_in_slots(monkeypatch, bits):
    """What has its slot is neither told apart nor searched again; matches that share a slot encode as in the library."""
    monkeypatch.setattr(token_store, "SLOT_BITS", bits)
    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abé\0'1. ") for _ in range(r.choice((1, 2, 8, 9, 31, 33, 40)))) for _ in range(50)) for _ in range(30)]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(BYTE_FILE).encode_batch(texts, add_special_tokens=False)]
    enc, asked = token_store.PieceEncoder(BYTE_FILE), []
    find = enc._find
    monkeypatch.setattr(enc, "_find", lambda raw, kind, begin, size: asked.append(size.tolist()) or find(raw, kind, begin, size))
    assert list(enc.encode(texts)) == want and list(enc.encode(texts[::-1])) == want[::-1]
    first, again = ({n for n in x if n <= token_store.SHORT} for x in asked)
    assert len(asked[0]) > 500 and len(first) > 8
    if bits == 20:
        assert len([n for n in asked[1] if n <= token_store.SHORT]) < 10 and len(again) < len(first)
