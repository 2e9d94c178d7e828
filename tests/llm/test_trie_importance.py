"""The prefix trie and importance resampling, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import importance, prefix_trie

from .helpers import clashing, corpus, frame, prose

CONVS = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations() -> list[tuple]:
    """Shared heads, copies, turnless results, gaps, null and empty fields, repeated rows and ids far apart."""
    r = random.Random(5)
    rows = []
    for c in [*range(60), 119, 1_000_000_007, 205, 206]:
        base = r.choice([0, 1, 2])
        for t in range(r.randint(1, 6)):
            rows.append((c, t, ["user", "assistant"][t % 2], prose(base * 10 + t, 6) if r.random() < 0.7 else prose(c * 100 + t, 4)))
    same = [(t, "user", f"common {t}") for t in range(5)]
    rows += [(c, *turn) for c in range(300, 340) for turn in same]
    rows += [(400, None, None, None), (400, 0, "user", ""), (400, 0, "user", ""), (401, None, "user", "x"), (401, 3, "", "y"), (None, 0, "user", "lost"), (402, 5, "user", "b"), (402, 5, "user", "a")]
    return rows


def trie_by_hand(rows: list[tuple], graft: bool) -> set[tuple]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, key, (role, text)))
    seqs = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    if graft:
        seqs = {c: seqs.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + s[h:] for c, s in seqs.items()}
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    out = set()
    for p, own_members in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: all(len(x) <= len(q) or x[: len(q)] != q for x in members)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in own_members if len(seqs[c]) == len(p))
        out.add((
            own_members[0], len(p), members[p[:-1]][0] if p else None, len(own_members), sum(len(q) == len(p) + 1 for q in below), sum(leaf(q) for q in below), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize("graft", [None, (20, 4)])
@pytest.mark.parametrize("shard", [(4096, 50_000), (7, 20), (1, 1)])
def test_trie(spark, graft, shard):
    rows = conversations()
    table = spark.createDataFrame(rows, CONVS).repartition(3)
    table = table.select("*", *(F.lit("x").alias(c) for c in ("id", "key", "n_words", "block", "hash", "ends", "n", "a.b", "base")))
    got = prefix_trie.build(table, graft=graft, shard_convs=shard[0], shard_turns=shard[1]).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == trie_by_hand(rows, graft is not None)


def test_trie_of_long_conversations(spark):
    """Far deeper than any recursion would go, in several shards, and other names of columns."""
    rows = [(c, t, "user", f"turn {t}" if t < 2500 else f"{c} {t}") for c in (3, 4, 25) for t in range(3000)]
    table = spark.createDataFrame(rows, "dialog int, at bigint, who string, said string")
    got = prefix_trie.build(table, "dialog", "at", "who", "said", shard_convs=2).collect()
    assert len(got) == 1 + 2500 + 3 * 500
    root = next(r for r in got if r["depth"] == 0)
    assert (root["conv_id"], root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"], root["ends_sha256"]) == (3, 3, 1, 3, 2 * 2 * 2500, EMPTY)


def test_trie_odd_input(spark):
    assert prefix_trie.build(spark.createDataFrame([], CONVS), graft=(20, 4)).collect() == []
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "user", "x")], CONVS)).collect() == []
    with pytest.raises(TypeError, match="integers"):
        prefix_trie.build(spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn int, role string, text string"))


def chosen_by_hand(docs: list[tuple], target: list[str], n: int, buckets: int, percent: int) -> dict:
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, able = [], []
    for k, (i, text, *_) in enumerate(docs):
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(found), weight, score, None])
        if words >= 20:
            able.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[k][-1] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 50), (3, 1000, 100)])
def test_importance(spark, n, buckets, percent):
    rows = [*corpus(), (500, prose(77, 60_000), "en", "s", 0), (None, prose(8, 30), None, None, 0), (7, "Ä" + "x" * 100_000 + " Ünder_score-1", None, None, 0)]
    target = [prose(3, 50), None, "", "The OF and"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(clashing(spark, rows).repartition(3), goal, n=n, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == chosen_by_hand(rows, target, n, buckets, percent)


def test_importance_counts_fold():
    """Counters that are folded after every text give the same counts."""
    batch = pa.record_batch({"text": [r[1] for r in corpus()]})
    once, often = ([b.to_pydict() for b in importance.counted(2, 100, kept)(iter([batch]))] for kept in (10**6, 1))
    assert once == often and sum(once[0]["count"]) > 1000


def test_importance_odd_input(spark):
    docs = frame(spark, [(k, prose(k, 30), "en", "s", 0) for k in range(20)])
    goal = spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(docs.where("false"), goal).collect() == []
    got = importance.resample(docs, goal).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("body"), F.lit(1).alias("score"))
    drawn = importance.select(named, goal, id_col="name", text_col="body", percent=25)
    assert drawn.columns == named.columns and drawn.count() == 5


def test_importance_prefers_the_target(spark):
    """Documents in the target's words are drawn first."""
    near = [(k, " ".join(["alpha", "beta", "gamma"][(k + j) % 3] for j in range(40)), None, None, 0) for k in range(10)]
    far = [(k + 10, " ".join(["stone", "water", "fire"][(k + j) % 3] for j in range(40)), None, None, 0) for k in range(90)]
    goal = spark.createDataFrame([(0, "alpha beta gamma " * 20)], "item_id int, text string")
    assert {r["doc_id"] for r in importance.select(frame(spark, near + far), goal).collect()} == set(range(10))
