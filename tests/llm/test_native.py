"""The operators without Python: against plain Python, on texts of many shapes, and on empty tables."""

import re
from collections import Counter

import pytest
from panelcast.llm import license_scan, line_dedup, mixing, quality

from .helpers import WORD, clashing, corpus, frame, prose, untouched


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(grams)
    covered = {k + j for k, x in enumerate(grams) if times[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    docs = corpus()
    scored = quality.score_quality(clashing(spark, docs))
    untouched(scored, clashing(spark, docs), "q", "base_failed", "kept")
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        q, want = got[i]["q"], quality_counts(text)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want, (i, text)
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = {r["doc_id"] for r in quality.keep_quality(frame(spark, docs)).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]} and 0 in kept and 13 in kept
    assert quality.keep_quality(clashing(spark, docs)).columns == clashing(spark, docs).columns


def test_license(spark):
    docs = corpus() + corpus()[16:18]  # repeated rows each keep a row
    got = license_scan.scan_licenses(clashing(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, text, *_ in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        r = by[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(starts), ",".join(sorted(labels))), text
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert by[16]["labels"] == "mit,reserved" and by[16]["score"] == 1.0
    assert by[17]["n_base"] == 3 and by[17]["base_labels"] == "cc-by,gpl"
    assert "cc-by-nc" in by[18]["labels"].split(",")
    # every containment: phrases cross block bounds at any offset
    far = [(k, "w " * k + "all rights reserved", None, None, 0) for k in range(60)]
    assert all(r["first_word"] == r["doc_id"] == r["last_word"] for r in license_scan.scan_licenses(frame(spark, far)).collect())


def test_license_paragraphs(spark):
    """Whole paragraphs at any offset, with some words changed, and too many; against every block and template."""
    rows = license_scan.templates()
    texts = []
    for k, r in enumerate(r for r in rows if not r["exact"]):
        words = list(r["body"])
        texts += [prose(k, 7 * k) + " " + " ".join(words).upper() + ". " + prose(50 + k, 30), " ".join([*prose(80 + k, 3 * k).split(), *words[: len(words) // 2]])]
        texts.append(" ".join("changed" if j % 40 == 7 else x for j, x in enumerate(words)))
    docs = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    assert max(r["step"] for r in rows) >= 128
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, docs)).collect()}
    for i, text, *_ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        labels, score = set(), 0.0
        for r in rows:
            for a in range(0, len(w), r["step"]):
                block = w[a : a + 2 * r["step"]]
                shared = len(set(block) & set(r["kinds"]))
                if shared >= r["need"] and (not r["exact"] or any(w[b : b + len(r["body"])] == r["body"] for b in range(a, a + r["step"]))):
                    labels.add(r["label"])
                    score = max(score, shared / len(r["kinds"]))
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), score), i
    assert all(r["label"] in got[3 * k]["labels"].split(",") for k, r in enumerate(r for r in rows if not r["exact"]))


@pytest.mark.parametrize("broadcast_lines", [200_000, 0])
def test_lines(spark, broadcast_lines):
    docs = corpus()
    cut = line_dedup.drop_lines(clashing(spark, docs), max_ratio=0.3, min_pages=5, counts=True, broadcast_lines=broadcast_lines)
    untouched(cut, clashing(spark, docs), "n_lines", "n_dropped")
    untouched(line_dedup.drop_lines(clashing(spark, docs)), clashing(spark, docs))
    got = {r["doc_id"]: r for r in cut.collect()}
    total, pages = Counter(), Counter()
    for _, text, _, host, _ in docs:
        total[host or ""] += 1
        pages.update({(host or "", x.strip(" \t\n\x0b\f\r")) for x in (text or "").split("\n")})
    bad = {k for k, n in pages.items() if k[1] and n >= 5 and n > 0.3 * total[k[0]]}
    assert bad == {("src0", "Same footer line")}
    for i, text, _, host, _ in docs:
        lines = None if text is None else text.split("\n")
        keep = None if text is None else [x for x in lines if (host or "", x.strip(" \t\n\x0b\f\r")) not in bad]
        assert got[i]["text"] == (None if text is None else "\n".join(keep)), i
        assert got[i]["n_dropped"] == (0 if text is None else len(lines) - len(keep))


def water_fill(budget, nodes):
    """[(name, weight, capacity)] -> shares in real numbers."""
    out, left = {}, list(nodes)
    while left:
        w = sum(x[1] for x in left)
        full = [x for x in left if x[2] <= x[1] * budget / w]
        if not full:
            return out | {x[0]: x[1] * budget / w for x in left}
        for x in full:
            out[x[0]] = x[2]
            budget -= x[2]
        left = [x for x in left if x not in full]
    return out


def test_fill(spark):
    nodes = [("a", 5, 10), ("b", 1, 1000), ("c", 1, 1000), ("d", 3, 30)]
    f = spark.createDataFrame([(*x, b) for x in nodes for b in (100,)], "name string, weight bigint, capacity bigint, budget bigint").select("name", "weight", "capacity", "budget")
    got = {r["name"]: r["share"] for r in mixing.fill(f, []).collect()}
    assert sum(got.values()) == 100 and all(abs(got[k] - v) < 1 for k, v in water_fill(100, nodes).items())
    short = {r["name"]: r["share"] for r in mixing.fill(f.withColumn("budget", f.budget + 10_000), []).collect()}
    assert short == {"a": 10, "b": 1000, "c": 1000, "d": 30}


def test_mix(spark):
    docs = corpus()
    docs += docs[:2]
    n = Counter()
    leaf = {}
    for i, text, lang, source, _ in docs:
        n[i] += len(WORD.findall(text or ""))
        leaf[i] = (mixing.DOMAINS.get(source or "unknown", "other"), lang or "unknown", source or "unknown")
    whole = mixing.select(frame(spark, docs), budget=10**9, max_epochs=3).collect()
    assert Counter(r["doc_id"] for r in whole) == {i: 3 for i, k in n.items() if k}  # more than there is: every leaf at its capacity
    budget = 2000
    got = mixing.select(clashing(spark, docs).drop("uid", "domain"), budget=budget, run_docs=2).collect()
    assert sum(r["take_tokens"] for r in got) == budget
    assert all((r["domain"], r["lang"], r["source"]) == leaf[r["doc_id"]] and r["n_tokens"] == n[r["doc_id"]] for r in got)
    tops = {d: sum(k * 4 for i, k in n.items() if leaf[i][0] == d) for d in {x[0] for x in leaf.values()}}
    want = water_fill(budget, [(d, mixing.WEIGHTS["domain"].get(d, 1), c) for d, c in tops.items() if c])
    have = Counter()
    for r in got:
        have[r["domain"]] += r["take_tokens"]
    assert all(abs(have[d] - v) <= 1 for d, v in want.items())
    again = mixing.select(frame(spark, docs), budget=budget, run_docs=1000).collect()
    key = lambda rs: sorted((r["doc_id"], r["epoch"], r["take_tokens"]) for r in rs)
    assert key(got) == key(again)  # runs are only cut for scale
    assert mixing.mix(frame(spark, docs), budget=budget).columns == frame(spark, docs).columns


def test_empty(spark):
    none = frame(spark, [])
    assert quality.score_quality(none).count() == quality.keep_quality(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert line_dedup.drop_lines(none).count() == 0
    assert mixing.select(none).count() == 0


def test_very_long_texts_and_ties(spark):
    """20,000 words and lines, and texts and hashes that are equal."""
    long = "\n".join(prose(k, 40) for k in range(500))
    docs = [(k, long, "en", "src0", 0) for k in range(3)] + [(9, long.replace("\n", " "), "en", "src0", 0)]
    got = {r["doc_id"]: r for r in quality.score_quality(frame(spark, docs)).collect()}
    assert all(tuple(got[i]["q"])[:5] == quality_counts(t) for i, t, *_ in docs)
    assert {r["doc_id"]: r["n_words"] for r in license_scan.scan_licenses(frame(spark, docs)).collect()} == {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for i, t, *_ in docs}
    cut = {r["doc_id"]: r for r in line_dedup.drop_lines(frame(spark, docs), counts=True).collect()}
    assert [(cut[i]["n_lines"], cut[i]["n_dropped"], cut[i]["text"] == "") for i in (0, 1, 2, 9)] == [(500, 500, True)] * 3 + [(1, 0, False)]
    same = [(7, "one two three", "en", "src0", 0)] * 4 + [(8, "one two three", "en", "src0", 0)] * 2  # rows of one id are one unit
    taken = mixing.select(frame(spark, same), budget=13, max_epochs=1).collect()
    assert sum(r["take_tokens"] for r in taken) == 13 and {(r["doc_id"], r["n_tokens"]) for r in taken} == {(7, 12), (8, 6)}
