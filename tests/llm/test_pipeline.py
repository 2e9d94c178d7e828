"""Every stage of the pipeline against plain Python on its own input, and the whole of run()."""

import hashlib
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from panelcast.llm import mixing
from tokenizers import Tokenizer

from .helpers import WORD, clashing, corpus, frame, prose
from .test_free import links
from .test_native import quality_counts

WS = " \t\n\x0b\x0c\r"


def documents():
    """Texts of many shapes, rows with null ids, repeated rows, and enough pages of a source that lines count."""
    rows = [(i, (t + "\n" + prose(300 + i, 90)) if t and i % 3 == 0 else t, lang, source, n) for i, t, lang, source, n in corpus()]
    base = prose(900, 150)
    rows += [(100 + k, f"Menu of the site\n{prose(400 + k, 110)}\nnumber {k}", "en", "src2", 0) for k in range(20)]
    rows += [(200 + k, " ".join(w if j != 17 * k else "other" for j, w in enumerate(base.split())), "de", "src3", 0) for k in range(5)]
    rows += [rows[-1], (None, prose(901, 80), None, None, None), (300, base, "de", "src3", 0)]
    return rows


def quality(rows):
    from panelcast.llm.quality import RULES, STOP_WORDS

    kept = []
    for r in rows:
        t = r[1] or ""
        n, chars, symbols, dup, repeat = quality_counts(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        ratio = lambda a, b: a / b if b else 0.0
        q = {"n_words": n, "mean_word_chars": ratio(chars, n), "symbols_per_word": ratio(symbols, n), "shouts_per_word": ratio(t.count("!!"), n), "stop_word_ratio": ratio(sum(w.lower() in STOP_WORDS for w in WORD.findall(t)), n), "dup_line_ratio": ratio(dup, len(lines))}
        good = all((low is None or q[c] >= low) and (high is None or q[c] <= high) for c, low, high in RULES)
        if good and n >= 50 and 100 * repeat <= 50 * n:
            kept.append(r)
    return kept


def line_dedup(rows):
    from panelcast.llm.line_dedup import MAX_RATIO, MIN_PAGES

    total, pages = Counter(), Counter()
    for r in rows:
        total[r[3] or ""] += 1
        pages.update({(r[3] or "", x.strip(WS)) for x in (r[1] or "").split("\n")})
    bad = {k for k, n in pages.items() if k[1] and n >= MIN_PAGES and n > MAX_RATIO * total[k[0]]}
    out = []
    for i, t, lang, source, _ in rows:
        new = None if t is None else "\n".join(x for x in t.split("\n") if (source or "", x.strip(WS)) not in bad)
        out.append((i, new, lang, source, None if new is None else len(new)))
    return out


def near_copies(rows):
    root = {i: c for i, (_, c) in links([r for r in rows if r[0] is not None], 5, 80, 100).items()}
    seen, out = set(), []
    for r in rows:
        if r[0] is None or (root[r[0]] == r[0] and r[:2] not in seen):
            out.append(r)
            seen.add(r[:2])
    return out


def shared_out(children, budget):
    """children: name -> (weight, capacity). Who is full drops out, and the others share what is left, until nobody new is full."""
    share, open_, left = {}, dict(children), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [c for c, (w, cap) in open_.items() if cap * total <= w * left]
        if not full:
            break
        for c in full:
            share[c] = open_.pop(c)[1]
            left -= share[c]
    total = sum(w for w, _ in open_.values())
    parts = {c: w * left // total for c, (w, _) in open_.items()}
    spare = left - sum(parts.values())
    for k, c in enumerate(sorted(parts)):
        share[c] = parts[c] + (k < spare)
    return share


def mixed(rows):
    """The rows, each as often as its unit is read: tokens flow from the root over domains and languages to sources, and a source reads whole epochs and a prefix of one more."""
    units = Counter()
    name = lambda r: ("" if r[0] is None else str(r[0]), r[2] or "unknown", r[3] or "unknown")
    for r in rows:
        units[name(r)] += len(WORD.findall(r[1] or ""))
    units = {u: n for u, n in units.items() if n}
    leaf = lambda u: (mixing.DOMAINS.get(u[2], "other"), u[1], u[2])
    tokens = Counter()
    for u, n in units.items():
        tokens[leaf(u)] += n
    shares = {(): sum(tokens.values()) * mixing.BUDGET_PERCENT // 100}
    for depth, level in enumerate(mixing.LEAF):
        below = {}
        for path in {x[: depth + 1] for x in tokens}:
            capacity = mixing.MAX_EPOCHS * sum(n for x, n in tokens.items() if x[: depth + 1] == path)
            below.setdefault(path[:depth], {})[path[-1]] = (mixing.WEIGHTS[level].get(path[-1], 1), capacity)
        shares = {(*up, c): n for up, children in below.items() for c, n in shared_out(children, shares[up]).items()}
    times = Counter()
    for x, n in tokens.items():
        whole, rest = divmod(shares[x], n)
        own = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{u[0]}".encode()).hexdigest(), units[u], u) for u in units if leaf(u) == x)
        before = 0
        for _, size, u in own:
            times[u] = whole + (before < rest)
            before += size
    return [r for r in rows for _ in range(times[name(r)])]


def same(got, want):
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("columns", ["own", "clashing"])
def test_each_stage_against_plain_python(spark, columns):
    rows = documents()
    for step, plain in ((pipeline.quality_rules, quality), (pipeline.line_dedup_stage, line_dedup), (pipeline.near_copies, near_copies)):
        given = frame(spark, rows) if columns == "own" else clashing(spark, rows)
        got, want = step(spark, given, ""), plain(rows)
        assert got.columns == given.columns
        same(got.select("doc_id", "text", "lang", "source", "n_chars"), want)
        assert 0 < len(want) <= len(rows)
        rows = want
    given = frame(spark, rows) if columns == "own" else clashing(spark, rows)
    drawn, want = pipeline.source_mix(spark, given, ""), mixed(rows)
    assert drawn.columns == given.columns and want
    same(drawn.select("doc_id", "text", "lang", "source", "n_chars"), want)
    told, encoded = pipeline.bpe_encode(spark, given, "").collect(), plain_bpe(rows)
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in told) == encoded


def plain_bpe(rows):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for i, t, lang, source, _ in rows:
        e = lib.encode(t or "", add_special_tokens=False)
        out[i, lang, source, len(e.ids), tuple(e.ids), hashlib.sha256(" ".join(e.tokens).encode()).hexdigest()] += 1
    return out


def test_stages_on_very_long_texts(spark):
    """Texts of a hundred thousand words and more, two of them near copies, beside short ones."""
    long = prose(71, 120_000)
    near = long.replace(" the ", " teh ", 400)
    rows = [(1, f"Menu\n{long}", "en", "src1", 0), (2, f"Menu\n{near}", "en", "src1", 0), *((10 + k, f"Menu\n{prose(500 + k, 90)}", "en", "src1", 0) for k in range(30))]
    for step, plain in ((pipeline.quality_rules, quality), (pipeline.line_dedup_stage, line_dedup)):
        got, want = step(spark, frame(spark, rows), ""), plain(rows)
        same(got.select("doc_id", "text", "lang", "source", "n_chars"), want)
        rows = want
    kept = pipeline.near_copies(spark, frame(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {2}
    rows = [r for r in rows if r[0] != 2]
    same(pipeline.source_mix(spark, frame(spark, rows), "").select("doc_id", "text", "lang", "source", "n_chars"), mixed(rows))
    told = pipeline.bpe_encode(spark, frame(spark, rows[:3]), "").collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in told) == plain_bpe(rows[:3])


def test_run(spark, tmp_path):
    for name, rows in (("some", documents()), ("none", [])):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = pipeline.run(spark, str(tmp_path / name)).collect()
        want = near_copies(line_dedup(quality(rows)))
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in mixed(want)) and bool(got) == bool(rows)
        text = {r[0]: r[1] for r in want}
        lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        for r in got:
            found = lib.encode(text[r["doc_id"]] or "", add_special_tokens=False)
            assert (r["ids"], r["n_tokens"], r["decoded_sha256"]) == (found.ids, len(found.ids), hashlib.sha256(" ".join(found.tokens).encode()).hexdigest())
