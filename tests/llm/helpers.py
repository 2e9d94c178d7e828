import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to", "Été", "straße"]) if r.random() < 0.3 else "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts of many shapes: null, empty, blank, short, long, copies, near copies, odd characters, repeated rows, null fields."""
    base = prose(1, 120)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (5, 40, 90)]
    far = " ".join([*words[:60], *prose(2, 60).split()])
    texts = [
        base, base, *near, far, None, "", " \t\n ", "one", "one two three", "One Two Three four", "one two three four", prose(3, 2000), base.replace(" ", "\n", 7), base.replace(" ", "  ", 3),
        "All rights reserved.\nReleased under the MIT License.", "cc by cc\nBY and the GNU general PUBLIC license, version 3", "Licensed under CC BY-NC 4.0.\n" + prose(4, 60), "a a a a a a a a a a a a", "K İ ß \x1c x²½ <|endoftext|> 😀 don't",
        *(f"Same footer line\n{prose(10 + k, 70)}\nunique {k}" for k in range(8)), "\n".join(["dup line"] * 4), prose(30, 55) + " ### $$$ %%% ***" * 9, "the " * 300,
    ]
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "src0", "src1", "src11"][k % 4] if "footer" not in (t or "") else "src0", len(t or "")) for k, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, rows):
    """The same rows with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    f = frame(spark, rows)
    return f.select("*", *(F.lit("x").alias(c) for c in ("q", "kept", "base_failed", "id", "row", "n", "ids", "uid", "domain", "host", "_row", "_text", "_w", "n_words", "_host", "_drop", "_lines", "_kept", "key", "_l", "_g", "_s", "_p", "_c", "_n", "_d", "_salt", "n_lines", "n_dropped", "a.b", "c0", "source_", "root", "family", "digest", "block", "start", "ends")))


def untouched(got, docs, *changed):
    """The columns that `clashing` adds came out whole, but for those that the operator gives itself."""
    from collections import Counter

    extra = [c for c in docs.columns if c not in {f.name for f in DOCS} | set(changed)]
    rows = got.select(*(f"`{c}`" for c in extra)).collect()
    assert Counter(map(tuple, rows)) == {("x",) * len(extra): docs.count()}
