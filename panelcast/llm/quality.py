"""Quality rules [native]: a table of thresholds compiled into one projection, with no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CHAR_RE, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in a it for on as was by this "
    "le la les de des du et que qui en un une est pour dans "
    "der die das und den dem von zu mit ist ein eine nicht "
    "el los las y un una del por con se para es"
).split()
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

#: measure, least, most (None: open). A document passes with every measure in its range.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("shouts_per_word", None, 0.2),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds q (a struct of counts and ratios) to each row, in place of a column of that name; all other columns stay as they are.

    Null text counts as empty: every count is 0. Three-word windows are compared by 64-bit hashes of
    their words, so that two different windows of one text of n words are confused with a chance of
    about n*n / 2**65.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD_CHAR_RE))
    base = held.withColumns({"_w": words(F.col("_text")), "_l": lines})
    grams = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_g", grams)
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    base = base.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    twin = F.filter("_s", lambda x, i: (F.get("_s", i + 1)["h"] == x["h"]) | (F.get("_s", i - 1)["h"] == x["h"]))
    base = base.withColumn("_p", F.sort_array(F.transform(twin, lambda x: x["p"])))
    # each window covers 3 words; of two windows less than 3 apart only the new words count
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("bigint")
    counts = base.withColumn(
        "_c",
        F.struct(
            long(F.size("_w")).alias("n_words"),
            long(F.length(F.array_join("_w", ""))).alias("word_chars"),
            long(F.regexp_count(body, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
            long(F.size("_l")).alias("n_lines"),
            long(F.regexp_count(body, F.lit("!!"))).alias("n_shouts"),
            long(F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
        ),
    )
    c = F.col("_c")
    ratios = {
        "mean_word_chars": _ratio(c["word_chars"], c["n_words"]),
        "symbols_per_word": _ratio(c["n_symbols"], c["n_words"]),
        "shouts_per_word": _ratio(c["n_shouts"], c["n_words"]),
        "stop_word_ratio": _ratio(c["n_stop_words"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
    }
    kept = [c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")]
    return counts.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c != "q"), F.struct(*kept, *(v.alias(k) for k, v in ratios.items())).alias("q"))


def verdict(q: Column, rules=RULES) -> Column:
    """The conjunction that the table compiles to; a null measure fails."""
    tests = [F.lit(True)]
    for name, least, most in rules:
        tests += [q[name] >= least] if least is not None else []
        tests += [q[name] <= most] if most is not None else []
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def score_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Every row with q, base_failed and kept. Clashing columns q, base_failed and kept are replaced; an empty table gives an empty one."""
    out = measures(docs, text)
    q = F.col("q")
    return out.withColumn("base_failed", base_failed(q)).withColumn("kept", ~F.col("base_failed") & verdict(q, rules))


def keep_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    # the verdict goes through explode, because a plain filter would be pushed down into the projections and have the words split
    # anew for every window
    return score_quality(held, "_text", rules).select("_row", F.explode(F.array("kept")).alias("_kept")).where("_kept").select("_row.*")
