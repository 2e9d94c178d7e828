"""Line dedup [native] by site-relative frequency: lines that stand on more than a given share of a host's pages are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, stage

#: A line on more than MAX_RATIO of its host's pages is boilerplate. On two pages alone it may be a copy of one page, so that it needs MIN_PAGES.
MAX_RATIO, MIN_PAGES = 0.03, 3
#: So many boilerplate lines (16-byte digests) may be broadcast; beyond, the hosts' lists are joined by a shuffle, in which a host has SALTS parts.
BROADCAST_LINES, SALTS = 200_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits of a line without the white space around it."""
    return F.unhex(F.md5(F.btrim(line, F.lit(WS))))


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(WS)) != ""


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (digest), pages, of_host: counts are of pages, so that a line counts once a page. Counted before the shuffle, by host and line."""
    pages = docs.select(F.coalesce(host, F.lit("")).alias("host"), text.alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    each = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _solid), _digest))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") > max_ratio * F.col("of_host"))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The same rows and columns with boilerplate lines cut out of the text; counts=True adds n_lines and n_dropped, in place of columns of these names.

    A null host is the host "". A null text stays null. White space around a line doesn't matter for comparing, blank
    lines are neither counted nor dropped, and a text may become empty. A host has at most (lines per page) / max_ratio such
    lines, however many pages it has. Lines are compared by 128-bit digests.
    """
    found = stage(boilerplate(docs, F.col(f"`{host_col}`"), F.col(f"`{text_col}`"), max_ratio, min_pages), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_list("line").alias("_drop")).withColumnRenamed("host", "_host")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("_host"), F.col(f"`{text_col}`").alias("_text"))
    if found.count() <= broadcast_lines:
        rows = rows.join(F.broadcast(lists), "_host", "left")
    else:
        # a host's rows go to several tasks, each of which gets its list
        salt = F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")
        lists = lists.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.withColumn("_salt", F.coalesce(salt, F.lit(0))).join(lists, ["_host", "_salt"], "left")
    rows = rows.withColumn("_lines", _lines(F.col("_text")))
    kept = F.filter("_lines", lambda x: ~F.array_contains("_drop", _digest(x)) | ~_solid(x))
    rows = rows.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
    text = F.when(F.size("_kept") == F.size("_lines"), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    tallies = {
        "n_lines": F.coalesce(F.size(F.filter("_lines", _solid)), F.lit(0)).cast("bigint"),
        "n_dropped": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("bigint"),
    }
    own = [c for c in docs.columns if not (counts and c in tallies)]
    columns = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in own]
    return rows.select(*columns, *(v.alias(k) for k, v in tallies.items() if counts))
