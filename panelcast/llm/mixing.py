"""Mixing sources to target weights [native]: hierarchical budgets over a domain - language - source tree.

A token budget flows from the root to the leaves in proportion to the weights. A child never gets more than its capacity
(its tokens times the greatest number of epochs); what it can't take goes to its siblings in proportion to their weights, and
only when all of them are full does the parent itself fall short, so that its own siblings take the rest. Each leaf then reads its documents in
epochs, each in an order of its own from a seeded hash, and the prefix that holds its budget is taken.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, words

#: Which domain a source belongs to; others belong to "other".
DOMAINS = {f"src{i}": "web" if i < 10 else "books" if i < 15 else "news" for i in range(20)}
#: Integer weights of domains, languages and sources among their siblings; 1 for any other.
WEIGHTS = {
    "domain": {"web": 6, "books": 3, "news": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 3},
}
MAX_EPOCHS, SEED, BUDGET_PERCENT = 4, 20_240_601, 50
#: Documents of a leaf that are ordered in one task, about.
RUN_DOCS = 2_000
LEAF = ["domain", "lang", "source"]


def _lookup(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*table.items())))[key], F.lit(other)) if table else F.lit(other)


def fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds `share` to nodes with a budget (of the parent), a weight and a capacity, in whole tokens.

    The children with the least capacity for their weight are full first; the others share what is left. Of tokens that
    rounding leaves over, the first by name get one each. Products of tokens and summed weights must stay under 2**63; beyond, the query fails.
    """
    of = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    name = nodes.columns[len(parents)]
    order = of.orderBy(F.col("capacity") / F.col("weight"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(upto), F.lit(0))
    full = nodes.withColumn("full", F.col("capacity") * F.sum("weight").over(rest) <= F.col("weight") * F.greatest(left, F.lit(0)))
    full = full.withColumn("left", F.greatest(F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(of), F.lit(0)))
    full = full.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(of))
    part = full.withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("weight * left div open")))
    spare = F.col("left") - F.sum(F.when(~F.col("full"), F.col("part")).otherwise(0)).over(of)
    nth = F.row_number().over(of.orderBy("full", name))
    return part.withColumn("share", F.col("part") + F.when(~F.col("full") & (nth <= spare), 1).otherwise(0)).drop("full", "left", "open", "part")


def budgets(leaves: DataFrame, budget: int, weights: dict = WEIGHTS) -> DataFrame:
    """leaf columns, tokens, share: capacities are summed up the tree, budgets flow down it. leaves: leaf columns, tokens, docs, capacity. One row a leaf."""
    nodes = None
    for depth, level in enumerate(LEAF):
        path = LEAF[: depth + 1]
        sums = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if depth:
            sums = sums.join(nodes.select(*LEAF[:depth], F.col("share").alias("budget")), LEAF[:depth])
        else:
            sums = sums.withColumn("budget", F.lit(budget).cast("bigint"))
        weight = _lookup(weights.get(level, {}), F.col(level), 1).cast("bigint")
        nodes = fill(sums.withColumn("weight", weight).where("weight > 0"), LEAF[:depth])
    return leaves.join(nodes.select(*LEAF, "share"), LEAF, "left").withColumn("share", F.coalesce("share", F.lit(0)).cast("bigint"))


def select(docs: DataFrame, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domains: dict = DOMAINS, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, run_docs: int = RUN_DOCS) -> DataFrame:
    """One row per document and epoch that it is read in: id, domain, lang, source, epoch, n_tokens, take_tokens.

    Tokens are words between white space. Without a budget, half of the corpus's tokens are taken. Null languages and
    sources are "unknown". Rows with equal id, language and source form one unit, taken or left together; a null id has
    the unit of the empty string. Documents without words are never taken. A unit belongs to the prefix if the budget isn't
    used up before it; take_tokens says how many of its tokens are inside. An empty table gives an empty one.
    """
    key = {"uid": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "lang": F.coalesce(F.col(f"`{lang_col}`"), F.lit("unknown")), "source": F.coalesce(F.col(f"`{source_col}`"), F.lit("unknown"))}
    read = docs.select(F.col(f"`{id_col}`").alias("id"), *(v.alias(k) for k, v in key.items()), F.size(words(F.col(f"`{text_col}`"))).cast("bigint").alias("n"))
    units = read.groupBy("uid", "lang", "source").agg(F.first("id").alias("id"), F.sum("n").alias("n")).where("n > 0")
    units = stage(units.withColumn("domain", _lookup(domains, F.col("source"), "other")), "mix-units")
    leaves = stage(units.groupBy(*LEAF).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("capacity", F.col("tokens") * max_epochs), "mix-leaves")
    if budget is None:
        budget = (leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * BUDGET_PERCENT) // 100
    shares = stage(budgets(leaves, budget, weights), "mix-shares")
    plan = shares.select(*LEAF, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest"), F.expr(f"(docs + {run_docs} - 1) div {run_docs}").alias("runs"))
    # one short row a leaf; beyond this many leaves, by a shuffle in which Spark splits large leaves
    plan = F.broadcast(plan) if shares.count() <= 100_000 else plan
    rows = units.join(plan, LEAF).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "whole", "uid")))
    # the hash's order is cut into runs of about equal length, so that no task has to order a whole leaf
    rows = rows.withColumn("run", F.expr("cast(conv(substr(order, 1, 8), 16, 10) as bigint) * runs div 4294967296"))
    run = Window.partitionBy(*LEAF, "run").orderBy("order", "n").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*LEAF, "run").agg(F.sum("n").alias("of_run"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("of_run").over(Window.partitionBy(*LEAF).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("inner", F.coalesce(F.sum("n").over(run), F.lit(0))).join(ahead.select(*LEAF, "run", "ahead"), [*LEAF, "run"])
    placed = placed.withColumn("left", F.col("rest") - F.col("ahead") - F.col("inner"))
    whole = F.transform(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>")), lambda e: F.struct(e.alias("epoch"), F.col("n").alias("take_tokens")))
    last = F.when(F.col("left") > 0, F.array(F.struct(F.col("whole").alias("epoch"), F.least("n", "left").alias("take_tokens")))).otherwise(F.array().cast("array<struct<epoch:bigint,take_tokens:bigint>>"))
    taken = placed.select("id", "uid", *LEAF, F.col("n").alias("n_tokens"), F.explode(F.concat(whole, last)).alias("e"))
    return taken.select(F.col("id").alias(id_col), "uid", *LEAF, "e.epoch", "n_tokens", "e.take_tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The selected documents, whole and with the columns they came with, one row for each epoch in which they are read."""
    taken = select(docs, id_col=id_col, lang_col=lang_col, source_col=source_col, **options).select(F.col("uid").alias("_uid"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_uid"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("unknown")).alias("_lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("unknown")).alias("_source"))
    return rows.join(taken, ["_uid", "_lang", "_source"]).select("_row.*")
