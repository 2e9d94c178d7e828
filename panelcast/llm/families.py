"""Search of linked sets in families: connected components by shared prefix or band keys, of bounded size in one task, larger ones in parts.

An index of sets is all that differs between operators: index(sizes, payloads) holds the members of a family or of a part, and its search(size, payload, after) gives the
numbers of the members from `after` on that link to a set. Links between members of one component needn't be found, so that members are
numbered component by component, the smallest first, and each is searched among those that come after its own component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected

#: Keys of a family that is searched in one task or of a part of a larger one, and of a bundle of small families, about.
FAMILY_KEYS, BUNDLE_KEYS = 1_000_000, 150_000
#: Searches before members are numbered by component, and rounds of them in families of several parts.
PILOTS, ROUNDS = 16, 2


class Forest:
    """Union-find over 0..m-1 with the smallest member as root."""

    def __init__(self, m: int):
        self.up = list(range(m))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def by_component(roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members in the order of their components, the smallest first, and for each the place behind its component."""
    _, which, size = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.lexsort((which, size[which]))
    edge = np.flatnonzero(np.append(np.diff(which[order]) != 0, True)) + 1
    return order, np.repeat(edge, np.diff(edge, prepend=0))


def search_family(sizes: np.ndarray, payloads: list, index: Callable, found: list | None = None) -> Forest:
    """Components of the members of one family by the links that searches find; `found` gathers those that joined two components."""
    m = len(payloads)
    forest = Forest(m)

    def join(q: int, hits: Iterable[int]) -> None:
        for x in hits:
            if forest.root(x) != forest.root(q):
                forest.join(q, x)
                if found is not None:
                    found.append((q, x))

    lists, done = index(sizes, payloads), set()
    for q in range(m):
        if len(done) == PILOTS:
            break
        if forest.root(q) == q:  # not linked to an earlier one
            done.add(q)
            join(q, lists.search(int(sizes[q]), payloads[q], 0).tolist())
    order, after = by_component(np.array([forest.root(x) for x in range(m)]))
    if after[0] == m or len(done) == m:
        return forest
    lists = index(sizes[order], [payloads[x] for x in order])
    for q, behind in zip(order.tolist(), after.tolist(), strict=True):
        if behind == m:  # the largest component
            break
        if q not in done:
            join(q, order[lists.search(int(sizes[q]), payloads[q], behind)].tolist())
    return forest


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*found, strict=True)) or [[], []])], names=["a", "b"])


def _payloads(column: pa.ChunkedArray, at: Iterable[int]) -> list:
    return [column[int(k)].as_buffer() for k in at]


def _groups(name: np.ndarray, *order_by: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each name, in order."""
    order = np.lexsort((*order_by[::-1], name))
    edges = np.flatnonzero(np.append(True, np.diff(name[order]) != 0)).tolist()
    return (order[a:b] for a, b in zip(edges, [*edges[1:], len(order)], strict=True))


def search_small(families: DataFrame, bundles: int, index: Callable) -> DataFrame:
    """Links (a, b) of families that fit a task; families: family, id, n, keys. Several go to a task."""

    def work(table: pa.Table) -> pa.Table:
        ids, n, keys = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("keys")
        found: list[tuple[int, int]] = []
        for own in _groups(table.column("family").to_numpy(), ids):
            if len(own) > 1:
                forest = search_family(n[own], _payloads(keys, own), index)
                found += [(int(ids[own[x]]), int(ids[own[forest.root(x)]])) for x in range(len(own)) if forest.root(x) != x]
        return _links(found)

    dealt = families.withColumn("bundle", F.pmod(F.xxhash64("family"), F.lit(bundles)))
    return dealt.select("bundle", "family", "id", "n", "keys").groupBy("bundle").applyInArrow(work, "a bigint, b bigint")


def search_parts(rows: DataFrame, index: Callable) -> DataFrame:
    """Links (a, b) of the rows that seek with the rows that are `listed`; rows: bundle, grp, id, n, keys, seeks, listed, many, root. A row seeks among those whose component is
    larger than its own (`many`, then `root`); `many` of -1 seeks among all."""

    def work(table: pa.Table) -> pa.Table:
        ids, n, keys = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("keys")
        seeks, listed, many, root = (table.column(c).to_numpy() for c in ("seeks", "listed", "many", "root"))
        found: list[tuple[int, int]] = []
        for own in _groups(table.column("grp").to_numpy(), many, root, ids):
            inside, asking = own[listed[own]], own[seeks[own]]
            if len(inside) and len(asking):
                lists = index(n[inside], _payloads(keys, inside))
                # rows are in the order of their components, so that this is the place behind the seeker's own
                fresh = np.append(True, (np.diff(many[inside]) != 0) | (np.diff(root[inside]) != 0))
                edges = np.append(np.flatnonzero(fresh), len(inside))
                firsts = list(zip(many[inside[edges[:-1]]].tolist(), root[inside[edges[:-1]]].tolist(), strict=True))
                for q in asking.tolist():
                    behind = 0 if many[q] < 0 else int(edges[bisect_right(firsts, (int(many[q]), int(root[q])))])
                    hits = inside[lists.search(int(n[q]), _payloads(keys, [q])[0], behind)]
                    found += [(int(ids[q]), int(ids[x])) for x in hits.tolist() if root[x] != root[q]]
        return _links(found)

    return rows.select("bundle", "grp", "id", "n", "keys", "seeks", "listed", "many", "root").groupBy("bundle").applyInArrow(work, "a bigint, b bigint")


def _blocks(of: str, family_keys: int) -> Column:
    """Into how many blocks rows of so many bytes go."""
    return F.greatest(F.ceil(F.col(of) / 8 / family_keys), F.lit(1)).cast("bigint")


def _block_of(blocks: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks))


def _upto(blocks: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)


def in_all_parts(listed: DataFrame, seekers: DataFrame, family_keys: int) -> DataFrame:
    """Every part of a family with every block of its seekers: both are bounded."""
    cut = seekers.groupBy("family").agg(F.sum(F.length("keys")).alias("bytes")).select("family", _blocks("bytes", family_keys).alias("blocks"))
    held = listed.join(cut, "family").withColumn("block", F.explode(_upto("blocks"))).withColumn("seeks", F.lit(False)).withColumn("listed", F.lit(True))
    ask = seekers.join(cut, "family").withColumn("block", _block_of("blocks", 1)).withColumn("part", F.explode(_upto("parts"))).withColumn("seeks", F.lit(True)).withColumn("listed", F.lit(False))
    return held.unionByName(ask).withColumn("grp", F.xxhash64("family", "part", "block")).withColumn("bundle", F.col("grp"))


def search_large(rows: DataFrame, sizes: DataFrame, index: Callable, family_keys: int) -> DataFrame:
    """Links (a, b) of families of several parts; rows: family, id, n, keys, prefix; sizes: family, total."""
    parts = sizes.select("family", F.ceil(F.col("total") / family_keys).cast("bigint").alias("parts"))
    rows = stage(rows.join(parts, "family").withColumn("part", _block_of("parts", 0)), "large-families")
    links = None
    left = seekers = rows.withColumn("root", F.col("id")).withColumn("many", F.lit(1).cast("bigint"))
    for turn in range(ROUNDS):
        # about PILOTS documents of each family, by a hash that is new in every round
        size = seekers.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
        pilots = seekers.join(size, "family").where(F.pmod(F.xxhash64("id", F.lit(turn)), F.col("size")) < PILOTS).drop("size").withColumn("many", F.lit(-1).cast("bigint"))
        new = search_parts(in_all_parts(left, pilots, family_keys), index)
        links = stage(new if links is None else links.union(new), "pilot-links")
        named = rows.join(connected(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
        counts = stage(named.groupBy("family", "root").agg(F.count(F.lit(1)).alias("many")), "component-sizes")
        left = stage(named.join(counts, ["family", "root"]), "large-roots")
        largest = counts.groupBy("family").agg(F.max(F.struct("many", "root")).alias("top")).select("family", F.col("top.root").alias("largest"))
        seekers = stage(left.join(largest, "family").where("root <> largest").drop("largest"), "seekers")
        remain = seekers.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 8
        if not remain:
            return links
        if remain <= family_keys:
            break
    # those that still seek go to all parts of their family, or to the documents that share a key with them: whichever are fewer places
    places = seekers.groupBy("family").agg(F.avg(F.size("prefix")).alias("places"), F.first("parts").alias("parts"))
    by_keys = stage(places.where("places < parts").select("family"), "spread-families")
    if by_keys.isEmpty():
        return stage(links.union(search_parts(in_all_parts(left, seekers, family_keys), index)), "links")
    apart = lambda df, how: df.join(by_keys, "family", how)
    links = links.union(search_parts(in_all_parts(apart(left, "left_anti"), apart(seekers, "left_anti"), family_keys), index))
    return stage(links.union(search_parts(in_key_groups(apart(left, "left_semi"), apart(seekers, "left_semi"), family_keys), index)), "links")


def in_key_groups(rows: DataFrame, seekers: DataFrame, family_keys: int) -> DataFrame:
    """The rows that share a key with one that seeks, key by key, pieces of them with blocks of seekers; keys of the same documents (told by a sum of 64-bit hashes) are one group."""
    wanted = seekers.select(F.explode("prefix").alias("key")).distinct()
    seeking = seekers.select("id", F.lit(True).alias("seeks")).distinct()
    posting = rows.select("id", F.length("keys").alias("bytes"), F.explode("prefix").alias("key")).join(wanted, "key", "left_semi").join(seeking, "id", "left").withColumn("seeks", F.coalesce("seeks", F.lit(False)))
    groups = posting.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string").alias("mark"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("seeks"), F.col("bytes"))).alias("seeking")
    ).where("many > 1")
    groups = groups.groupBy("many", "mark").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"), F.max("seeking").alias("seeking"))
    groups = groups.select("key", _blocks("bytes", family_keys).alias("pieces"), _blocks("seeking", family_keys).alias("blocks"))
    own = posting.select("key", "id", "seeks").join(groups, "key").withColumn("own_piece", _block_of("pieces", 0)).withColumn("own_block", _block_of("blocks", 1))
    # a row is listed in its piece, beside every block of seekers; one that seeks goes to the other pieces, too
    places = F.transform(_upto("blocks"), lambda b: F.struct(F.col("own_piece").alias("piece"), b.alias("block"), (F.col("seeks") & (b == F.col("own_block"))).alias("seeks"), F.lit(True).alias("listed")))
    away = F.transform(F.filter(_upto("pieces"), lambda p: F.col("seeks") & (p != F.col("own_piece"))), lambda p: F.struct(p.alias("piece"), F.col("own_block").alias("block"), F.lit(True).alias("seeks"), F.lit(False).alias("listed")))
    dealt = own.select("key", "id", "pieces", "blocks", F.explode(F.concat(places, away)).alias("at")).select("key", "id", "pieces", "blocks", "at.*")
    dealt = dealt.join(rows.select("id", "n", "keys", "many", "root"), "id").withColumn("grp", F.xxhash64("key", "piece", "block"))
    total = dealt.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 8
    return dealt.withColumn("bundle", F.when((F.col("pieces") > 1) | (F.col("blocks") > 1), F.col("grp")).otherwise(F.pmod("grp", F.lit(2 * (total // family_keys) + 1))))


def shared_keys(posting: DataFrame) -> DataFrame:
    """(key, id, lead) of the keys that several documents have; lead is the smallest id of a key. posting: id, key."""
    leads = posting.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").drop("last")
    return stage(posting.join(leads, "key").select("key", "id", "lead"), "shared-keys")


def families_of(shared: DataFrame) -> DataFrame:
    """(id, root): the family of every document that shares a key with another."""
    return connected(shared.select(F.col("lead").alias("a"), F.col("id").alias("b")))


def search(families: DataFrame, index: Callable, family_keys: int = FAMILY_KEYS) -> DataFrame:
    """(id, root) of linked documents. families: family, id, n, keys (a payload of the index), prefix (the keys that linked documents share one of)."""
    sizes = stage(families.groupBy("family").agg(F.sum(F.length("keys") / 8).cast("bigint").alias("total")), "families")
    whole, most = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).first()
    large = sizes.where(F.col("total") > family_keys)
    small = families.join(large.select("family"), "family", "left_anti") if most > family_keys else families
    links = search_small(small, 2 * (whole // BUNDLE_KEYS) + 1, index)
    if most > family_keys:
        links = links.union(search_large(families.join(large.select("family"), "family", "left_semi"), large, index, family_keys))
    links = stage(links, "links")
    return connected(links) if most > family_keys else links.select(F.col("a").alias("id"), F.col("b").alias("root"))
