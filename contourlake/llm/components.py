"""Links from buckets of candidates, and distributed union-find over them; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (u, v) is a centre or points to one centre only."""
    n, distinct = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == distinct and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id that links reach, for every id with a link to another.

    ``links`` has two columns of one type, ends of undirected links. Alternates the large-star and
    small-star steps: each node hands its greater, then its lesser neighbours the least one that it
    knows, until only stars are left. Each round is written to shared storage; minima are taken before
    shuffles, and joins have one side with unique keys, so that a hub's links can be split.
    """
    a, b = (F.col(c) for c in links.columns)
    now = written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Members of a bucket that are compared pair by pair, and of a block of a larger one.
FEW, BLOCK = 48, 512


def blocks(live: DataFrame) -> DataFrame:
    """(token, low, high, id, group, block): the buckets' members, dealt into units of two blocks each.

    A member is copied once for each block of its bucket, not for each partner, and a unit has some
    ``2 * BLOCK`` members whatever the bucket's size.
    """
    dealt = live.select("token", "id", "group", F.ceil(F.col("k") / BLOCK).cast("int").alias("n"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    return dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "group", "block")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share: products of their incidences, some thousand columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, (low, low + 4096)))
        seen = np.zeros((len(sets), 4096), np.float32)
        seen[owner[part], column[part] - low] = 1
        common += seen @ seen.T
    return np.rint(common).astype(np.int64)


def apart(groups: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which two members of a unit are of different groups and, in a unit of two blocks, of different blocks."""
    return (groups[:, None] != groups[None, :]) & ((block[:, None] != block[None, :]) | (block.min() == block.max()))


def joined_within(sets: list[np.ndarray], groups: np.ndarray, block: np.ndarray, num: int, den: int, candidates: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(root, member) positions that connect what similarity connects in a unit: fewer than it has members.

    Only ``candidates``, where they are given, are pairs; sets without one aren't looked at.
    """
    size, may = np.array([len(s) for s in sets]), apart(groups, block)
    if candidates is not None:
        may &= candidates
    live = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
    linked = np.zeros_like(may)
    if len(live):
        common = common_counts([sets[k] for k in live])
        linked[np.ix_(live, live)] = den * common >= num * (size[live][:, None] + size[live][None, :] - common)
    linked &= may
    linked |= linked.T
    root = np.full(len(sets), -1)
    for start in range(len(sets)):
        if root[start] >= 0:
            continue
        root[start], edge = start, [start]
        while edge:
            near = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
            root[near] = start
            edge = near.tolist()
    return ((int(root[k]), k) for k in range(len(sets)) if root[k] != k)


def by_unit(links: Callable[[list[tuple]], Iterator[tuple]], columns: tuple[str, ...], schema: pa.Schema):
    """A scan over rows sorted by unit: ``links`` of each unit's rows. One unit is held at a time."""

    def scan(batches):
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            units = zip(*(batch.column(c).to_pylist() for c in ("token", "low", "high")), strict=True)
            for unit, row in zip(units, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if unit != key:
                    out += links(held) if len(held) > 1 else ()
                    key, held = unit, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out = list(links(held)) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return scan


def _ends(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linking(postings: DataFrame, verified: Callable[[DataFrame], DataFrame], comparable: str, verified_blocks: Callable[[DataFrame], DataFrame], rounds: int = 4) -> DataFrame | None:
    """Verified links that connect all members whom links connect; those within a group may be left out. None where no token is shared.

    ``postings``: token, id, n (a size). ``verified`` keeps the linked ones of distinct pairs (a, b),
    a < b; ``comparable`` is SQL over two sizes n and m. ``verified_blocks`` connects what is linked
    across groups within the units of ``blocks``.

    In buckets (all members of a token) of up to ``FEW``, all pairs are judged: fewer than 24 for each
    row. Of larger ones, each round has the tokens whose members are of several groups propose one of
    them as a hub, and each member is compared with the hub that most of its tokens propose; links
    merge groups. What is left in several groups at last, or when a round did not halve the pairs across
    groups, goes to blocks, where members travel rather than pairs. So a large group of near copies that
    hubs can join costs its size, not its square, and pairs that no group joins are all judged.
    """
    counted = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    live = written(postings.join(counted, "token"), "live")
    if not live.limit(1).count():
        return None
    small, large = live.where(F.col("k") <= FEW), live.where(F.col("k") > FEW)
    left, right = (small.select("token", F.col("id").alias(i), F.col("n").alias(n)) for i, n in (("a", "n"), ("b", "m")))
    links = verified(written(left.join(right, "token").where(F.expr(f"a < b AND {comparable}")).select("a", "b").distinct(), "pairs"))
    if not large.limit(1).count():
        return links
    before = None
    for round_ in range(rounds):
        groups = components(links)
        links = groups.select(*_ends(F.col("id"), F.col("component")))
        grouped = written(large.select("token", "id", "n").join(groups.withColumnRenamed("component", "group"), "id", "left").select("token", "id", "n", F.coalesce("group", "id").alias("group")), "grouped")
        by_group = grouped.groupBy("token", "group").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("id", F.lit(round_)), "id", "n")).alias("hub"))
        mixed = by_group.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.expr("k * k")).alias("kk"), F.min("hub").alias("hub")).where("k * k > kk")
        mixed = written(mixed.select("token", "k", F.expr("(k * k - kk) / 2").alias("across"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("m")), "mixed")
        across, n = mixed.agg(F.sum("across"), F.count("*")).first()
        if not n:
            return links
        live = written(grouped.join(mixed, "token").select("token", "k", "id", "n", "group", "hub", "m"), "mixed-members")
        if round_ == rounds - 1 or (before is not None and 2 * across > before):
            return links.unionByName(verified_blocks(blocks(live)))
        before = across
        votes = live.where(F.expr(f"id != hub AND {comparable}")).groupBy("id", "hub").agg(F.count("*").alias("votes"))
        best = votes.groupBy("id").agg(F.max(F.struct("votes", "hub")).alias("best"))
        found = verified(written(best.select(*_ends(F.col("id"), F.col("best.hub"))).distinct(), "hubs"))
        links = links.unionByName(found)
    return links
