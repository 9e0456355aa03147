"""Contiguous shards of atomic groups with the least possible largest shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

#: Capacities that one pass over the groups tries.
TRIES = 16
#: Ends of groups that may come to the driver.
PULL = 100_000
#: Parts that each group's documents are dealt into by doc_id, to be numbered apart.
SALTS = 4096


def _running(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with the sum before each row, in the given order, of each column of ``sums`` ({column: result}).

    Rows are dealt out by ranges of ``order``; each range is summed on its own and moved on by
    the totals of the ranges before it, of which there are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_o_{c}") for c in sums]).join(totals, "_part")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_t_{c}")).alias(to) for c, to in sums.items()])


def _ends(groups: DataFrame, limits: list[int], largest: int) -> list[int]:
    """Of each limit: the greatest end of a group that isn't beyond it (0 if none)."""
    near = F.lit(False)
    for x in sorted(set(limits)):
        near |= F.col("end").between(x - largest, x)
    found = groups.where(near).agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"x{i}") for i, x in enumerate(limits)]).first()
    return [found[f"x{i}"] or 0 for i in range(len(limits))]


def _greedy(groups: DataFrame, capacities: list[int], shards: int, total: int, largest: int) -> list[list[int]]:
    """Cuts of the greedy filling for each capacity, as ends of the shards."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        at = [c[-1] if c else 0 for c in cuts]
        open_ = [i for i, x in enumerate(at) if x < total]
        if not open_:
            break
        found = _ends(groups, [min(total, at[i] + capacities[i]) for i in open_], largest)
        for i, x in zip(open_, found, strict=True):
            cuts[i].append(x)
    return cuts


def _greedy_here(ends: np.ndarray, capacity: int, shards: int, total: int) -> list[int]:
    cuts = []
    while len(cuts) < shards and (not cuts or cuts[-1] < total):
        limit = (cuts[-1] if cuts else 0) + capacity
        cuts.append(int(ends[np.searchsorted(ends, limit, "right") - 1]))
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, ends of the shards) for groups with ``size`` and ``end``.

    A capacity is feasible if greedy filling needs at most ``shards`` shards. Greedy cuts grow
    with the capacity, so the cuts of a feasible and an infeasible one bound all cuts between
    them. The range of capacities is narrowed on the whole table, ``TRIES`` points in a pass,
    until at most ``PULL`` groups end within the bounds; their ends come to the driver, where
    the search goes on to its end.
    """
    row = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    total, largest = row["total"] or 0, row["largest"] or 0
    if not total:
        return 0, []
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # high is always feasible
    bounds = [(j * (low - largest), j * high) for j in range(1, shards + 1)]
    while True:
        near = F.lit(False)
        for x, y in bounds:
            near |= F.col("end").between(x, min(y, total))
        inside = groups.where(near).select("end")
        if inside.count() <= PULL:
            break
        tries = sorted({*range(low, high, max(1, -(-(high - low) // TRIES))), high})
        cuts = _greedy(groups, tries, shards, total, largest)
        good = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        if good == 0:
            return tries[0], cuts[0]
        low, high = tries[good - 1] + 1, tries[good]
        if low == high:
            return high, cuts[good]
        fill = lambda c: c + [total] * (shards - len(c))
        bounds = list(zip(fill(cuts[good - 1]), fill(cuts[good]), strict=True))
    ends = np.unique(np.array([0, total, *(r["end"] for r in inside.collect())], np.int64))
    while low < high:
        middle = (low + high) // 2
        if _greedy_here(ends, middle, shards, total)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return high, _greedy_here(ends, high, shards, total)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put documents into ``shards`` shards of near equal bytes; equal texts stay together.

    Groups of equal texts, in the order of their smallest doc_id, are cut into contiguous
    shards; the capacity is the smallest for which that can be done. Size: UTF-8 bytes and
    one; a null text counts as an empty one and shares its group. Returns (doc_id, size,
    text_crc32, shard, slot), a row for each row of ``docs``; slots of a shard are gapless
    from 0 (rows that repeat a doc_id each get one; null doc_ids sort first). Shards may be
    empty if there are few groups; an empty table gives an empty result. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("print"))
    rows = materialize(rows.withColumn("salt", F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.lit(0))), "sizes")
    salted = rows.groupBy("print", "salt").agg(F.min("doc_id").alias("low"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    salted = materialize(salted, "salted-groups")
    groups = salted.groupBy("print").agg(F.min("low").alias("low"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    groups = _running(groups, ["low", "print"], {"size": "begin", "n": "place"}, "ordered-groups")
    groups = materialize(groups.withColumn("end", F.col("begin") + F.col("size")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for x in cuts[:-1]:
        shard = shard + F.when(F.col("begin") >= x, 1).otherwise(0)
    groups = groups.select("print", "place", shard.cast("int").alias("shard"))
    firsts = {r["shard"]: r["first"] for r in groups.groupBy("shard").agg(F.min("place").alias("first")).collect()}  # a row for each shard
    first = F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]) if firsts else F.create_map(F.lit(0), F.lit(0))
    parts = Window.partitionBy("print").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.select("print", "salt", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before"))
    offset = offset.join(groups, "print").select("print", "salt", "shard", (F.col("place") - first[F.col("shard")] + F.col("before")).alias("before"))
    own = Window.partitionBy("print", "salt").orderBy("doc_id")
    numbered = rows.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(offset, ["print", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))
