"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import words_of
from .scratch import materialize

#: Hexadecimal digits of the seeded order that part a leaf: 16 ** PART_DIGITS parts are summed and ordered apart.
PART_DIGITS = 3


def _totals_before(nodes: DataFrame, parent: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``nodes`` with, under each name of ``sums``, the total of a column over the rows of the same parent that come before in ``order``.

    Nodes are dealt into ranges of the whole order and written with their range's number; totals within a range and
    of the ranges before it are taken apart, so no task holds the children of one parent.
    """
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(nodes.repartitionByRange(ranges, *parent, *order).withColumn("_range", F.spark_partition_id()), name)
    within = Window.partitionBy(*parent, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*parent).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*parent, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ends = ends.select(*parent, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(ends, [*parent, "_range"])
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Give each parent's ``budget`` to its children by ``weight``, at most ``capacity`` each.

    What a child can't take goes to its siblings in proportion to their weights: sorted by
    capacity over weight, the children that are full come first; the others share the
    rest. Integers are shared by rounding running totals, so nothing is lost.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of tokens and weights go beyond a long
    place = F.struct("ratio", "node")
    out = nodes.withColumn("ratio", F.col("capacity") / F.col("weight"))
    out = _totals_before(out, parent, ["ratio", "node"], {"taken": "capacity", "lighter": "weight"}, f"shares-{len(parent)}")
    whole = out.groupBy(*parent).agg(F.sum("weight").alias("all_weight"))
    out = out.join(whole, parent)
    full = wide("budget") - wide("taken")
    out = materialize(out.withColumn("full", full * wide("weight") >= wide("capacity") * (wide("all_weight") - wide("lighter"))), f"filled-{len(parent)}")
    # once one child isn't full, none after it is
    first = out.groupBy(*parent).agg(F.min(F.when(~F.col("full"), place)).alias("first"))
    out = out.join(first, parent).withColumn("full", F.col("first").isNull() | (place < F.col("first")))
    sums = {"full_capacity": F.when(F.col("full"), F.col("capacity")), "full_weight": F.when(F.col("full"), F.col("weight"))}
    out = out.join(out.groupBy(*parent).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]), parent)
    out = out.withColumn("rest", F.col("budget") - F.col("full_capacity")).withColumn("open", F.col("all_weight") - F.col("full_weight"))
    upto = "CAST(rest AS DECIMAL(38,0)) * CAST(lighter - full_weight {} AS DECIMAL(38,0)) DIV open"
    share = F.expr(f"({upto.format('+ weight')}) - ({upto.format('')})")
    return out.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("long")).select(*nodes.columns, "share")


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: int, weights: Mapping[str, int], max_epochs: int) -> DataFrame:
    """``leaves`` (``levels``, tokens) with ``budget``: targets of the levels from the top down."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    total = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("node", F.col(path[-1])).withColumn("_root", F.lit(0))
        name = F.concat(F.lit(f"{path[-1]}="), F.coalesce(F.col(path[-1]), F.lit("")))
        nodes = nodes.withColumn("weight", F.coalesce(known[name], F.lit(1)).cast("long") if known is not None else F.lit(1).cast("long"))
        if total is None:
            most = nodes.agg(F.sum("capacity").alias("n")).first()["n"] or 0
            nodes = nodes.withColumn("budget", F.lit(min(budget, most)).cast("long"))
        else:
            nodes = nodes.join(total, parent)
        total = _share(nodes, ["_root", *parent]).select(*path, F.col("share").alias("budget"))
    return leaves.join(total, levels)


def mix_sources(
    docs: DataFrame, levels: Mapping[str, str], budget_share: float = 1.0, weights: Mapping[str, int] | None = None, max_epochs: int = 2, seed: int = 17, row: str | None = None
) -> DataFrame:
    """Choose documents so that their tokens follow the target weights of a tree.

    ``levels``: name and SQL expression of each level of the tree, from the root down (null
    values are a node ""). ``weights``: positive whole weights under "level=value", 1 for others. Tokens
    are words. The budget is ``budget_share`` of all tokens (rounded down), at most what
    ``max_epochs`` epochs of everything hold. It is handed down the tree by weight; what a
    child can't take in ``max_epochs`` epochs goes to its siblings, and only what they can't take
    either goes to the siblings of their parent. Each leaf then takes the prefix of its budget from a
    row of epochs, each in an order of its own, seeded by ``seed``, the leaf and the number of the epoch; a document that crosses the
    end of the prefix isn't taken in that epoch.

    Returns (doc_id, level columns, n_tokens, leaf_budget, epochs): a row for each row of ``docs``,
    with the number of times it is taken (0: not at all). Rows without words have 0 tokens and
    are taken as often as the whole epochs of their leaf. Equal doc_ids (and missing ones) of a leaf stand side by side in its orders and count as
    separate rows. Other columns are ignored, but ``row`` names a column of unique values that is returned
    too and orders rows of equal doc_id and size; an empty table gives an empty result.
    Parents with any number of children are fine: their running totals are taken in ranges. Leaves of any size are fine: the order is cut into 16 ** PART_DIGITS parts by its first digits, the parts
    are summed, and only documents of one part are ordered in one task.
    """
    if any(w < 1 for w in (weights or {}).values()):
        raise ValueError("weights are positive")
    names, key = list(levels), [row] if row else []
    rows = docs.select("doc_id", "text", *key, *[F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(c) for c, e in levels.items()])
    rows = rows.select("doc_id", *key, *names, F.greatest(F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialize(rows, "token-counts")
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaf-tokens")
    total = leaves.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    budgets = leaf_budgets(leaves, names, int(total * budget_share), weights or {}, max_epochs)
    whole = F.when(F.col("supply") > 0, F.expr("leaf_budget DIV supply")).otherwise(0)
    budgets = materialize(budgets.withColumnRenamed("tokens", "supply").withColumnRenamed("budget", "leaf_budget").withColumn("whole", whole), "leaf-budgets")
    # whole epochs take everything, so only the order of the epoch in which the budget ends matters
    parts_of_key = [F.lit(str(seed)), *names, F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    ordered = rows.join(budgets, names).withColumn("rank", F.substring(F.md5(F.concat_ws("|", *parts_of_key).cast("binary")), 1, 16))
    ordered = materialize(ordered.withColumn("part", F.substring("rank", 1, PART_DIGITS)), "seeded-orders")
    # where each part starts: sums before it under its first digit, and sums of the digits before
    parts = materialize(ordered.groupBy(*names, "part", F.substring("part", 1, 1).alias("digit")).agg(F.sum("n_tokens").alias("tokens")), "part-tokens")
    upto = lambda c, *by: F.coalesce(F.sum("tokens").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = parts.groupBy(*names, "digit").agg(F.sum("tokens").alias("tokens"))
    digits = digits.select(*names, "digit", upto("digit", *names).alias("above"))
    starts = parts.withColumn("within", upto("part", *names, "digit")).join(digits, [*names, "digit"])
    starts = materialize(starts.select(*names, "part", (F.col("above") + F.col("within")).alias("start")), "part-starts")
    own = Window.partitionBy(*names, "part").orderBy("rank", "doc_id", "n_tokens", *key).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumn("run", F.sum("n_tokens").over(own)).join(starts, [*names, "part"])
    more = (F.col("start") + F.col("run") <= F.col("leaf_budget") - F.col("whole") * F.col("supply")) & (F.col("n_tokens") > 0)
    return out.select("doc_id", *key, *names, "n_tokens", "leaf_budget", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int").alias("epochs"))
