"""Exact percentiles of very many or very large groups, by ranges instead of one group's values in one state."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

BINS = 1024
#: The ends that a sketch gives for a median: shares about a half, further off than the sketch errs.
NEAR, ACCURACY = 0.003, 1000


def equal_width_bin(x, lo, hi, bins: int):
    """Bin 0 to bins - 1; the greatest value belongs to the last. Null if there is one value alone."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1)))


def same_group(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on ``by`` in which nulls are a group too. ``right`` is small and of a size that Spark knows (``written``), so ``left`` isn't shuffled."""
    told = right.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(told[f"_by{i}"]) for i, c in enumerate(by)])
    return left.join(told, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def group_ends(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, lo, hi) of each group's values."""
    return values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def values_at(values: DataFrame, value: str, ranks, by: list[str], bins: int = BINS, ends: DataFrame | None = None) -> DataFrame:
    """(by, n, at): for each group the number of its values and a map from each wanted rank (from 0) to the value there.

    ``ranks`` makes an array of ranks from the column n; ``ends`` are ``group_ends`` if they are known already. Twice, the values between the bounds at hand are counted in ``bins`` equal steps, which tells the step that a
    rank lies in; its own least and greatest value are the next bounds. What is left of a group, about one value in ``bins`` squared, is put in order. So no task holds a group, counts are summed before they
    are shuffled, and values that are equal are counted together. The bounds (a few rows for each group) are written after each pass, so that a small table of them is sent to the values and values aren't shuffled.
    Nulls take no part; a group without values has no row.
    """
    clean = values.select(*by, F.col(value).alias("_x")).where("_x IS NOT NULL")
    ends = ends if ends is not None else written(group_ends(values, value, by), "ends")
    wanted = ends.where("n > 0").select(*by, "n", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(ranks(F.col("n"))).alias("_k"), F.lit(0).cast("long").alias("_before"))
    bounds = [*by, "_lo", "_hi"]
    up_to = Window.partitionBy(*bounds).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_c"))
    for step in range(3):
        told = wanted.select(*bounds).distinct() if step else ends.select(*by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        inside = same_group(clean, told, by)
        place = F.col("_x") if step == 2 else F.coalesce(equal_width_bin(F.col("_x"), F.col("_lo"), F.col("_hi"), bins), F.lit(0))
        counts = inside.where("_x BETWEEN _lo AND _hi").groupBy(*bounds, place.alias("_bin")).agg(F.count("_x").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_greatest"))
        counts = counts.withColumn("_here", F.coalesce(F.sum("_c").over(up_to), F.lit(0)))
        found = same_group(counts, wanted, bounds).withColumn("_start", F.col("_before") + F.col("_here")).where(hit)
        wanted = written(found.select(*by, "n", "_k", F.col("_start").alias("_before"), F.col("_least").alias("_lo"), F.col("_greatest").alias("_hi")), "bounds")
    return wanted.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_lo"))).alias("at"))


def exact_quantiles(values: DataFrame, value: str, shares: tuple[float, ...], by: list[str], bins: int = BINS, ends: DataFrame | None = None) -> DataFrame:
    """(by, n, q0, q1, ...): percentiles at the given shares, linear between the two nearest ranks."""

    def ranks(n):
        low = [F.floor(F.lit(p) * (n - 1)) for p in shares]
        return F.array_distinct(F.array(*low, *[F.least(k + 1, n - 1) for k in low]))

    found = values_at(values, value, ranks, by, bins, ends)
    spot = [F.lit(p) * (F.col("n") - 1) for p in shares]
    at = lambda k: F.try_element_at("at", k)
    between = lambda s: at(F.floor(s)) * (F.floor(s) + 1 - s) + at(F.least(F.floor(s) + 1, F.col("n") - 1)) * (s - F.floor(s))
    return found.select(*by, "n", *[F.when(s == F.floor(s), at(F.floor(s))).otherwise(between(s)).alias(f"q{i}") for i, s in enumerate(spot)])


def medians(values: DataFrame, cells: Mapping[str, Column], by: list[str], figures: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, figures, cells): for each group the struct (n, median) of each cell's finite values, and further aggregates; exact, the median null without values.

    A sketch of bounded size tells two values about each median; then values below and each value between them are counted, so states and what is ordered
    (about 0.6 % of a group) don't hold a group's values. Sketches only spare work: where the counts show that a median isn't between, all are found by ranges.
    """
    names, told = list(cells), {n: x.cast("double") for n, x in cells.items()}
    sketch = lambda x: F.percentile_approx(x, F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR)), F.lit(ACCURACY))
    ends = values.groupBy(*by).agg(*[f.alias(n) for n, f in (figures or {}).items()], *[F.struct(F.count(x).alias("n"), sketch(x).alias("ends")).alias(n) for n, x in told.items()])
    ends = written(ends, "ends")
    own = values.select(*by, *[x.alias(f"_v{i}") for i, x in enumerate(told.values())])
    bounds = ends.select(*by, *[F.get(f"{n}.ends", F.lit(j)).alias(f"_{e}{i}") for i, n in enumerate(names) for j, e in enumerate(("lo", "hi"))])
    each = [F.struct(F.lit(i).alias("_cell"), F.when(F.col(f"_v{i}") < F.col(f"_lo{i}"), float("-inf")).when(F.col(f"_v{i}") <= F.col(f"_hi{i}"), F.col(f"_v{i}")).alias("_x")) for i in range(len(names))]
    counts = same_group(own, bounds, by).select(*by, F.inline(F.array(*each))).where("_x IS NOT NULL").groupBy(*by, "_cell", "_x").agg(F.count("_x").alias("_c"))
    up_to = Window.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ends.select(*by, F.array(*[F.col(f"{n}.n") for n in names]).alias("_n"))
    counts = same_group(counts.withColumn("_start", F.coalesce(F.sum("_c").over(up_to), F.lit(0))), sizes, by).withColumn("_n", F.get("_n", F.col("_cell")))
    at = lambda k: F.max(F.when((k >= F.col("_start")) & (k < F.col("_start") + F.col("_c")), F.col("_x")))
    pair = counts.groupBy(*by, "_cell").agg(at(F.floor((F.col("_n") - 1) / 2)).alias("_a"), at(F.floor(F.col("_n") / 2)).alias("_b"))
    found = written(pair.select(*by, "_cell", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b")).alias("_m"), (F.col("_a") > float("-inf")).alias("_ok")), "medians")
    if not found.where("_m IS NULL OR NOT _ok").isEmpty():
        long = own.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_cell"), F.col(f"_v{i}").alias("_x")) for i in range(len(names))])))
        found = exact_quantiles(long, "_x", (0.5,), [*by, "_cell"]).withColumnRenamed("q0", "_m")
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_cell") == i, F.col("_m"))).alias(f"_m{i}") for i in range(len(names))])
    return same_group(ends, wide, by, "left").select(*by, *(figures or {}), *[F.struct(F.col(f"{n}.n").alias("n"), F.col(f"_m{i}").alias("median")).alias(n) for i, n in enumerate(names)])
