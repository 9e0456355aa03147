"""Histograms, density grids, contours and drawn subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import finite
from ..functions.transforms import forward
from ..model import Panel, Transform

#: Contour levels as parts of the greatest count.
LEVELS = (0.04, 0.10, 0.20, 0.35, 0.55, 0.80)


def clamped_bin(x: Column, lo: float | Column, hi: float | Column, bins: int) -> Column:
    """Display bin: values outside go to the end bins, NaN to the first."""
    at = F.floor((x - lo) / (hi - lo) * bins)
    return F.when(F.isnan(x) | (x < lo), 0).when(x >= hi, bins - 1).otherwise(F.least(at, F.lit(bins - 1))).cast("int")


def overlay(values: DataFrame, value: str, series: str, lo: float, hi: float, bins: int = 256, modal: bool = True) -> DataFrame:
    """(series, bin, height) for all bins: counts smoothed twice by a moving mean of five, or these over their maximum.

    Events are counted before they are shuffled; what is smoothed are ``bins`` rows of a series.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(series, clamped_bin(F.col(value), lo, hi, bins).alias("bin")).count()
    held = counts.groupBy(series).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("held"))
    rows = held.select(series, "held", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = rows.select(series, "bin", F.coalesce(F.try_element_at("held", F.col("bin")), F.lit(0).cast("long")).cast("double").alias("height"))
    around = Window.partitionBy(series).orderBy("bin").rowsBetween(-2, 2)
    for _ in range(2):
        rows = rows.withColumn("height", F.avg("height").over(around))
    if modal:
        rows = rows.withColumn("height", F.col("height") / F.greatest(F.max("height").over(Window.partitionBy(series)), F.lit(1e-300)))
    return rows


def density(events: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float], bins: int = 160, by: list[str] | None = None) -> DataFrame:
    """(by, bx, by_, n) counts of a grid."""
    x0, x1, y0, y1 = box
    return events.groupBy(*(by or []), clamped_bin(x, x0, x1, bins).alias("bx"), clamped_bin(y, y0, y1, bins).alias("by_")).agg(F.count(F.lit(1)).alias("n"))


def display_box(events: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    """(by, x0, x1, y0, y1): the finite extent of display values of each group; 0 to 1 without any, one wide if they are all the same."""
    ends = events.groupBy(*by).agg(*[f(finite(v)).alias(n) for n, f, v in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))])
    wide = lambda lo, hi: F.when(F.col(lo).isNull(), 1.0).when(F.col(lo) >= F.col(hi), F.col(lo) + 1.0).otherwise(F.col(hi))
    return ends.select(*by, F.coalesce("x0", F.lit(0.0)).alias("x0"), wide("x0", "x1").alias("x1"), F.coalesce("y0", F.lit(0.0)).alias("y0"), wide("y0", "y1").alias("y1"))


def density_grid(events: DataFrame, x: Column, y: Column, by: list[str], bins: int = 160) -> DataFrame:
    """(by, x0, x1, y0, y1, bx, by_, n): counts of each group's grid over its own extent; empty bins have no row."""
    boxed = events.select(*by, x.alias("_x"), y.alias("_y")).join(display_box(events, x, y, by), by)
    at = lambda v, lo, hi: clamped_bin(F.col(v), F.col(lo), F.col(hi), bins)
    return boxed.groupBy(*by, "x0", "x1", "y0", "y1", at("_x", "x0", "x1").alias("bx"), at("_y", "y0", "y1").alias("by_")).agg(F.count(F.lit(1)).alias("n"))


def heat_bucket(n: Column, top: Column, buckets: int = 14) -> Column:
    """Bucket of a count on a square-root scale; the greatest count alone is in the last."""
    return F.least(F.floor(F.sqrt(n / top) * (buckets - 1)).cast("int"), F.lit(buckets - 1))


def population_index(events: DataFrame, mask: Column | None = None, sample: str = "sample_id", index: str = "event_idx", width: int = 65_536) -> DataFrame:
    """The population's events with ``position`` (0, 1, ... in event order) and ``n_members``, for each sample.

    Members are counted in ranges of ``width`` event numbers; a range's first position is the sum of those before it, so that only
    events of one range are ordered together. Event numbers are distinct within a sample.
    """
    kept = (events if mask is None else events.where(mask)).withColumn("_range", F.floor(F.col(index) / width))
    counts = kept.groupBy(sample, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(sample).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(sample, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(sample)).alias("n_members"))
    ranked = kept.withColumn("_row", F.row_number().over(Window.partitionBy(sample, "_range").orderBy(index)))
    return ranked.join(counts, [sample, "_range"]).withColumn("position", F.col("_before") + F.col("_row") - 1).drop("_range", "_row", "_before")


def stride_sample(events: DataFrame, mask: Column | None = None, most: int = 20_000, sample: str = "sample_id", index: str = "event_idx") -> DataFrame:
    """Every k-th member of a population, from the first one on: k is the number of members over ``most``, rounded down, one at least. With ``position`` and ``n_members``."""
    placed = population_index(events, mask, sample, index)
    step = F.greatest(F.floor(F.col("n_members") / F.least(F.lit(most), F.col("n_members"))), F.lit(1))
    return placed.where(F.col("position") % step == 0)


def backgate(events: DataFrame, mask: Column, parent: Column | None = None, most: int = 20_000, behind: int = 8_000, sample: str = "sample_id", index: str = "event_idx") -> DataFrame:
    """``events`` with ``layer``: "population", its members by stride, and "parent", those of the parent (all events if None) by a stride of their own, as a backdrop."""
    front = stride_sample(events, mask, most, sample, index).withColumn("layer", F.lit("population"))
    back = stride_sample(events, parent, behind, sample, index).withColumn("layer", F.lit("parent"))
    return front.unionByName(back)


def reference_overlay(events: DataFrame, panel: Panel, x: tuple[str, Transform], y: tuple[str, Transform], most: int = 8_000, sample: str = "sample_id", index: str = "event_idx") -> DataFrame | None:
    """(x, y) of reference tubes by stride, on the axes of the tube they are drawn under; None if their panel hasn't a channel."""
    columns = [panel.find(name) for name, _ in (x, y)]
    if None in columns:
        return None
    shown = [forward(F.col(c).cast("double"), tf).alias(n) for n, c, (_, tf) in zip(("x", "y"), columns, (x, y), strict=True)]
    return stride_sample(events, None, most, sample, index).select(*shown)


# Which edges of a cell a contour joins, by its case: 1, 2, 4 and 8 for the corners (i, j), (i + 1, j), (i + 1, j + 1) and (i, j + 1)
# that are above the level; b, r, t and l are the edges between them in this order.
SEGMENTS = {1: "lb", 2: "br", 3: "lr", 4: "rt", 5: "lb rt", 6: "bt", 7: "lt", 8: "lt", 9: "bt", 10: "br tl", 11: "rt", 12: "lr", 13: "br", 14: "lb"}


def contours(grid: DataFrame, by: list[str], bins: int = 160, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(by, level, i, j, part, xa, ya, xb, yb): line segments around the bins of a ``density_grid`` whose count is over a level times the group's greatest one.

    Marching squares: each bin is a corner of four cells (its neighbours' centres), so corners meet by a grouping of at most four rows a bin; a corner
    without a row counts 0. Ends of segments lie on the cells' edges, in the units of the grid's extent, at the place where the count would reach the level.
    """
    top = grid.groupBy(*by).agg(F.max("n").alias("_top"))
    corners = F.inline(F.array(*[F.struct((F.col("bx") - dx).alias("i"), (F.col("by_") - dy).alias("j"), F.lit(k).alias("_k")) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]))
    box = ["x0", "x1", "y0", "y1"]
    cells = grid.select(*by, *box, "n", corners).where(F.col("i").between(0, bins - 2) & F.col("j").between(0, bins - 2))
    height = lambda k: F.coalesce(F.max(F.when(F.col("_k") == k, F.col("n"))), F.lit(0)).cast("double")
    cells = cells.groupBy(*by, *box, "i", "j").agg(*[height(k).alias(v) for k, v in enumerate(("va", "vb", "vc", "vd"))]).join(top, by)
    cells = cells.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("_cut", F.col("level") * F.col("_top"))
    case = sum((F.when(F.col(v) > F.col("_cut"), 1 << k).otherwise(0) for k, v in enumerate(("va", "vb", "vc", "vd"))), F.lit(0))
    cells = cells.withColumn("_case", case).where(~F.col("_case").isin(0, 15))
    centre = lambda lo, hi, i: F.col(lo) + (i + 0.5) * (F.col(hi) - F.col(lo)) / bins
    x, y = [centre("x0", "x1", F.col("i") + d) for d in (0, 1)], [centre("y0", "y1", F.col("j") + d) for d in (0, 1)]

    def reached(a: str, b: str) -> Column:
        d = F.col(b) - F.col(a)
        return F.when(F.abs(d) < 1e-12, 0.5).otherwise(F.least(F.greatest((F.col("_cut") - F.col(a)) / d, F.lit(0.0)), F.lit(1.0)))

    ends = {"b": (x[0] + reached("va", "vb") * (x[1] - x[0]), y[0]), "r": (x[1], y[0] + reached("vb", "vc") * (y[1] - y[0])), "t": (x[1] + reached("vc", "vd") * (x[0] - x[1]), y[1]), "l": (x[0], y[1] + reached("vd", "va") * (y[0] - y[1]))}
    line = lambda part, two: F.struct(F.lit(part).alias("part"), *[v.alias(n) for n, v in zip(("xa", "ya", "xb", "yb"), (*ends[two[0]], *ends[two[1]]), strict=True)])
    lines = F.coalesce(*[F.when(F.col("_case") == c, F.array(*[line(part, two) for part, two in enumerate(pairs.split())])) for c, pairs in SEGMENTS.items()])
    return cells.select(*by, "level", "i", "j", F.inline(lines))
