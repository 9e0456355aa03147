"""Thresholds, modes, singlet gates, spillover from controls and its check."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from ..functions.formats import finite
from ..functions.transforms import asinh, forward, inverse
from ..model import Gate, Panel, Transform
from ..sources.shared import written
from .compensation import Spillover
from .quantiles import equal_width_bin, medians, same_group, values_at

FEWEST, COFACTOR = 50, 150.0


def histogram(values: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, lo, hi, n, counts) of finite values, counts an array of all bins. Sums are combined before the shuffle; values meet a written table of their groups' ends, so they aren't shuffled."""
    clean = values.select(*by, finite(F.col(value)).alias("x")).where("x IS NOT NULL")
    ends = clean.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    counted = (same_group(clean, written(ends, "ends"), by) if by else clean.crossJoin(F.broadcast(ends))).withColumn("bin", equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
    counted = counted.groupBy(*by, "lo", "hi", "n", "bin").count()
    held = F.map_from_entries(F.collect_list(F.struct(F.coalesce("bin", F.lit(0)).alias("bin"), "count")))
    counts = counted.groupBy(*by, "lo", "hi", "n").agg(held.alias("held"))
    return counts.select(*by, "lo", "hi", "n", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("counts"))


def valley(counts: Column, lo: Column, hi: Column, n: Column, bins: int) -> Column:
    """Struct (threshold, depth) of the valley between the two tallest peaks of a histogram of ``bins`` counts; null without two peaks.

    Counts are smoothed three times by a moving mean that is cut off at the ends; a peak isn't at an end, is no lower than its
    neighbours and higher than one, and has 2 % of the greatest height. The valley is the first lowest bin between.
    """
    w, at = max(bins // 48, 1), lambda y, i: F.get(y, i.cast("int"))

    def smoothed(y: Column) -> Column:
        def mean(i: Column) -> Column:
            first, last = F.greatest(i - w, F.lit(0)), F.least(i + w, F.lit(bins - 1))
            return F.aggregate(F.slice(y, first + 1, last - first + 1), F.lit(0.0), lambda a, x: a + x) / (last - first + 1)

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mean)

    def between(y: Column, top: Column) -> Column:
        peak = lambda i: (at(y, i) >= at(y, i - 1)) & (at(y, i) >= at(y, i + 1)) & ((at(y, i) > at(y, i - 1)) | (at(y, i) > at(y, i + 1))) & (at(y, i) >= 0.02 * top)
        peaks = F.filter(F.sequence(F.lit(1), F.lit(bins - 2)), peak)
        tallest = F.slice(F.sort_array(F.transform(peaks, lambda i: F.struct((-at(y, i)).alias("y"), i.alias("i")))), 1, 2)

        def cut(two: Column) -> Column:
            first, last = F.least(two[0]["i"], two[1]["i"]), F.greatest(two[0]["i"], two[1]["i"])
            low = F.array_min(F.transform(F.sequence(first, last), lambda i: F.struct(at(y, i).alias("y"), i.alias("i"))))
            shorter = -F.greatest(two[0]["y"], two[1]["y"])
            depth = F.when(shorter > 0, F.least(F.greatest((shorter - low["y"]) / shorter, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
            return F.struct((lo + (low["i"] + 0.5) / bins * (hi - lo)).alias("threshold"), depth.alias("depth"))

        return let(tallest, lambda two: F.when(F.size(two) == 2, cut(two)))

    found = F.transform(counts, lambda c: c.cast("double"))
    for _ in range(3):
        found = let(found, smoothed)
    found = let(found, lambda y: let(F.array_max(y), lambda top: between(y, top)))
    return F.when((n >= FEWEST) & (hi > lo) & F.lit(bins >= 3), found)


def valley_table(values: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, threshold, depth, top): the valley of each group's finite values and the greatest of them; null without a valley. One plan for any number of groups."""
    h = histogram(values, value, bins, by).withColumn("_v", valley(F.col("counts"), F.col("lo"), F.col("hi"), F.col("n"), bins))
    return h.select(*by, F.col("_v.threshold").alias("threshold"), F.col("_v.depth").alias("depth"), F.col("hi").alias("top"))


def mode_of(values: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, mode): centre of the fullest bin, the last of equals; null if all values are the same."""
    h = histogram(values, value, bins, by)
    best = F.array_max(F.transform("counts", lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    return h.select(*by, F.when(F.col("hi") > F.col("lo"), F.col("lo") + (best["i"] + 0.5) / bins * (F.col("hi") - F.col("lo"))).alias("mode"))


def singlet_vertices(events: DataFrame, area: str, height: str, by: list[str], tolerance: float = 0.15) -> DataFrame:
    """(by, h_lo, h_hi, slope, vertices): a band of areas about the mode of the area to height ratio, between two heights.

    The heights are the values at 2 % and 98 % of the sorted positive heights, by truncated index; ratios are those of events between them, their mode
    of 64 bins. Groups with fewer than 50 heights or ratios, one height alone or no positive slope have no row. Vertices are (area, height).
    """
    clean = events.select(*by, finite(F.col(area)).alias("a"), finite(F.col(height)).alias("h")).where("h > 0")
    cut = [lambda n, p=p: F.floor(F.lit(p) * (n - 1)) for p in (0.02, 0.98)]
    core = values_at(clean, "h", lambda n: F.array_distinct(F.array(*[k(n) for k in cut])), by).where(F.col("n") >= FEWEST)
    core = core.select(*by, *[F.try_element_at("at", k(F.col("n"))).alias(c) for c, k in zip(("h_lo", "h_hi"), cut, strict=True)]).where("h_hi > h_lo")
    core = written(core, "heights")  # small, so that events aren't sorted by group in one task each
    ratios = same_group(clean, core, by).where("a IS NOT NULL AND h BETWEEN h_lo AND h_hi").select(*by, (F.col("a") / F.col("h")).alias("r"))
    enough = ratios.groupBy(*by).agg(F.count("r").alias("_ratios")).where(F.col("_ratios") >= FEWEST)
    out = core.join(mode_of(ratios, "r", 64, by).withColumnRenamed("mode", "slope"), by).join(enough.select(*by), by).where("slope > 0")
    corner = lambda h, t: F.array(F.col("slope") * F.col(h) * (1 + t), F.col(h))
    return out.withColumn("vertices", F.array(corner("h_lo", -tolerance), corner("h_hi", -tolerance), corner("h_hi", tolerance), corner("h_lo", tolerance)))


def singlet_gate(id: int, panel: Panel, events: DataFrame, parent: int | None = None, tolerance: float = 0.15) -> Gate | None:
    """The suggested singlet gate of one population's events on area and height of forward scatter; None if the panel hasn't both or there is no band."""
    area, height = forward_scatter(panel, "A"), forward_scatter(panel, "H")
    if area is None or height is None:
        return None
    found = singlet_vertices(events.withColumn("_all", F.lit(0)), panel.find(area), panel.find(height), ["_all"], tolerance).first()
    if found is None:
        return None
    return Gate(id, "Singlets (auto)", {"shape": "polygon", "vertices": [list(v) for v in found["vertices"]]}, parent, area, height)


def forward_scatter(panel: Panel, kind: str) -> str | None:
    """The channel FSC-A or FSC-H (``kind``), in any case, else the first FSC channel that ends so."""
    names = [n for n in panel.channels if n.upper() == f"FSC-{kind}"] + [n for n in panel.channels if n.upper().startswith("FSC") and n.upper().endswith(f"-{kind}")]
    return names[0] if names else None


def auto_threshold(id: int, panel: Panel, events: DataFrame, channel: str, transform: Transform, parent: int | None = None) -> Gate | None:
    """A range gate over the valley of one population's values in display space, in 128 bins; None without a valley."""
    column = panel.find(channel)
    if column is None:
        return None
    shown = events.select(forward(F.col(column).cast("double"), transform).alias("_d"))
    found = valley_table(shown, "_d", 128, []).first()
    if found is None or found["threshold"] is None:
        return None
    top = max(found["top"], found["threshold"])
    return Gate(id, f"{channel}+ (auto)", {"shape": "range", "x_min": found["threshold"], "x_max": top}, parent, channel, channel, transform, transform)


@dataclass(frozen=True)
class Controls:
    """Names of the unstained control and of the single stains, all values of the sample column."""

    unstained: str
    stains: tuple[str, ...]


def spillover_table(events: DataFrame, panel: Panel, controls: Controls, sample: str = "sample_id") -> DataFrame:
    """(control, source, target, value, reason): the spillover rows of single-stained controls, or why a control gives none.

    A control's primary channel has the greatest median over the unstained control's, the last of equals. Its row are the medians of its positive events
    over background, by the primary one: events over the valley of asinh(x / 150) in that channel, or all if fewer than 50 are over it. All controls
    go through each pass together; what is joined with events are written tables of a row for each control, so events aren't shuffled.
    """
    names, columns = zip(*panel.fluorescence(), strict=True)
    cells = [f"_c{i}" for i in range(len(columns))]
    values = {k: finite(F.col(c)) for k, c in zip(cells, columns, strict=True)}
    middle = F.array(*[F.coalesce(f"{k}.median", F.lit(0.0)) for k in cells])
    events = events.where(F.col(sample).isin(controls.unstained, *controls.stains))
    plain = medians(events, values, [sample]).select(sample, middle.alias("_plain"))
    bare = F.max(F.when(F.col(sample) == controls.unstained, F.col("_plain"))).over(Window.partitionBy(F.lit(0)))
    plain = plain.withColumn("_background", bare).where(F.col(sample) != controls.unstained)
    signal = F.zip_with("_plain", "_background", lambda x, b: x - b)
    best = F.array_max(F.transform(signal, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    stains = written(plain.select(sample, "_plain", "_background", best.alias("_best")), "stains")
    place = F.get(F.array(*[F.col(c).cast("double") for c in columns]), F.col("_best.i"))
    shown = same_group(events, stains.select(sample, "_best"), [sample]).withColumn("_d", asinh(place / COFACTOR))
    cuts = written(valley_table(shown, "_d", 128, [sample]).select(sample, "threshold"), "cuts")
    over = F.col("threshold").isNull() | (F.coalesce(F.col("_d") > F.col("threshold"), F.lit(False)) & ~F.isnan("_d"))
    shown = same_group(shown, cuts, [sample], "left").where(over)
    bright = medians(shown, values, [sample], {"_over": F.count(F.lit(1))}).select(sample, "_over", middle.alias("_bright"))
    bright = stains.join(bright, sample, "left").select(sample, F.when(F.col("_over") >= FEWEST, F.col("_bright")).otherwise(F.col("_plain")).alias("_bright"))
    wanted = events.sparkSession.createDataFrame([(s,) for s in controls.stains], f"{sample} string")
    rows = wanted.join(stains.drop("_plain"), sample, "left").join(bright, sample, "left").withColumn("_row", F.zip_with("_bright", "_background", lambda x, b: x - b))
    own, taken = F.get("_row", F.col("_best.i")), F.count_if(F.col("_best.v") > 0).over(Window.partitionBy("_best.i"))
    reason = F.when(F.lit(len(controls.stains) != len(names)), "there is one control for each channel").when(F.col("_best").isNull(), "the control or the unstained one has no events")
    reason = reason.when(~(F.col("_best.v") > 0), "no signal").when(taken > 1, "its channel is another control's").when(~(own > 0), "no positive signal")
    rows = rows.withColumn("reason", reason).withColumn("source", F.get(F.array(*[F.lit(n) for n in names]), F.col("_best.i")))
    cells = F.transform(F.array(*[F.lit(n) for n in names]), lambda n, i: F.struct(n.alias("target"), (F.get("_row", i) / own).alias("value")))
    cells = F.when(F.col("reason").isNull(), cells).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("value"))))
    return rows.select(F.col(sample).alias("control"), F.when(F.col("reason").isNull(), F.col("source")).alias("source"), "reason", F.inline(cells)).select("control", "source", "target", "value", "reason")


def compute_spillover(events: DataFrame, panel: Panel, controls: Controls, sample: str = "sample_id") -> Spillover:
    """The matrix of ``spillover_table`` on the driver; a control that gives no row is an error."""
    return Spillover.of_table(spillover_table(events, panel, controls, sample), [n for n, _ in panel.fluorescence()])


def display_cuts(events: DataFrame, panel: Panel, transforms: Mapping[str, Transform] | None = None, bins: int = 160, least_depth: float = 0.05, by: str = "sample_id") -> DataFrame:
    """(by, channel, cut): the valley of each tube's display values of each fluorescence channel, if it is deep enough, in data space."""
    fluor = panel.fluorescence()
    tf = lambda n: (transforms or {}).get(n, Transform("logicle"))
    long = events.select(by, F.inline(F.array(*[F.struct(F.lit(n).alias("channel"), forward(F.col(c).cast("double"), tf(n)).alias("_d")) for n, c in fluor])))
    found = valley_table(long, "_d", bins, [by, "channel"]).where(F.col("depth") >= least_depth)
    cut = F.coalesce(*[F.when(F.col("channel") == n, inverse(F.col("threshold"), tf(n))) for n, _ in fluor])
    return found.select(by, "channel", cut.alias("cut"))


def cross_check(events: DataFrame, panel: Panel, cuts: Mapping[str, float] | DataFrame | None = None, by: str = "sample_id", transforms: Mapping[str, Transform] | None = None) -> DataFrame:
    """Residual spill of each source into each other channel of each tube: (by, source, target, residual).

    (median of the target over the source's cut - under it) / (the same of the source), of events finite in both; null with fewer than 20 on a side or no spread in the source.
    Sources are the channels with a cut: one for all tubes (a mapping), or of each tube (by, channel, cut), which are the valleys of ``display_cuts`` if not given.
    The two sides of a source are groups of their own, so the state of an aggregation grows with the channels, not with their square.
    """
    fluor = panel.fluorescence()
    if isinstance(cuts, Mapping):
        given = {n: F.lit(float(cuts[n])) if n in cuts else F.lit(None).cast("double") for n, _ in fluor}
        told = events
    else:
        found = display_cuts(events, panel, transforms, by=by) if cuts is None else cuts
        wide = written(found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("channel", "cut"))).alias("_cuts")), "cuts")
        told, given = events.join(wide, by), {n: F.try_element_at("_cuts", F.lit(n)) for n, _ in fluor}
    sources = F.array(*[F.struct(F.lit(n).alias("source"), finite(F.col(c).cast("double")).alias("_x"), given[n].alias("_cut")) for n, c in fluor])
    split = told.select(by, *[finite(F.col(c).cast("double")).alias(f"_y{i}") for i, (_, c) in enumerate(fluor)], F.inline(sources)).where("_cut IS NOT NULL AND _x IS NOT NULL")

    other = {i: F.when(F.col("source") != n, F.col(f"_y{i}")) for i, (n, _) in enumerate(fluor)}  # a source isn't its own target
    cells = {f"_t{i}": y for i, y in other.items()} | {f"_s{i}": F.when(y.isNotNull(), F.col("_x")) for i, y in other.items()}
    side = lambda i: F.struct(F.col(f"_t{i}.n").alias("n"), F.col(f"_t{i}.median").alias("y"), F.col(f"_s{i}.median").alias("x"))
    halves = medians(split.withColumn("_over", F.col("_x") > F.col("_cut")), cells, [by, "source", "_over"])
    halves = halves.select(by, "source", "_over", F.array(*[side(i) for i in other]).alias("_t"))
    both = halves.groupBy(by, "source").agg(F.max(F.when(F.col("_over"), F.col("_t"))).alias("_hi"), F.max(F.when(~F.col("_over"), F.col("_t"))).alias("_lo"))

    def cell(i: int, name: str) -> Column:
        hi, lo = F.get("_hi", F.lit(i)), F.get("_lo", F.lit(i))
        spread = hi["x"] - lo["x"]
        value = F.when((hi["n"] >= 20) & (lo["n"] >= 20) & (F.abs(spread) >= 1e-6), (hi["y"] - lo["y"]) / spread)
        return F.struct(F.lit(name).alias("target"), value.alias("residual"))

    return both.select(by, "source", F.inline(F.array(*[cell(i, n) for i, (n, _) in enumerate(fluor)]))).where("source <> target")


def residual_grade(value: Column) -> Column:
    """By size: "good" under 0.02, "fair" under 0.05, else "poor"; null if undefined."""
    return F.when(F.abs(value) < 0.02, "good").when(F.abs(value) < 0.05, "fair").when(value.isNotNull(), "poor")
