"""Acquisition checks: flow rate, events on the margins, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.formats import finite, fixed
from ..model import Gate, Panel
from ..plans.gates import GatePlan

#: Limits of the flags.
FEW_EVENTS, LOW_VIABLE, FLOW_DEVIATION, OFF_SCALE = 5000, 50.0, 40.0, 1.0


def _flow(events: DataFrame, ends: DataFrame, time: str, bins: int, sample: str) -> DataFrame:
    """``ends`` (sample, n, lo, hi, ...) with n_bins, counts and max_dev_pct; these are null where time is constant or missing."""
    ends = ends.withColumn("n_bins", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.greatest(F.floor(F.col("n") / 100), F.lit(1))).cast("int")))
    clean = events.select(sample, finite(F.col(time).cast("double")).alias("t")).where("t IS NOT NULL").join(ends.where("n_bins IS NOT NULL").select(sample, "lo", "hi", "n_bins"), sample)
    at = F.least(F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n_bins")).cast("int"), F.col("n_bins") - 1)
    held = clean.groupBy(sample, at.alias("bin")).count().groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("held"))
    counts = F.transform(F.sequence(F.lit(0), F.col("n_bins") - 1), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    middle = lambda c: F.greatest(F.get(F.sort_array(c), F.floor(F.size(c) / 2).cast("int")), F.lit(1).cast("long"))
    out = ends.join(held, sample, "left").withColumn("counts", counts)
    worst = let(middle(F.col("counts")), lambda m: F.array_max(F.transform("counts", lambda c: F.abs(c - m) * 100.0 / m)))
    return out.withColumn("max_dev_pct", worst).drop("held")


def flow_rate(events: DataFrame, time: str, bins: int = 20, sample: str = "sample_id") -> DataFrame:
    """(sample, n_bins, counts, max_dev_pct): counts in equal steps of time and the greatest deviation from their upper median.

    Steps: at most ``bins``, one for each 100 events (those without a finite time too), at least one; empty steps count. Constant time gives nulls.
    """
    t = finite(F.col(time).cast("double"))
    ends = events.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    return _flow(events, ends, time, bins, sample).select(sample, "n_bins", "counts", "max_dev_pct")


def _shares(panel: Panel, ranges: dict[str, float]) -> Column:
    """Aggregate: (ord, channel, pct) of raw values at 99.9 % of the range and more, of all channels with a range of 2 and more, time included."""
    wanted = [(n, c, float(ranges[n])) for n, c in zip(panel.channels, panel.columns, strict=True) if ranges.get(n, 0) >= 2]
    share = lambda c, top: 100.0 * F.count_if((F.col(c) >= 0.999 * top) & ~F.isnan(F.col(c).cast("double"))) / F.count(F.lit(1))
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("channel"), share(c, top).alias("pct")) for i, (n, c, top) in enumerate(wanted)]
    return F.array(*rows) if rows else F.array().cast("array<struct<ord:int,channel:string,pct:double>>")


def margin_shares(events: DataFrame, panel: Panel, ranges: dict[str, float], sample: str = "sample_id") -> DataFrame:
    """(sample, ord, channel, pct) of raw events at the top of their range; ranges under 2 are passed over."""
    return events.groupBy(sample).agg(_shares(panel, ranges).alias("rows")).select(sample, F.inline("rows"))


def worst_margin(rows: Column) -> Column:
    """Of (ord, channel, pct) structs: the one of the greatest share, the last channel of equals."""
    return F.array_max(F.transform(rows, lambda r: F.struct(r["pct"].alias("pct"), r["ord"].alias("ord"), r["channel"].alias("channel"))))


def flags(n: Column, viable: Column, flow: Column, margin: Column, channel: Column) -> Column:
    """What is wrong with a sample, in words; undefined figures break no limit."""
    found = F.array(
        F.when(n < FEW_EVENTS, F.concat(F.lit("low events ("), n.cast("string"), F.lit(")"))),
        F.when(viable < LOW_VIABLE, F.concat(F.lit("low viability ("), fixed(viable, 0), F.lit("%)"))),
        F.when(flow > FLOW_DEVIATION, F.concat(F.lit("flow-rate Δ"), fixed(flow, 0), F.lit("%"))),
        F.when(margin > OFF_SCALE, F.concat(fixed(margin, 1), F.lit("% off-scale on "), channel)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def qc_scan(
    events: DataFrame, panel: Panel, ranges: dict[str, float], time: str | None = None, viable: tuple[list[Gate], int] | None = None, compensated: DataFrame | None = None, skipped: DataFrame | None = None, sample: str = "sample_id"
) -> DataFrame:
    """(sample, n_events, viable, flow_dev, offscale_pct, offscale_channel, flags), in one aggregation and one pass of time bins.

    ``viable``: gates and the id of one of them, whose share of its parent is told; undefined if it isn't among them. Gates see ``events``, unless ``compensated`` has the same samples' compensated ones:
    then a sample that isn't there is without the figure. ``skipped`` (sample, reason): files that couldn't be read, which become rows of no events and the flag "skipped: reason".
    """
    known = {g.id: g for g in viable[0]} if viable else {}
    share = None
    if viable and viable[1] in known:
        plan, parent = GatePlan(viable[0], panel), known[viable[1]].parent
        base = F.count(F.lit(1)) if parent is None else F.count_if(plan.effective(parent)) if parent in known else F.lit(0)
        share = F.when(base > 0, 100.0 * F.count_if(plan.effective(viable[1])) / base).otherwise(0.0)
    t = finite(F.col(time).cast("double")) if time else F.lit(None).cast("double")
    own = share if share is not None and compensated is None else F.lit(None).cast("double")
    out = events.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), _shares(panel, ranges).alias("_rows"), own.alias("viable"))
    if share is not None and compensated is not None:
        out = out.drop("viable").join(compensated.groupBy(sample).agg(share.alias("viable")), sample, "left")
    out = _flow(events, out, time, 20, sample) if time else out.withColumn("max_dev_pct", F.lit(None).cast("double"))
    out = out.withColumn("_worst", worst_margin(F.col("_rows")))
    told = flags(F.col("n"), F.col("viable"), F.col("max_dev_pct"), F.col("_worst.pct"), F.col("_worst.channel"))
    out = out.select(sample, F.col("n").alias("n_events"), "viable", F.col("max_dev_pct").alias("flow_dev"), F.col("_worst.pct").alias("offscale_pct"), F.col("_worst.channel").alias("offscale_channel"), told.alias("flags"))
    if skipped is None:
        return out
    none = {c: F.lit(None).cast("double") for c in ("viable", "flow_dev", "offscale_pct")} | {"offscale_channel": F.lit(None).cast("string")}
    lost = skipped.select(sample, F.lit(0).cast("long").alias("n_events"), *[v.alias(c) for c, v in none.items()], F.array(F.concat(F.lit("skipped: "), F.col("reason"))).alias("flags"))
    return out.unionByName(lost)
