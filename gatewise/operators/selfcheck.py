"""Golden figures against computed ones, by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-5


def compare_probes(golden: DataFrame, computed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(layer, probes, missing, unknown, max_dev, pass) of two tables (layer, channel, key, value).

    The deviation is abs(computed - golden) / (abs(golden) + 1). A layer passes if its greatest one is within ``tolerance`` and no golden probe is missing or undefined among the
    computed ones; computed probes that aren't golden are counted as unknown and fail nothing. Null channels and keys are equal to each other; keys are distinct. Two NaNs, or equal infinities, don't deviate.
    """
    named = lambda df, value: df.select("layer", *[F.coalesce(c, F.lit("")).alias(c) for c in ("channel", "key")], F.col("value").alias(value), F.lit(True).alias(f"_{value}"))
    both = named(golden, "golden").join(named(computed, "computed"), ["layer", "channel", "key"], "full_outer")
    g, c = F.col("golden"), F.col("computed")
    dev = F.when(c.eqNullSafe(g), 0.0).otherwise(F.abs(c - g) / (F.abs(g) + 1))
    both = both.select("layer", F.col("_golden").isNotNull().alias("known"), F.col("_computed").isNull().alias("lost"), F.when(F.col("_golden") & F.col("_computed"), dev).alias("dev"))
    out = both.groupBy("layer").agg(
        F.count_if("known").alias("probes"), F.count_if(F.col("known") & (F.col("lost") | F.col("dev").isNull())).alias("missing"), F.count_if(~F.col("known")).alias("unknown"), F.max(F.when(F.col("known"), F.col("dev"))).alias("max_dev")
    )
    return out.withColumn("pass", (F.col("missing") == 0) & (F.col("max_dev") <= tolerance) & (F.col("probes") > 0))
