"""Quantiles and distinct counts that roll up: sketches by vessel and day (or other keys), merged to any level.

A KLL sketch of parameter ``k`` gives the rank of a quantile within a share of the rows that is about 1.7 % at
200 and 0.4 % at 1000 (with 99 % confidence, of any one quantile); a HyperLogLog sketch of 2 to the power of
``lg`` registers has a relative standard error of 0.83 / sqrt(2 ** lg), 1.3 % at 12. Merged sketches keep
these errors, so a level above is made from the level below and pings are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUARTERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def sketched(df: DataFrame, keys: list[str], values: list[str], counted: list[str], k: int = 1000, lg: int = 12) -> DataFrame:
    """A row for each of the ``keys``: sketches, sums, and numbers of ``values`` and their nulls; distinct sketches of ``counted``. Nan counts as null."""
    out = [F.count("*").alias("n")]
    for v in values:
        known = F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))
        out += [F.kll_sketch_agg_double(known, k).alias(f"{v}_kll"), F.sum(known).alias(f"{v}_sum"), F.count(known).alias(f"{v}_n")]
    out += [F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(f"{c}_hll") for c in counted]
    return df.groupBy(*keys).agg(*out)


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same for fewer keys, out of the sketches alone; no keys give one row."""
    columns = sketches.columns
    out = [F.sum("n").alias("n")]
    for c in columns:
        if c.endswith("_kll"):
            v = c[: -len("_kll")]
            out += [F.kll_merge_agg_double(c).alias(c), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.sum(f"{v}_n").alias(f"{v}_n")]
        elif c.endswith("_hll"):
            out.append(F.hll_union_agg(c, True).alias(c))
    return sketches.groupBy(*keys).agg(*out)


def read_off(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = QUARTERS) -> DataFrame:
    """``n``, and for each value ``_q0`` to ``_q100``, ``_mean`` and ``_nulls``, for each counted column ``_distinct``."""
    out = []
    for c in sketches.columns:
        if c.endswith("_kll"):
            v = c[: -len("_kll")]
            some = F.col(f"{v}_n") > 0  # an empty sketch has no quantiles
            out += [F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(f"{v}_q{round(q * 100)}") for q in shares]
            out += [F.try_divide(f"{v}_sum", f"{v}_n").alias(f"{v}_mean"), (F.col("n") - F.col(f"{v}_n")).alias(f"{v}_nulls")]
        elif c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c[: -len('_hll')]}_distinct"))
    return sketches.select(*keys, "n", *out)
