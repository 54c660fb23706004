"""Steps that clean feature frames, and chains of them; keeping a frame's rows as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def finite(c: str):
    """A value, or null where it is infinite or not a number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def replaced_infinite(columns: list[str], value: float | None = None) -> Step:
    """Infinite values become `value` (null by default); NaN and null stay apart."""
    return lambda df: df.withColumns({c: F.when(F.abs(c) == float("inf"), F.lit(value).cast("double")).otherwise(F.col(c)) for c in columns})


def downcast(columns: list[str]) -> Step:
    return lambda df: df.withColumns({c: F.col(c).cast("float") for c in columns})


def sanitized(columns: list[str], by: list[str], clip_sd: float = 5.0) -> Step:
    """What is not finite becomes 0, then values are clipped to the key's mean by clip_sd deviations (of the whole population) and 1e-8."""
    w = Window.partitionBy(*by)

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in columns})
        bound = lambda c, sign: F.avg(c).over(w) + sign * clip_sd * (F.stddev_pop(c).over(w) + 1e-8)
        return df.withColumns({c: F.least(F.greatest(F.col(c), bound(c, -1)), bound(c, 1)) for c in columns})

    return step


def chained(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def aligned(base: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """base with the columns of made: base's rows, each once, whatever made has; repeated keys of made fail."""
    one = made.groupBy(*keys).agg(*(F.first(c).alias(c) for c in made.columns if c not in keys), F.count("*").alias("_n"))
    one = one.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the made columns is repeated"))).otherwise(F.lit(True)))
    out = base.join(one.drop("_n"), keys, "left")
    return out.where("_ok IS NULL OR _ok").drop("_ok")
