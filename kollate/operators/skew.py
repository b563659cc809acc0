"""Joins that spread a hot key over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that one task joins.
ROWS = 100_000


def spread_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", rows: int = ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``few``; a key with more than ``rows`` rows of ``many`` is dealt out in parts by hash, and the rows of
    ``few`` of that key are repeated for each part.

    The result is that of the plain join for inner, left, left_semi and left_anti. Null keys meet nothing; they are dealt out
    as well. ``counted`` is a table of the keys with the column ``n``, their rows in ``many``, where that is known already. The hot keys are at most one in ``rows`` rows, so the table of them is small enough to be broadcast.
    """
    if counted is None:
        counted = many.groupBy(*on).agg(F.count("*").alias("n"))
    hot = F.broadcast(counted.filter(F.col("n") > rows).select(*[F.col(c).alias(f"_{c}") for c in on], F.ceil(F.col("n") / rows).cast("int").alias("_parts")))

    def parted(df: DataFrame) -> DataFrame:
        same = [df[c].eqNullSafe(hot[f"_{c}"]) for c in on]
        return df.join(hot, same, "left").drop(*[f"_{c}" for c in on])

    parts = F.coalesce("_parts", F.lit(1))
    rest = [F.col(c) for c in many.columns if c not in on and dict(many.dtypes)[c][:3] != "map"]
    dealt = parted(many).withColumn("_part", F.pmod(F.xxhash64(*(rest or [F.rand(7)])), parts).cast("int")).drop("_parts")
    repeated = parted(few).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")
