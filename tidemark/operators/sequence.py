"""Row numbers that no single task has to produce.

A window over everything, or over one hot key, is one task. Here rows are cut into ordered buckets,
numbered inside their bucket, and shifted by the sizes of the buckets before: two small aggregates
instead of one long sort. Buckets follow the data: quantiles of an integer key, or ranges of a whole
order, so that each holds about the same number of rows whatever their distribution. Where the cuts
fall affects cost, never results.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint

WIDTH = 65_536  # a table of so many rows is one bucket


def _partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(base: DataFrame, key: str, width: int = WIDTH) -> list[float]:
    """Quantiles of an integer key: about as many buckets as a shuffle has partitions, none for a table of up to width rows."""
    n = _partitions(base)
    row = base.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("at")).first()
    return sorted(set(map(float, row["at"]))) if row["n"] > width else []


def by_cuts(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    """df with _b, the bucket of key: found by binary search in the JVM."""
    if not cuts:
        return df.withColumn("_b", F.lit(0.0))
    inf = float("inf")
    return Bucketizer(splits=[-inf, *cuts, inf], inputCol=key, outputCol="_b").transform(df)


def by_ranges(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with _b, which ranges of (keys, order) number: as many as a shuffle has partitions, of about equal size.

    Sampled ranges may differ from one evaluation to the next, so the rows are written once.
    """
    cut = df.repartitionByRange(_partitions(df), *keys, *order).withColumn("_b", F.spark_partition_id().cast("double"))
    return checkpoint(cut)


def bucketed_counts(cut: DataFrame, keys: list[str], order: list, counters: dict[str, Column | None]) -> DataFrame:
    """Running counts by order inside keys, this row included: of all rows (None) or of those with a condition.

    cut has _b, which must not decrease along order, nor be null, like the keys (domain keys never are). The join has the
    window's own partitioning, so rows are shuffled once.
    """
    count = {n: F.count(F.lit(1)) if c is None else F.count_if(c) for n, c in counters.items()}
    sizes = cut.groupBy(*keys, "_b").agg(*[c.alias(f"_n_{n}") for n, c in count.items()])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_b", *[F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in count])
    so_far = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut.withColumns({n: c.over(so_far) for n, c in count.items()}).join(shifts, [*keys, "_b"])
    return numbered.withColumns({n: (F.col(n) + F.col(f"_s_{n}")).cast("long") for n in count}).drop("_b", *[f"_s_{n}" for n in count])


def ranged_row_number(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """name: 1-based row number by any order inside keys."""
    return bucketed_counts(by_ranges(df, keys, order), keys, order, {name: None})


def keyed_row_number(df: DataFrame, keys: list[str], key: str, name: str, cuts: list[float]) -> DataFrame:
    """name: 1-based row number by an integer column inside keys (or over the whole table), with the cuts of its cut_points."""
    return bucketed_counts(by_cuts(df, key, cuts), keys, [key], {name: None})


def grouped_row_number(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """name: 1-based row number inside keys whose groups are small (the lines of an order, the events of a run)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
