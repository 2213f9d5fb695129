"""Numbering of the rows of groups of any size by one range partitioning.

`row_number()` puts a whole group into one task, so a group that holds a third of all rows never ends.  Here all
rows are sorted by group and order into range partitions, which cut a large group by themselves:

1. each row gets its place: its partition and its row there;
2. the sizes of the partitions, a row for each, are added up, which makes a place a dense number over all rows;
3. a row's ordinal is its dense number less that of the first row of its group, the least of the group.

Rows are sorted and moved once for the numbers.  The sorted rows are written to the shared folder with their places,
so all three steps see the same ones whatever is lost, cached or planned anew; pass in only the columns you need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import freed_shuffles, work_dir

#: Bits of the row in `monotonically_increasing_id`; the partition stands above them.
ROW_BITS = 33


def with_ordinal(
    df: DataFrame, keys: list[str], order: str, name: str = "ordinal", coarse: list[Column] = (), parts: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, by the `coarse` columns and then by `order`.

    `order` is one column; rows with equal order are numbered in any order.  Null keys are a group.  `folder` is a
    new folder all executors reach, by default one of `work_dir`.
    """
    marks = [f"__b{i}" for i in range(len(coarse))]
    by = [*keys, *marks, order]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark, folder = df.sparkSession, folder or work_dir(df.sparkSession)
    placed = (
        df.select("*", *[b.alias(m) for b, m in zip(coarse, marks)])
        .repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*marks)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    with freed_shuffles(spark):
        placed.write.option("compression", "zstd").parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    part = F.shiftright("__place", ROW_BITS)
    # One row a partition, so the running sum in one task and the broadcast are bounded.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))

    def dense(rows: DataFrame, number: str) -> DataFrame:
        row = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        return rows.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(
            number, F.col("__before") + row).drop("__part", "__before", "__place")

    first = dense(placed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("__place").alias("__place")), "__first")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return dense(placed, "__number").join(first, same).select(
        *df.columns, (F.col("__number") - F.col("__first") + 1).alias(name))
