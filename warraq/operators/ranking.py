"""Places within groups that one task could not hold: ranges are numbered apart and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_place(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row in its group by `order`, which must tell all rows of a group apart.

    Rows are divided into ranges of the order, whatever their group, so a group that
    holds a third of all rows is spread over as many tasks. Rows are numbered within
    (range, group); the ranges' sizes, one row for each range and group, give the
    offsets. The ranges are fixed by a checkpoint, so a lost executor finds them again.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    x = rows.select("*", *(c.alias(k) for c, k in zip(order, keys)))
    x = cut(x.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys)).withColumn("_part", F.spark_partition_id()))
    sizes = x.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    offsets = sizes.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col("_part").alias("_p"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*(F.col(k).asc_nulls_first() for k in keys))) - 1
    y = x.withColumn("_own", own)
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    out = y.join(offsets, same).withColumn(name, (F.col("_own") + F.col("_before")).cast("long"))
    return out.drop("_part", "_p", "_own", "_before", *keys, *(f"_b{i}" for i in range(len(by))))
