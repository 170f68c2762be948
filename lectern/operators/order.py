"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that the order is cut into; so many boundary values (about) reach the driver.
STRETCHES = 200


def numbered(df: DataFrame, column: str, name: str, *ties: str) -> DataFrame:
    """``df`` with 1, 2, ... in order of a column, and of ``ties`` where it repeats (one value of it stays in one task). Boundaries are picked by hash, so each run cuts alike."""
    step = max(1, df.count() // STRETCHES)
    bounds = sorted({r[0] for r in df.where(F.pmod(F.xxhash64(column, *ties), F.lit(step)) == 0).select(column).distinct().collect() if r[0] is not None})
    stretch: Column = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))) if bounds else F.lit(0)
    cut = df.withColumn("__stretch", stretch)
    before, total = {}, 0
    for k, n in sorted((r[0], r[1]) for r in cut.groupBy("__stretch").count().collect()):
        before[k], total = total, total + n
    offset = F.try_element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("__stretch")) if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("__stretch").orderBy(column, *ties))
    return cut.withColumn(name, (own + offset).cast("bigint")).drop("__stretch")
