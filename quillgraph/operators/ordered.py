"""Numbers, running sums and runs over a whole table in order, without one task for all of it.

Rows are parted by ranges of the order and written once, since ranges are sampled and a second
run could draw other ones. What passes from part to part is one row for each part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.lineage import cut


def _parted(rows: DataFrame, order: list) -> DataFrame:
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")


def _summed(parted: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``parted`` with the running sum of ``value``, the sums of earlier parts included."""
    parts = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, F.sum(value).over(inner) + F.col("_before")).drop("_before")


def running(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row. ``order`` should tell all rows apart."""
    return _summed(_parted(rows, order), order, value, name).drop("_part")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1."""
    return running(rows, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def runs(rows: DataFrame, position: str, fields: list[str], apart: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``rows`` with the number, from 0, of the run that they stand in.

    A row starts a run if ``apart(row, row before)`` holds for the structs of their ``fields``.
    """
    parted = _parted(rows, [position])
    here = F.struct(*fields)
    last = parted.groupBy("_part").agg(F.max_by(here, position).alias("_last"))
    ends = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_end"))  # one row for each part
    inner = Window.partitionBy("_part").orderBy(position)
    before = F.when(F.row_number().over(inner) == 1, F.col("_end")).otherwise(F.lag(here).over(inner))
    marked = parted.join(F.broadcast(ends), "_part").withColumn("_before", before)
    marked = marked.withColumn("_new", F.coalesce(apart(here, F.col("_before")).cast("int"), F.lit(0))).drop("_before", "_end")
    return _summed(marked, [position], F.col("_new"), name).drop("_part", "_new")


def counted(rows: DataFrame, value: str) -> DataFrame:
    """(value, _n, _upto, _total): rows at each value, up to it, and in all; null comes first."""
    counts = cut(rows.groupBy(value).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n").alias("_total"))
    return running(counts, [value], F.col("_n"), "_upto").crossJoin(F.broadcast(total))  # one row


def with_share(rows: DataFrame, value: str, name: str, strict: bool = False) -> DataFrame:
    """``rows`` with the share of rows at or below (``strict``: below) their value; ties share it."""
    return _looked_up(rows, value, name, (F.col("_upto") - F.col("_n") if strict else F.col("_upto")) / F.col("_total"))


def with_average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the mean place of those that tie with them."""
    return _looked_up(rows, value, name, F.col("_upto") - (F.col("_n") - 1) / 2.0)


def _looked_up(rows: DataFrame, value: str, name: str, what: Column) -> DataFrame:
    found = counted(rows, value).select(F.col(value).alias("_value"), what.alias(name))
    return rows.join(found, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
