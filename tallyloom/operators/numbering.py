"""Running totals and consecutive numbers without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots for each task of a shuffle, so that tasks get about as many rows each, and the most slots altogether.
SLOT, MOST_SLOTS = 64, 1 << 15


def with_slots(rows: DataFrame, by: str, name: str = "_slot") -> DataFrame:
    """rows and a column for their slot: how many of the ordinals' quantiles it reaches. So slots hold about as many rows each, wherever ordinals lie.

    The quantiles are a sketch over the one column, merged from all tasks, and a subquery of the plan: nothing runs until the
    rows are asked for. A row finds its slot by binary search. Whatever the sketch says, slots are in order of the ordinals.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = min(MOST_SLOTS, 1 << (SLOT * tasks - 1).bit_length())
    at = [i / slots for i in range(1, slots)]
    bounds = rows.select(F.percentile_approx(by, F.lit(at) if at else F.array(F.lit(0.5)), 20 * slots)).scalar()
    asked = rows.withColumn("_bounds", bounds)
    steps = F.array(*[F.lit(slots >> k) for k in range(1, slots.bit_length())]) if slots > 1 else F.array().cast("array<int>")
    slot = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get("_bounds", found + step - 1) <= F.col(by), found + step).otherwise(found))
    return asked.select(*rows.columns, slot.alias(name))


def running_total(rows: DataFrame, by: str, weight: str | int, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows and a column `name`: the total of weight over the rows before, in order of the integers in `by`, distinct within a group.

    Ordinals are dealt into slots: each slot is summed, the slots' sums are run through in order, and rows are run through
    within their slot. So neither all rows nor a hot group ends up in one task; one task gets the slots' sums of a group.
    """
    weigh = F.lit(weight) if isinstance(weight, int) else F.col(weight)
    dealt = with_slots(rows, by).withColumn("_w", weigh.cast("long"))
    sums = dealt.groupBy(*within, "_slot").agg(F.sum("_w").alias("_sum"))
    slots = Window.partitionBy(*within).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*within, "_slot", F.coalesce(F.sum("_sum").over(slots), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*within, "_slot").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    made = dealt.join(base, [*within, "_slot"]).withColumn("_run", F.col("_base") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return made.select(*rows.columns, F.col("_run").alias(name))


def numbered(rows: DataFrame, by: str, name: str = "n", within: tuple[str, ...] = ()) -> DataFrame:
    """rows and a column `name`: consecutive numbers from 1 in order of the integers in `by`, distinct within a group."""
    return running_total(rows, by, 1, name, within).withColumn(name, F.col(name) + 1)
