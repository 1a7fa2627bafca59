"""Rows that can't be used, set aside where they can be seen, and counted on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sorted:
    """kept and set_aside are read from where they were written; counts has `rows`, `kept`, and a number for each reason."""

    kept: DataFrame
    set_aside: DataFrame
    counts: dict[str, int]


def sort_out(rows: DataFrame, reason: Column, reasons: list[str], folder: str) -> Sorted:
    """Write rows to folder, those with a reason apart from the others, in one pass over rows, which counts both.

    What reads kept afterwards reads the folder, so that the source is read, and its lines are parsed, once. reasons: what
    reason may be, besides null. The folder must not be there yet.
    """
    seen = Observation()
    told = rows.withColumn("reason", reason)
    counts = [F.count_if(F.col("reason") == r).alias(f"r{i}") for i, r in enumerate(reasons)]
    told = told.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("kept"), *counts)
    told.withColumn("set_aside", F.col("reason").isNotNull()).write.partitionBy("set_aside").parquet(folder)
    found = seen.get
    back = rows.sparkSession.read.schema(f"{told.schema.toDDL()}, set_aside boolean").parquet(folder)
    kept, aside = back.where(~F.col("set_aside")).select(*rows.columns), back.where("set_aside").drop("set_aside")
    return Sorted(kept, aside, {"rows": found["rows"], "kept": found["kept"], **{r: found[f"r{i}"] for i, r in enumerate(reasons)}})
