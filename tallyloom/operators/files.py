"""Uploaded files: one of each name and content, with names that tell different contents apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import stem, suffix
from tallyloom.operators.numbering import numbered, running_total


def deduplicate_uploads(files: DataFrame, name: str = "name", content: str = "content", ord: str = "ord") -> DataFrame:
    """(name, ord, hash, display, position) of the first file of each name and content; ord are distinct integers.

    Where a name has several contents, display is stem(i).suffix, i counting from 1 in upload order. position is the new
    order: files of one name together, where the name came first. Contents are hashed where they are read and aren't shuffled.
    """
    own = files.select(F.col(name).alias("name"), F.col(ord).cast("long").alias("ord"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))
    first = own.groupBy("name", "hash").agg(F.min("ord").alias("ord"))
    names = first.groupBy("name").agg(F.count("*").alias("_files"), F.min("ord").alias("_first"))
    names = running_total(names, "_first", "_files", "_before")
    made = numbered(first, "ord", "_i", within=("name",)).join(names, "name")
    display = F.when(F.col("_files") == 1, F.col("name")).otherwise(F.concat(stem(F.col("name")), F.lit("("), F.col("_i").cast("string"), F.lit(")"), suffix(F.col("name"))))
    return made.select("name", "ord", "hash", display.alias("display"), (F.col("_before") + F.col("_i")).alias("position"))
