"""Stock lists in one of several encodings, and catalogs as JSON."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.schemas import CATALOG, PRODUCT, STOCK_OPTION

#: Encodings that are tried strictly, in turn, before UTF-8 with replacements.
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")


def decoded(raw: bytes) -> str:
    """The text of a file in the first encoding that fits all of it."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def required(columns: list[str], *names: str) -> None:
    """Raise unless all names are among the columns."""
    if missing := [n for n in names if n not in columns]:
        raise ValueError(f"columns {missing} are needed; found: {list(columns)}")


def _rows(batches):
    for files in batches:
        for path, raw in zip(files["path"], files["content"], strict=True):
            cells = pd.read_csv(io.StringIO(decoded(bytes(raw))), dtype=str)
            required(list(cells.columns), PRODUCT, STOCK_OPTION)
            text = lambda c: cells[c].where(cells[c].notna(), None)  # noqa: E731, B023
            yield pd.DataFrame({"path": path, "line": range(len(cells)), "product": text(PRODUCT), "option": text(STOCK_OPTION)})


def read_stock(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, product, option, ord) of stock lists, one task for each file; cells that say that they are missing are null.

    ord orders all rows: files by path, lines within. A file without the two columns raises, naming what it has. Spark's
    own CSV reader knows neither of the two Korean encodings, so files are decoded in Python.
    """
    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_rows, "path string, line long, product string, option string")
    files = rows.groupBy("path").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    before = files.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "path").select("path", "line", "product", "option", (F.col("before") + F.col("line")).alias("ord"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(product, ord, options) of a catalog: a JSON object of products and their options, in its order; the last of repeated keys counts."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", CATALOG))
    rows = text.select(F.posexplode(entries).alias("ord", "e")).select("ord", F.col("e.key").alias("product"), F.col("e.value").alias("options"))
    return rows.groupBy("product").agg(F.min("ord").cast("long").alias("ord"), F.max_by("options", "ord").alias("options"))
