"""Chats as CSV files and as lines of Python literals."""

from __future__ import annotations

import ast
import csv
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import na_as_text, na_to_null, parse_time

LINES = "file string, ord bigint, user string, message string, date string, has_date boolean, bad boolean, line string, path string"
CHAT = "path string, file string, ord bigint, date string, user string, message string"
#: Bytes of a file that hold its header.
HEAD = 4096


def literal_path(path: str) -> str:
    """A path that stands for one file, whatever signs its name has: readers take brackets, braces and stars for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def decoded(uri: Column) -> Column:
    """A path as it is listed, out of the address that file metadata has, in which some signs are percent-encoded."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """The files of each header line, as it stands; files without one are left out.

    The driver gets one row for each file, which it lists to read them anyway.
    """
    files = spark.read.format("binaryFile").load(paths)
    first = F.substring_index(F.decode(F.substring("content", 1, HEAD), "UTF-8"), "\n", 1)
    first = F.btrim(F.regexp_replace(first, "^\ufeff", ""), F.lit(" \r"))
    found: dict[str, list[str]] = {}
    for r in files.select("path", first.alias("first")).where("first <> ''").orderBy("path").collect():
        found.setdefault(r["first"], []).append(r["path"])
    return found


def read_chat_csv(spark: SparkSession, paths: str | list[str], na_compat: bool = True) -> DataFrame:
    """(path, file, ord, date, user, message) of CSV files with a header, as text; ord orders the rows of a file.

    Each file is read by its own header, whatever order or choice of columns it has: files of one header together, then
    joined by name. A file is read by one task, as its cells may hold line feeds. A missing column is empty text, a
    missing date null. With na_compat, a message cell that is empty or says that it is missing is the text `nan`, and such
    a user or date is null.
    """
    read = [_csv_of_one_header(spark, [literal_path(f) for f in files], first, na_compat) for first, files in headers(spark, paths).items()]
    return reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], CHAT)


def _csv_of_one_header(spark: SparkSession, paths: list[str], first: str, na_compat: bool) -> DataFrame:
    # the header is known, so that no file is read for its columns
    names = next(csv.reader([first]))
    have = {name.lower(): f"c{i}" for i, name in enumerate(names)}
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(shape).csv(paths, header=True, enforceSchema=True, multiLine=True, encoding="UTF-8", quote='"', escape='"')
    cell = lambda name: F.col(f"`{have[name]}`") if name in have else F.lit("")
    clean, message = (na_to_null, na_as_text) if na_compat else (lambda c: c, lambda c: c)
    told = [
        decoded(F.col("_metadata.file_path")).alias("path"),
        F.element_at(F.split(decoded(F.col("_metadata.file_path")), "/"), -1).alias("file"),
        F.monotonically_increasing_id().alias("ord"),
        (clean(cell("date")) if "date" in have else F.lit(None).cast("string")).alias("date"),
        (clean(cell("user")) if "user" in have else cell("user")).alias("user"),
        (message(cell("message")) if "message" in have else cell("message")).alias("message"),
    ]
    return rows.select(*told)


def _said(line: str) -> tuple:
    """(user, message, date, has_date, bad) of a line."""
    try:
        said = ast.literal_eval(line)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None, None, None, False, True
    text = lambda v: None if v is None else str(v)
    return (text(said.get("user")), text(said.get("message")), text(said.get("date")), "date" in said, False) if isinstance(said, dict) else (None, str(said), None, False, False)


LINE_COLUMNS = ["file", "ord", "user", "message", "date", "has_date", "bad", "line", "path"]


def _literals(batches):
    for files in batches:
        out = []
        for path, name, raw in zip(files["path"], files["file"], files["content"], strict=True):
            lines = ((at, line.strip()) for at, line in enumerate(bytes(raw).decode("utf-8").splitlines()))
            out += [(name, at, *_said(line), line, path) for at, line in lines if line]
        yield pd.DataFrame(out, columns=LINE_COLUMNS)


def _literal_lines(batches):
    for b in batches:
        yield pd.DataFrame([(f, o, *_said(s), s, p) for f, o, s, p in zip(b["file"], b["ord"], b["line"], b["path"], strict=True)], columns=LINE_COLUMNS)


def read_chat_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each line that isn't blank, a Python dict literal: user, message, date where there is one.

    bad marks lines that can't be read, a line with a byte order mark among them; a literal other than a dict is kept as
    its message. Files are decoded strictly and split as str.splitlines does, which Spark's text reader doesn't.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(_literals, LINES)


def read_literals(lines: DataFrame) -> DataFrame:
    """As read_chat_lines(), of lines that are rows already: (path, file, ord, line)."""
    told = lines.select("file", F.col("ord").cast("long").alias("ord"), F.btrim("line").alias("line"), "path").where("line <> ''")
    return told.mapInPandas(_literal_lines, LINES)


#: Why a line is set aside.
UNREADABLE, UNDATED = "not a literal", "date of no known shape"


def fault(rows: DataFrame) -> Column:
    """Why a line can't be used, null if it can: it is no literal, or it has a date that can't be read."""
    return F.when(F.col("bad"), UNREADABLE).when(F.col("has_date") & parse_time(F.col("date")).isNull(), UNDATED)


def in_range(rows: DataFrame, after=None, before=None, date: str = "date", strict: bool = True) -> DataFrame:
    """Rows from after to before, both included, as times without a zone; without either, all rows.

    A row without a date goes where a bound is given. A date of no known shape raises, or goes unless strict.
    """
    if after is None and before is None:
        return rows
    at = F.col(date) if dict(rows.dtypes)[date].startswith("timestamp") else parse_time(F.col(date), strict)
    for bound, test in ((after, at.__ge__), (before, at.__le__)):
        if bound is not None:
            rows = rows.where(test(F.lit(bound).cast("timestamp_ntz")))
    return rows


def lines_in_range(rows: DataFrame, after=None, before=None) -> DataFrame:
    """Readable lines from after to before; lines without a date stay, those whose date can't be read go."""
    rows = rows.where(~F.col("bad"))
    if after is None and before is None:
        return rows
    at, ok = parse_time(F.col("date")), F.lit(True)
    if after is not None:
        ok &= at >= F.lit(after).cast("timestamp_ntz")
    if before is not None:
        ok &= at <= F.lit(before).cast("timestamp_ntz")
    return rows.where(~F.col("has_date") | F.coalesce(ok, F.lit(False)))


@F.pandas_udf(T.StringType())
def literal(user: pd.Series, message: pd.Series, date: pd.Series) -> pd.Series:
    """A message as the Python literal of a dict."""
    none = lambda v: None if v is None or v != v else v
    return pd.Series([repr({"user": none(u), "message": none(m), "date": none(d)}) for u, m, d in zip(user, message, date, strict=True)])


def write_chat_lines(rows: DataFrame, path: str, by: str = "file") -> None:
    """Messages as lines of dict literals, in order of ord, in a folder for each value of `by`; one file there for each chat."""
    told = rows.repartition(by).sortWithinPartitions(by, "ord")
    told.select(by, literal("user", "message", F.col("date").cast("string")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)
