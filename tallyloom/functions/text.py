"""Scalar text functions, Column -> Column, with the Unicode rules of Python's str and re."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python takes for white space: Java's Unicode class lacks the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"
#: The cell texts that a CSV reader of data frames takes for missing, besides the empty cell.
NA_TOKENS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
STAMP = r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}"


def na_to_null(c: Column) -> Column:
    """A CSV cell, null where it is empty or says that it is missing."""
    return F.when((c != "") & ~c.isin(*NA_TOKENS), c)


def na_as_text(c: Column) -> Column:
    """A CSV cell as text: a missing one is `nan`, as where data frames are turned into strings."""
    return F.coalesce(na_to_null(c), F.lit("nan"))


def collapse(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def digits(c: Column) -> Column:
    """The decimal digits of any script, in order."""
    return F.regexp_replace(c, r"(?U)\D", "")


def phone(c: Column) -> Column:
    """010-1234-5678 for eleven digits that begin with 010, however written; anything else as it is."""
    d = digits(c)
    dashed = F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4))
    return F.when((F.length(d) == 11) & d.startswith("010"), dashed).otherwise(c)


def zip_code(c: Column) -> Column:
    """Five digits, zeros in front; more digits as they are; text without digits stripped; null and blank as empty."""
    s = strip(c)
    z = digits(s)
    return F.when(c.isNull() | (s == ""), "").when(z == "", s).when(F.length(z) <= 5, F.lpad(z, 5, "0")).otherwise(z)


def printable_ascii(c: Column) -> Column:
    """Printable ASCII only, stripped: what is left of a pasted key."""
    return strip(F.regexp_replace(c, r"[^\x20-\x7E]", ""))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def base_name(c: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """A file's name without its suffix; a name that begins with its only dot has none."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+\z", "")


def suffix(c: Column) -> Column:
    """A file's suffix with its dot, or empty text."""
    return F.regexp_extract(base_name(c), r".(\.[^.]+)\z", 1)


def chat_name(file: Column, prefix: str = "", normal=nfc) -> Column:
    """The chat of a file's name: what follows prefix, possibly nothing; else the stem without a time stamp, null if nothing is left.

    normal: the step to Unicode normal form C, which ASCII names can do without.
    """
    name = normal(stem(file))
    plain = F.nullif(F.regexp_replace(name, f"_{STAMP}\\z", ""), F.lit(""))
    if not prefix:
        return plain
    prefix = unicodedata.normalize("NFC", prefix)
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(plain)


def file_time(file: Column, strict: bool = True) -> Column:
    """The time stamp in a file's name, null without one. One that is no date raises; null unless strict."""
    found = F.nullif(F.regexp_extract(file, f"({STAMP})", 1), F.lit(""))
    shape = F.lit("yyyy-MM-dd-HH-mm-ss")
    return (F.to_timestamp_ntz if strict else F.try_to_timestamp)(found, shape).cast("timestamp_ntz")


def nickname(file: Column, prefix: str) -> Column:
    """A CSV file's name without a fixed prefix and its suffix."""
    name = F.regexp_replace(base_name(file), r"\.csv\z", "")
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)


def date_slug(c: Column) -> Column:
    """A time in a file's name: spaces and colons as hyphens."""
    return F.translate(c, " :", "--")


def live_label(c: Column) -> Column:
    """A stored time to the minute, or a hyphen."""
    return F.coalesce(F.nullif(F.replace(F.substring(c, 1, 16), F.lit("T"), F.lit(" ")), F.lit("")), F.lit("-"))


def job_label(title: Column, live: Column, total: Column) -> Column:
    """How a job is listed: title, live time, number of orders."""
    return F.concat(title, F.lit("  |  라이브: "), live_label(live), F.lit("  |  "), total.cast("string"), F.lit("건"))


#: Shapes of times that are tried in turn.
SHAPES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd-HH-mm-ss")


def parse_time(c: Column, strict: bool = False, shapes: tuple[str, ...] = SHAPES) -> Column:
    """A time by the first shape that fits; where none does, null, or if strict an error."""
    tried = F.coalesce(*[F.try_to_timestamp(c, F.lit(s)) for s in shapes]).cast("timestamp_ntz")
    if not strict:
        return tried
    bad = F.raise_error(F.concat(F.lit("not a date: "), c)).cast("timestamp_ntz")
    return F.when(c.isNotNull() & tried.isNull(), bad).otherwise(tried)
