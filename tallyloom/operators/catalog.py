"""Product catalogs: built from stock lists, counted, and turned from map to rows and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.sources.schemas import SINGLE

#: Products of a catalog that may become one JSON text, which goes into every prompt; more is an error.
MOST_PRODUCTS = 100_000


def clean(c: Column) -> Column:
    """A cell without white space at its ends; empty where missing or `nan`."""
    s = F.coalesce(strip(c.cast("string")), F.lit(""))
    return F.when(s == "nan", "").otherwise(s)


def build(stock: DataFrame, product: str, option: str, ord: str = "ord") -> DataFrame:
    """(product, ord, options): each product's distinct options in the order first seen, possibly none; ord is where it was first seen.

    Rows without a product go. Repeats are folded before they are shuffled.
    """
    rows = stock.select(F.col(ord).alias("ord"), clean(F.col(product)).alias("product"), clean(F.col(option)).alias("option")).where("product <> ''")
    pairs = rows.groupBy("product", "option").agg(F.min("ord").alias("ord"))
    listed = F.array_sort(F.collect_list(F.when(F.col("option") != "", F.struct("ord", "option"))))
    return pairs.groupBy("product").agg(F.min("ord").alias("ord"), F.transform(listed, lambda x: x["option"]).alias("options"))


def counts(catalog: DataFrame) -> DataFrame:
    """One row: products, options, and products whose only option says that there is none to choose."""
    single = F.col("options") == F.array(F.lit(SINGLE))
    return catalog.agg(F.count("*").alias("products"), F.coalesce(F.sum(F.size("options")), F.lit(0)).cast("long").alias("options"), F.count_if(single).alias("single"))


def listing(catalog: DataFrame) -> DataFrame:
    """(#, product, options, n_options) as a catalog is shown, # counting from 1 in order of ord."""
    from tallyloom.operators.numbering import numbered

    return numbered(catalog, "ord", "#").select("#", "product", F.array_join("options", ", ").alias("options"), F.size("options").alias("n_options"))


def to_rows(catalog: DataFrame) -> DataFrame:
    """(product, option_no, option) for each option of each product; products without options have no row."""
    return catalog.select("product", F.posexplode("options").alias("option_no", "option"))


def from_rows(rows: DataFrame, ord: str = "option_no") -> DataFrame:
    """(product, options) out of to_rows(), in order of ord."""
    return rows.groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct(ord, "option"))), lambda x: x["option"]).alias("options"))


def last_of_each(entries: DataFrame, product: str = "product", options: str = "options", ord: str = "ord") -> DataFrame:
    """(product, options) of a listed catalog as a dict: of repeated products the last one's options, at the first one's place."""
    return entries.groupBy(F.col(product).alias("product")).agg(F.min(ord).alias("ord"), F.max_by(options, ord).alias("options"))


def to_json(catalog: DataFrame) -> str:
    """The catalog as one indented JSON object, products in order of ord. Raises beyond MOST_PRODUCTS."""
    got = catalog.orderBy("ord").select("product", "options").limit(MOST_PRODUCTS + 1).collect()
    if len(got) > MOST_PRODUCTS:
        raise ValueError(f"more than {MOST_PRODUCTS} products: write the catalog as a table")
    return json.dumps({r["product"]: list(r["options"]) for r in got}, ensure_ascii=False, indent=2)
