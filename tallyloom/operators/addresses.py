"""Codes of addresses that aren't spelled like the table's: the nearest one by its rare letter groups.

An address is the set of three-letter groups of its words. A group weighs more the fewer known addresses have it. Two
addresses are as near as twice the weight of what they share, over the weight of both. The nearest known address that is
near enough gives its code.

Candidates meet by rare groups only. With groups in order of rarity, two addresses that are near enough share one among the
first few of each, until what is left of either couldn't reach the bound by itself. So a group that most addresses have
joins none of them, and no pair that counts is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.zipcodes import Service

NEAR = 0.6
#: Weights are whole numbers, thousandths.
UNIT = 1000


def groups(address):
    """The distinct three-letter groups of an address's words, whose ends are marked."""
    words = F.filter(F.split(F.lower(address), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def _weighed(rows: DataFrame, id: str, seen: DataFrame, all_known: Column, near: float) -> tuple[DataFrame, DataFrame]:
    """(id, groups, total) with each group's weight, and (id, g) of the rare groups by which it may be found.

    A group that no known address has weighs as if one had it.
    """
    each = rows.select(id, F.explode(groups(F.col(id))).alias("g")).join(seen, "g", "left").withColumn("n", all_known)
    weight = F.round(UNIT * F.log1p(F.col("n") / F.coalesce("known", F.lit(1)))).cast("long")
    each = each.select(id, "g", F.coalesce("known", F.lit(0)).alias("known"), weight.alias("w"))
    whole = each.groupBy(id).agg(F.collect_list(F.struct("g", "w")).alias("groups"), F.sum("w").alias("total"))
    rest = F.sum("w").over(Window.partitionBy(id).orderBy("known", "g").rowsBetween(0, Window.unboundedFollowing))
    all_of = F.sum("w").over(Window.partitionBy(id))
    rare = each.select(id, "g", (rest >= near / (2 - near) * all_of).alias("rare")).where("rare").select(id, "g")
    return whole, rare


def nearest(addrs: DataFrame, known: DataFrame, near: float = NEAR) -> DataFrame:
    """(addr, address, code, nearness) of addrs' column addr: the nearest of known's (address, code), by address where several are.

    Addresses that none is near enough to have no row. Of repeated known addresses, the least code counts.
    """
    table = known.groupBy("address").agg(F.min("code").alias("code")).where("address <> ''")
    seen = table.select(F.explode(groups(F.col("address"))).alias("g")).groupBy("g").agg(F.count("*").alias("known"))
    n = table.agg(F.count("*")).scalar()
    asked, asked_by = _weighed(addrs.select("addr").where("addr <> ''").distinct(), "addr", seen, n, near)
    have, have_by = _weighed(table.select("address"), "address", seen, n, near)
    pairs = asked_by.join(have_by, "g").select("addr", "address").distinct()
    both = pairs.join(asked, "addr").join(have.withColumnsRenamed({"groups": "own", "total": "own_total"}), "address")
    shared = F.aggregate(F.array_intersect("groups", "own"), F.lit(0).cast("long"), lambda sum, g: sum + g["w"])
    scored = both.select("addr", "address", (2.0 * shared / (F.col("total") + F.col("own_total"))).alias("nearness")).where(F.col("nearness") >= near)
    best = scored.groupBy("addr").agg(F.min_by(F.struct("address", "nearness"), F.struct(-F.col("nearness"), F.col("address"))).alias("_b"))
    return best.select("addr", "_b.address", "_b.nearness").join(table, "address").select("addr", "address", "code", "nearness")


def from_index(known: DataFrame, address: str = "address", code: str = "zip_code", near: float = NEAR) -> Service:
    """Codes of the nearest address of a table: (addr) -> (addr, zip)."""
    table = known.select(strip(F.col(address)).alias("address"), F.col(code).cast("string").alias("code"))
    return lambda addrs: addrs.join(nearest(addrs, table, near).select("addr", F.col("code").alias("zip")), "addr", "left")
