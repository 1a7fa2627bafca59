"""Nearest addresses against brute force, with planted misspellings and missing parts, and a word that all have."""

import math
import random
import re

from pyspark.sql import functions as F

from tallyloom.operators import addresses, zipcodes


def groups(address):
    words = [w for w in re.split(r"[^\w]+|_", address.lower()) if w]
    return {f"^{w}$"[i : i + 3] for w in words for i in range(len(w))}


def brute(asked, known, near):
    table = {}
    for a, c in known:
        table[a] = min(c, table.get(a, c))
    have = {a: groups(a) for a in table}
    n = {}
    for g in have.values():
        for x in g:
            n[x] = n.get(x, 0) + 1
    w = lambda x: round(1000 * math.log1p(len(table) / n.get(x, 1)))
    total = {a: sum(map(w, g)) for a, g in have.items()}
    found = {}
    for q in set(asked):
        mine = groups(q)
        own = sum(map(w, mine))
        scored = [(-2 * sum(map(w, mine & g)) / (own + total[a]), a) for a, g in have.items() if mine & g]
        if scored and -min(scored)[0] >= near:
            found[q] = table[min(scored)[1]]
    return found


def test_same_as_brute_force(spark):
    rng = random.Random(9)
    street = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(80)]
    known = [(f"Seoul City {rng.choice(street)} {rng.choice(street)} {rng.randint(1, 300)}", f"{i:05d}") for i in range(600)]
    known += [known[0], (known[0][0], "99999"), ("서울 중구 세종대로 110", "04524")]

    def worded(address):
        parts = address.split()
        kind = rng.randrange(4)
        if kind == 0 and len(parts) > 3:
            parts.pop(rng.randrange(2))
        elif kind == 1:
            i = rng.randrange(len(parts))
            k = rng.randrange(len(parts[i]))
            parts[i] = parts[i][:k] + "z" + parts[i][k + 1 :]
        elif kind == 2:
            parts.reverse()
        return ", ".join(parts)

    planted = [(worded(a), c) for a, c in rng.sample(known[:600], 200)]
    asked = [q for q, _ in planted] + ["seoul city", "nowhere", "서울시 중구 세종대로110", "서울 세종대로 110", "!!"]
    rows = spark.createDataFrame([(q,) for q in asked], "addr string")
    table = spark.createDataFrame(known, "address string, code string")
    made = {r["addr"]: r["code"] for r in addresses.nearest(rows, table).collect()}
    assert made == brute(asked, known, addresses.NEAR)
    assert sum(made.get(q) == c for q, c in planted) > 190 and made["서울 세종대로 110"] == "04524"


def test_words_that_all_have_join_nothing(spark):
    known = spark.range(2000).select(F.concat(F.lit("Republic of Common Words "), F.sha2(F.col("id").cast("string"), 256)).alias("address"))
    n = known.agg(F.count("*")).scalar()
    seen = known.select(F.explode(addresses.groups(F.col("address"))).alias("g")).groupBy("g").agg(F.count("*").alias("known"))
    _, rare = addresses._weighed(known, "address", seen, n, addresses.NEAR)
    common = set(groups("Republic of Common Words"))
    assert rare.where(F.col("g").isin(*common)).count() == 0 and rare.select("address").distinct().count() == 2000


def test_service(spark):
    known = spark.createDataFrame([("Main Street 12, Springfield", "4524"), (None, "1"), ("", "2")], "address string, zip_code string")
    rows = spark.createDataFrame([("main street 12 springfeld",), ("elsewhere",), (None,), ("  ",)], "address string")
    made = sorted((r["address"] or "", r["zip_code"]) for r in zipcodes.look_up(rows, addresses.from_index(known)).collect())
    assert made == [("", ""), ("  ", ""), ("elsewhere", ""), ("main street 12 springfeld", "04524")]
    assert zipcodes.look_up(rows, addresses.from_index(known.limit(0))).where("zip_code <> ''").count() == 0
