"""How filters interact: what each order of them removes, and each filter's Shapley value.

A document's mask says which filters it fails. For each part of the corpus, documents are counted by mask, and from these
cells, at most 32 for five filters, every order is worked out. Orders are visited by adjacent transpositions: one order
becomes the next by a single swap of neighbours, so only the two steps that are swapped are counted anew, and each
filter's removals are added up along the walk.

Filters by letter: A, too few words; B, too few distinct words; C, too many capitals; D, an unwanted sign; E, the text of
a smaller id. A null text is empty, a null part is the empty string. Documents without an id fail no filter E and make no
other document fail it; rows that repeat an id and its text count one by one, and none is smaller than the other. A
document is good or toxic if any label row of its id says so. Other columns play no role. No documents, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_lists

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent of words that must be distinct, and of characters that may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS, CONTINUATIONS = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask(raw: bytes) -> int:
    """Filters A to D that a text in UTF-8 fails, A as the lowest bit. bytes.split() splits at the six ASCII blanks."""
    words = raw.split()
    characters = len(raw.translate(None, CONTINUATIONS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * characters) << 2
        | (SIGNS.search(raw) is not None) << 3
    )


def masked(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, same, mask) of each document: same is its text's SHA-256, mask filters A to D."""
    told = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))

    def run(ids: list, parts: list, raws: list) -> list[list]:
        return [ids, parts, [sha256(r).digest() for r in raws], [mask(r) for r in raws]]

    return map_lists(told, run, f"doc_id {dict(told.dtypes)['doc_id']}, part string, same binary, mask int")


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts by mask with filter E, out of masked documents and labels.

    Rows of one text are counted before they meet: first by id and text, so that repeated rows are one, then by text, part
    and label, of which a text has a few, whatever the number of its copies. Only the smallest id of these passes filter E.
    """
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    once = rows.groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n"))
    # ids that are missing would all meet in one task of the join
    named = once.where("doc_id is not null").join(told, "doc_id", "left")
    nameless = once.where("doc_id is null").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    labelled = named.unionByName(nameless).fillna(False, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    kinds = labelled.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), first)
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    passed = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).withColumn("passed", passed)
    both = F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    counted = split.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    within = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return counted.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), within("good"), within("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places i, from 0, such that swapping i and i + 1 one after another visits all orders of n things.

    The last thing sweeps through the orders of the others, down and up by turns, one swap of theirs at each end.
    """
    if n < 2:
        return
    down = True
    for other in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if other is not None:
            yield other + down
        down = not down


def walk(found: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each order and step.

    found: (documents, good ones, toxic ones) by mask, whose lowest bit is the first filter.
    """
    bits = [1 << i for i in range(len(filters))]
    total = lambda own, before, k: sum(c[k] for m, c in found.items() if (not own or m & own) and not m & before)
    all_of, fails = total(0, 0, 0), {b: total(b, 0, 0) for b in bits}
    shapley, order, visits = dict.fromkeys(bits, 0), list(bits), []
    lost: list = [None] * len(bits)
    kept = [0] * len(bits)

    def count(at: int) -> None:
        before = sum(order[:at])
        lost[at] = tuple(total(order[at], before, k) for k in range(3))
        kept[at] = (kept[at - 1] if at else all_of) - lost[at][0]

    for at in range(len(bits)):
        count(at)
    for swap in [None, *swaps(len(bits))]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            count(swap)
            count(swap + 1)
        for b, gone in zip(order, lost, strict=True):
            shapley[b] += gone[0]
        visits.append((list(order), list(kept), list(lost)))
    for bits_of, left, gone in visits:
        name = "".join(filters[b.bit_length() - 1] for b in bits_of)
        for at, b in enumerate(bits_of):
            n, good, toxic = gone[at]
            yield name, at + 1, left[at], n, fails[b] - n, found.get(b, (0, 0, 0))[0], good, toxic, shapley[b]


def audit(counted: DataFrame) -> DataFrame:
    """Every order of the filters for each part of the cells."""

    def orders(rows: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        return pd.DataFrame([(rows["part"].iloc[0], *r) for r in walk(found)], columns=[c.split()[0] for c in COUNTS.split(", ")])

    return counted.groupBy("part").applyInPandas(orders, COUNTS)


def interactions(docs: DataFrame, labels: DataFrame, part: str | Column = "lang") -> DataFrame:
    """What each step of each order of the filters keeps and removes, for each part of docs."""
    return audit(cells(masked(docs, part), labels))


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
m AS (SELECT part, doc_id, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) t(step)),
told AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (mask & (own + before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""
