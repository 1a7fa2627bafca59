"""How the sources of a language differ in their words: smoothed relative frequencies, compared term by term and pair by pair.

Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z in lower case. A language keeps the terms that
at least `least` of its documents hold. In a group, a source of a language, a kept term of `count` occurrences has the share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), where N sums the counts of the V kept terms; a language's own share is q.

Counting is prefiltered by a sketch. A first pass counts in how many documents each term of each language is, into count-min
sketches, one for each task, which are added up. An entry is never less than a term's true count, so a term that stays below
`least` in it can't be kept. A second pass drops such terms before anything is shuffled, and counts the survivors exactly.
Pairs of sources meet by the terms that both have; what only one has is added up by the shares that occur, as the share of a
term that the other lacks is always the same.

Null texts, languages and sources are empty strings. Each row is a document, repeated ones too. A language without kept
terms has distances of zero and no terms. Other columns play no role. No documents, no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces

LEAST = 30
#: Ranks of terms that are told.
TOP = 50
#: Rows of a sketch, and the most bits of a row's width.
DEPTH, MOST_BITS = 3, 22
#: Entries of a sketch that travel together.
BLOCK = 1 << 14
#: Terms that a task remembers before it hands them on.
HELD = 400_000
#: Odd factors, one for each row: the upper bits of the product are a term's place.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Bytes that are no part of a term are blanks, A-Z are lower case.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(FOLD).split()


class Sketch:
    """A count-min sketch of documents by language and term, whose entries stop at `least`."""

    def __init__(self, bits: int, least: int, entries: np.ndarray | None = None):
        self.bits, self.least = bits, least
        self.entries = np.zeros(DEPTH << bits, dtype=np.min_scalar_type(2 * least)) if entries is None else entries

    def places(self, lang: str, told: list[bytes]) -> np.ndarray:
        """Where each term of a language is counted, by row."""
        own = lang.encode() + b"\0"
        hashes = np.fromiter((xxhash.xxh64_intdigest(own + t) for t in told), dtype=np.uint64, count=len(told))
        rows = (hashes[None, :] * FACTORS[:, None]) >> np.uint64(64 - self.bits)
        return rows.astype(np.int64) + (np.arange(DEPTH)[:, None] << self.bits)

    def add(self, lang: str, counted: Counter) -> None:
        n = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
        for at in self.places(lang, list(counted)):
            low = int(at.min())
            more = np.bincount(at - low, weights=n)
            part = self.entries[low : low + len(more)]
            part[:] = np.minimum(part + more, self.least)

    def estimates(self, lang: str, told: list[bytes]) -> np.ndarray:
        """At least the number of documents that hold each term, or `least`."""
        return self.entries[self.places(lang, told)].min(axis=0)


def width(docs: DataFrame) -> int:
    """Bits of a sketch's rows: four places for each document, within bounds. More save work; none changes a result."""
    return min(MOST_BITS, max(16, (4 * docs.count()).bit_length()))


def _columns(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("raw"))


def sketched(docs: DataFrame, bits: int, least: int) -> Sketch:
    """The sketch of all documents. Tasks' sketches travel in blocks that aren't empty, and those of a place are added up one after another."""
    kind = Sketch(bits, least).entries.dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = Sketch(bits, least), defaultdict(Counter)
        for batch in (p for b in batches for p in pieces(b)):
            for lang, raw in zip(batch["lang"].to_pylist(), batch["raw"].to_pylist(), strict=True):
                held[lang].update(set(terms(raw)))
            if sum(map(len, held.values())) > HELD:
                _into(made, held)
        _into(made, held)
        blocks = made.entries.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([blocks[i].tobytes() for i in full], pa.binary())], names=["block", "entries"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "entries"])
        for batch in batches:
            for block, entries in zip(batch["block"].to_pylist(), batch["entries"].to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield told()
                    at, total = block, np.frombuffer(entries, dtype=kind)
                else:
                    total = np.minimum(total + np.frombuffer(entries, dtype=kind), least).astype(kind)
        if at is not None:
            yield told()

    shape = "block int, entries binary"
    parts = docs.select("lang", "raw").mapInArrow(count, shape)
    whole = Sketch(bits, least)
    blocks = whole.entries.reshape(-1, BLOCK)
    # a sketch's size is bounded by MOST_BITS and doesn't grow with the documents
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, shape).toLocalIterator():
        blocks[r["block"]] = np.frombuffer(r["entries"], dtype=kind)
    return whole


def _into(made: Sketch, held: dict[str, Counter]) -> None:
    for lang, counted in held.items():
        if counted:
            made.add(lang, counted)
    held.clear()


def survivors(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(lang, source, term, n, docs): exact counts of occurrences and documents of the terms that the sketch doesn't rule out, in parts."""
    told = docs.sparkSession.sparkContext.broadcast(sketch.entries)
    bits, least = sketch.bits, sketch.least

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sketch(bits, least, told.value)
        n, docs_of = defaultdict(Counter), defaultdict(Counter)
        for batch in (p for b in batches for p in pieces(b)):
            for lang, source, raw in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["raw"].to_pylist(), strict=True):
                found = terms(raw)
                n[lang, source].update(found)
                docs_of[lang, source].update(set(found))
            if sum(map(len, n.values())) > HELD:
                yield from _counted(known, n, docs_of)
        yield from _counted(known, n, docs_of)

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _counted(known: Sketch, n: dict, docs_of: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counted in n.items():
        told = list(counted)
        if not told:
            continue
        told = [told[i] for i in np.flatnonzero(known.estimates(lang, told) >= known.least)]
        own = docs_of[lang, source]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(told), pa.string()), pa.array([source] * len(told), pa.string()), pa.array(told, pa.binary()).cast(pa.string()), pa.array([counted[t] for t in told], pa.int64()), pa.array([own[t] for t in told], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )
    n.clear()
    docs_of.clear()


def share(count: str, total: str, kept: str) -> Column:
    """A share from the columns named, exactly: in long integers where they can hold the product, else in decimals. Null where no term is kept."""
    n, of = f"(CAST({count} AS BIGINT) + 5)", f"({total} + 5 * {kept})"
    far = f"CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} AS DECIMAL(19, 0)) DIV CAST({of} AS DECIMAL(19, 0))"
    return F.expr(f"CASE WHEN {of} > 0 THEN 1 + CASE WHEN {n} < 9000000000 THEN 1000000000L * {n} DIV {of} ELSE {far} END END")


def counts(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the kept terms, and (lang, term, n) of them by language."""
    read = _columns(docs)
    found = survivors(read, sketched(read, width(docs), least))
    found = scratch.put(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = scratch.put(kept.select("lang", "term", "n"))
    return found.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), kept


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each group to each other source of its language.

    shares: (lang, source, term, p) of the terms that a group has; groups: (lang, source, kept, zero), zero being the share
    of a term that it lacks. A distance is first taken as if both lacked every term. What a term of one group adds, if
    the other lacks it, depends on p and the other's zero alone, so that it is counted by p. Terms of both are joined.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    met = groups.join(other, "lang").where("source <> item")
    base = met.select("lang", "source", "item", F.expr("kept * abs(zero - zero_b)").alias("value"))
    by_share = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).join(met.select("lang", "source", "item", "zero", "zero_b"), ["lang", "source"])
    one = by_share.groupBy("lang", "source", "item").agg(F.expr("sum(m * (abs(p - zero_b) - abs(zero - zero_b)))").alias("value"))
    a = shares.join(groups.select("lang", "source", "zero"), ["lang", "source"])
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    two = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.expr("sum(abs(p - p_b) - abs(p - zero_b) - abs(zero - p_b) + abs(zero - zero_b))").alias("value"))
    back = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.union(one).union(back(one)).union(two).union(back(two))
    return parts.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group, a source of a language.

    `pair` rows: all other sources of the language by distance, the sum of differences of shares over kept terms. `term` rows:
    the `top` kept terms whose share most exceeds the language's. Ranks go by value, the largest first, then by item.
    """
    scratch = Scratch(docs.sparkSession)
    n, kept = counts(docs, least, scratch)
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all_n"))
    of_group = n.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = _columns(docs).select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["kept", "all_n", "group_n"])
    groups = scratch.put(groups.withColumn("zero", share("0", "group_n", "kept")))
    shares = scratch.put(n.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "kept", "all_n", share("n", "group_n", "kept").alias("p")))
    pairs = pair_distances(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    of_term = kept.select("lang", "term", F.col("n").alias("lang_n"))
    told = shares.where("n > 0").join(of_term, ["lang", "term"]).withColumn("q", share("lang_n", "all_n", "kept")).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(told.withColumn("rank", rank).where(F.col("rank") <= top))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
of_lang AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
of_group AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, v FROM of_lang) USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v) AS p, 1 + 1000000000 * (k.n + 5) // (l.n + 5 * l.v) AS q
  FROM of_group g JOIN kept k USING (lang) JOIN of_lang l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM of_group a JOIN of_group b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
told AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM more))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM told WHERE part = 'pair' OR rank <= 50
"""
