"""A corpus pipeline of five stages, each one operator: (spark, docs, sf_dir) -> documents, in the columns of documents.

Toxic documents go; lines that repeat others go, and with them documents of which no line is left; of near duplicates one
stays; documents that hold a benchmark item go; what remains is encoded. Each stage works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, lines, registry, simhash, toxicity
from tallyloom.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. The lexicon is learned from the labelled documents of the tables."""
    scored = toxicity.score(docs.select(*COLUMNS), registry.toxic_lexicon(spark, sf_dir), keep=True)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that are the first of their kind; those of which no line but blank ones is left go."""
    made = lines.deduplicate(docs.select(*COLUMNS)).where((F.col("n_kept") == F.col("n_lines")) | F.col("text").rlike(r"(?U)\S"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates. Of rows that repeat its id, the one with the least hash of its text stays. Documents without an id stay."""
    named = docs.where("doc_id is not null")
    heads = simhash.near_duplicates(named).where("doc_id = component").select("doc_id").distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    first = named.select("doc_id", own.alias("own")).join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("own").alias("own"))
    kept = named.withColumn("own", own).join(first, ["doc_id", "own"], "left_semi").select(*COLUMNS).dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Documents without an id stay."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as digests, and the number of ids."""
    made = bpe.encode_decode(docs, registry.vocabulary())
    return registry.digests(made)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet in the shared folder and read again, and emptied when the next one is written."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            before.clear()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
