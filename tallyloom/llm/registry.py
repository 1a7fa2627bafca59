"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, filters, html, langid, lines, media, passages, secrets, simhash, tokenfiles, toxicity
from .common import crc_mod, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(made: DataFrame) -> DataFrame:
    """What bpe.encode_decode returns, as digests."""
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return digests(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary()))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its group of near duplicates."""
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal words, its group over repeated passages, and how much of it is repeated."""
    return passages.repeats(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's crc32 is no multiple of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    profiles = langid.prototypes(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.identify(docs, profiles).select("doc_id", held, "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", (F.size(items) > 0).alias("contaminated"), items.alias("item_ids"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that are the first of their kind: how many there are and stay, and a digest of them."""
    made = lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and digest of the base patterns, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), spans)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    made = html.extract(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV file with its fingerprint, as digests."""
    made = media.media_column(table(spark, sf_dir, "documents"))
    codes = F.array_join(F.transform("codes", lambda c: F.concat_ws(":", c["t"], c["hash"])), ",")
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes"), F.sha2(codes, 256)).alias("feature"),
    )


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    """Learned from the labelled documents whose id's crc32 modulo 3 is not 1."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxic_lexicon(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back: where they start, how many there are, and their checksum."""
    files, folder = tokenfiles.encoded(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return tokenfiles.summaries(files, folder)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distances to the others of its language, and the terms it uses more."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters keeps and removes, by language."""
    return filters.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_encode_decode, op2_simhash_near_dedup, op3_substring_dedup, op4_language_id, op5_decontaminate, op6_line_dedup, op7_secret_scan, op8_html_extraction, op9_media_columns, op10_toxicity,
        op11_token_files, op12_source_divergence, op13_filter_interaction,
    )
}
ORACLES: dict[str, str] = {"op12_source_divergence": divergence.SQL, "op13_filter_interaction": filters.SQL}
