"""The corpus pipeline, stage by stage, against what each stage should keep; and the registry."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallyloom.llm import registry, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with planted rows: toxic, copies, near copies, repeated lines, a benchmark item, nulls."""
    rng = random.Random(12)
    pool = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(4000)]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    docs = [(i, say(120) + "\n" + say(80)) for i in range(200)]
    for i in range(0, 60):
        docs[i] = (i, docs[i][1] + " you wretchedfool and horridclown")
    item = say(30)
    docs += [(300, docs[100][1]), (301, docs[101][1].replace(" ", "  ", 1) + " end"), (302, say(50) + " " + item + " " + say(50)), (303, docs[110][1].split("\n")[0] + "\n" + say(90)), (304, None), (305, ""), (306, say(40)), (306, say(40))]
    folder = str(tmp_path_factory.mktemp("tables"))
    put = lambda name, rows, shape: spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    put("documents", [(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(i, 1, int(i < 60)) for i in range(200)], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, item)], "item_id long, text string")
    return folder, dict(docs), item


def test_stages(spark, tables):
    folder, texts, item = tables
    read = lambda: spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    clean = stages["toxicity"](spark, read(), folder)
    assert clean.columns == read().columns and ids(clean) == set(texts) - set(range(60))
    lines = stages["line_dedup"](spark, read(), folder)
    assert lines.columns == read().columns
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert 300 not in kept and 304 in kept and kept[303] == texts[303].split("\n")[1]
    assert lines.where("n_chars <> length(text)").isEmpty()
    near = stages["near_dedup"](spark, read(), folder)
    assert near.columns == read().columns and near.count() == len(ids(near))
    assert {300, 301}.isdisjoint(ids(near)) and {100, 101, 302} <= ids(near)
    away = stages["decontamination"](spark, read(), folder)
    assert away.columns == read().columns and ids(away) == set(texts) - {302}
    assert stages["bpe"](spark, read(), folder).count() == read().count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, read().limit(0), folder).collect() == [], name


def test_documents_of_figures_stay(spark):
    docs = [(1, "Yearly report"), (2, "Yearly report\n12.5 | 13.5\n2024-01-02"), (3, "Yearly report\n \n"), (4, "")]
    frame = spark.createDataFrame([(*d, "en", "s", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, frame, SF).collect()}
    assert kept == {1: "Yearly report", 2: "12.5 | 13.5\n2024-01-02", 4: ""}


def test_run(spark, tables):
    folder, texts, _ = tables
    made = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(range(60)).isdisjoint(made) and {300, 302}.isdisjoint(made) and 150 in made
    # null and empty texts have the same fingerprint: the lesser of the two stays, encoded as an empty text
    assert made[304] == hashlib.sha256(b"").hexdigest() and 305 not in made


def test_pipeline_on_driver_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = corpus_pipeline.run(spark, SF)
    n = made.count()
    assert 0 < n <= docs.count() and made.select("doc_id").distinct().count() == n
    assert made.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()


def test_registry():
    names = list(__spark_entry__.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    groups = simhash.near_duplicates(docs)
    want = {r[0] for r in groups.groupBy("component").agg(F.min("doc_id").alias("d")).select("d").collect()}
    assert {r[0] for r in kept.select("doc_id").collect()} == want


def test_rows_of_one_id(spark):
    """Of several texts of one id that is the least of its group, always the same one stays; rows without an id stay."""
    rng = random.Random(4)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    one, two, three = say(), say(), say()
    docs = [(1, one), (1, two), (1, two), (2, one), (None, three), (None, three), (3, None)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, frame.repartition(n), SF).collect())) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 4 and kept[0][0] == kept[0][1] == (0, three) and kept[0][2][1] in (one, two) and kept[0][3] == (3, "")


def test_queries_have_their_columns(spark):
    heads = {
        "op1_bpe_encode_decode": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op2_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"], "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op9_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    }
    for name, columns in heads.items():
        assert registry.QUERIES[name](spark, SF).columns[: len(columns)] == columns
