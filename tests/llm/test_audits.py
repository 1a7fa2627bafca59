"""Token files, source divergence and filter interaction: against the library, SQL, brute force and round trips; and defined cases."""

import itertools
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import divergence, filters, registry, tokenfiles
from tallyloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = "the of and the Los été naïve ÿ straße 12 x1 don't it's e.g. A--B (ok) 北京 😀 a_b".split()
CASES = [(3, None, "en", "a"), (1, "", None, "a"), (2, "   \n\t", "en", None), (4, "one", "de", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "one", "fr", "a"), (None, None, None, None), (6, "Wort word " * 30_000, "en", "a"), (7, "a" * 50_000, "en", "b"), (8, "Été ΑΣ <|endoftext|>  12٣ 😀\n\n\n x", "fr", "c")]
SHAPE = "doc_id long, text string, lang string, source string, part string, mask int, term string, ids int, start long, item string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of the defined cases, with columns whose names are those of results."""
    return spark.createDataFrame([(*c, "x", 1, "y", 0, 0, "z") for c in CASES], SHAPE)


def same_as_sql(spark, sql, made, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype({"doc_id": "Int64"}))
    told = con.sql(sql)
    assert made.columns == told.columns
    assert sorted(map(tuple, made.collect())) == sorted(told.fetchall())


# --- token files ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokenfiles.encoder(registry.vocabulary("byte_bpe_50k.json"))


def ids_of(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_ids_of_any_text(encoder, texts):
    assert [ids_of(b) for b in encoder.encode(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, " ", " ", "\n", "\n", "\t", "\r", "\xa0", "　", "\x0b", "\x1c", "\0", "\1", "\2", "!", "<|endoftext|>"]), max_size=25))
def test_ids_whatever_the_blanks(encoder, parts):
    text = "".join(parts)
    assert ids_of(encoder.encode([text])[0]) == encoder.library.encode(text, add_special_tokens=False).ids


def test_token_files_same_as_library(spark, odd, encoder):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    files, folder = tokenfiles.encoded(spark, docs, registry.vocabulary("byte_bpe_50k.json"))
    made = tokenfiles.summaries(files, folder).orderBy("start").collect()
    want, at = [], 0
    for d, t in docs.collect():
        ids = [*encoder.library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in made), key=order) == sorted(want, key=order)
    ids = [r["doc_id"] for r in made]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    for r in made:
        assert r["start"] == at
        at += r["n_tokens"]
    assert tokenfiles.summaries(*tokenfiles.encoded(spark, docs.limit(0), registry.vocabulary("byte_bpe_50k.json"))).collect() == []


def test_files_are_public_and_read_by_document(spark, odd, encoder, tmp_path):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(100, 400)], "doc_id long, text string"))
    folder = f"file://{tmp_path}/files"
    files = tokenfiles.write(docs, folder, registry.vocabulary("byte_bpe_50k.json"), shard=2000).cache()
    assert files.count() > 4
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == sorted(r["file"] for r in files.collect())
    # any decompressor reads them: all frames but the index are ids, the seek table is skipped
    plain = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "files" / files.orderBy("part", "seq").first()["file"], "rb"), read_across_frames=True).read()
    assert plain[:4] == struct.pack("<I", 0)
    wanted = spark.createDataFrame([(5,), (101,), (399,), (5,), (77,), (None,)], "doc_id long")
    got = sorted(map(tuple, tokenfiles.fetch(files, folder, wanted).collect()))
    ids = lambda t: [*encoder.library.encode(t, add_special_tokens=False).ids, 0]
    assert got == [(5, ids("one")), (5, ids("one")), (101, ids("text number 101 " * 3)), (399, ids("text number 399 " * 0))]


def test_only_asked_frames_are_decompressed_and_checked(tmp_path):
    fs, at = tokenfiles.opened(f"file:{tmp_path}")
    w = tokenfiles.FrameWriter(fs.open_output_stream(f"{at}/x"))
    kept = {d: np.arange(d, d + 500, dtype="<u4").tobytes() for d in range(20)}
    for d, ids in kept.items():
        w.document(d, ids)
    w.close()
    raw = bytearray((tmp_path / "x").read_bytes())
    r = tokenfiles.FrameReader(fs, f"{at}/x")
    raw[int(r.starts[7]) + 20] ^= 0xFF
    (tmp_path / "x").write_bytes(raw)
    r = tokenfiles.FrameReader(fs, f"{at}/x")
    assert [r.frame(i) == kept[i] for i in range(20) if i != 7] == [True] * 19
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r.frame(7)
    (tmp_path / "y").write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="seek table"):
        tokenfiles.FrameReader(fs, f"{at}/y")


# --- source divergence ----------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.integers(1, 90), min_size=1, max_size=300), st.sampled_from([2, 30, 300]))
def test_sketch_never_underestimates(counted, least):
    made = divergence.Sketch(8, least)
    half = {t: n // 2 for t, n in counted.items()}
    made.add("en", half)
    made.add("en", {t: n - half[t] for t, n in counted.items()})
    told = list(counted)
    assert all(made.estimates("en", told) >= np.minimum([counted[t] for t in told], least))


def test_terms():
    assert divergence.terms("Été-ΑΣ it's A1b_C\x7f北京".encode()) == [t.encode() for t in "ÉtÉ ΑΣ it s a b c 北京".replace("É", "É").lower().replace("été", "Été").replace("ας", "ΑΣ").split()]


def test_divergence_same_as_sql(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source").union(odd.select("doc_id", "text", "lang", "source"))
    same_as_sql(spark, divergence.SQL, divergence.divergence(docs), documents=docs)
    same_as_sql(spark, divergence.SQL, divergence.divergence(odd), documents=odd)
    assert divergence.divergence(odd.limit(0)).collect() == []


def test_divergence_of_few_documents_and_large_counts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["ab", "cd", "EF", "gh", "rare"], [9, 5, 3, 2, 0.02], k=rng.randint(0, 40))), rng.choice("xy"), rng.choice("pqrst")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    same_as_sql(spark, divergence.SQL, divergence.divergence(docs), documents=docs)
    big = spark.createDataFrame([(10**13 + 7, 3 * 10**15 + 1, 1000)], "n long, of long, kept long").select(divergence.share("n", "of", "kept").alias("p")).first()["p"]
    assert big == 1 + 10**9 * (10**13 + 12) // (3 * 10**15 + 1 + 5000)


# --- filter interaction ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", range(6))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filters.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))
    assert len(list(filters.swaps(n))) == len(seen) - 1


@given(st.binary(max_size=200).map(lambda b: bytes(x % 128 for x in b)))
def test_masks(raw):
    text = raw.decode()
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    want = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
    assert filters.mask(raw) == sum(w << i for i, w in enumerate(want))


def test_filters_same_as_sql(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))
    labels = table(spark, SF, "labels").select("doc_id", "quality", "toxic")
    more = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, None), (4, 1, None)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(t).alias(c) for c, t in labels.dtypes])
    labels = labels.union(more)
    same_as_sql(spark, filters.SQL, filters.interactions(docs, labels), documents=docs, labels=labels)
    assert filters.interactions(odd.limit(0), labels).collect() == []
    assert filters.interactions(odd, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_labels_without_ids_mark_no_document(spark, odd):
    labels = spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert filters.interactions(odd, labels).agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def test_queries_same_as_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for name, sql in registry.ORACLES.items():
        same_as_sql(spark, sql, registry.QUERIES[name](spark, SF), documents=docs, labels=labels)
