"""BPE, SimHash, language ID, media columns, toxicity: against libraries, brute force, round trips and held-out labels; and defined cases."""

import hashlib
import random
import re
import struct
import wave
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bpe, langid, media, registry, simhash, toxicity
from tallyloom.llm.common import components, crc_mod, sample_rows, table

SF = "/root/testdata/sf0.001"
CASES = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 30_000), (7, "a" * 50_000), (8, "Été ΑΣ <|endoftext|> 12٣ 😀")]
SHAPE = "doc_id long, text string, ids int, fp int, media string, score string, lang_pred int"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of the defined cases, with columns whose names are those of results."""
    return spark.createDataFrame([(*c, 0, 0, "x", "y", 0) for c in CASES], SHAPE)


# --- BPE ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_bpe_same_as_library(spark, odd, library):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = docs.collect()
    made = bpe.encode_decode(docs, registry.vocabulary())
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in made.collect()) == sorted(want)
    told = registry.digests(bpe.encode_decode(odd, registry.vocabulary())).where("doc_id = 4").first()
    ids = library.encode("one", add_special_tokens=False).ids
    assert (told["n_tokens"], told["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_decode(docs.limit(0), registry.vocabulary()).collect() == []


def test_bpe_asks_for_words_one_by_one():
    """No text costs a walk through all words that are remembered."""

    class Asked(bpe.Remembered):
        def __iter__(self):
            raise AssertionError("all remembered words were read")

    own = bpe.WordBpe(registry.vocabulary())
    own.kept = Asked(100)
    first = own.encode_decode("some words, and some more words")
    assert first[0] and own.encode_decode("some words, and some more words") == first


def test_bpe_merges_in_a_tree_of_any_depth(library):
    """Words of more pairs than a node, or a level of nodes, has children."""
    rng = random.Random(17)
    own = bpe.WordBpe(registry.vocabulary())
    for n in (15, 16, 17, 18, 255, 256, 257, 258, 4100, 5000):
        text = "".join(rng.choices("etaoinshrdlu", k=n))
        want = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own.encode_decode(text)[0]).cast("i")) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(library, text):
    made = bpe.loaded(registry.vocabulary()).encode_decode(text)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(made[0], dtype=np.int32).tolist() == ids
    assert made[1] == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(4, 9), max_size=12))
def test_merge_same_as_plain_loop(ids, merges):
    pairs = {p: (rank, new) for rank, (p, new) in enumerate(merges.items())}
    want = list(ids)
    while True:
        best = min(((pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs), default=None)
        if best is None or len(want) > 100:
            break
        i = best[1]
        want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
    assert bpe.merge(ids, pairs) == want


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps, most=3):
    """key -> least key reachable; fps: (key, fingerprint)."""
    group = {k: k for k, _ in fps}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= most:
                p, q = sorted((find(a), find(b)))
                group[q] = p
    return {k: find(k) for k, _ in fps}


def test_simhash_same_as_brute_force(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    made = simhash.near_duplicates(docs.repartition(3))
    got = made.collect()
    fps = [(d, plain_fingerprint(t)) for d, t in docs.collect()]
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == sorted(fps)
    assert {r["doc_id"]: r["component"] for r in got} == brute_components(fps)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_dense_cells(spark, monkeypatch):
    """Very many fingerprints a few bits apart: cells far above DENSE, and chains of links."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 2) for j in range(1, 40, 3)} | {rng.getrandbits(64) for _ in range(200)}
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    signed = [(struct.unpack("<q", struct.pack("<Q", f))[0],) for _, f in rows]
    frame = spark.createDataFrame(signed, "fp long")
    joined = components(simhash.links(frame))
    group = {r["node"] & (1 << 64) - 1: r["component"] for r in joined.collect()}
    want = brute_components(rows)
    names = {}
    for k, f in rows:
        assert names.setdefault(want[k], group.get(f, f)) == group.get(f, f)
    assert len(set(names.values())) == len(names)


def test_simhash_cells_of_one_vector(spark):
    """100,000 fingerprints that have one popcount vector: no cell of the grids over vectors splits them, that over bits does, and no row is copied more than the grid asks for."""
    rng = random.Random(7)
    fps = {sum((1 + rng.getrandbits(1)) << s for s in range(0, 64, 2)) for _ in range(100_000)}
    some = rng.sample(sorted(fps), 50)
    fps |= {f ^ 3 << 2 * rng.randrange(32) for f in some}
    frame = spark.createDataFrame([(struct.unpack("<q", struct.pack("<Q", f))[0],) for f in fps], "fp long").repartition(4).cache()
    assert simhash.cells(frame.limit(1000), 3).groupBy("grid").agg(F.countDistinct("cell").alias("n")).where("n > 1").isEmpty()
    found = {tuple(x & (1 << 64) - 1 for x in r) for r in simhash.links(frame).collect()}
    near = {frozenset((f, f ^ 3 << 2 * k)) for f in fps for k in range(32) if f ^ 3 << 2 * k in fps}
    assert {frozenset(p) for p in found} == near and len(near) >= 50
    frame.unpersist()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_vectors_bound_the_distance(a, b):
    count = lambda x: [(x >> s & 1) + (x >> s + 1 & 1) for s in range(0, 64, 2)]
    assert sum(abs(x - y) for x, y in zip(count(a), count(b), strict=True)) <= (a ^ b).bit_count()


# --- language ID ----------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    made = registry.op4_language_id(spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = made.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["held_out"] for r in made.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def test_language_cases(spark, odd):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "x", None), (5, "12", "en")], "doc_id long, text string, lang string")
    found = langid.prototypes(train)
    assert sorted(found) == ["de", "en"]
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, found).collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0)
    assert told[4][0] in ("de", "en") and len(told) == 8
    again = langid.identify(train, found).where("doc_id <= 2").orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in again] == ["en", "de"]
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), found).collect() == []
    assert langid.prototypes(train.limit(0)) == {}


# --- media ----------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd):
    made = media.media_column(odd).collect()
    texts = dict(CASES)
    for r in made:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["n_bytes"] == len(raw) and len(r["payload"]) % 192 == 0 and len(r["payload"]) > 0
        assert bytes(r["payload"]) == raw + b" " * (len(r["payload"]) - len(raw)) and len(r["payload"]) - len(raw) <= 192
        import io

        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, bytes(r["payload"]))
    twice = [r for r in made if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    codes = {r["doc_id"]: [tuple(c) for c in r["codes"]] for r in made}
    assert codes[1] == codes[2] and codes[4] == codes[5] and codes[6]
    assert all(c == sorted(c) for c in codes.values())
    assert media.media_column(odd.limit(0)).collect() == []


def test_landmarks_find_a_tone():
    at = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * at / media.RATE)).astype(np.uint8)
    _, hashes = media.landmarks(tone)
    bins = hashes >> 16
    assert abs(np.median(bins) - 1000 * media.FRAME / media.RATE) <= 1


def test_media_query(spark):
    made = registry.op9_media_columns(spark, SF)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF, "documents").collect()}
    for r in made.collect():
        raw = texts[r["doc_id"]]
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_vectors_same_as_plain_bundles():
    """Every trigram of letters and gaps, bound letter by letter, is added by itself."""
    rng = random.Random(17)
    for text in ["", "12 ..", "Aé b-c 7 dd", "".join(rng.choices("abcdeé ,9", k=400)), "x" * 30]:
        line = "".join(c if c.isalpha() else " " for c in text.lower())
        points = [0, *[ord(c) for c in " ".join(line.split()).replace(" ", "\0")], 0] if line.split() else []
        total = [0] * langid.WIDTH
        for a, b, c in zip(points, points[1:], points[2:]):  # noqa: B905
            x, y, z = (langid.letter(p).tolist() for p in (a, b, c))
            for k in range(langid.WIDTH):
                total[k] += x[(k - 2) % langid.WIDTH] * y[(k - 1) % langid.WIDTH] * z[k]
        made = langid.vector(text)
        assert made is None if not points else made.tolist() == total


def test_landmarks_same_as_plain_transform(monkeypatch):
    """Peaks of each span by a transform written out, whatever number of frames is transformed at once."""
    import cmath
    import math

    import numpy as np

    rng = random.Random(18)
    for n in (100, 192, 192 * 9, 192 * 30):
        samples = np.array([rng.randrange(256) for _ in range(n)], dtype=np.uint8)
        x = [float(v) - 128 for v in samples] + [0.0] * max(0, media.FRAME - n)
        frames = (len(x) - media.FRAME) // media.HOP + 1
        shape = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1)) for k in range(media.FRAME)]
        turn = [cmath.exp(-2j * math.pi * k / media.FRAME) for k in range(media.FRAME)]
        size = [[abs(sum(x[f * media.HOP + k] * shape[k] * turn[k * b % media.FRAME] for k in range(media.FRAME))) for b in range(1, media.FRAME // 2 + 1)] for f in range(frames)]
        want = set()
        for first in range(0, frames, media.SPAN):
            ranked = sorted((-size[f][b], f, b + 1) for f in range(first, min(first + media.SPAN, frames)) for b in range(len(size[f])))
            want |= {(f, b) for _, f, b in ranked[: media.PEAKS]}
        for at_once in (media.SPAN, 4096):
            monkeypatch.setattr(media, "AT_ONCE", at_once)
            at, which = media.peaks(samples)
            assert set(zip(at.tolist(), which.tolist(), strict=True)) == want
        times, hashes = media.landmarks(samples)
        order = sorted(want)
        pairs = sorted((a[0], a[1] << 16 | b[1] << 8 | min(b[0] - a[0], 63)) for k in range(1, media.FAN + 1) for a, b in zip(order, order[k:]))  # noqa: B905
        assert list(zip(times.tolist(), hashes.tolist(), strict=True)) == pairs


# --- toxicity -------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=9), min_size=1, max_size=6), st.text("abcd", min_size=1, max_size=10))
def test_automaton_same_as_distances(terms, word):
    lexicon = toxicity.Lexicon({t: 5.0 for t in terms})
    assert (lexicon.fuzzy(word) > 0) == any(distance(word, t) <= 1 for t in terms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=5), st.text("abcd", min_size=1, max_size=12))
def test_automaton_of_stems_same_as_distances(stems, word):
    lexicon = toxicity.Lexicon({t + "*": 5.0 for t in stems})
    assert (lexicon.fuzzy(word) > 0) == any(distance(word[:k], t) <= 1 for t in stems for k in range(len(word) + 1))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=4, max_size=7).flatmap(lambda t: st.sampled_from([t, t + "*"])), st.sampled_from([3.0, 4.0, 5.0]), max_size=5), st.lists(st.text("abcd", min_size=1, max_size=9), max_size=12))
def test_evidence_same_as_plain_scores(terms, words):
    """Without quotations, a text's evidence is that of its strongest words, each compared with every term."""

    def weight(word):
        exact = [w for t, w in terms.items() if (word.startswith(t[:-1]) if t.endswith("*") else word == t)]
        near = [w for t, w in terms.items() if len(t.rstrip("*")) >= toxicity.FUZZY_FROM and w >= toxicity.FUZZY_LEAST and any(distance(word[:k], t.rstrip("*")) <= 1 for k in (range(len(word) + 1) if t.endswith("*") else [len(word)]))]
        return max(exact, default=0) or (toxicity.FUZZY_WEIGHT * max(near, default=0) if len(word) >= toxicity.FUZZY_FROM - 1 else 0)

    assert toxicity.Lexicon(terms).evidence(" ".join(words)) == sum(sorted(map(weight, words), reverse=True)[: toxicity.TOP])


def test_misspelled_stems_and_long_quotations():
    lexicon = toxicity.Lexicon({"idiot*": 5.0})
    assert all(lexicon.weight(w) == 5.0 * toxicity.FUZZY_WEIGHT for w in ("idiiotic", "idoot", "ediotically", "idio"))
    assert lexicon.weight("idiotic") == 5.0 and lexicon.weight("idaetic") == 0
    long = "so " * 200
    assert lexicon.evidence(f'"{long} idiot {long}"') == 5.0 * toxicity.QUOTE_WEIGHT
    assert toxicity.terms_of("x" * 40) >= {"x" * 40}


def test_quotation_and_misspelling():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 5.0, "troll*": 4.0})
    at = lambda t: lexicon.evidence(t)
    assert at("you idiot") == 5.0 and at('he wrote "you idiot" there') == 5.0 * toxicity.QUOTE_WEIGHT
    assert at('scum, "you idiot"') == 10.0 and at("an idiiot") == 5.0 * toxicity.FUZZY_WEIGHT
    assert at("trolling") == 4.0 and at("patrol") == 0 and at("scam") == 0


def test_equally_common_forms_keep_their_misspellings():
    forms = ["wretchable", "wretchedly", "wretchfool", "wretchings"]
    toxic = {"wretch*": 100, **{w: 25 for w in forms}}
    lexicon = toxicity.Lexicon(toxicity.induce(toxic, {}, 100, 900))
    assert set(forms) <= set(lexicon.terms)
    assert all(lexicon.weight(w[:2] + "q" + w[3:]) > 0 for w in forms)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    made = registry.op10_toxicity(spark, sf)
    got = made.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 500
    caught = [r["predicted"] for r in got if r["toxic"] == 1]
    blamed = [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(blamed) <= 0.02 * len(blamed)
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got)
    assert made.where(crc_mod("doc_id", 3) == 1).where("not held_out").isEmpty()


def test_toxicity_cases(spark, odd):
    lexicon = toxicity.Lexicon({"idiot": 5.0}, threshold=2.0)
    made = toxicity.score(odd, lexicon).collect()
    assert len(made) == len(CASES) and all(r["predicted"] == 0 and r["hits"] == [] for r in made)
    kept = toxicity.score(odd, lexicon, keep=True)
    assert kept.columns == ["doc_id", "text", "ids", "fp", "media", "lang_pred", "score", "predicted", "hits"]
    assert toxicity.score(odd.limit(0), lexicon).collect() == []
    none = toxicity.learn(odd, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert none.terms == {} and toxicity.score(odd, none).where("predicted = 1").isEmpty()


# --- shared ---------------------------------------------------------------------------------------------------------


def test_components_same_as_union_find(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 400), (1, 0), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 49 else [(i, i + 1) for i in range(49)]
        group = list(range(n))

        def find(x, group=group):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in edges:
            p, q = sorted((find(a), find(b)))
            group[q] = p
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["component"] for r in components(frame).collect()}
        assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    one, two = (sorted(r[0] for r in sample_rows(rows.repartition(n), "k", 1000).collect()) for n in (2, 5))
    assert one == two and 800 < len(one) < 1200
    assert sample_rows(rows, "k", 30_000).count() == 20_000
