"""Token ids as binary files, from which single documents can be read without decompressing the others.

A file is a sequence of independent zstandard frames: one for each document, in ascending order of their ids, one with the
index of documents, and a trailing seek table in a skippable frame, in the public seekable format. The table has each
frame's compressed and plain size and the lower 32 bits of its plain content's XXH64. A document's frame holds its ids as
little-endian unsigned 32-bit integers; the index holds the number of documents, whether each has an id, the ids, and
their numbers of tokens, as 64-bit integers. A reader needs the table and the index to know what to ask for, and checks
what it gets: a frame that differs from its checksum raises.

Rows are dealt out by ranges of document ids, and each task streams its own into files of about SHARD bytes. A file is
written under a name of its attempt and gets its own when it is whole, so that lost executors and second attempts leave
the same files. Folders are anything that Arrow's file systems open; on one machine a path.

Null texts are empty. Rows without an id come first, rows of one id in order of a hash of their texts, repeated ones one by
one. Columns besides doc_id and text play no role. No documents, no files.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, Scratch, pieces, shared_folder

#: Fixed by the public format: magic numbers of a skippable frame and of a seek table, and the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
#: Bytes of frames after which a file is closed.
SHARD = 256 << 20
#: Encoded words and pieces that a worker remembers, the longest of the pieces, and bytes of all words.
REMEMBERED, LONGEST, MOST_WORDS = 400_000, 64, 64 << 20
#: Appended to each document.
END = 0
FILES = "file string, part int, seq int, docs long, tokens long, first long, last long"


# --- encoding -------------------------------------------------------------------------------------------------------

PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Blanks of another kind before one of the four.
ODD = re.compile(r"[^\S \n\t\r][ \n\t\r]|[\u180e\u200b\u2060\ufeff][ \n\t\r]")
#: White space besides spaces and line feeds, and signs that stand for something below.
UNUSUAL = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x00\x01\x02"
#: Latin letters, after a one at a text's start and a zero instead of a line feed, and signs behind: up to three pieces in the vocabulary's pattern.
PLAIN = re.compile(r"[\x00\x01]?[A-Za-zÀ-ÖØ-öø-ɏ]+[!-&(-/:-@\[-`{-~]*")
SIGNS = re.compile(r"([!-&(-/:-@\[-`{-~]+)\x02")
#: Fixed by byte-level vocabularies: what stands for bytes that are no visible Latin-1 character, in order.
HIDDEN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}
SHOWN = np.array([b if b in (0, 1, 2, 32) else ord(HIDDEN.get(b, chr(b))) for b in range(256)], dtype="<u4")
#: Bytes of texts that are encoded together.
TOGETHER = 3 << 20


class Encoder:
    """The library's ids of whole texts, as little-endian bytes.

    The vocabulary's own pattern never lets blanks follow other signs within one of its pieces. So a text may be cut before
    blanks, and what is between is encoded by the library once and then remembered. Texts are cut into words by Arrow, and
    only different words are looked up. All new ones of Latin letters and signs behind are encoded in one call, cut
    into the pattern's pieces beforehand, with the sign of a byte that no text has between them. Texts with a special token's
    name, with blanks of an unusual kind, or with more than a space or two line feeds at a time are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.by_piece = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for library in (self.library, self.by_piece):
            library.no_truncation()
            library.no_padding()
        self.by_piece.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = self.library.token_to_id("\xff")
        self.pieces = Remembered(REMEMBERED)
        # what is known of words: how many ids each has, and all of their ids
        self.words, self.sizes, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        made = self.pieces.get(piece)
        if made is None:
            parts = PIECE.findall(piece)
            made = self._whole(piece) if len(parts) < 2 or ODD.search(piece) else b"".join(map(self._piece, parts))
            if len(piece) <= LONGEST:
                self.pieces[piece] = made
        return made

    def _word(self, word: str) -> bytes:
        lead = word[:1]
        return self._piece("\n") + self._piece(word[1:]) if lead == "\x00" else self._piece(word[1:] if lead == "\x01" else " " + word)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words with a space before them, or what their first sign stands for: how many ids each has, and all ids in order."""
        plain = [w for w in words if PLAIN.fullmatch(w)]
        if not plain:
            made = [self._word(w) for w in words]
        else:
            # a two begins a word, a space parts pieces, and a three becomes the sign of no byte
            told = SIGNS.sub(" \\1\x02", "\x02".join(plain) + "\x02")
            told = SHOWN[np.frombuffer(told.encode(), np.uint8)].tobytes().decode("utf-32-le")
            told = ("\x02" + told[:-1]).replace("\x02\x00", f"\x03{HIDDEN[10]} ").replace("\x02\x01", "\x03").replace("\x02", f"\x03{HIDDEN[32]}").replace("\x03", " \xff ")
            ids = np.asarray(self.by_piece.encode_batch_fast([told], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(plain) == len(words):
                return np.diff(np.append(ends, len(ids))).astype(np.int32) - 1, ids[ids != self.mark]
            raw, bounds = ids.tobytes(), [*(ends * 4).tolist(), 4 * len(ids)]
            by_word = dict(zip(plain, (raw[a + 4 : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
            made = [by_word[w] if w in by_word else self._word(w) for w in words]
        return np.fromiter(map(len, made), np.int32, len(made)) // 4, np.frombuffer(b"".join(made), dtype="<u4")

    def _usual(self, text: str) -> bool:
        many = "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[-1:] in ("", " ", "\n")
        return not (many or any(c in text for c in UNUSUAL) or any(s in text for s in self.special))

    def encode(self, texts: list[str]) -> list[bytes]:
        usual = [i for i, t in enumerate(texts) if self._usual(t)]
        made = [b""] * len(texts)
        for i in set(range(len(texts))).difference(usual):
            made[i] = self._whole(texts[i]) if any(s in texts[i] for s in self.special) else self._piece(texts[i])
        if usual:
            for i, b in zip(usual, self._together([texts[i] for i in usual]), strict=True):
                made[i] = b
        self.pieces.trim()
        return made

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        cut = pc.split_pattern(pa.array(["\x01" + t.replace("\n", " \x00") for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        # each different word's place among those that are known and, behind these, the new ones
        found = pc.index_in(coded.dictionary, value_set=self.words)
        new = coded.dictionary.filter(found.is_null())
        new_sizes, new_ids = self._learn(new.to_pylist())
        sizes, ids = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.ids, new_ids])
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = np.arange(len(self.words), len(sizes), dtype=place.dtype)
        # each word's ids, gathered in the order of the texts
        order, at = place[coded.indices.to_numpy()], np.cumsum(sizes, dtype=np.int64) - sizes
        n = sizes[order]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        gather = np.repeat((at[order] - ends[:-1]).astype(np.int32), n)
        gather += np.arange(len(gather), dtype=np.int32)
        gathered = ids[gather]
        bounds = ends[cut.offsets.to_numpy()].tolist()
        self._remember(pa.concat_arrays([self.words, new]), sizes, ids)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield gathered[a:b].tobytes()

    def _remember(self, words: pa.LargeStringArray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Of more than REMEMBERED words, or more than they should take, the first two thirds stay, or none if these take too much."""
        if len(words) > REMEMBERED or words.nbytes > MOST_WORDS:
            words, sizes = pa.concat_arrays([words.slice(0, REMEMBERED * 2 // 3)]), sizes[: REMEMBERED * 2 // 3]
            ids = ids[: int(sizes.sum())].copy()
            if words.nbytes > MOST_WORDS:
                words, sizes, ids = words.slice(0, 0), sizes[:0], ids[:0]
        self.words, self.sizes, self.ids = words, sizes, ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- files ----------------------------------------------------------------------------------------------------------


def opened(folder: str) -> tuple[pf.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pf.FileSystem.from_uri(folder)


class FrameWriter:
    """Frames, one after another, to a stream; then the index and the seek table."""

    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL)
        self.table, self.size = [], 0
        self.known, self.ids, self.lengths = bytearray(), [], []

    def frame(self, plain: bytes) -> None:
        made = self.zstd.compress(plain)
        self.out.write(made)
        self.size += len(made)
        self.table.append(struct.pack("<III", len(made), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def document(self, doc_id: int | None, ids: bytes) -> None:
        self.frame(ids)
        self.known.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.lengths.append(len(ids) // 4)

    def close(self) -> None:
        n = len(self.ids)
        self.frame(struct.pack("<q", n) + bytes(self.known) + np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.lengths, "<i8").tobytes())
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """One file: its seek table and index, and single frames."""

    def __init__(self, fs: pf.FileSystem, path: str):
        self.path, self.stream, self.zstd = path, fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.stream.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError(f"{path} has no seek table with checksums")
        entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.sizes, self.plain, self.sums = (entries[:, i].astype(np.int64) for i in range(3))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self.frame(frames - 1)
        n = struct.unpack_from("<q", index)[0]
        self.known = np.frombuffer(index, dtype=np.bool_, offset=8, count=n)
        self.ids = np.frombuffer(index, dtype="<i8", offset=8 + n, count=n)
        self.lengths = np.frombuffer(index, dtype="<i8", offset=8 + 9 * n, count=n)
        self.before = np.concatenate([[0], np.cumsum(self.lengths)])
        self.nameless = n - int(self.known.sum())

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def frame(self, i: int) -> bytes:
        made = self.zstd.decompress(self._at(int(self.starts[i]), int(self.sizes[i])), max_output_size=int(self.plain[i]))
        if len(made) != self.plain[i] or xxhash.xxh64_intdigest(made) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} of {self.path} is damaged")
        return made

    def places(self, doc_id: int) -> range:
        """The frames of a document, by its id; those without one come first."""
        return range(bisect_left(self.ids, doc_id, lo=self.nameless), bisect_right(self.ids, doc_id, lo=self.nameless))

    def close(self) -> None:
        self.stream.close()


# --- whole tables ---------------------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, vocabulary: str, shard: int = SHARD) -> DataFrame:
    """Encode all documents into files in folder; returns a row for each file, in FILES, as it would have to be kept to read them.

    Texts travel, not ids, which take more room; they are encoded where they are written.
    """
    fs, path = opened(folder)
    fs.create_dir(path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, seq = TaskContext.get(), encoder(vocabulary).encode, 0
        part, attempt = task.partitionId(), uuid.uuid4().hex
        files, at = opened(folder)
        end = struct.pack("<I", END)
        w = None

        def done() -> pa.RecordBatch:
            w.close()
            name = f"part-{part:06d}-{seq:04d}.tokens"
            files.move(f"{at}/_{attempt}", f"{at}/{name}")
            ids = [i for i, k in zip(w.ids, w.known, strict=True) if k]
            told = [[name], [part], [seq], [len(w.ids)], [sum(w.lengths)], [ids[0] if ids else None], [ids[-1] if ids else None]]
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(told, kinds, strict=True)], names=[c.split()[0] for c in FILES.split(", ")])

        for batch in (p for b in batches for p in pieces(b, TOGETHER)):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                if w is None:
                    w = FrameWriter(files.open_output_stream(f"{at}/_{attempt}", compression=None))
                w.document(doc_id, ids + end)
                if w.size >= shard:
                    yield done()
                    w, seq = None, seq + 1
        if w is not None:
            yield done()

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    return told.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(put, FILES)


def read(files: DataFrame, folder: str, schema: str, made: Callable[[FrameReader, int, bytes], tuple]) -> DataFrame:
    """A row for each document in files, which have a `start`: what `made` makes of the reader, the document's place and its ids."""
    names = [c.split()[0] for c in schema.split(", ")]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                r, rows = FrameReader(fs, f"{at}/{name}"), []
                for i in range(len(r.ids)):
                    rows.append((int(r.ids[i]) if r.known[i] else None, start + int(r.before[i]), *made(r, i, r.frame(i))))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=kinds)
                        rows = []
                r.close()
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=kinds)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return files.mapInArrow(get, schema)


def with_starts(files: DataFrame) -> DataFrame:
    """files, a row each, with `start`, the tokens of all files before; each row a partition, as rows are small and files aren't."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    told = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return told.repartition(max(1, files.count()))


def summaries(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its frame."""
    return read(with_starts(files), folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda r, i, ids: (len(ids) // 4, zlib.crc32(ids)))


def fetch(files: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted documents, by doc_id: only their frames are read and decompressed, and no more files opened than hold one.

    The driver lists the files' first and last ids, 16 bytes for each SHARD bytes. Wanted ids are sent to the files that may hold them.
    """
    listed = files.where("first is not null").select("file", "first", "last").orderBy("part", "seq").toPandas()
    first, last, names = listed["first"].tolist(), listed["last"].tolist(), listed["file"].tolist()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(names[i], d) for d in batch["doc_id"].to_pylist() for i in range(bisect_left(last, d), bisect_right(first, d))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["file", "doc_id"])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, at), r, name_of = opened(folder), None, None
        for batch in batches:
            for name, doc_id in zip(batch["file"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                if name != name_of:
                    if r is not None:
                        r.close()
                    r, name_of = FrameReader(fs, f"{at}/{name}"), name
                for i in r.places(doc_id):
                    ids = np.frombuffer(r.frame(i), dtype="<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = asked.mapInArrow(locate, "file string, doc_id long")
    return placed.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(get, "doc_id long, ids array<long>")


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str) -> tuple[DataFrame, str]:
    """Files of all documents in a new folder within the shared one: their rows, kept as a table, and the folder."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return Scratch(spark).put(write(docs, folder, vocabulary)), folder
