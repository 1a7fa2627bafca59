"""BPE encoding and decoding of whole texts with a public vocabulary whose words end in a suffix.

Merging uses a segment tree over the ranks of adjacent pairs: a leaf holds (rank, position) as one integer, an inner
node the least of its sixteen children, so that the root names the leftmost pair of the lowest rank. A merge changes at
most three leaves, each with a walk to the root; most words have the root only. Spark spreads the texts; each Python worker keeps the ids of words that it
has met, in a dictionary of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, map_lists

NONE = 1 << 62
#: Children of a node of the segment tree.
CHILDREN = 16
#: Letters and numbers that are newer than Python's tables, but known where the vocabulary was made; and what
#: the upper-case ones among such characters become in lower case, as ranges and their first counterparts.
KNOWN = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 "
    "116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff-18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
)
LOWER = "1c89-1c89=1c8a a7cb-a7cb=264 a7cc-a7cc=a7cd a7ce-a7ce=a7cf a7d2-a7d2=a7d3 a7d4-a7d4=a7d5 a7da-a7da=a7db a7dc-a7dc=19b 10d50-10d65=10d70 16ea0-16eb8=16ebb"
#: Words whose ids a Python worker remembers, at about 160 bytes each.
REMEMBERED = 300_000
#: Code points that are looked at together where the tables of characters are compared.
PAGE = 4096


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges in pairs, (left, right) -> (rank, merged), lowest rank first and leftmost among equals, until none applies.

    A text of n pieces takes O(n log n) steps, however long. An empty list stays empty.
    """
    n = len(ids)
    if n < 2:
        return ids
    if n <= CHILDREN + 1:
        return merge_in_root(ids, pairs)
    ids, get, shift = list(ids), pairs.get, n.bit_length()
    leaves = [found[0] << shift | i if (found := get(p)) else NONE for i, p in enumerate(zip(ids, ids[1:], strict=False))]
    # levels of the tree from the leaves up; the root is the least of the last one
    levels = [leaves]
    while len(levels[-1]) > CHILDREN:
        below = levels[-1]
        levels.append([min(below[k : k + CHILDREN]) for k in range(0, len(below), CHILDREN)])
    top, steps = levels[-1], list(zip(levels, levels[1:], strict=False))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    mask = (1 << shift) - 1

    def walk(i: int) -> None:
        for below, above in steps:
            i //= CHILDREN
            least = min(below[i * CHILDREN : (i + 1) * CHILDREN])
            if above[i] == least:
                return
            above[i] = least

    while (root := min(top)) < NONE:
        i = root & mask
        j = after[i]
        ids[i] = merged = get((ids[i], ids[j]))[1]
        ids[j] = -1
        k = after[i] = after[j]
        leaves[i] = NONE
        if k < n:
            before[k] = i
            found = get((merged, ids[k]))
            if found:
                leaves[i] = found[0] << shift | i
        if j < n - 1:
            leaves[j] = NONE
        h = before[i]
        if h >= 0:
            found = get((ids[h], merged))
            leaves[h] = found[0] << shift | h if found else NONE
        if steps:
            walk(i)
            if j < n - 1:
                walk(j)
            if h >= 0:
                walk(h)
    return [x for x in ids if x >= 0]


def merge_in_root(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """merge() where the root is the only node: a leaf holds (rank, merged), and leaves close up, so that places needn't be kept."""
    ids, get = list(ids), pairs.get
    leaves = [found[0] << 32 | found[1] if (found := get(p)) else NONE for p in zip(ids, ids[1:], strict=False)]
    while leaves and (root := min(leaves)) < NONE:
        i = leaves.index(root)
        ids[i] = merged = root & 0xFFFFFFFF
        del ids[i + 1], leaves[i]
        if i < len(leaves):
            found = get((merged, ids[i + 1]))
            leaves[i] = found[0] << 32 | found[1] if found else NONE
        if i:
            found = get((ids[i - 1], merged))
            leaves[i - 1] = found[0] << 32 | found[1] if found else NONE
    return ids


def ranges(characters: list[str]) -> str:
    """Sorted characters as the ranges of a pattern's class."""
    found: list[list[int]] = []
    for c in map(ord, characters):
        if found and c == found[-1][1] + 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def new_characters() -> tuple[str, str]:
    """Letters and numbers of the regex module that Python's tables lack, and those of them that aren't KNOWN, as ranges."""
    known = regex.compile(r"[\p{L}\p{N}]").findall
    pages = ("".join(chr(c) for c in range(i, i + PAGE) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, PAGE))
    new = [c for page in pages for c in known(page) if unicodedata.category(c) == "Cn"]
    spans = [[int(x, 16) for x in r.split("-")] for r in KNOWN.split()]
    return ranges(new), ranges([c for c in new if not any(a <= ord(c) <= b for a, b in spans)])


class WordBpe:
    """A vocabulary file of the kind "BPE with word ends": NFC, white space to one space, lower case, words, bytes, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, self.end = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, m in enumerate(told["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # each byte is written as a printable character: itself where it is one, else the next free one from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = [vocab.get(byte[b]) for b in range(256)]
        self.last = [vocab.get(byte[b] + self.end) for b in range(256)]
        split = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        new, unknown = new_characters()
        self.new = regex.compile(f"[{new}]").search if new else (lambda text: None)
        for kind in (r"\p{L}", r"\p{N}"):
            split = split.replace(kind, f"[{kind}--[{unknown}]]" if unknown else kind)
        self.new_words = regex.compile(split, regex.V1).findall
        self.lower = {int(a, 16) + k: int(c, 16) + k for a, b, c in (regex.split("[-=]", r) for r in LOWER.split()) for k in range(int(b, 16) - int(a, 16) + 1)}
        # single spaces are as they should be
        self.space = regex.compile(r"[^\P{White_Space} ]\p{White_Space}*| \p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None
        self.kept = Remembered(REMEMBERED)

    def normal(self, text: str) -> str:
        """Lower case goes character by character: a capital sigma has no final form."""
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        text = self.normal(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.new(text):
                return self.new_words(text.translate(self.lower))
        return self.words(text)

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return merge([i for i in ids if i is not None], self.pairs)

    def decode(self, ids) -> str:
        """Tokens joined by a space, as for a vocabulary file that names no decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as packed 32-bit integers, and their decoded text."""
        if not text:
            return b"", ""
        words: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            words += [part] if k % 2 else self.split(part)
        kept = self.kept
        # asked word by word: set.difference reads all of a dictionary of another class than dict
        new = {w for w in words if w not in kept}
        if new:
            kept.trim()
            new = {w for w in words if w not in kept}
        for w in new:
            kept[w] = array("i", [self.special[w]] if w in self.special else self.word(w)).tobytes()
        ids = b"".join([kept[w] for w in words])
        return ids, self.decode(np.frombuffer(ids, dtype=np.int32).tolist())


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One vocabulary for each Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded text of each document: (key, ids array<int>, decoded string).

    docs: any columns besides key and text are ignored. A null text counts as empty: no ids, and empty decoded text.
    Repeated rows give repeated results, a null key stays null; an empty table gives an empty one. vocabulary: path of the file, the same on
    every machine. Rows are independent: no shuffle, and memory is bounded by a batch and the remembered words.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys, texts):
        bpe = loaded(vocabulary)
        made = [bpe.encode_decode(t) for t in texts]
        ends = np.cumsum([0] + [len(m[0]) // 4 for m in made], dtype=np.int64)
        values = np.frombuffer(b"".join([m[0] for m in made]), dtype=np.int32)
        return keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), [m[1] for m in made]

    return map_lists(docs.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, ids array<int>, decoded string")
