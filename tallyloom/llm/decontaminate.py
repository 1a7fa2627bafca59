"""Benchmark decontamination by template windows.

Numbers, units that follow a number, and capitalised words within a sentence become typed placeholders; what remains is
a template. Windows of a template are joined by hash with those of the benchmark, so a question that was given other
names or figures is still met. On one diagonal (same distance between place in document and in item) each slot of the
item meets one slot of the document, of the same type. Names and units must also be the same ones throughout: one of the
item always meets one of the document, and the other way round; equal figures needn't stay equal, as they may stand for
different things. Where names contradict each other, the assignment that most windows bear out holds, and only windows
against it go.
Windows also match as they stand, in lower case without placeholders, so verbatim copies are met whatever their words are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, cut, map_lists

WINDOW, LEAST_WORDS = 8, 3
#: Figures without words among them, as few as which are a question of their own.
FIGURES = 5
#: Share of an item's windows that a document must hold.
COVERED = 0.3
#: Window hashes of the benchmark that are sent to every task, 8 bytes each; beyond it, all windows are shuffled and joined.
SENT = 1_000_000
TOKEN = re.compile(r"\w+(?:[.,]\d+)*|[.!?:\n]")
NUMBER = re.compile(r"[+-]?\d[\d.,]*(?:st|nd|rd|th)?")
#: Words that are units where they follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "km2 m2 m3 hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar c f k n percent pct dollar dollars euro euros cent cents usd eur".split()
)
PLAIN, NAME, NUM, UNIT, END = range(5)
FILL = np.array([0, *map(xxhash.xxh64_intdigest, (b"<name>", b"<number>", b"<unit>")), 0], dtype=np.uint64)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)
REMEMBERED = 200_000


class Codes(Remembered):
    """token -> 61 bits of its lower-cased hash and 3 of its kind."""

    def __missing__(self, token: str) -> int:
        self.trim()
        if token in ".!?:\n":
            kind = END
        elif NUMBER.fullmatch(token):
            kind = NUM
        elif token.lower() in UNITS:
            kind = UNIT
        else:
            kind = NAME if token.istitle() and len(token) > 1 else PLAIN
        self[token] = code = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "replace")) >> 3 << 3 | kind
        return code


CODES = Codes(REMEMBERED)


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A text's tokens, the places of its words among them, the hash of each word or of its placeholder, and whether it is a placeholder."""
    tokens, at, words, slot, kind = coded(text)
    return tokens, at, np.where(slot, FILL[kind], words), slot


def coded(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's tokens, the places of its words among them, and of each word its hash, whether it is a placeholder, and its kind."""
    tokens = TOKEN.findall(text or "")
    codes = np.fromiter(map(CODES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    kind = (codes & np.uint64(7)).astype(np.int8)
    before = np.empty_like(kind)
    before[:1], before[1:] = END, kind[:-1]
    slot = (kind == NUM) | ((kind == NAME) & (before != END)) | ((kind == UNIT) & (before == NUM))
    at = np.flatnonzero(kind != END)
    return tokens, at, codes[at] >> np.uint64(3), slot[at], kind[at]


def windows(hashes: np.ndarray, slots: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` words; 0 where fewer than half are words rather than placeholders."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    made = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        made += hashes[k : k + n] * POWERS[k]
        made ^= made >> np.uint64(29)
    if slots.any():
        held = np.concatenate([[0], np.cumsum(slots)])
        made[2 * (held[size:] - held[:-size]) > size] = 0
    return made


def template_windows(rows: DataFrame, key: str, text: str, sizes: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, size, pos, window, slots, total, form): windows of each text, total being how many it has of that size.

    A window without placeholders comes once (form 0). Another comes as a template with its slots (1), unless it is of
    mostly placeholders, and as it stands, without slots (2, or 3 if it is of mostly placeholders). A text of less than
    FIGURES words, all of them figures, has no window.

    sizes None: WINDOW, or the whole text where that is shorter (LEAST_WORDS at least). wanted: sorted hashes to keep.
    """
    if wanted is not None:
        near = np.zeros(1 << 22, dtype=bool)  # by their first bits, most windows are told apart at once
        near[(wanted >> np.uint64(42)).astype(np.int64)] = True

    def among(made):
        if wanted is None:
            return made != 0
        keep = near[(made >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(keep)
        keep[at] = wanted[np.minimum(np.searchsorted(wanted, made[at]), len(wanted) - 1)] == made[at]
        return keep & (made != 0)

    def run(keys, texts):
        out = [[], [], [], [], [], [], []]
        for k, t in zip(keys, texts, strict=True):
            tokens, places, words, slots, kinds = coded(t)
            filled = np.where(slots, FILL[kinds], words)
            for size in sizes or ([min(WINDOW, len(places))] if len(places) >= LEAST_WORDS else []):
                plain = windows(words, np.zeros_like(slots), size)
                if size < FIGURES and len(plain):
                    figures = np.concatenate([[0], np.cumsum(slots & (kinds != NAME))])
                    plain[figures[size:] - figures[:-size] == size] = 0
                made = windows(filled, slots, size) if slots.any() else plain
                held = np.concatenate([[0], np.cumsum(slots)])
                slotted = held[size:] > held[:-size] if len(plain) else np.zeros(0, dtype=bool)
                form = np.where(slotted, np.where(made == 0, 3, 2), 0)
                for hashes, at, forms in ((plain, np.flatnonzero(among(plain)), form), (made, np.flatnonzero(among(made) & slotted), np.ones_like(form))):
                    for i in at.tolist():
                        out[0].append(k)
                        out[1].append(size)
                        out[2].append(i)
                        out[4].append([tokens[places[j]].lower() for j in range(i, i + size) if slots[j]] if forms[i] == 1 else [])
                    out[3] += hashes[at].view(np.int64).tolist()
                    out[5] += [len(plain)] * len(at)
                    out[6] += forms[at].tolist()
        return out

    kind = rows.schema[key].dataType.simpleString()
    return map_lists(rows.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, size int, pos int, window long, slots array<string>, total int, form int")


def consistent(found: list[dict]) -> list[dict]:
    """The windows of one diagonal whose names and units agree with one assignment: pairs that most windows hold come first, equal values before others."""
    fixed = [[p for p in f["pairs"] if not NUMBER.fullmatch(p["item_slots"] or "")] for f in found]
    pairs = Counter((p["item_slots"], p["slots"]) for f in fixed for p in f)
    left: dict[str, str] = {}
    right: dict[str, str] = {}
    for a, b in sorted(pairs, key=lambda p: (-pairs[p], p[0] != p[1], p)):
        if a not in left and b not in right:
            left[a], right[b] = b, a
    return [f for f, own in zip(found, fixed, strict=True) if all(left.get(p["item_slots"]) == p["slots"] for p in own)]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", sent: int = SENT) -> DataFrame:
    """(key, item, coverage): documents that hold `COVERED` of an item's template windows or more, consistently filled, or of all its windows as they stand.

    Null and empty texts match nothing, nor do items of fewer than LEAST_WORDS words, or of fewer than FIGURES that are all figures. A repeated
    item counts for itself. Rows of one key count as one document, and so do those without a key, whose result has a null key. An empty table
    on either side gives an empty result. Other columns are ignored.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("item_text"))
    held = cut(template_windows(items, "item", "item_text"))
    kinds = held.select("window").distinct()
    sizes = [r["size"] for r in held.select("size").distinct().orderBy("size").collect()] or [WINDOW]
    few = kinds.limit(sent + 1).count() <= sent
    wanted = np.sort(np.array([r["window"] for r in kinds.collect()], dtype=np.int64).view(np.uint64)) if few else None
    found = template_windows(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), "key", "body", sizes, wanted).drop("total", "form")
    there = held.select("item", "size", "window", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "total", "form")
    both = found.join(there, ["window", "size"]).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    hit = F.struct("item_pos", "form", F.arrays_zip("item_slots", "slots").alias("pairs"))
    lines = both.groupBy("key", "item", "diagonal").agg(F.max("total").alias("total"), F.collect_set(hit).alias("found"))

    def run(keys, names, totals, hits):
        pure = [consistent(h) for h in hits]
        return keys, names, totals, [[f["item_pos"] for f in p if f["form"] != 3] for p in pure], [[f["item_pos"] for f in p if f["form"] != 1] for p in pure]

    kind = lambda c: lines.schema[c].dataType.simpleString()
    pure = map_lists(lines.select("key", "item", "total", "found"), run, f"key {kind('key')}, item {kind('item')}, total int, at array<int>, plain array<int>")
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = pure.groupBy("key", "item").agg(places("at").alias("n"), places("plain").alias("n_plain"), F.max("total").alias("total"))
    # windows of mostly placeholders aren't counted among templates on either side
    counted = held.where("form <> 3").groupBy("item").agg(F.countDistinct("pos").alias("usable"))
    share = F.greatest(F.coalesce(F.col("n") / F.col("usable"), F.lit(0.0)), F.col("n_plain") / F.col("total"))
    whole = whole.join(counted, "item", "left").select("key", "item", share.alias("coverage"))
    return whole.where(F.col("coverage") >= COVERED).select(F.col("key").alias(key), F.col("item").alias(item), "coverage")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", sent: int = SENT) -> DataFrame:
    """(key, items): documents with the items that they hold, in order; clean documents have no row."""
    found = matches(docs, benchmark, key, text, item, item_text, sent)
    return found.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
