"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rotated) by their place; a text's vector bundles (adds) its trigrams'. A language's
prototype bundles its training texts; a text gets the language of the highest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, sample_rows

WIDTH, SEED = 512, 20011
#: Trigrams bound at once, which bounds memory.
AT_ONCE = 4096


@lru_cache(maxsize=20_000)
def letter(point: int) -> np.ndarray:
    """The vector of a letter, the same on every machine; code point 0 stands for the gap between words."""
    return np.random.default_rng([SEED, point]).integers(0, 2, WIDTH, dtype=np.int8) * 2 - 1


def letters(text: str | None) -> np.ndarray:
    """Code points of a lower-cased text's letters, with one 0 for each run of other characters and at both ends; empty without letters."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    if len(points) == 0:
        return points
    kinds, back = np.unique(points, return_inverse=True)
    alpha = np.array([chr(p).isalpha() if p < 0x110000 and not 0xD800 <= p < 0xE000 else False for p in kinds.tolist()])[back]
    if not alpha.any():
        return np.zeros(0, dtype=np.int64)
    points = np.concatenate([[0], np.where(alpha, points, 0), [0]])
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


def vector(text: str | None) -> np.ndarray | None:
    """The bundle of a whole text's trigrams; None without letters."""
    points = letters(text)
    if len(points) == 0:
        return None
    kinds, codes = np.unique(points, return_inverse=True)
    n = len(kinds)
    own = np.stack([letter(p) for p in kinds.tolist()])
    first, second = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
    grams = (codes[:-2] * n + codes[1:-1]) * n + codes[2:]
    if n**3 <= 300_000:
        counts = np.bincount(grams, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(grams, return_counts=True)
    total = np.zeros(WIDTH, dtype=np.float32)
    for i in range(0, len(found), AT_ONCE):
        g = found[i : i + AT_ONCE]
        bound = first[g // (n * n)] * second[g // n % n] * own[g % n]
        total += counts[i : i + AT_ONCE].astype(np.float32) @ bound.astype(np.float32)
    return total


def prototypes(labelled: DataFrame, most: int = 12_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype of unit length for each language of labelled rows (null languages and texts without letters teach nothing).

    Fitted on a sample of about `most` rows, by a hash of key. Every text counts alike, whatever its length. What comes
    to the driver is one vector for each language, summed by Spark.
    """

    def run(langs, texts):
        sums: dict[str, np.ndarray] = {}
        for name, t in zip(langs, texts, strict=True):
            if (v := vector(t)) is not None:
                sums[name] = sums.get(name, 0) + v / (np.linalg.norm(v) or 1)
        return list(sums), [v.astype(float).tolist() for v in sums.values()]

    rows = sample_rows(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), key, most).select(F.col(lang).cast("string"), F.col(text))
    parts = map_lists(rows, run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    out = {r["lang"]: np.array([p["x"] for p in r["v"]], dtype=np.float32) for r in found}
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row of docs; score is the cosine with the language's prototype, 0 where negative.

    Null texts, texts without letters, and any text if there is no prototype get `und` and 0. Ties go to the language
    that sorts first. A null key stays null. Other columns are ignored; rows are independent, without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = sorted(prototypes)
    table = np.stack([prototypes[k] for k in names]) if names else None

    def run(keys, texts):
        langs, scores = [], []
        for t in texts:
            v = vector(t) if names else None
            near = table @ v / (np.linalg.norm(v) or 1) if v is not None else None
            best = int(np.argmax(near)) if v is not None else -1
            langs.append(names[best] if best >= 0 else "und")
            scores.append(min(1.0, max(0.0, float(near[best]))) if best >= 0 else 0.0)
        return keys, langs, scores

    return map_lists(docs.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, lang_pred string, score double")
