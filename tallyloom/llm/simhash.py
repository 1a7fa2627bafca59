"""Near duplicates by SimHash, found by a range join over segment popcounts.

A fingerprint becomes a vector: the number of bits set in each of its 32 segments of two bits. The Manhattan distance of
two vectors is a lower bound of the Hamming distance of the fingerprints. For links at `most` bits, the 32 dimensions
are dealt into most + 3 bands; in three of the bands, at least, two linked vectors agree, so a grid over each three
bands, with cells of one vector, brings every linked pair together. The rest of both vectors is the range test, and the
fingerprints themselves the exact one.

Texts are reduced to distinct fingerprints first, so copies cost nothing. A cell of more than `DENSE` fingerprints is not
paired out: the other three bands, of which linked vectors differ in `most` segments or fewer, are dealt into most + 1
parts, and a second grid over each part splits the cell. Fingerprints of cells that are still dense, such as those of one
vector, meet by their bits instead, in three of most + 3 blocks, which costs as many rows for each of them as the first
grid did. What is dense even then is one cluster of near fingerprints: it is dealt into blocks, and every two blocks meet
in a task of bounded size that compares them as arrays and returns no more than the links of a spanning forest.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_lists

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at once, which bounds the memory of a very long text.
AT_ONCE = 65_536
#: The largest cell whose fingerprints are paired out, and the fingerprints in a block of a larger one.
DENSE, BLOCK = 48, 2048
EVEN = 0x5555555555555555


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; fewer words than size make one shingle, none make 0."""
    words = WORD.findall((text or "").encode("utf-8", "replace").translate(UPPER))
    n = len(words)
    if not n:
        return 0
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(size, n)
    starts = [0, *ends]
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), n - k + 1
    for i in range(0, total, AT_ONCE):
        hashes = np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts[i : i + AT_ONCE], ends[k - 1 + i : k - 1 + i + AT_ONCE])], dtype="<u8")  # noqa: B905
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp long, the fingerprint's 64 bits as a signed number); a null text has the fingerprint 0."""

    def run(keys, texts):
        return keys, np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64).tolist()

    return map_lists(docs.select(F.col(key), F.col(text)), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def embedding(fp: Column) -> tuple[Column, Column]:
    """The vector of popcounts of two-bit segments, as two bit planes: ones (segments with one bit set) and twos (both)."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseXOR(high), low.bitwiseAND(high)


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the vectors of two fingerprints: a segment counts one where just one of the two has a single bit, two for none against both."""
    (a1, a2), (b1, b2) = embedding(a), embedding(b)
    one = a1.bitwiseXOR(b1)
    two = a2.bitwiseXOR(b2).bitwiseAND(F.bitwise_not(one))
    return F.bit_count(one) + 2 * F.bit_count(two)


def bands(n: int, segments: list[int] | None = None) -> list[int]:
    """Masks, over the even bits, of n bands of the segments (all 32, if not given), as equal as can be."""
    every = list(range(32)) if segments is None else segments
    return [sum(1 << (2 * s) for i, s in enumerate(every) if i * n // len(every) == k) for k in range(n)]


def grids(most: int) -> list[int]:
    """Masks of the segments of each three of the most + 3 bands."""
    return [reduce(int.__or__, c) for c in combinations(bands(most + 3), 3)]


def masked(fp: Column, mask: int) -> Column:
    """The vector of the masked segments, as one number."""
    ones, twos = embedding(fp)
    return ones.bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(twos.bitwiseAND(F.lit(mask)), 1))


def spread(fps: DataFrame, keys: list[list[Column]], names: list[str], *kept: str) -> DataFrame:
    """fps, once for each of the keys, whose columns get these names."""
    made = [F.struct(*[c.alias(n) for c, n in zip(k, names, strict=True)]) for k in keys]
    return fps.select(*kept, "fp", F.explode(F.array(*made)).alias("c")).select(*kept, *[f"c.{n}" for n in names], "fp")


def cells(fps: DataFrame, most: int) -> DataFrame:
    """(grid, cell, fp): each distinct fingerprint in its cell of each grid; a grid is three of the most + 3 bands."""
    return spread(fps, [[F.lit(g), masked(F.col("fp"), m)] for g, m in enumerate(grids(most))], ["grid", "cell"])


def second_cells(placed: DataFrame, most: int) -> DataFrame:
    """(grid, cell, part, inner, fp): fingerprints of dense cells by each of the most + 1 parts of the grid's other segments, one of which linked vectors share."""
    parts = [bands(most + 1, [s for s in range(32) if not m >> (2 * s) & 1]) for m in grids(most)]
    inner = lambda k: reduce(lambda last, g: F.when(F.col("grid") == g, masked(F.col("fp"), parts[g][k])).otherwise(last), range(len(parts)), F.lit(None).cast("long"))
    return spread(placed, [[F.lit(k), inner(k)] for k in range(most + 1)], ["part", "inner"], "grid", "cell")


def bit_cells(fps: DataFrame, most: int) -> DataFrame:
    """(grid, cell, fp): fingerprints by the bits of each three of most + 3 blocks, which those at `most` bits share."""
    blocks = [sum(1 << b for b in range(64) if b * (most + 3) // 64 == k) for k in range(most + 3)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return spread(fps, [[F.lit(g), F.col("fp").bitwiseAND(F.lit(signed(sum(c))))] for g, c in enumerate(combinations(blocks, 3))], ["grid", "cell"])


def close(a: Column, b: Column, most: int) -> Column:
    """The range test, which the embedding's distance allows, and then the exact one."""
    return (manhattan(a, b) <= most) & (F.bit_count(a.bitwiseXOR(b)) <= most)


def met(placed: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) within cells of up to DENSE fingerprints, and the other cells with their number n of fingerprints."""
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    few = placed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= DENSE)).drop("n"), keys)
    x, y = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    pairs = x.join(y, keys).where((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b"), most)).select("a", "b")
    return pairs, cut(sizes.where(F.col("n") > DENSE))


def forest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the fingerprints in a and b, over all links between a and b (or within a, where b is a)."""
    even = np.uint64(EVEN)
    planes = lambda x: ((x ^ x >> np.uint64(1)) & even, x & x >> np.uint64(1) & even)
    bits = b.view(np.uint64)
    b1, b2 = planes(bits)
    every = np.unique(np.concatenate([a, b]))
    root = np.arange(len(every))
    left, right = [], []
    at_b = np.searchsorted(every, b)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in a.tolist():
        i = int(np.searchsorted(every, x))
        own = np.int64(x).view(np.uint64)
        a1, a2 = planes(own)
        one = a1 ^ b1
        near = np.flatnonzero(np.bitwise_count(one) + 2 * np.bitwise_count((a2 ^ b2) & ~one) <= most)
        near = at_b[near[np.bitwise_count(bits[near] ^ own) <= most]]
        for j in near[root[near] != find(i)].tolist():
            r, s = find(i), find(j)
            if r != s:
                root[max(r, s)] = min(r, s)
                left.append(int(every[i]))
                right.append(int(every[j]))
    return left, right


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints, enough to connect all that differ in `most` bits or fewer.

    All pairs at that distance, but for clusters of over DENSE fingerprints that share three blocks of bits: of those, what connects them.
    """
    placed = cells(fps, most)
    found, dense = met(placed, ["grid", "cell"], most)
    if dense.isEmpty():
        return found.distinct()
    placed = cut(second_cells(placed.join(dense.drop("n"), ["grid", "cell"]), most))
    more, dense = met(placed, ["grid", "cell", "part", "inner"], most)
    found = found.union(more)
    if dense.isEmpty():
        return found.distinct()
    placed = cut(bit_cells(placed.join(dense.drop("n"), ["grid", "cell", "part", "inner"]).select("fp").distinct(), most))
    more, dense = met(placed, ["grid", "cell"], most)
    found = found.union(more)
    if dense.isEmpty():
        return found.distinct()
    # the rest is dealt into blocks by a hash; blocks i <= j of a cell meet in a group of 2 * BLOCK or so
    many = dense.select("grid", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(many, ["grid", "cell"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        values = group["fp"].to_numpy(np.int64)
        first = values[group["own"].to_numpy() == i]
        a, b = forest(first, first if i == j else values[group["own"].to_numpy() == j], most)
        return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    return found.union(dealt.groupBy("grid", "cell", "i", "j").applyInPandas(meet, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, most: int = 3, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links of `most` differing bits or fewer.

    Null and empty texts have the fingerprint 0 and are linked like any other; a document without links is its own
    component. Repeated keys stay repeated rows; null keys are left out of the minimum; an empty table gives an empty one.
    """
    found = cut(fingerprints(docs, key, text, size))
    kinds = cut(found.groupBy("fp").agg(F.min(key).alias("least")))
    joined = components(links(kinds.select("fp"), most))
    least = kinds.join(joined, kinds["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = cut(least)
    groups = least.groupBy("group").agg(F.min("least").alias("component"))
    named = least.join(groups, "group").select("fp", "component")
    return found.join(named, "fp").select(key, "fp", "component")
