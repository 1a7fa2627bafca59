"""Secret scans with DataFrame functions only.

Three fixed patterns give spans of code points. Beside them, two character Markov models of first order, of random
strings and of ordinary identifiers, are compared by log-likelihood ratio on every other long token. The models are
trained on samples that label themselves: what the patterns find, and the plain words of the same texts.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_rows

#: The base patterns, in the order in which kinds are listed, with the group that has a least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 32 or more: the same as all runs of [0-9a-f]+ without the shorter ones, as no run begins within another.
HEX = r"[0-9a-f]{32,}"
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: Tokens that the models judge, of this length or more, and what ordinary identifiers look like.
LEAST = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST
ORDINARY = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{7,}"
#: Mean log-likelihood ratio, in nats for each character, from which a token is a secret; what is added to counts.
RATIO, SMOOTH, BACK = 0.5, 0.5, 8
#: Codes of a token's characters: the first, and how many there are from it to the last.
FIRST, WIDE = 43, 80
#: Matches of a text that are walked together: the arrays that grow with each match are this long at most, so work is linear in the matches.
CHUNK = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches of pattern in text, without those whose group is shorter than least, as an array of SPAN.

    The pieces between the matches and the matches themselves, laid end to end, give the places.
    """
    hits, held = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), held.alias("held"))
    none = F.array().cast(SPAN)

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(p["held"]) >= least, F.concat(acc["found"], one.cast(SPAN))).otherwise(acc["found"]).alias("found"))

    def placed(walked):
        before = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        starts = F.aggregate(walked, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), before, lambda acc: acc["starts"])
        moved = lambda c, at: F.transform(c["found"], lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["end"] + at).alias("end"), s["kind"].alias("kind")))
        return F.flatten(F.zip_with(walked, starts, moved))

    walk = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("found")), step)
    walked = let(parts, lambda p: let(F.transform(chunks(p), walk), placed))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def chunks(items: Column) -> Column:
    """An array's items in arrays of CHUNK; one empty array where there are none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.shiftright(F.size(items) - 1, CHUNK.bit_length() - 1))), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def bigrams(values: DataFrame, value: str = "v") -> DataFrame:
    """(first, second, n): how often one character follows another within the values."""
    v = F.col(value)
    pair = values.where(F.length(v) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.substring(v, i, F.lit(2)))).alias("p"))
    return pair.groupBy("p").agg(F.count("*").alias("n")).select(F.substring("p", 1, 1).alias("first"), F.substring("p", 2, 1).alias("second"), "n")


class Model:
    """Log-likelihood ratios of bigrams, random against ordinary, as one array for SQL: WIDE * WIDE numbers, by both characters' codes.

    A step's probability is its share among the steps from the same character, mixed with BACK steps dealt as the second
    character's share of all; the latter is smoothed by SMOOTH for each of the tokens' 67 characters.
    """

    def __init__(self, random: dict[tuple[str, str], int], ordinary: dict[tuple[str, str], int]):
        self.empty = not random or not ordinary
        steps = [self.steps(random), self.steps(ordinary)]
        self.ratio = [round(math.log(steps[0](chr(FIRST + i), chr(FIRST + j)) / steps[1](chr(FIRST + i), chr(FIRST + j))), 6) for i in range(WIDE) for j in range(WIDE)]

    @staticmethod
    def steps(counts: dict[tuple[str, str], int]):
        first, second = Counter(), Counter()
        for (a, b), n in counts.items():
            first[a] += n
            second[b] += n
        total = sum(second.values())
        return lambda a, b: (counts.get((a, b), 0) + BACK * (second[b] + SMOOTH) / (total + SMOOTH * 67)) / (first[a] + BACK)

    def mean(self, token: Column) -> Column:
        """The mean log-likelihood ratio of a token's steps."""
        ratio = F.from_json(F.lit(json.dumps(self.ratio)), "array<double>")
        code = lambda i: F.ascii(F.substring(token, i, F.lit(1))) - FIRST
        step = lambda acc, i: acc + F.coalesce(F.get(ratio, code(i) * WIDE + code(i + 1)), F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), step) / (F.length(token) - 1)


def train(docs: DataFrame, most: int = 4_000, key: str = "doc_id", text: str = "text") -> Model:
    """Both models, from a sample of about `most` documents by a hash of key. The driver gets bigram counts, bounded by the alphabet."""
    body = sample_rows(docs, key, most).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    secret = [F.regexp_extract_all("t", F.lit(p), F.lit(g)) for _, p, g, _ in BASE]
    kept = [F.filter(s, lambda x, n=n: F.length(x) >= n) for s, (_, _, _, n) in zip(secret, BASE, strict=True)]
    random = body.where(F.col("t").rlike("|".join(p for _, p, _, _ in BASE))).select(F.explode(F.concat(*kept)).alias("v"))
    rest = F.regexp_replace("t", "|".join(p for _, p, _, _ in BASE), " ")  # found secrets are no ordinary words
    words = body.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("v")).where(~F.col("v").rlike("[0-9]{4}|^[0-9a-f]{16,}$|^AKIA"))
    count = lambda rows: {(r["first"], r["second"]): r["n"] for r in bigrams(rows).where(F.concat("first", "second").rlike("^[A-Za-z0-9+/_.=-]{2}$")).collect()}
    return Model(count(random), count(words))


def scan(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): spans of the three patterns, and of other tokens that the models take for random strings.

    Spans have start, rank, end (exclusive) and kind, sorted by start and rank, in code points of the whole text. A null
    text counts as empty, without spans. A token that overlaps a base span isn't added. Without a model, or one that met
    no secret or no word, nothing is added. A null key stays null. Rows are independent, repeated or not; other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), t.alias("_t"))
    base = F.concat(*[spans(F.col("_t"), kind, rank, *how) for rank, (kind, *how) in enumerate(BASE)])
    added = F.array().cast(SPAN)
    if model is not None and not model.empty:
        token = lambda s: F.substring(F.col("_t"), s["start"] + 1, s["end"] - s["start"])
        odd = lambda s: token(s).rlike("[0-9]") & token(s).rlike("[A-Za-z]")
        meets = lambda s, others: F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

        def free(part):
            """The tokens of a chunk that overlap no base span; only spans within the chunk's range are looked at for each token."""
            range_ = F.struct(F.get(part, F.lit(0))["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"))
            near = F.filter(F.col("base"), lambda b: (b["start"] < range_["end"]) & (range_["start"] < b["end"]))
            return F.when(F.size(part) > 0, let(near, lambda n: F.filter(part, lambda s: ~meets(s, n)))).otherwise(part)

        long = F.filter(spans(F.col("_t"), "markov", len(BASE), TOKEN, 0, LEAST), odd)
        added = F.when(F.col("_t").rlike(TOKEN), F.filter(let(long, lambda s: F.flatten(F.transform(chunks(s), free))), lambda s: model.mean(token(s)) >= RATIO)).otherwise(added)
    return rows.select(key, "_t", F.array_sort(base).alias("base")).select(key, "base", F.array_sort(added).alias("added"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
