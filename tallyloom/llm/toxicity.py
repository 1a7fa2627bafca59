"""Toxicity of whole texts: Levenshtein automata run over a lexicon's trie, with windows of context.

The lexicon is learned from labelled texts: words, and stems that words begin with, which toxic texts hold far oftener
than others. Its trie and the automaton of a word are walked together, so that misspelled words and stems are met too. A
hit counts less inside quotation marks that other hits do not surround.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, Scratch, map_lists, sample_rows

WORD = re.compile(r"[^\W_]+")
QUOTED = re.compile("\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]")
#: Stems are the first 3 to 9 letters of a longer word; words of so many letters are terms themselves.
STEMS, LEAST_LETTERS = range(3, 10), 3
#: Terms shorter than this are met as they stand only.
FUZZY_FROM = 5
#: Words around a hit in which another, outside quotation, makes it abuse; weight of a quoted hit without one, and of a misspelled one.
AROUND, QUOTE_WEIGHT, FUZZY_WEIGHT = 8, 0.3, 0.5
#: A term's least weight, and that of a term whose misspellings count.
LEAST, FUZZY_LEAST = math.log(10), math.log(40)
#: Evidence is that of the TOP strongest hits, so that a long text isn't the worse for its length; it is counted in steps
#: of 1 / STEP. A score is the logistic of its distance from the threshold.
TOP, STEP = 3, 4
MOST = 40.0
REMEMBERED = 200_000


def terms_of(text: str | None) -> set[str]:
    """Words of a text as "word", and their stems as "stem*", once each."""
    found = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) >= LEAST_LETTERS:
            found.add(w)
        found.update([w[:k] + "*" for k in STEMS if len(w) > k])
    return found


@dataclass
class Lexicon:
    """Terms with their weights, as a trie, those whose misspellings count as another, and the evidence from which a text is predicted toxic."""

    terms: dict[str, float]
    threshold: float = 0.0
    trie: dict = field(default_factory=dict)
    near: dict = field(default_factory=dict)
    firsts: set = field(default_factory=set)
    seconds: set = field(default_factory=set)
    ordinary: set = field(default_factory=set)
    known: Remembered = field(default_factory=lambda: Remembered(REMEMBERED))

    def __post_init__(self):
        for term, weight in self.terms.items():
            stem, plain = term.endswith("*"), term.rstrip("*")
            fuzzy = len(plain) >= FUZZY_FROM and weight >= FUZZY_LEAST
            for node in (self.trie, self.near) if fuzzy else (self.trie,):
                for c in plain:
                    node = node.setdefault(c, {})
                node["*" if stem else "$"] = weight
            if fuzzy:
                # with one edit between them, a word has the term's first half at its start, or the second one about where it is in the term
                half, n = len(plain) // 2, len(plain)
                self.firsts.add(plain[:half])
                self.seconds.update([(plain[half:], end) for end in (n - 1, n, n + 1)])
        self.first_sizes = sorted({len(x) for x in self.firsts})
        self.second_places = sorted({(end, len(x)) for x, end in self.seconds})

    def exact(self, word: str) -> float:
        """The greatest weight of the terms that word is or begins with."""
        node, best = self.trie, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("*", 0.0))
        return max(best, node.get("$", 0.0))

    def fuzzy(self, word: str) -> float:
        """The greatest weight of the terms of FUZZY_FROM letters or more within one edit of word, or of its beginning where the term is a stem.

        The automaton's states are places in the word with no edit or one behind them. Without an edit there is one way
        down the trie; from each node of it, an edit leads to ways that must follow the rest of the word.
        """
        n = len(word)
        if not any(word[:k] in self.firsts for k in self.first_sizes) and not any((word[end - k : end], end) in self.seconds for end, k in self.second_places if end <= n):
            return 0.0

        def rest(node: dict, i: int) -> float:
            found = node.get("*", 0.0)
            while i < n:
                node = node.get(word[i])
                if node is None:
                    return found
                found = max(found, node.get("*", 0.0))
                i += 1
            return max(found, node.get("$", 0.0))

        best, node = rest(self.near, 0), self.near
        for i in range(n + 1):
            if i < n:
                best = max(best, rest(node, i + 1))
            for c, below in node.items():
                if c != "$" and c != "*":
                    best = max(best, rest(below, i))
                    if i < n and c != word[i]:
                        best = max(best, rest(below, i + 1))
            if i == n or (node := node.get(word[i])) is None:
                return best
        return best

    def misspelled(self, word: str) -> bool:
        return not self.exact(word) and self.fuzzy(word) > 0

    def weight(self, word: str) -> float:
        if (found := self.known.get(word)) is None:
            self.known.trim()
            found = self.exact(word) or (FUZZY_WEIGHT * self.fuzzy(word) if len(word) >= FUZZY_FROM - 1 and word not in self.ordinary else 0.0)
            self.known[word] = found
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each hit in the lower-cased text, after its context is weighed."""
        low = (text or "").lower()
        words = WORD.findall(low)
        known, weight = self.known, self.weight
        kinds = {w for w in set(words) if (known[w] if w in known else weight(w))}
        if not kinds:
            return []
        spans = [(m.start(), m.end(), k, weight(m[0])) for k, m in enumerate(WORD.finditer(low)) if m[0] in kinds]
        quotes = [m.span() for m in QUOTED.finditer(low)]
        inside, q = [], 0
        for s, e, _, _ in spans:
            while q < len(quotes) and quotes[q][1] < e:
                q += 1
            inside.append(q < len(quotes) and quotes[q][0] <= s)
        bare = [k for (_, _, k, _), within in zip(spans, inside, strict=True) if not within]
        made, at = [], 0
        for (s, e, k, w), within in zip(spans, inside, strict=True):
            if within:
                while at < len(bare) and bare[at] < k - AROUND:
                    at += 1
                if not (at < len(bare) and bare[at] <= k + AROUND):
                    w *= QUOTE_WEIGHT
            made.append((s, e, w))
        return made

    def evidence(self, text: str | None) -> float:
        return self.sum(self.hits(text))

    @staticmethod
    def sum(hits: list[tuple[int, int, float]]) -> float:
        return min(MOST, sum(sorted((w for _, _, w in hits), reverse=True)[:TOP]))

    def score(self, evidence: float) -> float:
        """0.7 or more just where evidence reaches the threshold."""
        return 1 / (1 + math.exp(min(50.0, max(-50.0, self.threshold - evidence - math.log(7 / 3)))))


def induce(toxic: dict[str, int], clean: dict[str, int], bad: int, good: int) -> dict[str, float]:
    """Terms with their weights, from the numbers of toxic and clean texts that hold each, of bad and good texts in all.

    A weight is the log odds that a holder is toxic over those of any text, shrunk by two texts of the usual mixture.
    Kept are terms of three toxic texts or more, raised odds and few clean holders, unless a shorter stem does as well. Words
    of FUZZY_FROM letters or more stay though a stem covers them: they are what misspellings are of.
    """
    if not bad or not good:
        return {}
    share = bad / (bad + good)
    weight = {t: math.log((n + 2 * share) / (clean.get(t, 0) + 2 * (1 - share)) * (1 - share) / share) for t, n in toxic.items() if n >= 3}
    strong = {t: w for t, w in weight.items() if w >= LEAST and clean.get(t, 0) <= 0.1 * toxic[t]}
    terms: dict[str, float] = {}
    for t in sorted(strong, key=lambda t: (len(t.rstrip("*")), t)):
        plain = t.rstrip("*")
        covered = any(terms.get(plain[:k] + "*", 0.0) >= strong[t] - 0.5 for k in STEMS if k < len(plain))
        if not covered or (not t.endswith("*") and len(plain) >= FUZZY_FROM):
            terms[t] = strong[t]
    return terms


def learn(docs: DataFrame, labels: DataFrame, most: int = 15_000, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Lexicon:
    """A lexicon from docs and their labels (0 or 1; null labels, and labels of no document, teach nothing).

    Fitted on a sample of about `most` labels, by a hash of key, which are sent to where the texts are read. The threshold
    comes from crossing over: lexicons of either half of the sample, each run on the other half. Words of clean texts
    that look like misspelled terms are taken for ordinary ones. The driver gets terms of three toxic texts or more,
    ordinary words, and a histogram of evidence; the sample bounds them all.
    """
    chosen = sample_rows(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y")), key, most)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2)).cast("int").alias("half")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).select("y", half, "text"))
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}

    def tally(y, wanted=None):
        def run(halves, texts):
            seen: Counter = Counter()
            for h, t in zip(halves, texts, strict=True):
                found = terms_of(t)
                seen.update([(w, h) for w in (found if wanted is None else found & wanted)])
            return [k[0] for k in seen], [k[1] for k in seen], list(seen.values())

        made = map_lists(rows.where(F.col("y") == y).select("half", "text"), run, "term string, half int, n long")
        return made.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])

    held = tally(1).where("n0 + n1 >= 3").collect()
    toxic = {r["term"]: (r["n0"], r["n1"]) for r in held}
    clean = {r["term"]: (r["n0"], r["n1"]) for r in tally(0, set(toxic)).collect()} if toxic else {}

    def of(*halves):
        count = lambda d: {t: sum(n[h] for h in halves) for t, n in d.items()}
        return Lexicon(induce(count(toxic), count(clean), *[sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0)]))

    lexicon, crossed = of(0, 1), (of(1), of(0))

    def alike(texts):
        every = set().union(*[WORD.findall((t or "").lower()) for t in texts])
        return [[w for w in every if len(w) >= FUZZY_FROM - 1 and lexicon.misspelled(w)]]

    ordinary = {r["word"] for r in map_lists(rows.where("y = 0").select("text"), alike, "word string").distinct().collect()}
    for x in (lexicon, *crossed):
        x.ordinary, x.known = ordinary, Remembered(REMEMBERED)

    def weigh(labels, halves, texts):
        seen = Counter((y, math.floor(crossed[h].evidence(t) * STEP)) for y, h, t in zip(labels, halves, texts, strict=True))
        return [k[0] for k in seen], [k[1] for k in seen], list(seen.values())

    bins = map_lists(rows, weigh, "y int, e int, n long").groupBy("y", "e").agg(F.sum("n").alias("n")).collect()
    lexicon.threshold = threshold({(r["y"], r["e"]): r["n"] for r in bins})
    scratch.clear()
    return lexicon


def threshold(bins: dict[tuple[int, int], int]) -> float:
    """The evidence of the best F1; the middle of the gap below it, where several steps are as good."""
    steps = sorted({e for _, e in bins if e > 0})
    total = sum(n for (y, _), n in bins.items() if y == 1)
    best, at = -1.0, None
    for e in steps:
        hit, false = (sum(n for (y, x), n in bins.items() if y == k and x >= e) for k in (1, 0))
        f1 = 2 * hit / (total + hit + false) if hit else 0.0
        if f1 > best:
            best, at = f1, e
    if at is None:
        return MOST + 1
    below = max([x for _, x in bins if x < at], default=0)
    return (at + max(below, 0)) / 2 / STEP


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, score, predicted, hits array<struct<start, end, weight>>) for each row; predicted is 1 from a score of 0.7.

    Spans are of the lower-cased text. Null and empty texts have no evidence and the least score. Repeated rows get
    equal scores and a null key stays null; rows are independent, without a shuffle. Other columns are ignored, or with keep come first, all but
    those with the names of the results.
    """
    made = ("score", "predicted", "hits")
    rows = docs.select(*[c for c in docs.columns if c not in made]) if keep else docs.select(F.col(key), F.col(text))
    at = rows.columns.index(text)
    given = rows.schema.fields if keep else [rows.schema[key]]

    def run(*columns):
        found = [lexicon.hits(t) for t in columns[at]]
        scores = [lexicon.score(lexicon.sum(h)) for h in found]
        spans = [[{"start": s, "end": e, "weight": w} for s, e, w in h] for h in found]
        return *columns[: len(given)], scores, [int(s >= 0.7) for s in scores], spans

    told = T.StructType.fromDDL("score double, predicted int, hits array<struct<start:int,end:int,weight:double>>")
    return map_lists(rows, run, T.StructType([*given, *told.fields]))
