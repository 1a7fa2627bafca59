"""Names from a list, found in texts: the longest one at each place, from left to right.

The names are an Aho-Corasick automaton, so that a text is read once, however many names there are. A name counts only
where it isn't part of a longer word: a letter or digit of a script that parts words by spaces may not stand right before
or behind it if the name begins or ends with one. Scripts that write words together, such as Hangul, have no such rule
there; only a longer name of the list keeps a shorter one from being found in it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names that one automaton may have; a longer list is dealt into several, which read the texts one after another.
MOST_BYTES = 16 << 20
#: Scripts from here on write words together, or have letters that are words.
UNPARTED = "\u0e00"


def parted(left: str, right: str) -> bool:
    """Whether a word may end between two neighbours, of which either may be missing."""
    return not (left and right and left.isalnum() and right.isalnum() and left < UNPARTED and right < UNPARTED)


def stands_alone(text: str, start: int, end: int) -> bool:
    return parted(text[start - 1 : start], text[start]) and parted(text[end - 1], text[end : end + 1])


class Names:
    """An automaton of names; empty ones are left out."""

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()

    def all(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of every place where a name stands by itself."""
        if not text or not len(self.automaton):
            return []
        found = ((end + 1 - len(name), end + 1, name) for end, name in self.automaton.iter(text))
        return [x for x in found if stands_alone(text, x[0], x[1])]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        return leftmost_longest(self.all(text))


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of places, those that a reader takes who always takes the longest name and goes on behind it."""
    kept, at = [], 0
    for start, end, name in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            kept.append((start, end, name))
            at = end
    return kept


def matches(rows: DataFrame, names: DataFrame, text: str = "message", name: str = "name", most: int = MOST_BYTES) -> DataFrame:
    """A row for each name found in the texts of rows: rows' columns, n from 1, start and end in characters, found, and rest, the text up to the next name.

    names: one name a row; null and empty ones are left out. Texts without a name, null ones among them, have no row. The
    names' size is summed first. Up to `most` bytes, they are sent to all tasks as one automaton. Beyond that they are dealt
    into as many automata as needed; each row is read with all of them in turn, which keep what they found beside it, and
    the last one picks.
    """
    listed = names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    made = rows.withColumn("_found", F.lit(None).cast("array<struct<start:int,end:int,name:string,rest:string>>"))
    for i in range(parts):
        own = listed.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i)
        sent = rows.sparkSession.sparkContext.broadcast([r["name"] for r in own.toLocalIterator()])
        made = made.mapInArrow(_marked(sent, text, last=i == parts - 1), made.schema)
    told = made.select("*", F.posexplode("_found").alias("_n", "_m"))
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_n") + 1).alias("n"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end"), F.col("_m.name").alias("found"), F.col("_m.rest").alias("rest"))


#: A worker's automata, by the number of what was sent: tasks of one step share one.
_built: dict[str, Names] = {}


def _marked(sent, text: str, last: bool):
    """Adds the places of the names that were sent to `_found`; the last one picks, and tells what is between names."""
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _built:
            _built.clear()
            _built[number] = Names(sent.value)
        own = _built[number]
        for b in batches:
            at, ends, found = b.schema.get_field_index("_found"), [0], []
            for said, before in zip(b[text].to_pylist(), b["_found"].to_pylist(), strict=True):
                here = own.all(said or "")
                if before:
                    here += [(m["start"], m["end"], m["name"]) for m in before]
                if last:
                    here = leftmost_longest(here)
                    until = [x[0] for x in here[1:]] + [None] * bool(here)
                    found += [(s, e, n, said[e:to]) for (s, e, n), to in zip(here, until, strict=True)]
                else:
                    found += [(*x, None) for x in here]
                ends.append(len(found))
            kind = b.schema.field(at).type
            # column by column: a dictionary for each place takes longer than finding it
            parts = zip(*found, strict=True) if found else [[]] * 4
            places = pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(parts, kind.value_type.fields, strict=True)], fields=kind.value_type.fields)
            yield b.set_column(at, b.schema.field(at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places, type=kind))

    return run


NUMBER = re.compile(r"\d+")


def places(text: str, part: str) -> Iterator[tuple[int, int]]:
    """Where part is in text, from left to right, without overlaps."""
    at = text.find(part)
    while at >= 0:
        yield at, at + len(part)
        at = text.find(part, at + len(part))


def option_of(rest: str, options: list[str]) -> tuple[str | None, int]:
    """(option, volume) of what is said behind a product: the first of its options by place and then by length, and the first
    number outside of it, 1 if there is none. A product's only option needn't be said."""
    said = leftmost_longest([(i, j, o) for o in options if o for i, j in places(rest, o) if stands_alone(rest, i, j)])
    start, end, option = said[0] if said else (0, 0, options[0] if len(options) == 1 else None)
    number = next((m for m in NUMBER.finditer(rest) if m.start() >= end or m.end() <= start), None)
    return option, int(number[0]) if number else 1


def catalog_items(messages: DataFrame, catalog: DataFrame, message: str = "message", most: int = MOST_BYTES) -> DataFrame:
    """messages' columns, n, product, option and volume of each item that is said: products by name, options and numbers behind them.

    catalog: (product, options), a row for each product. What belongs to a product goes up to the next one. A catalog of any
    size will do: beyond `most` bytes of names it becomes several automata, and options are joined by product.
    """
    said = matches(messages, catalog.select(F.col("product").alias("name")), message, "name", most)
    own = catalog.where("product <> ''").groupBy(F.col("product").alias("found")).agg(F.min("options").alias("_options"))
    joined = said.join(own, "found")
    choose = F.pandas_udf(_chosen, "struct<option:string,volume:bigint>")
    made = joined.withColumn("_c", choose("rest", "_options"))
    return made.select(*[F.col(f"`{c}`") for c in messages.columns], "n", F.col("found").alias("product"), F.col("_c.option").alias("option"), F.col("_c.volume").alias("volume"))


def _chosen(rest, options):
    import pandas as pd

    return pd.DataFrame([option_of(r, [] if o is None else [x for x in o if x is not None]) for r, o in zip(rest, options, strict=True)], columns=["option", "volume"])
