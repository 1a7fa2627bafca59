"""Names found in texts, against brute force; catalogs of several automata; items behind products."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import extract, matching


def brute(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """At each place from left to right, the longest name that stands alone."""
    found, at = [], 0
    while at < len(text):
        here = [n for n in names if n and text.startswith(n, at) and matching.stands_alone(text, at, at + len(n))]
        best = max(here, key=len, default=None)
        if best:
            found.append((at, at + len(best), best))
        at += len(best) if best else 1
    return found


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab 1사과", max_size=4), max_size=12), st.text("ab 1사과-", max_size=40))
def test_same_as_brute_force(names, text):
    assert matching.Names(sorted(names)).find(text) == brute(text, names)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_tables_in_one_automaton_and_in_several(spark, most):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abc 사", k=rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choices("abc 사1", k=rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, message string").withColumn("found", F.lit("mine")).repartition(3)
    listed = spark.createDataFrame([(n,) for n in [*names, *names, "", None]], "name string")
    made = matching.matches(rows.drop("found"), listed, most=most).orderBy("i", "n").collect()
    want = [(i, n, *x) for i, t in enumerate(texts) for n, x in enumerate(brute(t or "", set(names)), 1)]
    assert [(r["i"], r["n"], r["start"], r["end"], r["found"]) for r in made] == want
    assert all(r["rest"] == texts[r["i"]][r["end"] :][: len(r["rest"])] for r in made)
    assert matching.matches(rows.drop("found"), listed.limit(0), most=most).collect() == []
    assert matching.matches(rows.drop("found").limit(0), listed, most=most).collect() == []


def test_items_of_a_catalog(spark):
    catalog = {"apple": ["5kg", "10kg"], "pineapple": ["단일상품"], "배": ["대", "소"]}
    said = {"pineapple 3, apple 10kg 2": [("pineapple", "단일상품", 3), ("apple", "10kg", 2)], "apples 3": [], "crabapple": [], "배 소 4개 apple": [("배", "소", 4), ("apple", None, 1)], "배 7 대": [("배", "대", 7)], None: []}
    table = spark.createDataFrame(list(catalog.items()), "product string, options array<string>")
    rows = spark.createDataFrame([(t,) for t in said], "message string")
    made = {}
    for r in matching.catalog_items(rows, table).orderBy("n").collect():
        made.setdefault(r["message"], []).append((r["product"], r["option"], r["volume"]))
    assert made == {t: items for t, items in said.items() if items}
    find = extract.by_catalog(catalog)
    assert {t: [(i["product"], i["option"], i["volume"]) for i in find([{"user": "u", "message": t}])["items"]] for t in said} == said


def test_options_are_found_without_patterns(monkeypatch):
    """A pattern for each option of each message would be compiled again and again."""
    monkeypatch.setattr(matching.re, "finditer", lambda *a: pytest.fail("a pattern was made"))
    assert matching.option_of(" a.b+ 3", ["a.b+", "a.b", "axb"]) == ("a.b+", 3)
    assert list(matching.places("aaaaa", "aa")) == [(0, 2), (2, 4)]


@pytest.mark.parametrize("name", ["catalog_matches", "extract_by_catalog"])
def test_messages_of_one_file_are_dealt_to_all_cores(spark, name):
    from tallyloom import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_work_grows_with_the_text_not_with_the_names():
    import time

    names = matching.Names([f"name{i}" for i in range(200_000)])
    text = " ".join(f"name{i * 7} other" for i in range(20_000))

    def seconds(t):
        start = time.process_time()
        names.find(t)
        return time.process_time() - start

    assert seconds(text * 2) < 8 * max(seconds(text), 0.02)
    assert seconds(text) < 5
