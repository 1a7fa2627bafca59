"""Chats of any file name, in every flow."""

import pytest

from tallyloom.operators import extract
from tallyloom.plans import chats as plans
from tallyloom.sources import chats as lines

NAMES = ["with space", "100%", "a%20b", "chat (1)", "a[1]", "b{x,y}", "plus+sign", "star*", "what?", "김 철수", "hash#1", "semi;colon", "a,b", "am&p=1"]
ROW = "2026-03-12 10:00:00"


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_no_chat_is_lost(spark, tmp_path, kind):
    paths = []
    for i, name in enumerate(NAMES):
        path = tmp_path / f"{name}.{kind}"
        said = f"DATE,USER,MESSAGE\n{ROW},u{i},사과 {i}\n" if kind == "csv" else f"{{'user': 'u{i}', 'message': '사과 {i}', 'date': '{ROW}'}}\n"
        path.write_text(said, encoding="utf-8")
        paths.append(str(path))
    # what the bracket would stand for as a pattern
    (tmp_path / f"a1.{kind}").write_text("DATE,USER,MESSAGE\n", encoding="utf-8")
    made, chats = plans.extract_orders(spark, paths, extract.by_catalog({"사과": []}), "20260315")
    assert {(r["chat_name"], r["volume"]) for r in made.collect()} == {(n, i) for i, n in enumerate(NAMES)}
    assert {r["file"]: len(r["messages"]) for r in chats.collect()} == {f"{n}.{kind}": 1 for n in NAMES}


def test_converter_keeps_every_chat(spark, tmp_path):
    for name in NAMES:
        (tmp_path / f"{name}.csv").write_text(f"DATE,USER,MESSAGE\n{ROW},u,m\n", encoding="utf-8")
    assert {r["file"] for r in lines.read_chat_csv(spark, [lines.literal_path(str(tmp_path / f"{n}.csv")) for n in NAMES]).collect()} == {f"{n}.csv" for n in NAMES}
    plans.convert(spark, str(tmp_path), str(tmp_path / "out"), "", [])
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == len(NAMES)


def test_files_that_are_not_there_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,USER,MESSAGE\n")
    with pytest.raises(Exception, match="b.csv"):
        plans.extract_orders(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], extract.by_catalog({}), "20260315")
    known = spark.createDataFrame([("x", True, "x")], "path string, _listed boolean, display string")
    with pytest.raises(Exception, match="not listed: y"):
        plans._of_files(spark.createDataFrame([("y", 1)], "path string, ord long"), known).collect()
