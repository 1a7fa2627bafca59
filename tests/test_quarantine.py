"""Bad lines: set aside with their reason, counted in the pass that reads them."""

from pyspark.sql import functions as F

from tallyloom.operators import extract
from tallyloom.plans import chats as plans
from tallyloom.sources import chats as lines
from tallyloom.sources.quarantine import sort_out

TEXT = "{'user': 'a', 'message': '사과 3', 'date': '2026-03-12 10:00:00'}\nno literal\n\n{'user': 'a', 'message': '사과 4', 'date': 'soon'}\n{'user': 'a', 'message': '사과 5'}\n{'user': \n"


def test_counts_are_what_is_stored(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(TEXT, encoding="utf-8")
    rows = lines.read_chat_lines(spark, str(tmp_path / "a.jsonl"))
    done = sort_out(rows, lines.fault(rows), [lines.UNREADABLE, lines.UNDATED], str(tmp_path / "q"))
    assert done.counts == {"rows": 5, "kept": 2, lines.UNREADABLE: 2, lines.UNDATED: 1}
    assert sorted((r["reason"], r["line"]) for r in done.set_aside.collect()) == [(lines.UNDATED, "{'user': 'a', 'message': '사과 4', 'date': 'soon'}"), (lines.UNREADABLE, "no literal"), (lines.UNREADABLE, "{'user':")]
    assert sorted(r["message"] for r in done.kept.collect()) == ["사과 3", "사과 5"]
    assert done.kept.columns == rows.columns
    empty = sort_out(rows.limit(0), lines.fault(rows), [lines.UNREADABLE], str(tmp_path / "q2"))
    assert empty.counts == {"rows": 0, "kept": 0, lines.UNREADABLE: 0} and empty.kept.collect() == [] and empty.set_aside.collect() == []


def test_the_source_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(100).mapInPandas(counted, "id long")
    done = sort_out(rows, F.when(F.col("id") % 10 == 0, "tenth"), ["tenth"], str(tmp_path / "q"))
    assert done.kept.count() == 90 and done.set_aside.count() == 10 and done.counts == {"rows": 100, "kept": 90, "tenth": 10}
    assert read.value == 100
    plan = done.kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "set_aside" in plan and "PartitionFilters" in plan


def test_flow_tells_its_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(TEXT, encoding="utf-8")
    find, counts = extract.by_catalog({"사과": []}), []
    for k, (after, want) in enumerate([(None, [3, 4, 5]), ("2026-03-01 00:00:00", [3, 5])]):
        plain, _ = plans.extract_orders(spark, [str(tmp_path / "a.jsonl")], find, "20260315", after=after)
        made, _ = plans.extract_orders(spark, [str(tmp_path / "a.jsonl")], find, "20260315", after=after, quarantine=str(tmp_path / f"q{k}"), told=counts.append)
        assert sorted(r["volume"] for r in made.collect()) == sorted(r["volume"] for r in plain.collect()) == want
    assert counts == [{"rows": 5, "kept": 2, lines.UNREADABLE: 2, lines.UNDATED: 1}] * 2
    assert spark.read.parquet(str(tmp_path / "q1")).where("set_aside = 'true'").count() == 3
