"""Stored runs: all or nothing, replaced by a repeat, found by their folders."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history
from tallyloom.plans import chats as plans
from tallyloom.sources.store import SLOTS, Store, slot


def tables(spark, job_id, n, tag="x"):
    orders = spark.createDataFrame([(f"20260315{i:03d}", tag, i) for i in range(n)], "order_number string, product string, volume long")
    chats = spark.createDataFrame([("f.csv", [("u", "m")], ("o",))], "file string, messages array<struct<user:string,message:string>>, result struct<order_name:string>")
    return {"extracted_orders": history.order_records(orders, job_id, "2026-01-01"), "training_data": history.training_records(chats, job_id, "me", "[]", "2026-01-01")}


def job(i, user="me", at="2026-01-01"):
    return {"id": i, "user_id": user, "created_at": at}


def test_a_failure_between_tables_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.jobs("me").collect() == [] and store.committed("extracted_orders").collect() == []
    broken = tables(spark, "a", 3)
    broken["training_data"] = broken["training_data"].withColumn("user_id", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        store.put(job("a"), broken)
    assert store.jobs().collect() == [] and store.committed("extracted_orders").collect() == []
    assert store.rows("extracted_orders", store.job("a")).collect() == []
    # not even a run that is whole but for its commit
    store.stage("a", tables(spark, "a", 3))
    assert store.committed("extracted_orders").collect() == []
    store.put(job("a"), tables(spark, "a", 2))
    assert store.committed("extracted_orders").count() == 2
    assert len(store.vacuum(3600)) == 0
    assert len(set(store.vacuum(0))) == 2
    assert store.committed("extracted_orders").count() == 2 and store.committed("training_data").count() == 1


def test_a_repeat_replaces(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.put(job("a"), tables(spark, "a", 3, "old"))
    store.put(job("b"), tables(spark, "b", 1))
    store.put({**job("a"), "title": "again"}, tables(spark, "a", 2, "new"))
    assert sorted((r["id"], r["title"], r["total_orders"]) for r in store.jobs("me").collect()) == [("a", "again", 2), ("b", "", 1)]
    assert [r["product"] for r in store.rows("extracted_orders", store.job("a")).collect()] == ["new"] * 2
    assert sorted(r["product"] for r in store.committed("extracted_orders").collect()) == ["new", "new", "x"]
    assert store.rows("extracted_orders", store.job("none")).collect() == []


def test_only_the_folders_of_the_jobs_are_read(spark, tmp_path):
    folder = str(tmp_path / "db")
    store = Store(spark, folder)
    for i in range(8):
        store.put(job(f"j{i}", "me" if i % 2 else "you", f"2026-01-0{i + 1}"), tables(spark, f"j{i}", i))
    recent = history.recent_jobs(store.jobs("me"), "me", 2)
    rows = store.rows("extracted_orders", recent)
    assert {p.rsplit("run=", 1)[1].split("/")[0] for p in rows.inputFiles()} == {r for _, r in store.runs(recent)}
    assert rows.count() == 5 + 7
    listed = plans.jobs_of(spark, folder, "me", 3)
    assert [(r["id"], r["total_orders"]) for r in listed.collect()] == [("j7", 7), ("j5", 5), ("j3", 3)]
    # totals come with the commits: no orders are read, and of the jobs only the user's slot
    assert all(f"extraction_jobs/slot={slot('me')}" in p for p in listed.inputFiles())
    assert 0 <= slot("me") < SLOTS and slot("me") != slot("you")
    with pytest.raises(ValueError, match="over 1 jobs"):
        store.runs(store.jobs(), most=1)


def test_totals_of_few_jobs_shuffle_only_their_orders(spark, tmp_path):
    orders = spark.range(100_000).select((F.col("id") % 1000).cast("string").alias("job_id"))
    orders.write.parquet(str(tmp_path / "o"))
    jobs = spark.createDataFrame([(f"{i}", "me", f"2026-01-{10 + i}") for i in range(20)], "id string, user_id string, created_at string")
    made = history.totals_of(history.recent_jobs(jobs, "me"), spark.read.parquet(str(tmp_path / "o")))
    assert sorted(map(tuple, made.collect())) == [(f"{i}", 100) for i in range(15, 20)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Scan parquet") - 600 :]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in below[: below.index("Scan parquet")].split("BroadcastHashJoin")[-1]


def test_stored_jobs_joins_once(spark, monkeypatch):
    """Orders are joined to their jobs before the jobs are stored, not again for each."""
    from tallyloom import catalogue

    plans_of, stage = [], Store.stage

    def watched(self, job_id, tables):
        plans_of.append(tables["extracted_orders"]._jdf.queryExecution().optimizedPlan().toString())
        return stage(self, job_id, tables)

    monkeypatch.setattr(Store, "stage", watched)
    catalogue.QUERIES["stored_jobs"](spark, "/root/testdata/sf0.001")
    assert len(plans_of) == 4 and not any("Join" in p for p in plans_of)
