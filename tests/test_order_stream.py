"""Chats as streams: closed once, late messages aside, numbers that go on, restarts from the checkpoint."""

import time

import pytest

from tallyloom.operators import extract
from tallyloom.operators.calls import Ledger, Policy
from tallyloom.streaming import chats as watching
from tallyloom.streaming import orders as streams

GAP = 3


def put(folder, name, rows, header="DATE,USER,MESSAGE"):
    at = {"DATE": 0, "USER": 1, "MESSAGE": 2}
    order = [at[h] for h in header.split(",")]
    part = folder / f".{name}"
    part.write_text("\n".join([header, *[",".join(r[i] for i in order) for r in rows]]) + "\n", encoding="utf-8")
    part.rename(folder / name)


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "asked").mkdir()
    find = extract.by_catalog({"apple": [], "pear": []})

    def ask(messages):
        (tmp_path / "asked" / f"{time.time_ns()}").touch()
        return find(messages)

    kept = lambda f: Ledger(f, f"{tmp_path}/ledger", policy=Policy(wait=0.0, parts=1))

    def until(done):
        """From the checkpoint, as after a restart, until done() holds; then the stream is stopped."""
        source = watching.watch_chats(spark, str(tmp_path / "in"))
        # files of one chat are told apart by what is behind the plus sign
        source = source.selectExpr("split(file, '[+]')[0] AS file", "user", "message", "time")
        q = streams.order_stream(source, ask, "20260315", f"{tmp_path}/out", f"{tmp_path}/state", GAP, kept, processingTime="1 second")
        try:
            for _ in range(200):
                assert q.exception() is None
                if done():
                    return
                time.sleep(0.5)
            raise AssertionError("the stream doesn't get there")
        finally:
            q.stop()

    return until


def table(spark, tmp_path, name):
    folder = tmp_path / "out" / name
    whole = [str(p) for p in folder.glob("batch=*") if (p / "_SUCCESS").exists()] if folder.exists() else []
    return spark.read.parquet(*whole).collect() if whole else []


def test_batches_with_late_rows_and_restarts(spark, tmp_path, run):
    orders = lambda: sorted((r["order_number"], r["chat_name"], r["product"], r["volume"]) for r in table(spark, tmp_path, "orders"))
    put(tmp_path / "in", "kim+1.csv", [("2026-03-12 10:02:00", "kim", "apple 2"), ("2026-03-12 10:00:00", "kim", "hello")])
    put(tmp_path / "in", "lee+1.csv", [("2026-03-12 09:00:00", "lee", "pear 1")], "USER,MESSAGE,DATE")
    put(tmp_path / "in", "park+1.csv", [("2026-03-12 11:00:00", "park", "hi")])
    run(lambda: len(orders()) == 2)
    assert [x[1:] for x in orders()] == [("lee", "pear", 1), ("kim", "apple", 2)] or {x[1:] for x in orders()} == {("lee", "pear", 1), ("kim", "apple", 2)}
    # park had nothing to order, and uses no number; what kim says now is late
    put(tmp_path / "in", "kim+2.csv", [("2026-03-12 10:05:00", "kim", "apple 9")])
    put(tmp_path / "in", "choi+1.csv", [("2026-03-12 08:00:00", "choi", "pear 7")])
    run(lambda: len(orders()) == 3 and table(spark, tmp_path, "late"))
    assert [(r["file"], r["message"]) for r in table(spark, tmp_path, "late")] == [("kim", "apple 9")]
    assert [x[0] for x in orders()] == ["20260315001", "20260315002", "20260315003"] and orders()[2][1:] == ("choi", "pear", 7)
    before = orders()
    put(tmp_path / "in", "kim+3.csv", [("2026-03-12 10:06:00", "kim", "pear 1")])
    run(lambda: len(table(spark, tmp_path, "late")) == 2)
    assert orders() == before
    assert len(list((tmp_path / "asked").iterdir())) == 4
    assert streams.numbered_before(spark, f"{tmp_path}/out", 10**9) == 3 and streams.numbered_before(spark, f"{tmp_path}/none", 5) == 0
