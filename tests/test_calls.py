"""Services: asked once whatever fails, tried again, held to a rate, with their errors told."""

import os

import pytest

from tallyloom.operators import extract, zipcodes
from tallyloom.operators.calls import Bucket, Ledger, Policy, call

QUICK = Policy(wait=0.0, parts=2, flush=3)


def counting(folder, fails=lambda request, before: False):
    """A service that notes each call in folder, and fails where told to."""

    def ask(request):
        note = f"{folder}/{request.encode().hex()}"
        before = os.path.getsize(note) if os.path.exists(note) else 0
        with open(note, "a") as f:
            f.write(".")
        if fails(request, before):
            raise OSError(f"no answer to {request}")
        return None if request == "nothing" else request.upper()

    return ask


def calls(folder):
    return {bytes.fromhex(n).decode(): os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "notes").mkdir()
    return str(tmp_path / "notes")


def requests(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "request string")


def test_what_is_known_is_not_asked(spark, tmp_path, notes):
    ledger = Ledger(counting(notes), f"{tmp_path}/ledger", policy=QUICK)
    first = ledger.answers(requests(spark, ["a", "b", "b", None, "nothing"])).collect()
    assert sorted(map(tuple, first)) == [("a", "A", None), ("b", "B", None), ("nothing", None, None)]
    again = ledger.answers(requests(spark, ["b", "c", "nothing"])).collect()
    assert sorted(map(tuple, again)) == [("b", "B", None), ("c", "C", None), ("nothing", None, None)]
    assert calls(notes) == {"a": 1, "b": 1, "c": 1, "nothing": 1}
    other = Ledger(counting(notes), f"{tmp_path}/ledger", service="other", policy=QUICK)
    assert other.answers(requests(spark, ["a"])).collect()[0]["answer"] == "A"
    assert calls(notes)["a"] == 2


def test_a_run_that_was_stopped_asks_nothing_twice(spark, tmp_path, notes):
    def dies(request, before):
        if request == "r17":
            raise SystemExit("the worker is gone")
        return False

    texts = [f"r{i}" for i in range(40)]
    broken = Ledger(counting(notes, dies), f"{tmp_path}/ledger", policy=QUICK)
    with pytest.raises(Exception):
        broken.answers(requests(spark, texts)).collect()
    paid = {r["request"] for r in broken.rows(spark).collect()}
    assert paid
    whole = Ledger(counting(notes), f"{tmp_path}/ledger", policy=QUICK)
    assert sorted(r["answer"] for r in whole.answers(requests(spark, texts)).collect()) == sorted(t.upper() for t in texts)
    assert all(calls(notes)[t] == 1 for t in paid)
    assert all(n == 1 for t, n in calls(notes).items() if t != "r17" and t in paid)


def test_failing_calls_are_tried_again_and_told(spark, tmp_path, notes):
    ledger = Ledger(counting(notes, lambda r, before: r == "bad" or before < 2), f"{tmp_path}/ledger", policy=QUICK)
    made = {r["request"]: (r["answer"], r["error"]) for r in ledger.answers(requests(spark, ["x", "bad"])).collect()}
    assert made == {"x": ("X", None), "bad": (None, "OSError: no answer to bad")}
    assert calls(notes) == {"x": 3, "bad": 3}
    assert [tuple(r) for r in ledger.failures(spark).collect()] == [("bad", "OSError: no answer to bad", 3)]
    better = Ledger(counting(notes), f"{tmp_path}/ledger", policy=QUICK)
    assert better.answers(requests(spark, ["x", "bad"])).where("error is not null").count() == 0
    assert better.failures(spark).count() == 0
    assert calls(notes) == {"x": 3, "bad": 4}


def test_waits_double_and_each_attempt_takes_a_token():
    slept, taken = [], []

    class Counted(Bucket):
        def take(self):
            taken.append(1)

    def ask(_):
        raise ValueError("no")

    assert call(ask, "r", Policy(attempts=5, wait=1, longest_wait=5), Counted(None), slept.append) == (None, "ValueError: no", 5)
    assert slept == [1, 2, 4, 5] and len(taken) == 5


def test_rate_is_held():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = Bucket(10, 3, lambda: now[0], sleep)
    for _ in range(23):
        bucket.take()
    assert now[0] == pytest.approx(2.0)
    now[0] += 100
    for _ in range(3):
        bucket.take()
    assert now[0] == pytest.approx(102.0)


def test_rate_of_all_tasks(spark, tmp_path, notes):
    ledger = Ledger(counting(notes), f"{tmp_path}/ledger", policy=Policy(rate=20, parts=2))
    ledger.answers(requests(spark, [f"q{i}" for i in range(30)])).collect()
    at = sorted(r["at"] for r in ledger.rows(spark).collect())
    assert len(at) == 30 and at[-1] - at[0] >= (30 - 2) / 20 * 0.6


def test_addresses_and_chats_through_a_ledger(spark, tmp_path, notes):
    rows = spark.createDataFrame([("a",), (" a ",), ("bad",), ("",), (None,), ("odd",)], "address string")
    codes = Ledger(counting(notes, lambda r, before: r == "bad"), f"{tmp_path}/codes", policy=QUICK)
    words = Ledger(lambda r: "a" if r == "odd" else None, f"{tmp_path}/words", policy=QUICK)
    made = zipcodes.look_up(rows, zipcodes.from_ledger(codes), zipcodes.rewriter_from_ledger(words), errors="why").collect()
    assert sorted((r["address"] or "", r["zip_code"], r["why"]) for r in made) == [("", "", None), ("", "", None), (" a ", "A", None), ("a", "A", None), ("bad", "", "OSError: no answer to bad"), ("odd", "ODD", None)]
    chats = spark.createDataFrame([("x", [("u", "hi")]), ("y", [("u", "hi")]), ("z", [])], "file string, messages array<struct<user:string,message:string>>")

    def find(messages):
        open(f"{notes}/asked", "a").write(".")
        if not messages:
            raise ValueError("nothing was said")
        return {"order_name": messages[0]["user"], "items": []}

    kept = lambda ask: Ledger(ask, f"{tmp_path}/chats", policy=QUICK)
    for _ in range(2):
        said = {r["file"]: (r["result"] and r["result"]["order_name"], r["error"], len(r["messages"])) for r in extract.extracted(chats, find, ledger=kept).collect()}
        assert said == {"x": ("u", None, 1), "y": ("u", None, 1), "z": (None, "ValueError: nothing was said", 0)}
    assert os.path.getsize(f"{notes}/asked") == 1 + 3 + 3
    assert extract.extracted(chats, find).where("error is null").count() == 2
