"""A stand-in for the service, in this process, that notes what it is asked."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import remote

ROWS = [{"id": i, "user_id": f"u{i % 7}", "title": f"t{i}" if i % 3 else None, "secret": "x", "created_at": f"2026-01-{1 + i % 28:02d}T00:00:00", "n": i / 2} for i in range(500)]
TESTS = {"eq": lambda a, b: str(a) == b, "gt": lambda a, b: a > type(a)(b), "gte": lambda a, b: a >= type(a)(b), "lt": lambda a, b: a < type(a)(b), "lte": lambda a, b: a <= type(a)(b)}


@pytest.fixture
def service():
    asked, sent, refuse = [], [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = parse_qsl(urlparse(self.path).query)
            asked.append(query)
            if refuse:
                self.send_response(refuse.pop())
                self.end_headers()
                return
            rows, o = ROWS, dict(query)
            for column, test in query:
                if column in ("select", "order", "limit"):
                    continue
                name, _, told = test.partition(".")
                if test == "not.is.null":
                    rows = [r for r in rows if r[column] is not None]
                elif name == "in":
                    rows = [r for r in rows if str(r[column]) in told[1:-1].split(",")]
                else:
                    rows = [r for r in rows if r[column] is not None and TESTS[name](r[column], told)]
            rows = sorted(rows, key=lambda r: r["id"])[: int(o["limit"])]
            sent.extend(r["id"] for r in rows)
            body = json.dumps([{c: r[c] for c in o["select"].split(",")} for r in rows]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, sent, refuse
    server.shutdown()


def table(spark, url, schema="id long, user_id string, title string", **options):
    remote.register(spark)
    rows = spark.read.format("remote_table").schema(schema).option("url", url).option("table", "jobs").option("key", "id")
    for k, v in {"low": 0, "high": 400, "parts": 4, "page": 30, **options}.items():
        rows = rows.option(k, v)
    return rows.load()


def test_all_rows_by_ranges_and_pages(spark, service):
    url, asked, sent, _ = service
    made = sorted(table(spark, url, "id long, title string, created_at timestamp, n double").collect(), key=lambda r: r["id"])
    assert [(r["id"], r["title"], r["n"]) for r in made] == [(r["id"], r["title"], r["n"]) for r in ROWS]
    assert made[3]["created_at"].isoformat() == "2026-01-04T00:00:00"
    assert sorted(sent) == list(range(500))
    assert all(dict(q)["select"] == "id,title,created_at,n" and dict(q)["limit"] == "30" for q in asked)


def test_filters_reach_the_service(spark, service):
    url, asked, sent, _ = service
    rows = table(spark, url).where((F.col("user_id") == "u3") & (F.col("id") > 100) & (F.length("title") > 3)).collect()
    assert sorted(r["id"] for r in rows) == [r["id"] for r in ROWS if r["user_id"] == "u3" and r["id"] > 100 and r["title"] and len(r["title"]) > 3]
    # what the service doesn't know is left to Spark, the rest is never sent
    # that titles are needed follows from what is asked of them, and is told to the service too
    assert set(sent) == {r["id"] for r in ROWS if r["user_id"] == "u3" and r["id"] > 100 and r["title"]}
    assert all(("user_id", "eq.u3") in q and ("id", "gt.100") in q for q in asked)
    sent.clear()
    assert table(spark, url).where(F.col("id").isin(5, 7, 499)).count() == 3 and sorted(sent) == [5, 7, 499]


def test_pages_are_asked_again(spark, service):
    url, asked, sent, refuse = service
    refuse += [503, 429]
    assert table(spark, url, parts=1, page=200).count() == 500
    assert len(asked) == 5 and sorted(sent) == list(range(500))
    refuse.append(403)
    with pytest.raises(Exception, match="403"):
        table(spark, url).count()


def test_ranges_hold_every_key():
    for low, high, parts in ((0, 100, 4), (0, 0, 3), (5, 6, 10), (-10, 10, 1)):
        found = remote.ranges(low, high, parts)
        assert found[0].low is None and found[-1].high is None
        assert all(a.high == b.low for a, b in zip(found, found[1:], strict=False))
