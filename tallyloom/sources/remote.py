"""A table behind a REST service as a data source: rows by ranges of a key, page by page, only those and the columns that are asked for.

    spark.dataSource.register(RemoteTable)
    spark.read.format("remote_table").schema("id long, user_id string").option("url", ...).option("table", "jobs").option("key", "id").load()

The service answers GET url/table?select=columns&column=operator.value&order=key.asc&limit=n with a JSON list of objects. Each
task reads its own range of keys, each page from behind the last key of the page before, so that a page costs the same
however far it is, and rows that are added meanwhile disturb none. A task that is run again reads its pages again.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Filters that the service knows, and how it calls them.
OPERATORS = {ds.EqualTo: "eq", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "gte", ds.LessThan: "lt", ds.LessThanOrEqual: "lte"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RemoteTable)


@dataclass
class KeyRange(ds.InputPartition):
    """Keys from low, included, to high, not included; None is open."""

    low: int | None
    high: int | None


def ranges(low: int, high: int, parts: int) -> list[KeyRange]:
    """`parts` ranges that hold all keys: low and high only say where most are, the first and last ones are open."""
    bounds = sorted({low + (high - low) * i // parts for i in range(1, parts)})
    return [KeyRange(a, b) for a, b in zip([None, *bounds], [*bounds, None], strict=True)]


class RemoteTable(ds.DataSource):
    """Options: url, table, key (an integer column), low and high (about where keys are), parts, page (rows), attempts, token."""

    @classmethod
    def name(cls) -> str:
        return "remote_table"

    def reader(self, schema: T.StructType) -> RemoteReader:
        return RemoteReader(schema, dict(self.options))


class RemoteReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options, self.asked = schema, options, []
        self.key = options["key"]
        if self.key not in schema.names:
            raise ValueError(f"the schema lacks the key {self.key}")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            told = self._told(f)
            if told is None:
                yield f
            else:
                self.asked.append(told)

    def _told(self, f: ds.Filter) -> tuple[str, str] | None:
        """A filter as a pair of the address, None if the service doesn't know it."""
        if isinstance(f, ds.IsNotNull) and len(f.attribute) == 1:
            return f.attribute[0], "not.is.null"
        if isinstance(f, ds.In) and len(f.attribute) == 1 and all(isinstance(v, int) for v in f.value):
            return f.attribute[0], f"in.({','.join(map(str, f.value))})"
        for kind, name in OPERATORS.items():
            if type(f) is kind and len(f.attribute) == 1 and isinstance(f.value, (int, str)) and not isinstance(f.value, bool):
                return f.attribute[0], f"{name}.{f.value}"
        return None

    def partitions(self) -> list[KeyRange]:
        o = self.options
        return ranges(int(o.get("low", 0)), int(o.get("high", 0)), max(1, int(o.get("parts", 1))))

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        last, page = None, int(self.options.get("page", 1000))
        while True:
            bounds = [(self.key, f"gt.{last}")] if last is not None else [(self.key, f"gte.{partition.low}")] if partition.low is not None else []
            bounds += [(self.key, f"lt.{partition.high}")] if partition.high is not None else []
            rows = self._page([("select", ",".join(self.schema.names)), *self.asked, *bounds, ("order", f"{self.key}.asc"), ("limit", str(page))])
            yield from (tuple(value(r.get(f.name), f.dataType) for f in self.schema.fields) for r in rows)
            if len(rows) < page:
                return
            last = rows[-1][self.key]

    def _page(self, query: list[tuple[str, str]]) -> list[dict]:
        """One page; refusals that may pass are asked again after waits that double."""
        o, wait = self.options, 0.2
        address = f"{o['url'].rstrip('/')}/{o['table']}?{urllib.parse.urlencode(query)}"
        request = urllib.request.Request(address, headers={"Authorization": f"Bearer {o['token']}"} if "token" in o else {})
        for left in range(int(o.get("attempts", 4)) - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", 30))) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if not left or (e.code < 500 and e.code != 429):
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(wait)
            wait *= 2
        raise AssertionError("unreachable")


def value(told, kind: T.DataType):
    """A JSON value as the column's type."""
    if told is None:
        return None
    if isinstance(kind, T.StringType):
        return told if isinstance(told, str) else json.dumps(told, ensure_ascii=False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(told)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(told)
    return {T.BooleanType: bool, T.DoubleType: float, T.FloatType: float}.get(type(kind), int)(told)
