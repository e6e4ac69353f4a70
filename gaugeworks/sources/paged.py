"""A paged web API as a Spark data source: one partition a range of rows, counted before it is trusted.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema(S).option("url", "https://...").option("key", "Items").load()

Pages are fetched by the executors, with retries.  A partition is a page, or with
``sweep`` ("column,low,high,step") a range of keys, or a list of at most ``LIST``
keys where a condition names them.  Conditions that the service understands are
passed on (with ``spark.sql.python.filterPushdown.enabled``), the ``filter`` option
adds one in the service's own words.  When pages hold fewer rows than the service
counted, or rows lie outside the swept keys, the read fails instead of returning
a short table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import datasource
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

PAGE, LIST = 1000, 45
_OPERATORS = {
    datasource.EqualTo: "eq",
    datasource.GreaterThan: "gt",
    datasource.GreaterThanOrEqual: "ge",
    datasource.LessThan: "lt",
    datasource.LessThanOrEqual: "le",
}


def fetch(url: str, tries: int = 4, wait: float = 1.0, opener: Callable = urlopen) -> dict:
    """JSON of a URL; waits twice as long after each failure, then raises."""
    for k in range(tries):
        try:
            with opener(url) as r:
                return json.load(r)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("tries must be positive")


def _literal(value: object) -> str | None:
    """A value in the service's words, times in UTC; None where it has none."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | Decimal):
        return str(value)
    if isinstance(value, datetime):
        whole = value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
        return f"'{whole:%Y-%m-%dT%H:%M:%S}.{whole.microsecond // 1000:03d}z'" if whole.microsecond % 1000 == 0 else None
    if isinstance(value, date):
        return f"'{value:%Y-%m-%d}T00:00:00.000z'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else None


def _compared(column: str, word: str, value: object) -> str | None:
    """``column word value`` in the service's words; a day stands for all its times there."""
    if isinstance(value, date) and not isinstance(value, datetime):
        day, next_ = _literal(value), _literal(value + timedelta(1))
        words = {"eq": f"({column} ge {day} and {column} lt {next_})", "gt": f"{column} ge {next_}", "ge": f"{column} ge {day}", "lt": f"{column} lt {day}", "le": f"{column} lt {next_}"}
        return words[word]
    text = _literal(value)
    return None if text is None else f"{column} {word} {text}"


def _value(x: object, kind: DataType) -> object:
    """A JSON value as a column of ``kind`` takes it: dates and times are text there, numbers may be."""
    if x is None or x == "":
        return x if isinstance(kind, StringType) else None
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        moment = datetime.fromisoformat(str(x).upper().replace("Z", "+00:00"))
        moment = moment.astimezone(UTC) if moment.tzinfo else moment.replace(tzinfo=UTC)
        return moment.date() if isinstance(kind, DateType) else moment.replace(tzinfo=None) if isinstance(kind, TimestampNTZType) else moment
    if isinstance(kind, DecimalType):
        return Decimal(str(x))
    return float(x) if isinstance(kind, DoubleType | FloatType) else x


def clause(condition: datasource.Filter) -> str | None:
    """A condition on one column in the service's words; None where Spark has to judge it."""
    if isinstance(condition, datasource.Not):
        inner = clause(condition.child)
        return None if inner is None else f"not ({inner})"
    column = "/".join(condition.attribute)
    if isinstance(condition, datasource.IsNotNull | datasource.IsNull):
        return f"{column} {'ne' if isinstance(condition, datasource.IsNotNull) else 'eq'} null"
    if isinstance(condition, datasource.In):
        values = [_compared(column, "eq", v) for v in condition.value]
        return None if None in values or not values else "(" + " or ".join(values) + ")"
    word = _OPERATORS.get(type(condition))
    return None if word is None else _compared(column, word, getattr(condition, "value", None))


@dataclass
class Page(InputPartition):
    """Rows from ``skip`` on, or with ``rows`` -1 all rows that meet ``keys``."""

    skip: int
    rows: int
    keys: str = ""


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.kinds, self.options = [f.name for f in schema.fields], [f.dataType for f in schema.fields], options
        self.pushed, self.lists = [options["filter"]] if "filter" in options else [], []
        self.size = int(options.get("page", PAGE))

    def pushFilters(self, filters: list[datasource.Filter]) -> Iterator[datasource.Filter]:
        for f in filters:
            words = clause(f)
            if words is None or isinstance(f, datasource.Not):
                yield f  # services differ in what a negation makes of null, so Spark judges it too
            if words is None:
                continue
            if isinstance(f, datasource.In) and len(f.value) > LIST and not self.lists:
                # one request takes no more keys, so each list is a partition
                keys = sorted(set(f.value))
                self.lists = [clause(datasource.In(f.attribute, tuple(keys[k : k + LIST]))) for k in range(0, len(keys), LIST)]
            else:
                self.pushed.append(words)

    def _url(self, keys: str = "", **more: object) -> str:
        query, every = {"$format": "json", **more}, [*self.pushed, *([keys] if keys else [])]
        if every:
            query["$filter"] = every[0] if len(every) == 1 else " and ".join(f"({c})" for c in every)
        return f"{self.options['url']}?{urlencode(query)}"

    def _count(self, keys: str = "") -> int:
        return int(fetch(self._url(keys, **{"$top": 1, "$inlinecount": "allpages"}))["metadata"]["count"])

    def partitions(self) -> list[Page]:
        if self.lists:
            return [Page(0, -1, keys) for keys in self.lists]
        if "sweep" in self.options:
            column, low, high, step = (part.strip() for part in self.options["sweep"].split(","))
            low, high, step = int(low), int(high), int(step)
            outside = self._count() - self._count(f"{column} ge {low} and {column} lt {high}")
            if outside:
                raise ValueError(f"{outside} rows lie outside the swept keys")
            return [Page(0, -1, f"{column} ge {k} and {column} lt {min(k + step, high)}") for k in range(low, high, step)]
        total = self._count()
        return [Page(k, min(self.size, total - k)) for k in range(0, total, self.size)] or [Page(0, 0)]

    def _page(self, skip: int, rows: int, keys: str) -> list[dict]:
        order = self.options.get("orderby", "id")
        got = fetch(self._url(keys, **{"$top": rows, "$skip": skip, "$orderby": order, "$select": ",".join(self.names)}))[self.options["key"]]
        if len(got) < rows:
            raise ValueError(f"short pull: {len(got)} of {rows} rows from {skip}")
        return got

    def read(self, partition: Page) -> Iterator[tuple]:
        total = self._count(partition.keys) if partition.rows < 0 else partition.rows
        for k in range(0, total, self.size):
            for row in self._page(partition.skip + k, min(self.size, total - k), partition.keys):
                yield tuple(_value(row.get(n), kind) for n, kind in zip(self.names, self.kinds, strict=True))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)
