"""Cached pages of a paged price service as a Spark source.

The service answers a request (symbol, floor, to) with the newest bars up to `to`, a page at most. A cache holds an answer as
JSON under the hash of its request. Reading walks the cursor back: after a page `to` is the day before its earliest bar, until
a page is missing or empty, is short, or reaches `start`, or `max_calls` pages were read. A bar met twice counts as the later
page has it.

    spark.dataSource.register(PagedPrices)
    spark.read.format("paged_prices").schema("symbol string, date date, adjClose double, _failure string")
         .option("symbols", listed).load(folder)

Only the columns of the given schema are built. `symbols` names a text file with a symbol a line; tasks take `per_task`
symbols each, so a long list is many tasks, and more symbols where that would be over `MAX_TASKS` tasks. With
spark.sql.python.filterPushdown.enabled filters on symbol (= and in) leave out the other symbols' pages. A symbol whose pages
can't be read does not end the job: it gives one row with its reason in `_failure` and no bars (none of its earlier pages
either), which `settled` puts aside."""

from __future__ import annotations

import datetime
import functools
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.window import Window

PAGE, FLOOR, START, MAX_CALLS, PER_TASK, MAX_TASKS = 4999, "1990-01-01", "1998-06-01", 5, 50, 1000
SCHEMA = "symbol string, date date, adjOpen double, adjHigh double, adjLow double, adjClose double, volume double, _failure string"


def page_key(symbol: str, floor: str, to: str | None) -> str:
    """The cache's name for a request; None: up to today."""
    import hashlib

    return hashlib.sha1("|".join(["historical", symbol, floor, str(to)]).encode()).hexdigest()[:16]


def walk(fetch, start: str, page: int, max_calls: int, to: str | None = None) -> list[dict]:
    """The bars that the cursor meets; fetch gives a page's bars, or none, for a `to`."""
    seen: dict[str, dict] = {}
    for _ in range(max_calls):
        rows = fetch(to)
        if not rows:
            break
        for r in rows:
            seen[r["date"]] = r
        earliest = min(r["date"] for r in rows)
        if earliest <= start or len(rows) < page:
            break
        to = (datetime.date.fromisoformat(earliest) - datetime.timedelta(days=1)).isoformat()
    return list(seen.values())


@functools.lru_cache(maxsize=1 << 16)
def _day(text: str) -> datetime.date:
    """A bar's date; symbols share most of theirs."""
    return datetime.date.fromisoformat(text)


class _Symbols(InputPartition):
    def __init__(self, symbols: list[str]) -> None:
        self.symbols = symbols


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema, self.only = options, schema, None

    def _opener(self, path: str) -> Callable[[str], bytes | None]:
        """Reads the file at path with an ending, none if it is missing; the file system is looked up once."""
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

        def read(ending: str) -> bytes | None:
            try:
                with fs.open_input_file(f"{root}{ending}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        return read

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("symbol",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        listed = self._opener(self.options["symbols"])("")
        if listed is None:
            raise FileNotFoundError(self.options["symbols"])
        symbols = [s for s in dict.fromkeys(listed.decode().split("\n")) if s and (self.only is None or s in self.only)]
        size = max(int(self.options.get("per_task", PER_TASK)), -(-len(symbols) // MAX_TASKS))
        return [_Symbols(symbols[lo : lo + size]) for lo in range(0, len(symbols), size)] or [_Symbols([])]

    def read(self, partition: _Symbols) -> Iterator[pa.RecordBatch]:
        o = self.options
        floor, start, page, calls = o.get("floor", FLOOR), o.get("start", START), int(o.get("page", PAGE)), int(o.get("max_calls", MAX_CALLS))
        opened = self._opener(o["path"])
        for symbol in partition.symbols:
            asked = []

            def fetch(to: str | None, symbol: str = symbol, asked: list = asked) -> list[dict]:
                asked.append(to)
                data = opened(f"/{page_key(symbol, floor, to)}.json")
                rows = [] if data is None else json.loads(data)
                for r in rows:
                    _day(r["date"])
                return rows

            try:
                rows, failure = walk(fetch, start, page, calls, o.get("to")), None
                columns = [self._column(f, symbol, rows) for f in self.schema.fields]
            except Exception as e:  # log and go on: a symbol's reason is a row of the result
                rows, failure = [], f"page {len(asked)}: {type(e).__name__}"
            if failure:
                columns = [pa.array([symbol if f.name == "symbol" else failure if f.name == "_failure" else None], self._kind(f)) for f in self.schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)

    def _kind(self, f: T.StructField) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(f.dataType)

    def _column(self, f: T.StructField, symbol: str, rows: list[dict]) -> pa.Array:
        if f.name in ("symbol", "_failure"):
            values = [symbol if f.name == "symbol" else None] * len(rows)
        elif isinstance(f.dataType, T.DateType):
            values = [_day(r[f.name]) for r in rows]
        elif isinstance(f.dataType, T.DoubleType):
            values = [None if r.get(f.name) is None else float(r[f.name]) for r in rows]
        else:
            values = [r.get(f.name) for r in rows]
        return pa.array(values, self._kind(f))


class PagedPrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def read_pages(spark: SparkSession, folder: str, symbols: str, schema: str = SCHEMA, **options: object) -> DataFrame:
    """The bars and failures of the cache in folder for the symbols listed in a file."""
    spark.dataSource.register(PagedPrices)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("paged_prices").schema(schema).option("symbols", symbols)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(folder)


def settled(df: DataFrame, failures: str) -> DataFrame:
    """The bars of a read; its failures (symbol, _failure) are written to a side table first. Fewer than a row a symbol."""
    df.where(F.col("_failure").isNotNull()).select("symbol", "_failure").write.mode("overwrite").parquet(failures)
    return df.where(F.col("_failure").isNull()).drop("_failure")


def write_pages(bars: DataFrame, folder: str, page: int = PAGE, floor: str = FLOOR, broken: str = "false") -> None:
    """Put bars (symbol, date, fields) into the cache as the service would answer the walking cursor; pages for which the
    expression `broken` (over symbol and p, the page's number) holds are cut off. Pages are dealt out to tasks."""
    others = [c for c in bars.columns if c not in ("symbol", "date")]
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = bars.withColumn("p", F.floor((F.row_number().over(w) - 1) / page)).withColumn("bar", F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), *others))
    pages = rows.groupBy("symbol", "p").agg(F.max("date").alias("newest"), F.min("date").alias("oldest"), F.to_json(F.sort_array(F.collect_list("bar"), False)).alias("body"))
    before = F.lag("oldest").over(Window.partitionBy("symbol").orderBy("p"))
    to = F.when(F.col("p") > 0, F.date_format(F.date_sub(before, 1), "yyyy-MM-dd"))
    pages = pages.withColumn("to", to).withColumn("body", F.expr(f"if({broken}, left(body, length(body) div 2), body)"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in batches:
            for symbol, until, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_output_stream(f"{root}/{page_key(symbol, floor, until)}.json") as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    pages.select(F.col("symbol").cast("string").alias("symbol"), "to", "body").mapInArrow(put, "n long").agg(F.sum("n")).collect()
