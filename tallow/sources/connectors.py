"""Search connectors over stored responses: a Python data source for batch and streams.

``store()`` writes responses (``seq``, ``request``, ``provider``, ``page``,
``attempt``, ``status``, ``body``) in folders by provider and page of results;
``register()`` makes them readable as

    spark.read.format("stored_search").load(path)
    spark.readStream.format("stored_search").option("admit", 100).option("ledger", ...).load(path)

A row is a result: ``request``, ``provider``, ``page``, ``rank``, ``title``,
``url``, ``snippet``, ``ok``, ``attempts``, ``degraded``, ``error``.  Attempts
are replayed by the connectors' rule: those that a later one may mend are
tried again, ``retries`` times at most; a response after the first attempt is
degraded; a request without one gives a row of its own with rank 0 and the
last error, so that no request is lost.

Files hold ranges of ``seq``, all attempts of a request together.  Filters on
provider and page leave out whole folders before any file is opened.

Folders may be on any file system that pyarrow opens by its URI.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "request string, provider string, page int, rank int, title string, url string, snippet string, ok boolean, attempts int, degraded boolean, error string"
#: Statuses that a later attempt may mend, and the form of each provider's answers.
AGAIN = (429, 500, 502, 503, 504)
FORMS = {"duckduckgo": "links", "brave": "web", "searxng": "list", "stored": "anchors"}
_LINKS = {"links": re.compile(r'class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>', re.I | re.S), "anchors": re.compile(r'<a href="([^"]+)">(.*?)</a>', re.I | re.S)}
#: Where the JSON forms keep results, and the snippet of one.
_LISTS = {"web": (("web", "results"), "description"), "list": (("results",), "content")}


def store(responses: DataFrame, path: str, files: int | None = None) -> None:
    """Write responses; a page of a provider gets about ``files`` files, each a range of ``seq``."""
    rows = responses.select("seq", "request", "provider", "page", "attempt", "status", "body")
    keys = ("provider", "page", "seq")
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys, "attempt").write.partitionBy("provider", "page").parquet(path)


def results(body: str, form: str) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of a stored response; none if it can't be read."""
    if form in _LINKS:
        out = []
        for link, title in _LINKS[form].findall(body):
            url = html.unescape(link)
            target = re.search(r"[?&]uddg=([^&#]+)", url)
            out.append((re.sub(r"<[^>]+>", "", html.unescape(title)).strip(), unquote(target[1]) if target else url, ""))
        return out
    names, snippet = _LISTS[form]
    try:
        at = json.loads(body)
        for name in names:
            at = at[name]
        return [tuple(x.get(k) or "" for k in ("title", "url", snippet)) for x in at]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


class _Part(InputPartition):
    def __init__(self, path: str, provider: str, page: int, first: int | None = None, last: int | None = None) -> None:
        self.path, self.provider, self.page, self.first, self.last = path, provider, page, first, last


class _Stored:
    """The files of a folder and the rows of one; what batch and stream readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.retries, self.count, self.form = options["path"], int(options.get("retries", 3)), int(options.get("count", 10)), options.get("form")

    def files(self) -> list[_Part]:
        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            m = re.search(r"/provider=([^/]+)/page=(\d+)/[^/_.][^/]*\.parquet$", f.path)
            if f.is_file and m:
                out.append(_Part(f.path, unquote(m[1]), int(m[2])))
        return sorted(out, key=lambda p: (p.provider, p.page, p.path))

    def range_of(self, path: str) -> tuple[int, int]:
        """The least and largest seq of a file, from its statistics."""
        meta = pq.read_metadata(path, filesystem=fs.FileSystem.from_uri(self.path)[0])
        column = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == "seq")
        stats = [meta.row_group(k).column(column).statistics for k in range(meta.num_row_groups)]
        return min(s.min for s in stats), max(s.max for s in stats)

    def rows(self, part: _Part) -> Iterator[tuple]:
        form = self.form or FORMS.get(part.provider)
        if form not in _LINKS and form not in _LISTS:
            raise ValueError(f"unknown form {form} of provider {part.provider}; known are {sorted([*_LINKS, *_LISTS])}")
        bounds = None if part.first is None else [("seq", ">=", part.first), ("seq", "<", part.last)]
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(part.path) as file:
            pieces = pq.ParquetFile(file).iter_batches(1024, columns=["seq", "request", "attempt", "status", "body"])
            each = (r for piece in pieces for r in piece.to_pylist())
            for (seq, request), tries in groupby(each, key=lambda r: (r["seq"], r["request"])):
                if bounds is None or part.first <= seq < part.last:
                    yield from self.replayed(request, part, form, list(tries))

    def replayed(self, request: str, part: _Part, form: str, tries: list[dict]) -> Iterator[tuple]:
        head, n = (request, part.provider, part.page), 0
        for n, t in enumerate(tries[: self.retries + 1], 1):
            if t["status"] == 200:
                for rank, found in enumerate(results(t["body"] or "", form)[: self.count], 1):
                    yield (*head, (part.page - 1) * self.count + rank, *found, True, n, n > 1, None)
                return
            if t["status"] not in AGAIN:
                break
        yield (*head, 0, None, None, None, False, n, True, f"HTTP {t['status']}")

    def batches(self, part: _Part, size: int = 1024) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row in self.rows(part):
            held.append(row)
            if len(held) == size:
                yield batch()
                held.clear()
        if held:
            yield batch()


class _Batch(DataSourceReader):
    """One partition a file; only files of the providers and pages that filters leave."""

    def __init__(self, options: dict[str, str]) -> None:
        self.stored, self.only = _Stored(options), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("provider",), ("page",)):
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[_Part]:
        fits = lambda p: all(getattr(p, k) in v for k, v in self.only.items())
        # without any file one partition without rows
        return [p for p in self.stored.files() if fits(p)] or [_Part("", "", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.stored.batches(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """Requests in the order of ``seq``, at most ``admit`` of them a micro-batch: with the trigger's interval, the rate.

    The offset is the next seq.  ``ledger`` is a file, beside the query's
    checkpoint, that holds the end of the last batch that was planned; the
    limit counts from there after a restart, as Spark tells a reader where it
    goes on only with the next batch.
    """

    def __init__(self, options: dict[str, str]) -> None:
        if "ledger" not in options:
            raise ValueError("a stream needs the option ledger, a file beside the checkpoint")
        self.stored, self.admit, self.ledger, self.ranges = _Stored(options), int(options.get("admit", 1000)), options["ledger"], {}
        self.next = self._read()

    def _read(self) -> int:
        system, path = fs.FileSystem.from_uri(self.ledger)
        if not system.get_file_info(path).is_file:
            return 0
        with system.open_input_file(path) as f:
            return json.loads(f.read())["next"]

    def _planned(self, end: int) -> None:
        if end > self.next:
            system, path = fs.FileSystem.from_uri(self.ledger)
            with system.open_output_stream(f"{path}.tmp") as f:
                f.write(json.dumps({"next": end}).encode())
            system.move(f"{path}.tmp", path)
            self.next = end

    def _files(self) -> list[_Part]:
        parts = self.stored.files()
        for p in parts:
            if p.path not in self.ranges:
                self.ranges[p.path] = self.stored.range_of(p.path)
        return parts

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self._files()
        total = 1 + max((last for _, last in self.ranges.values()), default=-1)
        return {"next": max(self.next, min(total, self.next + self.admit))}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self._planned(end["next"])
        fits = [p for p in self._files() if self.ranges[p.path][0] < end["next"] and self.ranges[p.path][1] >= start["next"]]
        return [_Part(p.path, p.provider, p.page, start["next"], end["next"]) for p in fits]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.stored.batches(partition)


class StoredSearch(DataSource):
    """Options: path; ``retries`` (3), ``count`` results a response (10), ``form`` of answers (by provider); a stream's ``admit`` and ``ledger``."""

    @classmethod
    def name(cls) -> str:
        return "stored_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredSearch)


def admitted(spark: SparkSession, path: str, target: str, admit: int, **options) -> None:
    """Run the stream until nothing is left, into a Parquet folder ``target`` with its checkpoint and ledger beside it; goes on where an earlier run ended."""
    register(spark)
    reader = spark.readStream.format("stored_search").options(admit=admit, ledger=f"{target}-ledger.json", **options)
    query = reader.load(path).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
