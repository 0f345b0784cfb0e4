"""Readers and writers with the rules of stored research data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str | list[str], schema: str, max_rows: int | None = None) -> DataFrame:
    """JSONL by a declared schema; blank lines give no row.  ``path`` may hold globs."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.limit(max_rows) if max_rows else rows


def json_document(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A JSON file with a list of rows, or with an object that has them under ``rows``."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{row}>>")
    held = F.from_json("v", f"rows array<struct<{row}>>")["rows"]
    return whole.select(F.explode(F.when(F.col("v").startswith("["), listed).otherwise(held)).alias("r")).select("r.*")


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Lines of text (``value``) as rows."""
    return lines.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order column; rows without a key go.  One combinable aggregate."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")


def strict(df: DataFrame, key: str) -> DataFrame:
    """Fails on a row without a key."""
    return df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"row without {key}"))).otherwise(F.col(key)))


def id_list(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def source_ids(df: DataFrame) -> DataFrame:
    """Distinct ids from sample_id, else question_id, without the suffix of derived samples."""
    own = F.split(F.coalesce(*[F.col(c) for c in ("sample_id", "question_id") if c in df.columns]), "__graph_d")
    return df.select(F.get(own, 0).alias("id")).filter("id is not null").distinct()


def harvest(lines: DataFrame, pattern: str) -> DataFrame:
    """Distinct matches of a pattern in raw text, of whatever format the files are."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("id")).distinct()


def digest(df: DataFrame, row: Column, digits: int = 3) -> DataFrame:
    """One digest of a table's rows whatever their order: SHA-256 of sorted SHA-256, in two levels.

    Rows meet in buckets by the first ``digits`` hexadecimal digits of their
    hash, so no task sorts more than a bucket; take a digit more for 16 times
    the rows.  A null row counts for nothing, as in SQL.
    """
    own = df.select(F.sha2(row, 256).alias("h"))
    hashes = F.collect_list("h")  # without nulls; of no hash there is no digest
    whole = F.when(F.size(hashes) > 0, F.sha2(F.array_join(F.sort_array(hashes), ""), 256))
    return own.groupBy(F.substring("h", 1, digits).alias("b")).agg(whole.alias("h")).agg(whole.alias("digest"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``sha256`` of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def trainer_log(lines: DataFrame, order: str) -> DataFrame:
    """Lines ``step:N - key:value - ...``: ``step`` and ``metrics`` of the last line of each step."""
    step = F.regexp_extract("value", r"step:(\d+)", 1)
    rows = lines.filter(F.col("value").rlike(r"step:\d+ - ")).select(step.cast("long").alias("step"), order, "value")
    last = last_by_key(rows, "step", order)
    pairs = F.str_to_map(F.regexp_replace("value", r"^.*?step:\d+ - ", ""), F.lit(" - "), F.lit(":"))
    return last.select("step", pairs.alias("metrics"))


def snippet_documents(responses: DataFrame, id_col: str, body: str) -> DataFrame:
    """Documents of stored search responses: items without snippets go, a missing title is the URL."""
    items = F.from_json(body, "items array<struct<url:string,title:string,snippets:array<string>>>")["items"]
    rows = responses.select(id_col, F.posexplode(F.filter(items, lambda i: F.size(i["snippets"]) > 0)).alias("place", "i"))
    title = F.coalesce(F.nullif("i.title", F.lit("")), "i.url")
    return rows.select(id_col, (F.col("place") + 1).alias("rank"), title.alias("title"), F.col("i.url").alias("url"), F.array_join("i.snippets", "\n").alias("text"))


#: Links of a result page, and where its redirects keep the target.
RESULT_LINK = r'(?is)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
_ENTITIES = {"&quot;": '"', "&#39;": "'", "&#x27;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&amp;": "&"}


def _unescaped(c: Column) -> Column:
    for entity, character in _ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def _link_results(body: Column, pattern: str) -> Column:
    urls, titles = (F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in (1, 2))

    def one(r: Column) -> Column:
        url = _unescaped(r["u"])
        target = F.regexp_extract(url, "[?&]uddg=([^&#]+)", 1)
        title = F.trim(F.regexp_replace(_unescaped(r["t"]), "<[^>]+>", ""))
        return F.struct(title.alias("title"), F.when(target != "", F.try_url_decode(target)).otherwise(url).alias("url"), F.lit("").alias("snippet"))

    return F.transform(F.arrays_zip(urls.alias("u"), titles.alias("t")), one)


def _json_results(path: str, snippet: str):
    def parse(body: Column) -> Column:
        rows = F.from_json(F.get_json_object(body, path), f"array<struct<title:string,url:string,{snippet}:string>>")
        filled = lambda x: F.coalesce(x, F.lit(""))
        return F.transform(rows, lambda r: F.struct(filled(r["title"]).alias("title"), filled(r["url"]).alias("url"), filled(r[snippet]).alias("snippet")))

    return parse


#: Parsers of stored search responses by the form of the provider's answer.
RESULTS = {"links": lambda body: _link_results(body, RESULT_LINK), "anchors": lambda body: _link_results(body, r'(?is)<a href="([^"]+)">(.*?)</a>'), "web": _json_results("$.web.results", "description"), "list": _json_results("$.results", "content")}


def search_results(responses: DataFrame, id_col: str, body: str, form: str, count: int = 10) -> DataFrame:
    """``id_col``, ``rank``, ``title``, ``url``, ``snippet`` of the first ``count`` results of stored search responses."""
    if form not in RESULTS:
        raise ValueError(f"unknown form {form}; known are {sorted(RESULTS)}")
    rows = responses.select(id_col, F.posexplode(F.slice(RESULTS[form](F.col(body)), 1, count)).alias("place", "r"))
    return rows.select(id_col, (F.col("place") + 1).alias("rank"), "r.*")


def register(path: str, spark: SparkSession, name: str, file: str, columns: dict[str, str]) -> None:
    """Add a dataset to a registry (JSON lines): its file, and the names that its columns get.  The last entry of a name counts."""
    entry = spark.createDataFrame([(name, file, columns)], "name string, file_name string, columns map<string,string>")
    entry.withColumn("at", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").json(path)


def registered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dataset of a registry, with its columns under their registered names."""
    entries = spark.read.schema("name string, file_name string, columns map<string,string>, at long").json(path).filter(F.col("name") == name)
    entry = entries.agg(F.max_by(F.struct("file_name", "columns"), "at").alias("e")).first().e
    if entry is None:
        raise ValueError(f"unknown dataset {name}")
    rows = spark.read.parquet(entry.file_name)
    return rows.select(*[F.col(own).alias(given) for own, given in sorted(entry.columns.items())])


def stage_frozen(spark: SparkSession, folder: str, manifest: dict[str, str], target: str) -> dict[str, bool]:
    """Copy files of a folder to another one, each only if its SHA-256 is the manifest's; whether each was copied."""
    found = {r.path.rsplit("/", 1)[-1]: (r.path, r.sha256) for r in checksums(spark, folder).collect()}  # one row a file of the manifest's folder
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = {}
    for name, wanted in sorted(manifest.items()):
        path, own = found.get(name, (None, None))
        out[name] = own == wanted
        if out[name]:
            a, b = fs.Path(path), fs.Path(f"{target.rstrip('/')}/{name}")
            fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return out


def first_success(attempts: DataFrame, key: str, order: str, ok: str, value: str, costs: tuple[str, ...] = ()) -> DataFrame:
    """Of stored attempts at each key the first that succeeded, else the last: ``key``, ``value``, ``ok``, ``attempts``, ``degraded`` (a later one had to do).

    ``costs`` are columns of tokens, time or money that every attempt up to the one that counts has cost; their sums come last.
    """
    good = F.min(F.when(F.col(ok), F.struct(order, value)))
    rows = attempts.groupBy(key).agg(good.alias("good"), F.max(F.struct(order, value)).alias("last"), F.min(order).alias("first"), F.count("*").alias("attempts"))
    done = F.col("good").isNotNull()
    if costs:
        # attempts after the first success were never made
        end = rows.select(F.col(key).alias("_key"), F.coalesce(F.col("good")[order], F.col("last")[order]).alias("_end"))
        made = attempts.join(end, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col(order) <= F.col("_end"))
        spent = made.groupBy(F.col(key).alias("_key")).agg(*[F.sum(c).alias(c) for c in costs])
        rows = rows.join(spent, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return rows.select(key, F.when(done, F.col("good")[value]).otherwise(F.col("last")[value]).alias("value"), done.alias("ok"), "attempts", (done & (F.col("good")[order] > F.col("first"))).alias("degraded"), *costs)


class _Visible(HTMLParser):
    HIDDEN, BREAKS = frozenset(("script", "style", "noscript", "svg")), frozenset("p div br li h1 h2 h3 h4 h5 h6 tr section article".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Visible text of pages, block tags as line ends; by Arrow batches, as HTML needs a parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(1).to_pylist():
                parser = _Visible()
                parser.feed(page or "")
                parser.close()
                lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
                out.append("\n".join(x for x in lines if x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def swapped(df: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``df`` with each row whose key ``fresh`` has (once) given way to that row; others, and rows without a key, stay.

    A new table is written from it, the old one stays as it is.  Fresh rows
    whose key isn't there add nothing.
    """
    new = fresh.select(F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"))
    rows = df.select(F.struct(*df.columns).alias("_old")).join(new, F.col(f"_old.{key}") == F.col("_key"), "left")
    return rows.select(F.coalesce("_row", "_old").alias("r")).select("r.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in a local one only where none is set and Spark is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = "file://" + tempfile.mkdtemp(prefix="tallow-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read back, where several branches of a plan need it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(spark: SparkSession, paths: list[str], schema: str, key: list[str]) -> DataFrame:
    """Shards by several paths or globs, each path once, each key once."""
    rows = spark.read.schema(schema).json(sorted(set(paths)))
    return rows.dropDuplicates(key)


def guarded(write, path: str) -> bool:
    """Whether a write took place: false if the path holds data already."""
    try:
        write(path)
    except AnalysisException as e:
        if "EXISTS" not in (e.getCondition() or "").upper():
            raise
        return False
    return True


#: Readers of stored responses by a provider's name.
PROVIDERS = {"snippets": snippet_documents, "page": visible_text}


def documents_of(provider: str, responses: DataFrame, id_col: str, body: str) -> DataFrame:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}; known are {sorted(PROVIDERS)}")
    return PROVIDERS[provider](responses, id_col, body)
