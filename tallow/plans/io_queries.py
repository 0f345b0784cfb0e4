"""Queries that write, read back, and swap parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import builders, replay, retrieval
from ..sources import readers
from .registry import query


@query("s09_parquet_sink", "SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'Question: ' || question AS prompt FROM qa")
def _(t):
    path = readers.scratch(t.spark, "rl")
    readers.write_parquet(t.qa.select(*builders.rl_row(F.col("doc_id").cast("string"), F.col("question"), F.col("golds"), "train")), path)
    return t.spark.read.parquet(path).select("extra_info.sample_id", F.get("prompt", 0)["content"].alias("prompt"))


@query("s10_json_sink", "SELECT doc_id, prediction FROM qa")
def _(t):
    path = readers.scratch(t.spark, "jsonl")
    readers.write_json_lines(t.qa.select("doc_id", "prediction"), path)
    return readers.json_lines(t.spark, path, "doc_id long, prediction string")


@query("s11_append_log", "SELECT doc_id, toxic FROM labels")
def _(t):
    path = readers.scratch(t.spark, "log")
    for half in (0, 1):
        readers.append_log(t.labels.filter(F.col("doc_id") % 2 == half).select("doc_id", "toxic"), path)
    return readers.json_lines(t.spark, path, "doc_id long, toxic int")


@query("s13_shard_merge", "SELECT doc_id, lang FROM documents")
def _(t):
    path = readers.scratch(t.spark, "shards")
    for shard in range(3):
        # neighbouring shards overlap
        readers.write_json_lines(t.documents.filter(F.col("doc_id") % 3 <= shard).select("doc_id", "lang"), f"{path}/part{shard}")
    return readers.merged(t.spark, [f"{path}/part*", f"{path}/part*"], "doc_id long, lang string", ["doc_id"])


@query("s14_json_document", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = readers.scratch(t.spark, "document")
    # the document is one value, as small as the table of nations
    whole = t.nation.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return readers.json_document(t.spark, f"{path}/*.txt", "n_nationkey: int, n_name: string")


@query("s25_checksums", "SELECT sha256(string_agg(r_name, '' ORDER BY r_regionkey) || chr(10)) AS sha256 FROM region")
def _(t):
    path = readers.scratch(t.spark, "sums")
    whole = t.region.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]), "").alias("value"))
    whole.coalesce(1).write.text(path)
    return readers.checksums(t.spark, path).filter("path like '%.txt'").select("sha256")


@query("s26_overwrite_guard", "SELECT true AS first, false AS second, true AS same")
def _(t):
    path, rows = readers.scratch(t.spark, "guard"), t.nation.select("n_nationkey", "n_name")
    first, second = (readers.guarded(lambda p: readers.write_parquet(rows, p), path) for _ in range(2))
    return t.spark.range(1).select(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(readers.same_rows(rows, t.spark.read.parquet(path))).alias("same"))


@query("z01_injected_strategies", "SELECT doc_id, 'find ' || prediction AS query, len(golds) AS n_documents FROM qa")
def _(t):
    generate = lambda s: s.select("doc_id", F.concat(F.lit("find "), "prediction").alias("query"))
    retrieve = lambda s: s.join(t.qa.select("doc_id", F.size("golds").cast("long").alias("n_documents")), "doc_id")
    return replay.rollout(t.qa, generate, retrieve)


@query("z04_provider_switch")
def _(t):
    return readers.documents_of("page", t.pages, "page_id", "html").select("page_id", F.length("text").alias("n"))


@query("z05_weights_from_settings", "SELECT event_id, 1.0::DOUBLE * value + 0.5::DOUBLE * value + 0.1::DOUBLE * value - 0.0::DOUBLE * value - 0.0::DOUBLE * value AS reward FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", scores.reward(v, v, v, v, v, scores.weights_of(t.spark)).alias("reward"))


@query("k02b_paragraph_candidates")
def _(t):
    asked = t.benchmark.select("item_id", F.lower("text").alias("q"))
    pages = t.item_of(t.documents).join(asked, "item_id").select("doc_id", "text", "q")
    return retrieval.chunks(pages, F.col("q"), "doc_id", "text", most=600)
