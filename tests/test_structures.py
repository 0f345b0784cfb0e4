"""Stored and streaming structures: index, quantiles, connectors, once-only logs, versions, digests, table function."""

import hashlib
import json
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallow.functions.steps import split_steps
from tallow.operators import quantiles
from tallow.operators.index import Index
from tallow.sources import connectors, digests
from tallow.sources.versions import ConflictError, Versioned
from tallow.streaming import logs

# Index ------------------------------------------------------------------------


def slow_bm25(docs, query, k, k1=1.5, b=0.75):
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    weight = lambda w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
    part = lambda w, ws: ws.count(w) * (k1 + 1) / (ws.count(w) + k1 * (1 - b + b * len(ws) / max(1.0, avgdl)))
    scored = {d: sum(weight(w) * part(w, ws) for w in query if w in ws) for d, ws in docs.items()}
    return sorted(((round(s, 8), d) for d, s in scored.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_index_gives_the_best_and_skips_blocks(spark, tmp_path):
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = {g: {d: rnd.choices(words, k=rnd.randint(0, 30)) for d in range(n)} for g, n in ((1, 400), (2, 3), (3, 60))}
    rows = [(g, d, ws) for g, own in docs.items() for d, ws in own.items()]
    index = Index.build(spark.createDataFrame(rows, "group long, candidate long, terms array<string>"), str(tmp_path / "index"), block=8, folders=4)
    queries = [(k, g, [*rnd.choices(words, k=rnd.randint(1, 5)), "unknown"], 5) for k, g in enumerate([1, 1, 1, 1, 2, 3, 3])] + [(7, 2, [], 5)]
    asked = spark.createDataFrame(queries, "query long, group long, terms array<string>, k int").cache()
    got = {}
    for r in index.top(asked).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.score, r.candidate)
    for k, g, terms, n in queries:
        assert [got[k][i + 1] for i in range(len(got[k]))] == slow_bm25(docs[g], terms, n), k
    read, needed = (f(asked).agg(F.sum(F.size("entries"))).first()[0] for f in (index.blocks, index.needed))
    met = sum(sum(w in ws for ws in docs[g].values()) for _, g, terms, _ in queries for w in set(terms))
    assert read == met < len(queries) * len(rows) and needed < 0.8 * read  # only candidates with a common term, and of these not all
    again = Index.open(spark, str(tmp_path / "index"))
    assert again.folders == 4 and again.postings.count() == index.postings.count()


def test_index_searches_by_shards_and_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    from tallow.operators import index as module

    monkeypatch.setattr(module, "SHARD", 50)
    monkeypatch.setattr(module, "CHUNK", 2)
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(2000)]
    docs = {d: rnd.choices(words, k=rnd.randint(0, 30)) for d in range(600)}
    index = Index.build(spark.createDataFrame([(1, d, ws) for d, ws in docs.items()], "group long, candidate long, terms array<string>"), str(tmp_path / "index"), block=8, folders=4)
    assert index.groups.first().shards == 12
    assert index.postings.groupBy("shard", "term").agg(F.sum(F.size("entries")).alias("n")).agg(F.max("n")).first()[0] <= 100  # no list grows with the group
    queries = {q: rnd.choices(words, k=rnd.randint(0, 6)) for q in range(9)}
    asked = spark.createDataFrame([(q, 1, ws, 5) for q, ws in queries.items()], "query long, group long, terms array<string>, k int")
    got = {}
    for r in index.top(asked).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.score, r.candidate)
    assert {q: [own[i + 1] for i in range(5)] for q, own in got.items()} == {q: slow_bm25(docs, ws, 5) for q, ws in queries.items()}
    # what leaves a shard are its best, not all candidates that share a term
    assert index._by_shard(asked, 8).groupBy("query").count().agg(F.max("count")).first()[0] <= 5 * 12


# Quantiles --------------------------------------------------------------------


def test_quantiles_equal_those_of_sorted_values(spark):
    rnd = random.Random(2)
    inf = float("inf")
    groups = {"a": [rnd.gauss(0, 1) for _ in range(900)], "b": [1.5] * 400 + [2.5] * 300 + [rnd.random() for _ in range(50)], None: [2.0**-k for k in range(200)], "c": [-inf, 1.0, 2.0, inf] * 30, "d": [7.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    wanted = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    ranks = {r.g: r for r in quantiles.nearest_ranks(df, "g", "x", wanted, buckets=64, few=20).collect()}
    lines = {r.g: r for r in quantiles.linear_quantiles(df.filter("g <> 'c' or g is null"), "g", "x", {"q3": 0.3}, buckets=64, few=20).collect()}
    assert set(ranks) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        assert all(ranks[g][k] == xs[round((len(xs) - 1) * q)] for k, q in wanted.items()), g
        if g != "c":
            at = (len(xs) - 1) * 0.3
            assert abs(lines[g].q3 - (xs[math.floor(at)] + (at - math.floor(at)) * (xs[math.ceil(at)] - xs[math.floor(at)]))) < 1e-12
    whole = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 10**15 + 9 * 10**17).alias("x"))
    assert quantiles.nearest_ranks(whole, "g", "x", {"p": 0.25}, buckets=4, few=5).first().p == 250 * 10**15 + 9 * 10**17


# Connectors -------------------------------------------------------------------

LINK = '<a class="result__a" rel=x href="//d.com/l/?uddg=https%3A%2F%2Fe.org%2Fa%3Fb&amp;rut=1">A &amp; <b>B</b></a>'


def responses(spark, path, n=40):
    rows = []
    for k in range(n):
        tries = {0: [(200, LINK)], 1: [(503, None), (429, None), (200, LINK)], 2: [(503, None)] * 6, 3: [(404, None), (200, LINK)]}[k % 4]
        for a, (status, body) in enumerate(tries, 1):
            rows.append((k, f"q{k}", "duckduckgo", 1, a, status, body))
        rows.append((k, f"q{k}", "searxng", 2, 1, 200, json.dumps({"results": [{"title": "t", "url": f"u{k}"}, {"content": "c"}]})))
    frame = spark.createDataFrame(rows, "seq long, request string, provider string, page int, attempt int, status int, body string")
    connectors.store(frame, path, 4)
    return rows


def test_connector_replays_attempts_and_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "responses")
    responses(spark, path)
    connectors.register(spark)
    frame = spark.read.format("stored_search").load(path)
    got = {(r.request, r.page, r["rank"]): r for r in frame.collect()}
    assert len(got) == 40 + 80
    assert tuple(got["q0", 1, 1])[4:] == ("A & B", "https://e.org/a?b", "", True, 1, False, None)
    assert got["q1", 1, 1].degraded and got["q1", 1, 1].attempts == 3
    assert tuple(got["q2", 1, 0])[4:] == (None, None, None, False, 4, True, "HTTP 503") and tuple(got["q3", 1, 0])[7:] == (False, 1, True, "HTTP 404")
    assert got["q5", 2, 11].url == "u5" and got["q5", 2, 12].snippet == "c"
    one = frame.filter("provider = 'searxng' and page in (2, 3)")
    assert one.count() == 80 and 1 <= one.rdd.getNumPartitions() < frame.rdd.getNumPartitions()
    assert spark.read.format("stored_search").load(path).filter("provider = 'none'").count() == 0
    with pytest.raises(Exception, match="unknown form x"):
        spark.read.format("stored_search").option("form", "x").load(path).collect()


def test_admitted_stream_goes_on_where_it_ended(spark, tmp_path):
    path, target = str(tmp_path / "responses"), str(tmp_path / "out")
    responses(spark, path)
    connectors.register(spark)
    reader = spark.readStream.format("stored_search").options(admit=7, ledger=f"{target}-ledger.json").load(path)
    seen, query = [], None

    def stop_after_two(batch, batch_id):
        seen.append(batch.select("request").distinct().count())
        batch.write.mode("overwrite").parquet(f"{target}/{batch_id}")
        if batch_id == 2:
            raise RuntimeError("killed")

    query = reader.writeStream.foreachBatch(stop_after_two).option("checkpointLocation", f"{target}-checkpoint").start()
    with pytest.raises(Exception, match="killed"):
        query.processAllAvailable()

    def go_on(batch, batch_id):
        seen.append(batch.select("request").distinct().count())
        batch.write.mode("overwrite").parquet(f"{target}/{batch_id}")

    query = reader.writeStream.foreachBatch(go_on).option("checkpointLocation", f"{target}-checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert max(seen) == 7 and len(seen) == 7  # six batches, one of them twice
    got = sorted(map(str, spark.read.schema(connectors.SCHEMA).option("recursiveFileLookup", "true").parquet(target).collect()))
    assert got == sorted(map(str, spark.read.format("stored_search").load(path).collect()))


# Logs -------------------------------------------------------------------------


def test_once_log_survives_a_kill_between_write_and_commit(spark, tmp_path):
    rows = [(k % 25, f"v{k}") for k in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("id long, v string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = logs.OnceLog(spark, f"file://{tmp_path}/log", "id", "id long, v string")
    commit = log.commit

    def killed(batch_id):
        if batch_id == 2:
            raise RuntimeError("killed")
        commit(batch_id)

    log.commit = killed
    with pytest.raises(Exception, match="killed"):
        log.start(stream).processAllAvailable()
    assert log.committed() == [0, 1] and log.read().count() == 20
    again = logs.OnceLog(spark, f"file://{tmp_path}/log", "id", "id long, v string")
    query = again.start(stream)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in again.read().collect()) == list(range(25))
    again.write(spark.createDataFrame([(99, "x")], "id long, v string"), 3)  # a replay of a committed batch adds nothing
    assert again.read().count() == 25


def test_states_of_idle_keys_go_and_a_restart_goes_on(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "g long, k long, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(idle, rows, wait=0):
        stream = spark.readStream.schema("g long, k long, bad boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = logs.stream_until_streak(stream, "g", "k", "bad", 2, idle).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            for _ in range(120):
                if query.exception() or (any((tmp_path / "out").glob("*.parquet")) and len(out()) >= rows):
                    break
                time.sleep(0.5)
            time.sleep(wait)
        finally:
            query.stop()
        assert query.exception() is None

    out = lambda: sorted(tuple(r) for r in spark.read.schema("g long, k long, bad boolean").parquet(str(tmp_path / "out")).collect())
    put("a", [(1, 1, False), (1, 2, True), (2, 1, True)])
    run(3_600_000, 3)
    put("b", [(1, 3, True), (1, 4, False), (2, 2, False)])
    run(1, 5, wait=5)  # another query from the checkpoint: the run that began before goes on; then the timers pass
    assert out() == [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, True), (2, 2, False)]
    put("c", [(1, 9, True), (1, 10, True), (1, 11, False)])
    run(1, 7)
    assert out()[3:5] == [(1, 9, True), (1, 10, True)] and len(out()) == 7


# Versions and digests ---------------------------------------------------------


def test_of_two_writers_one_wins(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = spark.range(100).select("id", F.lit("old").alias("x")).repartitionByRange(5, "id")
    first = Versioned.create(rows, path)
    sums = lambda files: {f: hashlib.sha256((tmp_path / "table" / f).read_bytes()).hexdigest() for f in files}
    before = sums(first.files)
    fresh = lambda ids, x: spark.createDataFrame([(i, x) for i in ids], "id long, x string")
    one, two = Versioned.open(spark, path), Versioned.open(spark, path)
    won = one.replace_rows(fresh([3, 4, 500], "won"), "id")
    with pytest.raises(ConflictError, match="version 1"):
        two.replace_rows(fresh([3, 90], "lost"), "id")
    latest = Versioned.open(spark, path)
    assert latest.version == 1 and latest.files == won.files
    kept = set(first.files) & set(latest.files)
    assert len(kept) == 4 and sums(kept) == {f: before[f] for f in kept}
    assert sorted(r.id for r in latest.read().filter("x = 'won'").collect()) == [3, 4] and latest.read().count() == 100
    assert {p.name for p in (tmp_path / "table" / "data").iterdir()} == {f.split("/")[1] for f in (*first.files, *latest.files)}  # nothing is left of the loser
    assert Versioned.open(spark, path, 0).read().filter("x = 'old'").count() == 100
    assert latest.replace_rows(fresh([1000], "none"), "id").version == 1


def test_digest_is_kept_up_to_date(spark):
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, x string")
    of = lambda df: digests.row_digest(df, F.concat_ws("|", "id", "x"))
    whole, value = of(frame(range(100)).repartition(7)), lambda d: d.first().digest
    assert value(digests.combined(of(frame(range(60))), of(frame(range(60, 100))))) == value(whole)
    assert value(digests.combined(whole, removed=of(frame([5, 6])))) == value(of(frame([k for k in range(100) if k not in (5, 6)])))
    assert value(of(frame([1, 1]))) != value(of(frame([1]))) and value(of(frame([]).limit(0)) if False else of(frame([1]).limit(0))).startswith("0-")
    parts = [int(hashlib.sha256(f"{i}|v{i}".encode()).hexdigest()[:8], 16) for i in range(100)]
    assert whole.first().s0 == sum(parts) % 2**64


def test_table_function_keeps_state_by_trajectory(spark):
    rows = [("a", 2, "<search>x</search>"), ("a", 1, "<think> t </think> <SEARCH>y</SEARCH><answer></answer>"), ("b", 1, "no tags"), ("b", 2, "<search>z</search>"), ("c", 1, None)]
    got = sorted(tuple(r) for r in split_steps(spark.createDataFrame(rows, "id string, n int, t string"), "id", "n", "t").collect())
    assert got == [("a", 1, 0, "think", "t", 0), ("a", 1, 1, "search", "y", 1), ("a", 2, 2, "search", "x", 2), ("b", 2, 0, "search", "z", 1)]
