"""Queries over samples, splits, set operations, joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering, sampling
from .registry import query

_H = lambda c, p="42:": f"sha256('{p}' || {c})"


@query("t01_hash_sample", f"SELECT o_orderkey FROM orders ORDER BY {_H('o_orderkey')} LIMIT 200")
def _(t):
    return sampling.hash_sample(t.orders.select("o_orderkey"), 200, "o_orderkey")


@query("t02_prefixed_orders", f"SELECT 'w6' AS kind, * FROM (SELECT o_orderkey FROM orders ORDER BY {_H('o_orderkey', 'w6-stage1-42:')} LIMIT 50) UNION ALL SELECT 'w7', * FROM (SELECT o_orderkey FROM orders ORDER BY {_H('o_orderkey', 'w7-s2g-42:')} LIMIT 50) UNION ALL SELECT 'w55', * FROM (SELECT o_orderkey FROM orders ORDER BY {_H('o_orderkey', 'w55:42:')} LIMIT 50)")
def _(t):
    part = lambda k, p: sampling.hash_sample(t.orders.select("o_orderkey"), 50, "o_orderkey", p).select(F.lit(k).alias("kind"), "o_orderkey")
    return part("w6", "w6-stage1-42:").unionByName(part("w7", "w7-s2g-42:")).unionByName(part("w55", "w55:42:"))


@query("t03_shuffle_slice", f"SELECT doc_id FROM documents ORDER BY {_H('doc_id', 'shuffle-42:')} LIMIT 100 OFFSET 50")
def _(t):
    return t.documents.select("doc_id").orderBy(sampling.hash_key(F.col("doc_id"), "shuffle-42:"), "doc_id").offset(50).limit(100)


_CUTS = "CASE WHEN rn <= 300 THEN 'train' WHEN rn <= 400 THEN 'dev' WHEN rn <= 420 THEN 'val' END"


@query("t04_consecutive_slices", f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H('o_orderkey')}) AS rn FROM orders) SELECT o_orderkey, {_CUTS} AS split FROM r WHERE rn <= 420")
def _(t):
    rows = sampling.hash_sample(t.orders.select("o_orderkey"), 420, "o_orderkey")
    rows = rows.withColumn("rn", F.row_number().over(Window.orderBy(sampling.hash_key(F.col("o_orderkey")), "o_orderkey")))
    return rows.select("o_orderkey", F.when(F.col("rn") <= 300, "train").when(F.col("rn") <= 400, "dev").otherwise("val").alias("split"))


@query(
    "t05_ratio_split",
    "SELECT source, count(*) AS n, least(greatest(1, CAST(round_even(count(*) * 0.05::DOUBLE, 0) AS INT)), greatest(1, CAST(floor(count(*) / 10) AS INT))) AS n_dev FROM documents GROUP BY source",
)
def _(t):
    rows = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", "n", sampling.ratio_split(F.col("n"), 0.05).alias("n_dev"))


_QUOTA = """g AS (SELECT {key} AS k, count(*) AS total FROM {table} GROUP BY 1), r AS (SELECT *, {n} * total / (sum(total) OVER ())::DOUBLE AS raw FROM g),
 b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r), p AS (SELECT *, row_number() OVER (ORDER BY raw - base DESC, k DESC) AS place, {n} - sum(base) OVER () AS rest FROM b),
 quotas AS (SELECT k, total, base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS quota FROM p)"""


@query("w13_hamilton_quota", f"WITH {_QUOTA.format(key='source', table='documents', n=137)} SELECT k AS source, total, CAST(quota AS BIGINT) AS quota FROM quotas")
def _(t):
    return sampling.hamilton(t.documents.groupBy("source").agg(F.count("*").alias("total")), "source", "total", 137)


@query(
    "t06_stratified_take",
    f"WITH {_QUOTA.format(key='source', table='documents', n=137)}, d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H('doc_id')}) AS rn FROM documents) SELECT doc_id, source FROM d JOIN quotas ON source = k WHERE rn <= quota",
)
def _(t):
    return sampling.stratified(t.documents.select("doc_id", "source"), "source", 137, "doc_id").select("doc_id", "source")


@query("t07_equal_band_take", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H('doc_id')}) <= 20")
def _(t):
    return sampling.per_group(t.documents.select("doc_id", "lang"), ["lang"], 20, "doc_id").select("doc_id", "lang")


@query(
    "t08_stratified_smoke",
    f"""WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H('doc_id')}) AS rn FROM documents),
    first AS (SELECT doc_id, lang FROM r, k WHERE rn <= 42 // k), rest AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM first) ORDER BY {_H('doc_id')} LIMIT (42 - (SELECT count(*) FROM first)))
    SELECT * FROM first UNION ALL SELECT * FROM rest""",
)
def _(t):
    # first a share for each class, then the best of the rest: a rank of (in the share or not, hash)
    d, size = t.documents.select("doc_id", "lang"), 42
    k = d.select("lang").distinct().agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(sampling.hash_key(F.col("doc_id")), "doc_id"))
    rows = d.withColumn("rn", rank).crossJoin(F.broadcast(k)).withColumn("late", (F.col("rn") > F.floor(F.lit(size) / F.col("k"))).cast("int"))
    return rows.orderBy("late", sampling.hash_key(F.col("doc_id")), "doc_id").limit(size).select("doc_id", "lang")


@query(
    "t09_class_balance",
    f"WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY {_H('doc_id')}) <= (SELECT m FROM m)",
)
def _(t):
    return sampling.balanced(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@query(
    "t10_interleave",
    f"""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_H('doc_id')}) AS rn FROM labels)
    SELECT doc_id, toxic, CAST(row_number() OVER (ORDER BY rn, toxic) AS INT) AS place FROM r QUALIFY place <= 60""",
)
def _(t):
    rows = sampling.per_group(t.labels.select("doc_id", "toxic"), ["toxic"], 60, "doc_id")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rank", "toxic"))).filter("place <= 60").select("doc_id", "toxic", "place")


@query(
    "t11_sequential_fill",
    f"""WITH a AS (SELECT doc_id FROM documents WHERE n_chars < 800 ORDER BY {_H('doc_id')} LIMIT 40),
    b AS (SELECT doc_id FROM documents WHERE n_chars < 2000 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY {_H('doc_id')} LIMIT 60),
    c AS (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY {_H('doc_id')} LIMIT 50)
    SELECT doc_id, 'internal' AS category FROM a UNION ALL SELECT doc_id, 'search' FROM b UNION ALL SELECT doc_id, 'evidence' FROM c""",
)
def _(t):
    d = t.documents.select("doc_id", "n_chars", "lang")
    wanted = [("internal", F.col("n_chars") < 800, 40), ("search", F.col("n_chars") < 2000, 60), ("evidence", F.col("lang") == "en", 50)]
    return sampling.sequential_fill(d, "doc_id", wanted)


@query(
    "t12_quadrant_quota",
    f"""WITH s AS (SELECT doc_id, quality * 2 + toxic AS quadrant FROM labels),
    e AS (SELECT doc_id, quadrant FROM s WHERE quadrant <> 2 QUALIFY row_number() OVER (PARTITION BY quadrant ORDER BY {_H('doc_id')}) <= 10),
    h AS (SELECT s.doc_id, quadrant FROM s JOIN documents USING (doc_id) WHERE quadrant = 2 ORDER BY n_chars DESC, s.doc_id LIMIT 15) SELECT * FROM e UNION ALL SELECT * FROM h""",
)
def _(t):
    s = t.labels.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("quadrant"))
    easy = sampling.per_group(s.filter("quadrant <> 2"), ["quadrant"], 10, "doc_id").select("doc_id", "quadrant")
    hard = s.filter("quadrant = 2").join(t.documents.select("doc_id", "n_chars"), "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(15)
    return easy.unionByName(hard.select("doc_id", "quadrant"))


@query("t13_hard_mining", f"SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS class FROM labels ORDER BY class, {_H('doc_id')} LIMIT 70")
def _(t):
    kind = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return t.labels.select("doc_id", kind.alias("class")).orderBy("class", sampling.hash_key(F.col("doc_id")), "doc_id").limit(70)


@query(
    "t14_taxonomy_assign",
    f"""WITH l AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'A' WHEN n_chars < 1000 THEN 'B' WHEN n_chars < 2000 THEN 'C' ELSE 'O' END AS label FROM documents),
    b AS (SELECT doc_id, label, 'internal' AS category FROM l WHERE label = 'A' UNION ALL SELECT doc_id, label, 'search_format' FROM l WHERE label IN ('B', 'C')
      UNION ALL SELECT doc_id, label, 'evidence' FROM l WHERE label = 'C' UNION ALL SELECT doc_id, label, 'rejected' FROM l WHERE label = 'O')
    SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY category, label ORDER BY {_H('doc_id')}) <= CASE category WHEN 'search_format' THEN 60 ELSE 40 END""",
)
def _(t):
    n = F.col("n_chars")
    label = F.when(n < 500, "A").when(n < 1000, "B").when(n < 2000, "C").otherwise("O")
    kinds = F.when(label == "A", F.array(F.lit("internal"))).when(label == "B", F.array(F.lit("search_format"))).when(label == "C", F.array(F.lit("search_format"), F.lit("evidence"))).otherwise(F.array(F.lit("rejected")))
    rows = t.documents.select("doc_id", label.alias("label"), F.explode(kinds).alias("category"))
    return sampling.per_group(rows, ["category", "label"], F.when(F.col("category") == "search_format", 60).otherwise(40), "doc_id").select("doc_id", "label", "category")


@query("t15_oversample", "SELECT doc_id, toxic, CAST(c.copy AS INT) AS copy FROM labels, range(1, 4) AS c(copy) WHERE c.copy <= CASE WHEN toxic = 1 THEN 3 ELSE 1 END")
def _(t):
    return sampling.repeat(t.labels.select("doc_id", "toxic"), F.when(F.col("toxic") == 1, 3).otherwise(1))


@query("t16_best_row", "SELECT arm, sample_id, metric, tokens FROM runs ORDER BY metric >= 50 DESC, metric DESC, tokens, -sample_id DESC, arm LIMIT 1")
def _(t):
    return t.runs.orderBy(F.desc(F.col("metric") >= 50), F.desc("metric"), "tokens", F.desc(-F.col("sample_id")), "arm").limit(1).select("arm", "sample_id", "metric", "tokens")


_PAIR = "SELECT a.sample_id, a.metric AS a, b.metric AS b, b.metric - a.metric AS delta FROM runs a JOIN runs b USING (sample_id) WHERE a.arm = 'view' AND b.arm = 'click'"


def _pair(t):
    a = t.runs.filter("arm = 'view'").select("sample_id", F.col("metric").alias("a"))
    b = t.runs.filter("arm = 'click'").select("sample_id", F.col("metric").alias("b"))
    return a.join(b, "sample_id").withColumn("delta", F.col("b") - F.col("a"))


@query("t17_delta_examples", f"WITH p AS ({_PAIR}) SELECT * FROM (SELECT 'gain' AS side, * FROM p ORDER BY delta DESC, sample_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'loss', * FROM p ORDER BY delta, sample_id LIMIT 8)")
def _(t):
    p = _pair(t)
    top = p.orderBy(F.desc("delta"), "sample_id").limit(8).select(F.lit("gain").alias("side"), "*")
    return top.unionByName(p.orderBy("delta", "sample_id").limit(8).select(F.lit("loss").alias("side"), "*"))


@query("t18_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 75")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(75).limit(25)


@query("t19_category_order", "SELECT doc_id, lang, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS place FROM documents")
def _(t):
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    rows = ordering.ordered_places(t.documents.select("doc_id", "lang", order.alias("o")), ["o", "doc_id"])
    return rows.select("doc_id", "lang", (F.col("place") + 1).alias("place"))


@query("t20_ranked_evidence", "WITH e AS (SELECT conv_id, turn, 'E' || (turn + 1) AS evidence_id, length(text) % 7 AS score FROM conversations) SELECT conv_id, evidence_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY -score, turn // 3, evidence_id) AS INT) AS place FROM e QUALIFY place <= 8")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("E"), (F.col("turn") + 1).cast("string")).alias("evidence_id"), (F.length("text") % 7).alias("score"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.floor(F.col("turn") / 3), "evidence_id")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 8").select("conv_id", "evidence_id", "place")


# Set operations -----------------------------------------------------------

_A, _B = "(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')", "(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')"


def _ids(t, status):
    return t.orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"))


@query("u01_union_all", f"SELECT id, count(*) AS n FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}) GROUP BY id")
def _(t):
    return _ids(t, "F").unionByName(_ids(t, "O")).groupBy("id").agg(F.count("*").alias("n"))


@query("u02_union_distinct", f"SELECT * FROM {_A} UNION SELECT * FROM {_B}")
def _(t):
    return _ids(t, "F").union(_ids(t, "O")).distinct()


@query("u03_intersect", f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}")
def _(t):
    return _ids(t, "F").intersect(_ids(t, "O"))


@query("u04_except", f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}")
def _(t):
    return _ids(t, "F").subtract(_ids(t, "O"))


@query("u05_symmetric_difference", f"SELECT 'removed' AS side, * FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}) UNION ALL SELECT 'added', * FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})")
def _(t):
    a, b = _ids(t, "F"), _ids(t, "O")
    return a.subtract(b).select(F.lit("removed").alias("side"), "id").unionByName(b.subtract(a).select(F.lit("added").alias("side"), "id"))


@query("u06_set_equality", f"SELECT (SELECT count(*) FROM (SELECT * FROM {_A} EXCEPT ALL SELECT * FROM {_B})) + (SELECT count(*) FROM (SELECT * FROM {_B} EXCEPT ALL SELECT * FROM {_A})) = 0 AS equal, (SELECT count(*) FROM {_A}) = (SELECT count(*) FROM (SELECT * FROM {_A} INTERSECT ALL SELECT * FROM {_A})) AS itself")
def _(t):
    sign = lambda d, s: d.select("id", F.lit(s).alias("s"))
    # one pass: the multisets are equal if every id's signed count is 0
    a, b = _ids(t, "F"), _ids(t, "O")
    equal = lambda x, y: sign(x, 1).unionByName(sign(y, -1)).groupBy("id").agg(F.sum("s").alias("s")).agg((F.sum((F.col("s") != 0).cast("int")) == 0).alias("e"))
    return equal(a, b).select(F.col("e").alias("equal")).crossJoin(equal(a, a).select(F.col("e").alias("itself")))


@query(
    "u07_array_sets",
    "WITH s AS (SELECT doc_id, list_distinct(string_split(prediction, ' ')) AS a, list_distinct(string_split(golds[2], ' ')) AS b FROM qa) SELECT doc_id, list_sort(list_intersect(a, b)) AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_union, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM s",
)
def _(t):
    s = t.qa.select("doc_id", F.array_distinct(F.split("prediction", " ")).alias("a"), F.array_distinct(F.split(F.get("golds", 1), " ")).alias("b"))
    return s.select(
        "doc_id",
        F.array_sort(F.array_intersect("a", "b")).alias("both"),
        F.size(F.array_union("a", "b")).cast("long").alias("n_union"),
        F.array_sort(F.array_except("a", "b")).alias("only_a"),
        (F.size(F.array_except("b", "a")) == 0).alias("subset"),
    )


@query("u08_append_missing", "WITH s AS (SELECT doc_id, string_split(prediction, ' ') AS a, list_filter(string_split(golds[2], ' '), lambda x, i: list_position(string_split(golds[2], ' '), x) = i) AS b FROM qa) SELECT doc_id, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS merged FROM s")
def _(t):
    s = t.qa.select("doc_id", F.split("prediction", " ").alias("a"), F.array_distinct(F.split(F.get("golds", 1), " ")).alias("b"))
    return s.select("doc_id", F.concat("a", F.filter("b", lambda x: ~F.array_contains("a", x))).alias("merged"))


# Windows ------------------------------------------------------------------


@query("w01_best_attempt", "SELECT user_id, event_id, value > 50 AS valid FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value > 50 DESC, event_id) = 1")
def _(t):
    # the least struct of (invalid, attempt) is one combinable aggregate, no sort
    rows = t.events.groupBy("user_id").agg(F.min(F.struct((F.col("value") <= 50).alias("bad"), "event_id")).alias("m"))
    return rows.select("user_id", "m.event_id", (~F.col("m.bad")).alias("valid"))


@query("w02_priority_dedupe", "SELECT user_id, event_type, event_id, CAST(count(*) OVER (PARTITION BY user_id) - 1 AS BIGINT) AS duplicates FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) = 1")
def _(t):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = t.events.groupBy("user_id").agg(F.min(F.struct(p.alias("p"), "event_id", "event_type")).alias("m"), (F.count("*") - 1).alias("duplicates"))
    return rows.select("user_id", "m.event_type", "m.event_id", "duplicates")


@query("w03_duplicate_queries", "WITH n AS (SELECT trace_id, step_id, left(trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')), 2) AS k FROM steps WHERE step_type = 'search') SELECT trace_id, step_id, k, row_number() OVER (PARTITION BY trace_id, k ORDER BY step_id) > 1 AS duplicate FROM n")
def _(t):
    from ..functions.text import query_key

    n = t.steps.filter("step_type = 'search'").select("trace_id", "step_id", F.left(query_key("content"), F.lit(2)).alias("k"))
    return n.withColumn("duplicate", F.row_number().over(Window.partitionBy("trace_id", "k").orderBy("step_id")) > 1)


@query("w04_group_advantage", "SELECT arm, sample_id, round((metric - avg(metric) OVER w) / CASE WHEN stddev_pop(metric) OVER w > 1e-8 THEN stddev_pop(metric) OVER w ELSE 1 END, 6) AS advantage FROM runs WINDOW w AS (PARTITION BY sample_id)")
def _(t):
    from ..operators.audits import advantages

    return advantages(t.runs, "sample_id", "metric").select("arm", "sample_id", F.round("advantage", 6).alias("advantage"))


_MID = "rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE"


@query("w05_midrank", f"SELECT doc_id, {_MID} AS midrank FROM scores")
def _(t):
    from ..operators.audits import midranks

    return midranks(t.scores, "score").select("doc_id", "midrank")


@query("w06_cumulative_precision", "WITH r AS (SELECT doc_id, label, row_number() OVER w AS rn, sum(label) OVER w AS hits FROM scores WINDOW w AS (ORDER BY score DESC, label, doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, hits / rn::DOUBLE AS precision FROM r WHERE label = 1")
def _(t):
    from ..operators.audits import cumulative_precision

    return cumulative_precision(t.scores, "label", "score", "doc_id")


@query("w07_capped_top_k", "WITH r AS (SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 8")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))).filter("rn <= 2")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).filter("rn <= 8").drop("rn")


@query("w08_tertiles", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) - 1 AS pos, count(*) OVER () AS n FROM scores) SELECT doc_id, CASE WHEN pos < n // 3 THEN 'genuine_hard' WHEN pos < 2 * n // 3 THEN 'medium' ELSE 'near_solved' END AS band FROM r")
def _(t):
    return sampling.tertiles(t.scores, "score", "doc_id").select("doc_id", "band")


_NOV = "SELECT user_id AS episode, event_id, CAST(extract('day' FROM ts) AS INT) AS turn, event_type || (event_id % 3) AS url FROM events"


@query("w09_novelty_counters", f"WITH n AS ({_NOV}), f AS (SELECT episode, turn, CASE WHEN row_number() OVER (PARTITION BY episode, url ORDER BY turn, event_id) = 1 THEN 1 ELSE 0 END AS new FROM n) SELECT episode, turn, count(*) AS returned, CAST(sum(new) AS BIGINT) AS new_urls FROM f GROUP BY ALL")
def _(t):
    n = t.events.select(F.col("user_id").alias("episode"), "event_id", F.day("ts").alias("turn"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("url"))
    first = n.withColumn("new", (F.row_number().over(Window.partitionBy("episode", "url").orderBy("turn", "event_id")) == 1).cast("long"))
    return first.groupBy("episode", "turn").agg(F.count("*").alias("returned"), F.sum("new").alias("new_urls"))


@query("w10_stable_source_ids", f"WITH n AS ({_NOV}), f AS (SELECT episode, url, min(event_id) AS first FROM n GROUP BY ALL) SELECT episode, url, 'S' || row_number() OVER (PARTITION BY episode ORDER BY first) AS source_id FROM f")
def _(t):
    n = t.events.select(F.col("user_id").alias("episode"), "event_id", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("url"))
    first = n.groupBy("episode", "url").agg(F.min("event_id").alias("first"))
    number = F.row_number().over(Window.partitionBy("episode").orderBy("first"))
    return first.select("episode", "url", F.concat(F.lit("S"), number.cast("string")).alias("source_id"))


@query("w11_new_versus_all_prior", f"WITH n AS ({_NOV}), d AS (SELECT DISTINCT episode, turn, url FROM n) SELECT episode, turn, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM d p WHERE p.episode = d.episode AND p.url = d.url AND p.turn < d.turn) THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM d GROUP BY ALL")
def _(t):
    n = t.events.select(F.col("user_id").alias("episode"), F.day("ts").alias("turn"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("url")).distinct()
    first = n.withColumn("first", F.min("turn").over(Window.partitionBy("episode", "url")))
    return first.groupBy("episode", "turn").agg(F.sum((F.col("first") == F.col("turn")).cast("long")).alias("fresh"))


@query("w12_error_streak", "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island, bad ORDER BY event_id) AS streak FROM e WHERE bad) SELECT user_id, min(event_id) AS abort_at FROM s WHERE streak >= 2 GROUP BY user_id")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select("user_id", "event_id", (F.col("event_type") == "error").alias("bad")).withColumn("island", F.sum((~F.col("bad")).cast("int")).over(w))
    s = e.filter("bad").withColumn("streak", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("event_id")))
    return s.filter("streak >= 2").groupBy("user_id").agg(F.min("event_id").alias("abort_at"))


@query("w14_contiguous_shards", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS BIGINT) AS shard FROM orders")
def _(t):
    # places from sorted ranges and their counts, so no task holds all rows
    return ordering.ordered_places(t.orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.floor(F.col("place") / F.ceil(F.col("total") / 7)).alias("shard"))


@query("w15_previous_observation", "SELECT trace_id, step_id, lag(content) OVER (PARTITION BY trace_id ORDER BY step_id) AS previous FROM steps")
def _(t):
    return t.steps.select("trace_id", "step_id", F.lag("content").over(Window.partitionBy("trace_id").orderBy("step_id")).alias("previous"))


@query("w16_first_last_step", "SELECT trace_id, min(step_id) AS first_step, max(step_id) AS last_step, arg_max(content, step_id) AS answer FROM steps WHERE step_type = 'observation' GROUP BY trace_id")
def _(t):
    return t.steps.filter("step_type = 'observation'").groupBy("trace_id").agg(F.min("step_id").alias("first_step"), F.max("step_id").alias("last_step"), F.max_by("content", "step_id").alias("answer"))


@query("w17_round_slices", f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {_H('doc_id')}) - 1) // 30 + 1 AS BIGINT) AS round FROM documents QUALIFY round <= 3")
def _(t):
    rows = sampling.hash_sample(t.documents.select("doc_id"), 90, "doc_id")
    rn = F.row_number().over(Window.orderBy(sampling.hash_key(F.col("doc_id")), "doc_id"))
    return rows.select("doc_id", (F.floor((rn - 1) / 30) + 1).alias("round"))


@query("w18_proportional_split", f"WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_H('doc_id', 'w55:42:')}) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, toxic, CASE WHEN rn <= n * 0.6::DOUBLE THEN 'train' WHEN rn <= n * 0.8::DOUBLE THEN 'calib' ELSE 'dev' END AS split FROM r")
def _(t):
    w = Window.partitionBy("toxic")
    rows = t.labels.select("doc_id", "toxic", F.row_number().over(w.orderBy(sampling.hash_key(F.col("doc_id"), "w55:42:"), "doc_id")).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.select("doc_id", "toxic", F.when(F.col("rn") <= F.col("n") * 0.6, "train").when(F.col("rn") <= F.col("n") * 0.8, "calib").otherwise("dev").alias("split"))
