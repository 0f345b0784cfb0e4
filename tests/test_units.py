"""Fixture cases and edge cases of functions and operators."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tallow import plans
from tallow.functions import predicates, scores, tags, text
from tallow.operators import audits, builders, memory, ordering, replay, sampling, summaries, validators
from tallow.sources import readers
from tallow.streaming import logs


@pytest.fixture
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("v")).first().v

    return of


@pytest.mark.parametrize(("a", "b"), [("The  Cat, sat!", "cat sat"), ("a an the", ""), ("", ""), ("theatre's", "theatres"), ("A.B.C. the end", "abc end")])
def test_normalize_answer(value, a, b):
    assert value(text.normalize_answer(F.lit(a))) == b


@pytest.mark.parametrize(
    ("p", "golds", "f1"), [("", [""], 1.0), ("", ["x"], 0.0), ("x", [], 0.0), ("b b c", ["b c c", "b b c"], 1.0), ("x y", ["x z"], 0.5), ("3rd", ["the third"], 0.0)]
)
def test_token_f1(value, p, golds, f1):
    array = F.array(*map(F.lit, golds)).cast("array<string>")
    assert value(scores.best_prf(F.lit(p), array))["f1"] == f1


def test_ordinals_and_short_subsets(value):
    assert value(scores.acceptance_f1(F.lit("3rd"), F.array(F.lit("the third")))) == 1.0
    assert value(scores.acceptance_f1(F.lit("London"), F.array(F.lit("London England UK")))) == 1.0
    assert value(scores.acceptance_f1(F.lit("a b c d"), F.array(F.lit("zz")))) == 0.0


def test_empty_evidence_differs_between_evaluation_and_reward(value):
    none = F.array().cast("array<string>")
    assert value(scores.set_prf(none, none))["f1"] == 1.0 and value(scores.evidence_reward(none, none)) == 0.0


def test_title_hits_are_those_of_a_search_word_by_word(spark):
    key = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ")
    want = lambda title, body: sorted({w for w in title.split(" ") if key(w) and key(w) in key(body)})
    titles = ("", " ", "the Cat", "Cat  the the", "é -- ñ", "foo-bar --foo, BAR!", "x\ny z", "in ca", "9 -9 q", "ÑA Ωσς", "un-seen words", "\u212a k")
    bodies = ("", "a Cat.\nThe cat", "cat\nthe", "foo bar", "so: un seen\nfoo-bar é", "x y, z 9", "ωσσ ña in\ncat", "k \u212a --")
    rows = [(t, b) for t in titles for own in bodies for b in (own, own + "\n" + t, t + own)]
    got = spark.createDataFrame(rows, "t string, b string").select("t", "b", predicates.title_hits(F.col("t"), F.col("b")).alias("h")).collect()
    assert [(r.t, r.b, r.h) for r in got] == [(t, b, want(t, b)) for t, b in rows]
    assert {len(r.h) for r in got} >= {0, 1, 2}


def test_hits_of_a_long_title_take_no_search_a_word(spark, tmp_path):
    # 60,000 words in a line of 0.5 MB: a search for each word would compare 1.5e10 bytes
    words = [f"word{k:05}" for k in range(60_000)]
    frame = lambda x, schema, name: spark.createDataFrame(x, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame([(1, "first\n" + " ".join(words))], "doc_id long, text string", "documents")
    frame([(0, "asked")], "item_id long, text string", "benchmark")
    began = time.perf_counter()
    got = plans.QUERIES["m16_title_hits"](spark, str(tmp_path)).collect()
    assert [r.hits for r in got] == [words, []] and time.perf_counter() - began < 20
    began = time.perf_counter()
    body = F.concat(F.array_join(F.reverse("w"), "\n"), F.lit(" end"))  # in another order: told by hashing
    rows = spark.createDataFrame([(words,)], "w array<string>").select(F.array_join("w", " ").alias("t"), body.alias("b"))
    assert rows.select(predicates.title_hits(F.col("t"), F.col("b")).alias("h")).first().h == words and time.perf_counter() - began < 20


def test_depth_labels(value):
    n = text.normalize_answer
    seen = text.padded_contains(n(F.lit("Ada Example was born in London.")), n(F.lit("London")))
    assert value(predicates.depth(seen, F.lit(False)))["reason"] == "answer_visible_after_search1"
    assert value(predicates.depth(F.lit(False), F.lit(True))).depth == 2 and value(predicates.depth(F.lit(False), F.lit(False))).depth == 0


def test_conditioning(value):
    got = predicates.conditioning(F.lit("Peter Szewczyk nationality"), F.lit("who made it"), F.lit("nothing here"), F.lit("Peter Szewczyk's nationality"))
    assert value(got) == "missing_state_refinement"


def test_actions_by_priority_and_loose_answers(value):
    assert value(tags.first_action(F.lit("<internal>x</internal><search>q</search>"))) == "search"
    assert value(tags.first_action(F.lit("<search>q</search><answer>a</answer>"))) == "answer"
    assert value(tags.loose_answer(F.lit("Paris </answer>"))) == "Paris" and value(tags.loose_answer(F.lit("no tag"))) is None
    assert value(tags.open_evidence(F.lit("<evidence> body"))) == "body" and value(tags.open_evidence(F.lit("<evidence>b</evidence>"))) is None


def test_steps_keep_the_order_of_the_text(value):
    got = value(tags.tag_steps(F.lit("<search>q</search> x <think>t</think><answer> </answer>")))
    assert [s.step_type for s in got] == ["search", "think"]


def test_memory_text(value):
    memo = F.lit("Known: x\nMissing:\n- birthplace\n* date\nDecision: SEARCH\nNext Query: Ada Example birthplace")
    assert value(tags.memory_missing(memo)) == ["birthplace", "date"] and value(tags.memory_decision(memo)) == "SEARCH"
    assert value(tags.memory_next_query(memo)) == "Ada Example birthplace"
    assert value(tags.memory_missing(F.lit("Missing: None.\nDecision: ANSWER"))) == []


def test_step_validator(spark):
    def errors(*steps):
        rows = spark.createDataFrame([(list(steps),)], "steps array<struct<step_id:int,step_type:string,content:string,loss_mask:boolean>>")
        return rows.select(validators.step_errors(F.col("steps")).alias("e")).first().e

    assert errors((0, "search", "q", True), (1, "observation", "o", False), (2, "answer", "a", True)) == []
    assert len(errors((1, "serch", " ", True))) == 4
    assert errors((0, "answer", "a", True), (1, "search", "q", True)) == ["the answer step must be the last step"]


def test_trace_validator(spark):
    schema = (
        "question string, steps array<struct<step_id:int,step_type:string,content:string,loss_mask:boolean,document_ids:array<string>,evidence_ids:array<string>>>,"
        " documents array<string>, evidences array<struct<evidence_id:string,document_id:string>>, cost struct<" + ",".join(f"{k}:double" for k in validators.COSTS) + ">"
    )

    def errors(question="q", documents=("D1",), evidences=(("E1", "D1"),), cost=(0.0,) * len(validators.COSTS), cited=("D1",), used=("E1",)):
        row = (question, [(0, "answer", "a", True, list(cited), list(used))], list(documents), list(evidences), tuple(cost))
        return spark.createDataFrame([row], schema).select(validators.trace_errors(*map(F.col, ("question", "steps", "documents", "evidences", "cost"))).alias("e")).first().e

    assert errors() == []
    assert errors(question=" ") == ["question must be non-empty"] and errors(question=None) == ["question must be non-empty"]
    assert errors(documents=("D1", "D1")) == ["document ids must be unique"]
    assert errors(evidences=(("E1", "D1"), ("E1", "D1"))) == ["evidence ids must be unique"]
    assert errors(evidences=(("E1", "D7"),)) == ["unknown id D7"] == errors(cited=("D7",)) and errors(used=("E7", "E7")) == ["unknown id E7"] * 2
    assert errors(cost=(-1.0, 0.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0)) == ["search_count must be >= 0", "duplicate_query_count must be >= 0"]


def test_training_row_validator(spark):
    lit, ref = F.lit, lambda i, x: F.struct(F.lit(f"D{i}").alias("document_id"), F.lit(f"T{i}").alias("title"), F.lit(i).alias("sentence_id"), F.lit(x).alias("text"))
    refs, gold = F.array(ref(1, "one text"), ref(2, "two  text")), lit("gold")
    turn = lambda r: F.struct(F.lit(r).alias("role"), F.lit("x").alias("content"))
    provenance = lambda r=None, s="candidate": F.struct(F.lit(r).cast("string").alias("reasoning_source"), F.lit(s).alias("retriever_scope"))

    def errors(category, reasoning=None, **changed):
        docs = F.array(F.struct(F.lit("T1").alias("title"), F.lit("one text").alias("text")))
        target = builders.target(category, lit("q"), gold, refs, docs, builders.template_reasoning(refs, gold) if reasoning is None else lit(reasoning))
        row = {k: lit("x") for k in validators.FIELDS} | {
            "category": lit(category), "messages": F.array(turn("system"), turn("user")), "target": target, "gold_answer": gold,
            "evidence_refs": F.slice(refs, 1, 0) if category == "internal" else refs, "provenance": provenance(),
        }
        return spark.range(1).select(validators.sft_errors(row | changed).alias("e")).first().e

    for c in validators.CATEGORIES:
        assert errors(c) == [], c
    assert errors("evidence", messages=F.array(turn("system"), turn("user"), turn("assistant"))) == ["assistant must not be in messages"]
    assert errors("evidence", messages=F.array(turn("user"), turn("system"))) == ["messages must start with system and include user"]
    assert errors("evidence", gold_answer=lit("other")) == ["answer is not the gold one"] and errors("evidence", gold_answer=lit("The Gold!")) == []
    assert errors("evidence", metadata=lit(None)) == ["missing field metadata"]
    assert errors("evidence", evidence_refs=F.slice(refs, 1, 1)) == ["evidence block count differs from refs"]
    assert errors("evidence", evidence_refs=F.array(ref(1, "one text"), ref(3, "two text"))) == ["[1] evidence document_id mismatch", "[1] evidence title mismatch", "[1] evidence sentence_id mismatch"]
    assert errors("internal", evidence_refs=refs) == ["internal must have no evidence_refs"]
    assert errors("search_format", provenance=provenance(None, "full_corpus")) == ["full_corpus scope is forbidden"]
    assert errors("evidence_reasoning", reasoning="gold it is") == ["[0] reasoning misses the evidence text", "[1] reasoning misses the evidence text"]
    assert errors("evidence_reasoning", reasoning="gold it is", provenance=provenance("teacher")) == [] and errors("evidence_reasoning", reasoning="x", provenance=provenance("teacher")) == ["reasoning not answer-consistent"]
    assert errors("evidence_reasoning", reasoning="x", provenance=provenance("pending")) == ["pending reasoning placeholder mismatch"] and errors("evidence_reasoning", reasoning=validators.PENDING, provenance=provenance("pending")) == []
    assert len(errors("evidence", target=lit("<internal>a</internal><search>b</search><answer>gold</answer> tail"))) == 3


def test_public_addresses(spark):
    urls = {
        "http://127.0.0.1/": False, "http://10.0.0.1/": False, "https://172.31.0.9:8443/x": False, "http://172.32.0.9/": True, "http://192.168.1.1": False, "http://169.254.169.254/latest": False, "http://8.8.8.8/": True,
        "http://user:pw@127.0.0.1/": False, "http://localhost/": False, "http://a.localhost:80/": False, "http://[::1]/": False, "http://[fe80::1]/": False, "http://[2606:4700::1111]/": True, "http://[2001:db8::1]/": False,
        "http://2130706433/": False, "http://0x7f.1/": False, "http://256.1.1.1/": False, "HTTP://Example.COM/a": True, "ftp://example.com/": False, "http:///x": False, "": False, "http://1.2.3.4.5/": False, "http://example.com1/": True, "http://100.64.0.1/": False,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.p for r in rows.select("u", predicates.public_http("u").alias("p")).collect()} == urls


def test_hop_labels(value):
    label = lambda n, c, d, f: value(predicates.hop_label(F.lit(n), F.lit(c), F.lit(d), F.lit(f)))
    assert [label("exact_duplicate", True, 0, 0), label("semantic_duplicate", False, 1, 0), label("normalized_duplicate", True, 0, 2)] == ["duplicate_retry", "duplicate_but_new_docs", "duplicate_but_new_docs"]
    assert [label("rewrite", True, 1, 0), label("rewrite", True, 0, 0), label("rewrite", False, 3, 3)] == ["obs_conditioned_hop", "obs_conditioned_no_new_docs", "rewrite_not_obs_conditioned"]


def test_two_hop_graphs(spark):
    schema = "question string, answer string, contexts array<struct<title:string,text:string>>, facts array<struct<title:string,sentence:string>>"
    others = [(f"Other {k}", f"nothing {k}") for k in range(8)]
    contexts = [("Film X", "Film X was made by Ada Example."), ("Ada Example", "Ada Example was born in London."), *others]
    facts = [("Film X", "Film X was made by Ada Example."), ("Ada Example", "Ada Example was born in London.")]

    def graph(question="Where was the maker of Film X born?", answer="London", contexts=contexts, facts=facts):
        return spark.createDataFrame([(question, answer, contexts, facts)], schema).select(predicates.two_hop(*map(F.col, ("question", "answer", "contexts", "facts"))).alias("g")).first().g

    found = graph()
    assert (found.a, found.b, found.fact_b, len(found.distractors)) == ("Film X", "Ada Example", facts[1][1], 8)
    assert graph(contexts=contexts[:-1]) is None and graph(question="Where was Ada Example born?") is None and graph(answer="Paris") is None
    assert graph(facts=facts[:1]) is None and graph(contexts=[("Film X", "London: Film X by Ada Example."), *contexts[1:]]) is None
    assert graph(contexts=[("Film X", "Film X has a maker."), *contexts[1:]]) is None and graph(facts=[facts[0], ("Ada Example", "She was born.")]) is None
    rows = spark.createDataFrame([(7, "Where was the maker of Film X born?", "London", contexts, facts)], "id long, " + schema).withColumn("g", predicates.two_hop(*map(F.col, ("question", "answer", "contexts", "facts"))))
    steps = replay.curriculum(rows.withColumn("d", F.lit(2)), "id", "question", "answer", "g", "d").orderBy("turn").collect()
    assert [s.decision for s in steps] == ["SEARCH", "SEARCH", "ANSWER"] and steps[1].query.startswith("Ada Example ") and steps[1].titles == ["Ada Example", "Other 4", "Other 5", "Other 6", "Other 7"]
    assert [len(s.titles) for s in replay.curriculum(rows.withColumn("d", F.lit(1)), "id", "question", "answer", "g", "d").orderBy("turn").collect()] == [5, 0]


def test_trajectory_reasons(spark):
    decision = lambda kind, query="", answer="", missing=(), sources=("S1",): (kind, query, answer, list(missing), list(sources))
    d = "struct<decision:string,next_query:string,answer:string,missing:array<string>,source_ids:array<string>>"
    schema = f"question string, golds array<string>, depth int, decisions array<{d}>, results array<struct<errors:int,documents:array<struct<source_id:string,url:string,text:string>>>>, forced {d}"
    obs1, obs2 = [("S1", "http://a.org", "Film X was made by Ada Example")], [("S2", "http://b.org", "Ada Example was born in London")]
    base = {
        "depth": 2, "decisions": [decision("SEARCH", "who made film x"), decision("SEARCH", "ada example birthplace"), decision("ANSWER", answer="London", sources=("S2",))],
        "results": [(0, obs1), (0, obs2)], "forced": decision("ANSWER", answer="Paris"),
    }

    def reason(**changed):
        r = base | changed
        row = ("Where was the maker of film X born?", ["London"], r["depth"], r["decisions"], r["results"], r["forced"])
        return spark.createDataFrame([row], schema).select(replay.trajectory_reason(*map(F.col, ("question", "golds", "depth", "decisions", "results", "forced"))).alias("r")).first().r

    first, second, last = base["decisions"]
    cases = {
        "accepted": {}, "answer_without_search": {"decisions": [last]}, "depth_mismatch": {"decisions": [first, last]}, "teacher_answer_mismatch": {"decisions": [first, second, decision("ANSWER", answer="Rome")]},
        "answer_with_unresolved_missing": {"decisions": [first, second, decision("ANSWER", answer="London", missing=["x"])]}, "answer_not_grounded_in_available_sources": {"decisions": [first, second, decision("ANSWER", answer="London", sources=["S9"])]},
        "forced1_teacher_error": {"forced": None}, "forced1_protocol_error": {"forced": decision("SEARCH")}, "forced1_already_correct": {"forced": decision("ANSWER", answer="London")},
        "teacher_over_depth": {"depth": 1}, "duplicate_query": {"decisions": [first, decision("SEARCH", "Who made film X?"), last]}, "query_not_observation_conditioned": {"decisions": [first, decision("SEARCH", "weather today"), last]},
        "web_error": {"results": [(1, obs1), (0, obs2)]}, "empty_observation": {"results": [(0, obs1), (0, [])]}, "benchmark_leak": {"results": [(0, [("S1", "https://huggingface.co/datasets/hotpot_qa", "Ada Example")]), (0, obs2)]},
        "no_new_information": {"results": [(0, obs1), (0, obs1)]}, "prematurely_sufficient": {"results": [(0, [("S1", "http://a.org", "Ada Example of London")]), (0, obs2)]}, "no_final_answer": {"decisions": [first, second]},
    }
    assert {k: reason(**v) for k, v in cases.items()} == {k: k for k in cases}
    assert reason(depth=1, decisions=[first, decision("ANSWER", answer="London")], forced=None) == "accepted"


def test_depth_behaviour_counts(spark):
    schema = "depth int, question string, golds array<string>, queries array<string>, observations array<struct<content:string,document_ids:array<string>>>, answer string"
    rows = [
        (1, "who made film x", ["ada"], ["who made film x"], [("ada example", ["a"])], "ada"),
        (2, "where was the maker born", ["london"], ["the maker", "ada birthplace"], [("ada example", ["a"]), ("london", ["b"])], "london"),
        (2, "where was the maker born", ["london"], ["the maker", "The Maker!", "x"], [("ada", ["a"]), ("ada", ["a"])], None),
        (3, "left out", ["x"], ["x"], [], "x"),
    ]
    got = summaries.depth_behaviour(spark.createDataFrame(rows, schema)).first()
    assert (got.evaluated, got.depth1_count, got.depth2_count, got.stop_at_d1, got.continue_at_d2, got.answer_f1) == (3, 1, 2, 1.0, 1.0, 1.0)
    assert [round(x, 4) for x in (got.finish_rate, got.duplicate_extra_query_rate, got.obs_conditioned_extra_query_rate, got.new_evidence_extra_query_rate)] == [0.6667, 0.3333, 0.3333, 0.3333]
    assert got.gate == "WEB_ADAPTIVE_DEPTH_FAIL" and summaries.depth_behaviour(spark.createDataFrame([], schema)).first().evaluated == 0


def test_orderings_of_different_scores(spark):
    """With a score of its own for every row nothing is sorted by one task, and all sums are those of a sort."""
    rows = [(k, k * 7919 % 10007 / 10007, k * 31 % 97 % 2) for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, score double, label int").repartition(13)
    ordered = sorted(rows, key=lambda r: r[1])
    places = {r.id: (r.place, r.total) for r in ordering.ordered_places(df, ["score"]).collect()}
    assert places == {r[0]: (k, 5000) for k, r in enumerate(ordered)}
    upto, total = {}, 0
    for r in reversed(ordered):
        total += r[2]
        upto[r[0]] = total
    got = {r.id: r.upto_label for r in ordering.running_sums(df, [F.desc("score")], ["label"]).collect()}
    assert got == upto
    ones = [k + 1 for k, r in enumerate(ordered) if r[2]]
    n1, n0 = len(ones), 5000 - len(ones)
    assert abs(audits.auroc(df, "label", "score").first().auroc - (sum(ones) - n1 * (n1 + 1) / 2) / (n1 * n0)) < 1e-12
    quantiles = audits.linear_quantiles(df.withColumn("g", F.col("label")), "g", "score", {"q": 0.3}).collect()
    for r in quantiles:
        own = sorted(x[1] for x in rows if x[2] == r.g)
        place = (len(own) - 1) * 0.3
        assert abs(r.q - (own[int(place)] + (place - int(place)) * (own[int(place) + 1] - own[int(place)]))) < 1e-12
    assert ordering.ordered_places(df.limit(0), ["score"]).count() == 0 == audits.midranks(df.limit(0), "score").count()


def test_hamilton_ties_go_to_the_larger_key(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "k string, n long")
    got = {r.k: r.quota for r in sampling.hamilton(counts, "k", "n", 10).collect()}
    assert got == {"a": 3, "b": 3, "c": 4}


def test_auroc_with_ties_and_one_label(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert audits.auroc(df, "label", "score").first().auroc == 0.875
    assert audits.auroc(df.filter("label = 1"), "label", "score").first().auroc is None


def test_memory_novelty_and_budget(spark):
    rows = [(1, 1, 0, "u1", "T1", "first snippet", 1.0), (1, 2, 1, "u2", "T2", "second snippet", 2.0), (1, 2, 2, "u1", "T1", "First  SNIPPET", 3.0), (1, 2, 3, "", "T3", "  ", 1.0)]
    docs = spark.createDataFrame(rows, "episode long, turn long, position long, url string, title string, text string, score double")
    got = sorted(tuple(r) for r in memory.add_evidence(docs).select("evidence_id", "source_id", "snippet").collect())
    assert got == [("E1", "S1", "first snippet"), ("E2", "S2", "second snippet")]
    full = memory.render(memory.add_evidence(docs), 1000).first()
    assert full.rendered.index("[S2]") < full.rendered.index("[S1]") and full.n_lines == 2
    assert memory.render(memory.add_evidence(docs), 10).first().rendered.endswith("- None")


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "x": "a"}\n\n{"id": 1, "x": "b"}\n{"x": "c"}\n')
    rows = readers.json_lines(spark, str(path), "id long, x string")
    assert rows.filter("x is not null").count() == 3
    assert [r.x for r in readers.last_by_key(rows, "id", "x").collect()] == ["b"]
    with pytest.raises(Exception, match="row without id"):
        readers.strict(rows, "id").select("id").collect()
    for name, body in (("l.json", '[{"id": 1}, {"id": 2}]'), ("o.json", '{"rows": [{"id": 3}]}')):
        (tmp_path / name).write_text(body)
    ids = [r.id for n in ("l.json", "o.json") for r in readers.json_document(spark, str(tmp_path / n), "id: long").collect()]
    assert ids == [1, 2, 3]
    df = spark.createDataFrame([(1, "é"), (2, "b")], "id long, x string")
    readers.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_parquet(df, str(tmp_path / "p"))
    assert readers.same_rows(df, spark.read.parquet(str(tmp_path / "p"))) and not readers.same_rows(df, df.union(df))
    readers.append_log(df, str(tmp_path / "log"))
    readers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert readers.checksums(spark, str(path)).first().length == len(path.read_bytes())


def test_row_digest_is_of_all_sorted_hashes(spark):
    import hashlib

    from tallow.plans import QUERIES

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    buckets: dict = {}
    for h in sorted(sha(f"{r.doc_id}:{r.text}") for r in rows if r.text is not None):
        buckets.setdefault(h[:3], []).append(h)
    assert QUERIES["s08_row_digest"](spark, "/root/testdata/sf0.001").first().asDict() == {"digest": sha("".join(sorted(sha("".join(b)) for b in buckets.values())))}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, x string")
    assert readers.digest(df, F.col("x"), 1).first() == readers.digest(df.orderBy(F.desc("id")), F.col("x"), 1).first()


def test_row_digest_of_null_texts_and_of_no_rows_is_that_of_the_statement(spark, tmp_path):
    import duckdb

    from tallow.plans import ORACLES, QUERIES

    rows = [(1, "a"), (2, None), (None, "b"), (3, ""), (600, "c"), (600, "c")]
    got = {}
    for name, own in {"all": rows, "without nulls": [r for r in rows if None not in r], "changed": [*rows[:-1], (600, "d")], "null": [(2, None)], "none": []}.items():
        spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        got[name] = QUERIES["s08_row_digest"](spark, f"{tmp_path}/{name}").first().digest
        assert (got[name],) == duck.execute(ORACLES["s08_row_digest"]).fetchone(), name
    assert got["all"] == got["without nulls"] != got["changed"] and got["null"] is None and got["none"] is None


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    rows = [(e, t, p, f"u{(e + t * p) % 3}") for e in range(4) for t in range(3) for p in range(3)]
    docs = spark.createDataFrame(rows, "episode long, turn long, position long, url string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = logs.stream_novelty(stream, None).writeStream.format("memory").queryName("novelty").outputMode("append").start()
    try:
        query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("novelty").select("episode", "turn", "new_urls").collect())
    finally:
        query.stop()
    assert got == sorted(tuple(r) for r in logs.fold_novelty(docs).collect())


def test_stream_breaker_equals_batch_breaker(spark, tmp_path):
    rows = [(g, k, (g * 7 + k * 5) % 3 == 0 or k in (4, 5)) for g in range(5) for k in range(12)]
    df = spark.createDataFrame(rows, "g long, k long, bad boolean")
    for part in range(3):  # batches follow each other in the order of k
        df.filter(f"k div 4 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    want = sorted(tuple(r) for r in logs.until_streak(df, "g", "k", F.col("bad"), 2).select("g", "k", "bad").collect())
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = logs.stream_until_streak(stream, "g", "k", "bad", 2, None).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    try:
        query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("breaker").collect())
    finally:
        query.stop()
    assert got == want and len(want) < len(rows)


def test_stored_results_and_attempts(spark):
    page = '<a class="result__a" rel=x href="//d.com/l/?uddg=https%3A%2F%2Fe.org%2Fa%3Fb&amp;rut=1">A &amp; <b>B</b></a><a class="result__a" href="http://f.org">F</a><a href="http://no">n</a>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "x")], "id long, body string")
    got = [tuple(r) for r in readers.search_results(rows, "id", "body", "links").collect()]
    assert got == [(1, 1, "A & B", "https://e.org/a?b", ""), (1, 2, "F", "http://f.org", "")]
    listed = spark.createDataFrame([(1, '{"results": [{"title": "t", "url": "u"}, {"content": "c"}]}'), (2, "no json")], "id long, body string")
    assert [tuple(r) for r in readers.search_results(listed, "id", "body", "list").collect()] == [(1, 1, "t", "u", ""), (1, 2, "", "", "c")]
    with pytest.raises(ValueError, match="unknown form"):
        readers.search_results(rows, "id", "body", "x")
    tries = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, "y"), ("a", 3, True, "z"), ("b", 1, False, "p"), ("b", 2, False, "q"), ("c", 1, True, "r")], "k string, n int, ok boolean, v string")
    assert sorted(tuple(r) for r in readers.first_success(tries, "k", "n", "ok", "v").collect()) == [("a", "y", True, 3, True), ("b", "q", False, 2, False), ("c", "r", True, 1, False)]


def test_rescoring_needs_every_stored_rationale(spark):
    cache = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, reasoning string")
    assert summaries.rescored(cache, cache.filter("sample_id = 1")).count() == 1
    with pytest.raises(Exception, match="no stored rationale for 3"):
        summaries.rescored(cache, spark.createDataFrame([(3,)], "sample_id long")).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
