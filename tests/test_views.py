"""The text views: each text is split, read and brought into normal form once."""

from pyspark.sql import functions as F

from tallow import plans
from tallow.functions.text import normalize_answer, padded_contains
from tallow.plans import registry

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_split_once_not_once_a_line(spark):
    assert _plan(registry._lines(registry.Tables(spark, DATA))).count("split(") == 1


def test_normal_forms_are_those_of_the_texts(spark):
    t = registry.Tables(spark, DATA)
    want = t.qa.select("doc_id", normalize_answer("prediction").alias("answer"), F.transform("golds", normalize_answer).alias("texts"), normalize_answer("body").alias("body"))
    got = t.qa_norms.select("doc_id", "answer", "texts", "body")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0


def test_shown_golds_are_those_of_the_normal_forms(spark, tmp_path):
    asked = ("The long-winded question, a word", "an", "", "\u00e9t\u00e9 \u2013 \u03a3\u03a3", "a\u2013an", None, "w\u00f6rd")
    lines = ("a", "the -", "a\u2013an", "the a an", "...", "And", "x", "\u00a0a\t", "so: LONGWINDED", "question word!", "The long-winded", "(question) a the word", "long.winded question the word it is")
    lines += ("longwinded questions word", "\u00c9t\u00e9", "\u2013 \u03c3\u03c2", "\u00e9t\u00e9 \u2013 \u03a3\u03a3", "W\u00d6RD a\u0308", "a\u0308", "an", "\u2003\u3000")
    texts = ["\n".join((x, y, "", y, x)) for x in lines for y in lines] * len(asked)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(k * len(asked) + k // (len(lines) ** 2), x) for k, x in enumerate(texts)], "doc_id long, text string", "documents")  # each with every question
    write(list(enumerate(asked)), "item_id long, text string", "benchmark")
    for t in (registry.Tables(spark, str(tmp_path)), registry.Tables(spark, DATA)):
        want = t.qa_norms.select("doc_id", *[padded_contains(F.col("body"), F.get("texts", k)).alias(name) for k, name in enumerate(("asked", "after", "own"))])
        got = t.qa_shown
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0
    want = registry.Tables(spark, str(tmp_path)).qa_shown.groupBy("asked").count().collect()
    assert {r.asked for r in want} == {True, False, None}


def test_a_line_is_read_once_for_shown_golds(spark):
    for name in ("p14_answer_visible", "p16_depth_label", "k06_retrieval_quality"):
        assert _plan(plans.QUERIES[name](spark, DATA)).count("translate(lower(") == 2, name  # of a line and of a question


def test_traces_and_summaries_read_each_line_once(spark):
    for name in ("e01_evaluation_summary", "b17_trace_metrics"):
        assert _plan(plans.QUERIES[name](spark, DATA)).count("posexplode(") == 1, name
    assert _plan(plans.QUERIES["m02_evidence_keys"](spark, DATA)).count("<evidence>") == _plan(registry.Tables(spark, DATA).tagged).count("<evidence>") + 1
    for name in ("p14_answer_visible", "p15_loose_containment", "p16_depth_label", "k06_retrieval_quality"):
        assert _plan(plans.QUERIES[name](spark, DATA)).count("(a|an|the)") == 3, name  # of a line, the next one and a question


def test_sentences_are_cut_once(spark):
    assert "regexp_extract_all" not in _plan(plans.QUERIES["k01_sentence_bm25"](spark, DATA))  # what ranks reads the staged terms only


def test_samples_are_read_once_for_the_rescored_gate(spark):
    assert _plan(plans.QUERIES["m09b_rescored_counts"](spark, DATA)).count("split(text") == 0


def test_a_line_is_brought_into_normal_form_once_for_reasons(spark):
    # of a line, a question, the bridge, the answer and two queries; the next line's is that line's own
    assert _plan(plans.QUERIES["b13_synthesis_reasons"](spark, DATA)).count("(a|an|the)") == 6


def test_a_line_is_brought_into_normal_form_once_for_metrics(spark):
    assert _plan(plans.QUERIES["b17_trace_metrics"](spark, DATA)).count("(a|an|the)") == 3  # of a line, a question and what was said


def test_a_target_is_read_once_a_tag(spark):
    plan = _plan(plans.QUERIES["p28_sft_validation"](spark, DATA))
    assert plan.count("<evidence>(.*?)") == plan.count("<internal>(.*?)") == 1


def test_errors_of_requests_need_no_index(spark, monkeypatch):
    from tallow.operators.index import Index

    monkeypatch.setattr(Index, "build", None)
    got = plans.QUERIES["s18_retrieval_requests"](spark, DATA)
    assert "regexp_extract_all" not in _plan(got)  # no text is cut into terms
    assert {e.error and e.error.split(":")[0] for e in got.select("error").distinct().collect()} == {None, "sample_id and query required", "unknown sample_id"}


def test_long_batches_become_objects_in_pieces():
    import pyarrow as pa

    from tallow.operators.rationale import PIECE, _spelled

    n = 2 * PIECE + 5
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "words": [["london"]] * n, "text": [f"in london {k}" for k in range(n)], "sources": [[f"a{k}", None] for k in range(n)]})
    out = list(_spelled(iter([batch])))
    assert [b.num_rows for b in out] == [PIECE, PIECE, 5]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["id"], r["near"], r["letters"]) for r in rows] == [(k, ["london"], f"a{k}") for k in range(n)]


def test_texts_of_a_rationale_are_read_once(spark):
    from tallow.functions.grounding import PROPER
    from tallow.functions.text import RATIONALE_WORD

    plan = _plan(plans.QUERIES["x28_x30_x31_rationale_quality"](spark, DATA))
    assert plan.count(RATIONALE_WORD) == 3  # words of the sources, of the rationale and of a piece of evidence
    assert plan.count(PROPER) == 1
