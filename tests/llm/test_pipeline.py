import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallow.llm import mixing, near_dedup, pii, store, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, at = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA).cache()
        assert at.columns == columns
        kept.append(at)
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in docs.collect()} - toxic
    gone = {r.doc_id for r in near_dedup.near_duplicates(kept[0], words=5, percent=80).filter("not kept").collect()}
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in kept[0].collect()} - gone
    assert kept[2].count() == kept[1].count() and pii.find(kept[2]).filter("size(base) > 0").count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[2]).collect()}
    assert kept[3].count() == sum(copies.values())
    final = corpus_pipeline.STAGES[-1][1](spark, kept[3], DATA).collect()
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert len(final) == kept[3].count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string, row int, step int, node long, base string, spans string"
EXTRA = ("x", "y", 1, 2, 3, "b", "s")


def folder(spark, path, rows):
    """A folder with documents of these rows and labels that teach the classifier two words."""
    docs = [(k, f"word{k % 7} word{k % 11} word{k % 13}" + (" vilename scumword" if k % 4 == 0 else ""), "en", "abc"[k % 3], 20, *EXTRA) for k in range(1000, 1200)] if rows else []
    spark.createDataFrame([*docs, *rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] % 4 == 0)) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_odd_rows(spark, tmp_path):
    """Null, empty, very long, repeated and toxic texts, rows without an id, extra columns with names of the operators' own."""
    plain = "one two three four five six seven eight nine ten"
    long = " ".join(f"v{k}" for k in range(100_000))
    rows = [(1, plain, "en", "a", 48, *EXTRA), (2, plain, "en", "a", 48, *EXTRA), (None, plain, "en", None, 48, *EXTRA), (3, None, "en", "a", None, *EXTRA), (4, "", None, "b", 0, *EXTRA), (5, long, "en", "c", len(long), *EXTRA)]
    rows += [(6, "mail a.b@c.org or call +49 (030) 555-1234 x", "en", "a", None, *EXTRA), (6, "mail a.b@c.org or call +49 (030) 555-1234 x", "en", "a", None, *EXTRA), (None, "no id at all but some words here", "en", "b", 32, *EXTRA), (7, "vilename scumword", "en", "a", 17, *EXTRA)]
    sf = folder(spark, tmp_path / "odd", rows)
    at, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen.append([r for r in at.collect() if r.doc_id is None or r.doc_id < 1000])
    toxic, near, pii_, mixed = seen
    assert 7 not in {r.doc_id for r in toxic} and len(toxic) == len(rows) - 1
    texts = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in near)
    assert texts == [(0, "no id at all but som"), (1, plain[:20]), (3, ""), (4, ""), (5, long[:20]), (6, "mail a.b@c.org or ca")]
    assert {r.doc_id: r.text for r in pii_}[6] == "mail [EMAIL] or call [PHONE] x" and {r.doc_id: r.text for r in pii_}[3] is None
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and all((r.id, r.hash, r.row, r.step, r.node, r.base, r.spans) == EXTRA for r in mixed)
    final = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    assert len(final) == at.count()


def test_stages_take_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "none", []))
    assert out.collect() == []


def test_run_leaves_its_result_alone(spark):
    before = store.mark(spark)
    out = corpus_pipeline.run(spark, DATA)
    assert len(store.mark(spark) - before) == 1 and out.count() > 0
