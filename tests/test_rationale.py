"""Rules of rationale quality and of replayed episodes."""

import json
import re
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallow.functions import grounding as g
from tallow.operators import rationale as r
from tallow.operators import replay


def one(spark, **columns):
    """The values of column expressions over no data."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_folding_and_near_names():
    assert r.folded("Ad-Dīn Ñ 9") == "addinn9" and r.near("Nayrizi", "al-Nairizi the mathematician") and not r.near("Paris", "London")
    assert not r.near("", "x") and not r.near("abc", "xyz") and r.near("al-Nairizi", "Nairizi")


@given(st.text("abcd", min_size=5, max_size=9), st.text("abcde", max_size=60))
def test_stretches_are_skipped_only_if_they_cant_be_alike(name, text):
    stretches = [text[k : k + len(name)] for k in range(max(len(text) - len(name) + 1, 1))]
    assert r.alike(name, text) == any(SequenceMatcher(None, name, x).ratio() >= r.ALIKE for x in stretches)


def test_long_texts_are_compared_in_linear_time():
    began = time.perf_counter()
    assert not r.near("zzzzqqqq", "the quick brown fox " * 50_000)
    assert time.perf_counter() - began < 5


def test_forms_of_an_answer(spark):
    answer = 'Franco "Gianfranco" Zeffirelli, KBE (born 1923)'
    got = one(spark, a=g.aliases(F.lit(answer)), n=g.name_tokens(F.lit("Franco Zeffirelli, KBE (born 1923)")), d=g.legal_dates(F.lit("1066March3, 1887")), u=g.aliases(F.lit("British")), k=g.aliases(F.lit("John Doe, better known as Johnny (singer)")))
    assert "gianfranco" in got.a and got.n == ["franco", "zeffirelli"] and set(got.d) == {"march 3 1887", "3 march 1887"}
    assert set(got.u) == {"british", "britain", "uk", "united kingdom", "great britain"} and {"johnny", "john doe"} <= set(got.k)


@pytest.mark.parametrize(
    ("answer", "said", "ok"),
    [
        ("London", "So he was born in London.", True), ("London", "He was born in Paris.", False), ("yes", "Both share a nationality.", True), ("no", "They do not agree.", True),
        ("Italian", "She came from Italy.", True), ("", "", False), ("Michael Smith", "Mike met others, therefore it was smith", True), ("Michael Smith", "Anna met others, therefore it was smith", False),
        ("the Long and Winding Road to the Sea", "it is called winding the sea road", False), ("one two three four five six", "said: two three four!", True), ("U2", "They saw U2 live.", True),
    ],
)
def test_answers_are_arrived_at(spark, answer, said, ok):
    empty = F.array().cast("array<string>")
    assert one(spark, v=g.arrives(F.lit(said), F.lit(answer), F.lit(""), F.lit(""), empty)).v is ok


def test_novel_names(spark):
    sources = ["Who directed Film X?", "Ada Example", "Film X was directed by Ada Example in Italy. She won an Award in the Julian year."]
    names = lambda said: one(spark, v=g.novel_names(F.lit(said), F.array(*map(F.lit, sources)), F.lit(r.folded(" ".join(sources))))).v
    assert names("Ada Example directed Film X. Therefore Italian cinema counts.") == []
    assert names("Bogus Person directed it.") == ["Bogus Person"]
    assert names("The Awards of Ada. Because Both Example films. Gregorian dates, Old Style.") == []
    assert names("She lived in Brazil and in Europe.") == ["Brazil"]


def judged(spark, raw, answer, question, evidence):
    rows = spark.createDataFrame([(1, raw, answer, question, evidence)], "id long, raw string, answer string, question string, evidence array<string>")
    return r.score_rationales(rows, "id", "raw", "answer", "question", "evidence").first()


def test_judgement(spark):
    good = "Film X was directed by Ada Example. Ada Example was born in London, which the second text states clearly. Therefore the answer to the question is London."
    evidence = ["Film X was directed by Ada Example", "Ada Example was born in London"]
    question = "Where was the director of Film X born?"
    got = judged(spark, "```json\n" + json.dumps({"reasoning": good}) + "\n```", "London", question, evidence)
    assert got.accepted and got.score == 5 and got.bridged and got.covered == 2
    assert judged(spark, "well: " + json.dumps({"reasoning": good}) + " done", "London", question, evidence).accepted
    assert not judged(spark, json.dumps({"reasoning": good + " <answer>London</answer>"}), "London", "", evidence).accepted
    assert not judged(spark, json.dumps({"reasoning": good + " As an AI, I must stop."}), "London", question, evidence).clean
    spelled = judged(spark, json.dumps({"reasoning": "the name nairizi is what the text gives, so it is the one"}), "Abu'l-Abbas al-Fadl ibn Hatim al-Nayrīzī", "who was nairizi", ["x"])
    assert spelled.derived
    none = judged(spark, "plain text", "London", "", evidence)
    assert (none.parsed, none.score, none.clean, none.accepted, none.novel) == (False, 0, True, False, [])


def test_phases_and_truncation(spark):
    def fold(chunks, cap):
        return spark.range(1).select(replay.phases(F.array(*map(F.lit, chunks)), cap).alias("s")).first().s

    done = fold(["<search>a</search>", "<answer>x</answer>", "<search>b</search>"], 3)
    assert done.finished and done.searches == 1 and done.steps == 3
    spent = fold(["<search>a</search>", "<search>b</search>"], 1)
    assert spent.phase == "evidence" and spent.searches == 1 and not spent.finished
    ids = spark.createDataFrame([([5, 1, 2, 7, 1, 2],), ([5, 6],), ([],)], "ids array<int>")
    got = [x.v for x in ids.select(replay.truncate_tokens(F.col("ids"), [[1, 2], [7]], 10).alias("v")).collect()]
    assert got == [[5, 1, 2], [5, 6], []]


def test_score_rationales_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, '{"reasoning": "x"}', "x", "", ["", None])], "id long, raw string, answer string, question string, evidence array<string>")
    assert r.score_rationales(rows, "id", "raw", "answer", "question", "evidence").count() == 2


@given(st.lists(st.sampled_from(["as an AI", "gold  label", "gold label", "I", "i must", "<think", "x<Think", "</answer", "my task is", "step by-step", "grading", "upgrading", "let's see", ".", "We need to answer"]), max_size=6), st.sampled_from(["", " ", "_"]))
def test_talk_about_the_task_is_each_of_its_forms(pieces, blank):
    text = blank.join(pieces)
    assert bool(re.search("(?i)" + g.TALK, text)) == bool(re.search("(?i)" + "|".join(g.META), text))


def test_each_character_is_folded_without_its_accents():
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        want = re.sub("[^a-z0-9]", "", "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower())
        assert r.folded(c) == want and r.folded(c + "A\u00e9-9") == want + "ae9", c


def test_repeated_names_and_many_names(spark):
    names = lambda said, *sources: one(spark, v=g.novel_names(F.lit(said), F.array(*map(F.lit, sources)), F.lit(r.folded(" ".join(sources))))).v
    assert names("Bogus Person met The Ada. Bogus Person left. An Awards of Ada.", "Ada won an award-winning show") == ["Bogus Person", "Bogus Person"]
    assert names("no name at all", "x") == [] and names("", "") == []
    word = lambda k: "N" + "".join(chr(97 + int(d)) for d in str(k)) + "xy"
    many = [word(k) for k in range(3000)]
    assert names(". ".join(many), " ".join(x.lower() for x in many[::2])) == many[1::2]
