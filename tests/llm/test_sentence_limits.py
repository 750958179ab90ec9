"""Rules of sentence ends that must not depend on the size of the input or the length of a quotation."""

import pytest

from schemaloom.llm.langid import units_of
from schemaloom.llm.sentences import Lexicon, Splitter, learn, split_sentences


@pytest.mark.parametrize("times", [1, 10])
def test_a_stray_first_use_takes_no_name_out(spark, times):
    lines = ["we met on Friday in town"] * 100 + ["Friday was cold"] + ["so said Judge in court"] * 40 + ["Judge it"] * 20
    names = learn(spark.createDataFrame([(x,) for x in lines * times], "text string")).never_first
    assert "Friday" in names and "Judge" not in names


@pytest.mark.parametrize("opening, close", ["“”", "「」", "『』"])
def test_a_quotation_of_any_length_is_one_unit(opening, close):
    inside = "这是第一句。" + "很长的话" * 150 + "。"
    text = f"{opening}{inside}{close}埃福布说。工会表示新预算。"
    ends = Splitter(Lexicon()).ends(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == [f"{opening}{inside}{close}埃福布说。", "工会表示新预算。"]


def test_a_quotation_ends_with_its_own_mark_on_its_own_line():
    later = "「开头没有结尾。" + "很长的话" * 100 + "。"
    parts = lambda text: len(Splitter(Lexicon()).ends(text))
    assert parts(later + "他说「好」。") == 3 and parts(later + "\n好」。") == 3


@pytest.mark.parametrize("pair", ["“”", "„“", "«»", "「」", "『』", '""'])
def test_languages_of_a_long_quotation_do_not_count(pair):
    text = f"He said {pair[0]}{'palabras sin fin ' * 30}{pair[1]} and went home"
    assert "palabras" not in "".join(words for _, _, words in units_of(text))


def test_a_long_lexicon_is_joined_and_gives_the_same_sentences(spark):
    rows = [(f"The mayor met Dr. Name{i} there. The day was long, and Mr. Bo left the U.S. on Monday. It is approx. 3 p.m. now",) for i in range(40)]
    rows += [('"Stop it now!" Ann Lee cried. "No, never," cried Bo.\nThe end?',)] * 8 + [(None,), ("",), ("Bo said: Prof. Vo.\nThe end",)]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "i int, t string")
    one, two = (sorted(tuple(r) for r in split_sentences(df, ["i"], "t", df.select("t"), n).collect()) for n in (10**6, 0))
    assert one == two and len(one) > 100


def test_an_abbreviation_counts_at_any_size(spark):
    rows = [("it has approx. 20 parts",)] * 6
    few = learn(spark.createDataFrame(rows + [("the dog",)] * 10, "t string"))
    many = learn(spark.createDataFrame(rows, "t string").unionByName(spark.range(400_000).selectExpr("'the dog' as t")))
    assert "approx" in few.abbreviations and few.abbreviations["approx"] == many.abbreviations["approx"]


def test_words_of_saying_are_learnt(spark):
    rows = [(f"„Wir warten nicht mehr!“ rief {name} laut.",) for name in ("Bo", "Al", "Vi")] * 4
    lexicon = learn(spark.createDataFrame(rows, "t string"))
    assert "rief" in lexicon.saying and "laut" not in lexicon.saying
    text = "„Wir warten!“ Anna Lee rief es laut. „Wir warten!“ Anna Lee ging."
    ends = Splitter(lexicon).ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == ["„Wir warten!“ Anna Lee rief es laut.", "„Wir warten!“", "Anna Lee ging."]


def test_names_come_from_the_document():
    lexicon = Lexicon({"Corp": 0.5})
    text = "We asked Vako there. It left Bo Corp. Vako fell."
    assert len(Splitter(lexicon).ends(text)) == 2 and len(Splitter(lexicon).ends(text.replace("asked Vako", "asked them"))) == 3
