import pytest

from schemaloom.llm.sentences import Lexicon, Splitter, learn, sentence_ends

LEXICON = Lexicon({"Dr": 0.0, "U.S": 0.8, "p.m": 0.3, "approx": 0.5, "St": 0.0, "K": 0.0, "J": 0.0}, {"the", "a", "it", "we", "union", "who"}, {"Sundays"}, {"No"})


def split(text):
    ends, out, at = Splitter(LEXICON).ends(text), [], 0
    for e in ends:
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("parts", [
    ["Dr. Kihoro told J. K. Rahoja that it rose by 3.5 percent at 4 p.m. on Friday.", "The union met."],
    ["She moved to the U.S.", "The board left for the U.S. on Monday."],
    ['"Is it over now?" the judge asked.', '"We will try again in 1980."', "The Zipp! festival opened."],
    ["Prices rose… but only here.", "Who would pay?", "No. 14 in St. Vevaze was sold."],
    ["Trains stop at 6 a.m. and at 9 p.m. Sundays.", "It closed."],
    ["« Nous n’attendrons plus ! » a déclaré Dirive hier.", "Qui va payer ?"],
    ["Version 22.5.1 lists 37,492 cases.", "eKola, a lender, cut its staff."],
])
def test_latin(parts):
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [
    ["“真的吗？”埃福布问道，“我不相信。”", "工会表示新预算。", "普托表示：“会议已经取消。”", "这怎么可能？！"],
    ["「もう待てません。」と組合の代表は話した。", "本当ですか！？"],
    ["उत्पादन में 9.3 प्रतिशत की वृद्धि हुई।", "खर्च कौन देगा?"],
])
def test_other_scripts(parts):
    assert split("".join(parts)) == parts


def test_lines_headings_and_wraps():
    assert split("Legacy\nThe bridge was closed.\n\nIt fell\n") == ["Legacy", "The bridge was closed.", "It fell"]
    assert split("The central bank rejected its northern branch. Police\nofficers said a few words because of heavy doubts") == [
        "The central bank rejected its northern branch.", "Police\nofficers said a few words because of heavy doubts"]
    assert split("The union met.The board left.") == ["The union met.", "The board left."]


def test_blank_and_marks_only():
    assert split(" \n ") == [] and split("!!!") == ["!!!"]


def test_ends_count_code_points(spark):
    df = spark.createDataFrame([(1, "𝒳 fell. The end  ", 9), (2, None, 9), (3, "", 9), (4, " ", 9)], "i int, t string, end_pos int")
    got = sorted(tuple(r) for r in sentence_ends(df, ["i"], "t", LEXICON).collect())
    assert got == [(1, 7), (1, 15)]


def test_lexicon_is_learnt(spark):
    rows = [(f"The mayor met Dr. Name{i} there. The day was long.",) for i in range(60)] + [("It has approx. 20 parts and the dog.",)] * 20
    lexicon = learn(spark.createDataFrame(rows, "t string"))
    assert lexicon.abbreviations["Dr"] < 0.1 and "approx" in lexicon.abbreviations and "long" not in lexicon.abbreviations and "the" in lexicon.common


def test_long_text():
    text = "The union met in the hall. " * 20_000
    assert len(Splitter(LEXICON).ends(text)) == 20_000
