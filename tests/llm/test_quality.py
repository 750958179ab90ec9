from schemaloom.llm.quality import text_quality, text_statistics

PROSE = ["The council has approved the plan for the bridge.", "He said that the road was closed on Monday.", "It was not clear who would pay for it.", "The board met in the hall and made a decision."]
JUNK = ["| a | 12 | 33 |\n| b | 44 | 55 |\n| c | 1 | 2 |", "==========", "• red\n• green\n• the blue\n• yellow", "3a 2e 6b ad 52 ef 9f d0 da 8d", "xkcdq rtzpl wqrtz bcdfg hjklm"]


def common(spark):
    return spark.createDataFrame([("en", w) for w in "the a of and in has for it was that on he not who would to is said".split()], "lang string, word string")


def test_tails_tell_prose_from_junk(spark):
    rows = [(i, PROSE[i % 4].replace("bridge", f"bridge {i}"), "x") for i in range(200)] + [(1000 + i, t, "y") for i, t in enumerate(JUNK)]
    rows += [(2000, None, ""), (2001, "", ""), (2002, " 　\n", "")]
    df = spark.createDataFrame(rows + rows[:5], "sent_id long, text string, is_prose string")
    got = {r["sent_id"]: r["is_prose"] for r in text_quality(df, "sent_id", "text", common(spark)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] for i in range(200))
    assert [got[1000 + i] for i in range(len(JUNK))] == [False] * len(JUNK)
    assert got[2000] is None and got[2001] is None and got[2002] is None


def test_statistics_of_one_text(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nAnd ran!")], "i int, t string")
    row = text_statistics(df, "t", {"en": ["the", "and"]}).first()
    assert row["n_words"] == 5 and row["line_end_share"] == 1.0 and abs(row["common_share"] - 0.4) < 1e-9 and row["symbol_ratio"] == 0


def test_empty_table(spark):
    assert text_quality(spark.createDataFrame([], "sent_id long, text string"), "sent_id", "text", common(spark)).count() == 0
