import numpy as np
import pytest

from schemaloom.llm.langid import fit, fit_documents, grams, identify, label_language, units_of

SAMPLE = {
    "en": ["The council has approved the plan for the old bridge near the river.", "Police officers said that the road was closed because of heavy rain.", "Nobody believed the mayor when he spoke about the new budget."],
    "de": ["Der Stadtrat hat den Plan für die alte Brücke am Fluss genehmigt.", "Die Polizei sagte, dass die Straße wegen des Regens gesperrt wurde.", "Niemand glaubte dem Bürgermeister, als er über den Haushalt sprach."],
    "zh": ["市议会批准了河边旧桥的计划。", "警方表示，因为大雨，道路已经关闭。", "没有人相信市长关于新预算的讲话。"],
}
UNITS = [(lang, t) for lang, texts in SAMPLE.items() for t in texts for _ in range(4)]


@pytest.fixture(scope="module")
def model():
    return fit([t for _, t in UNITS], [x for x, _ in UNITS], landmarks=8)


def test_held_out_sentences(model):
    held = {"en": "The old road near the council was closed by the police.", "de": "Die alte Straße wurde wegen des Haushalts gesperrt.", "zh": "警方批准了新的道路计划。"}
    scores = model.scores(list(held.values()))
    assert [model.languages[i] for i in scores.argmax(1)] == list(held)


def test_grams_against_brute_force():
    units = ["Ab  ab1x", "", "é na"]
    row, key = grams(units)
    for i, u in enumerate(units):
        padded = " " + "".join(c if c.isalpha() else " " for c in u.lower()) + " "
        while "  " in padded:
            padded = padded.replace("  ", " ")
        want = {padded[j : j + n] for n in range(1, 5) for j in range(len(padded) - n + 1)} - {" "}
        assert len(np.unique(key[row == i])) == len(want)


def test_documents_segments_and_dirt(spark, model):
    en, de, zh = (SAMPLE[x] for x in ("en", "de", "zh"))
    rows = [(1, " ".join(en), "xx", "a"), (2, " ".join(en[:2]) + "\n" + " ".join(de), "en", "a"), (3, f'The mayor read "{de[0]}" to the council.', "en", "a"), (4, None, "en", "a"), (5, " \n", None, "a"), (6, "".join(zh), "zh_TW", "a"), (7, "12345 !!", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, lang string")
    got = {r["doc_id"]: r for r in identify(df, ["doc_id"], "text", model).collect()}
    assert got[1]["languages"] == ["en"] and set(got[2]["languages"]) == {"en", "de"} and got[3]["languages"] == ["en"] and got[6]["languages"] == ["zh"]
    assert got[4]["lang"] is None and got[5]["lang"] is None and got[7]["lang"] is None
    text = rows[1][1]
    assert [text[s["start"] : s["end"]].strip() for s in got[2]["segments"]] == [" ".join(en[:2]), " ".join(de)]


def test_fit_on_wrong_labels(spark):
    rows = [(i, " ".join([t, t]), "de" if i % 9 == 0 and lang == "en" else lang) for i, (lang, t) in enumerate(UNITS * 5)]
    fitted = fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert fitted.languages[fitted.scores([SAMPLE["en"][0]]).argmax()] == "en"


def test_labels(spark):
    labels = ["EN", "en-GB", "zh_TW", "und", "", "-", None, "xx", " de "]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(label_language(df["l"])).collect()] == ["en", "en", "zh", None, None, None, None, None, "de"]


def test_one_language_is_refused():
    with pytest.raises(ValueError):
        fit(["a b c"], ["en"])


def test_very_long_text_is_cut():
    units = units_of("word " * 100_000)
    assert max(len(u) for _, _, u in units) <= 2000 and units[-1][1] == 500_000


def test_labels_that_are_no_language_are_not_learnt(spark):
    mixed = [t for _, t in UNITS]
    rows = [(i, " ".join([t, t]), lang) for i, (lang, t) in enumerate(UNITS * 4)] + [(1000 + i, mixed[i % len(mixed)], ("xx", "nl", "und")[i % 3]) for i in range(120)]
    fitted = fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert set(fitted.languages) == {"en", "de", "zh"}


def test_a_tenth_language_is_learnt_from_its_labels(spark):
    dutch = ["De gemeenteraad heeft het plan voor de oude brug goedgekeurd.", "De politie zei dat de weg door de regen was afgesloten.", "Niemand geloofde de burgemeester toen hij over de begroting sprak."]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(UNITS * 2 + [("nl-BE", t) for t in dutch for _ in range(12)])]
    fitted = fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert fitted.languages[fitted.scores(["De oude brug is door de politie afgesloten."]).argmax()] == "nl"
