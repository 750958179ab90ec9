import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.llm.canonical import canonical, canonical_array, lookalike_classes, lookalike_pairs
from schemaloom.llm.codepoints import to_codepoints, to_text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8))
def test_round_trip_of_code_points(rows):
    array = pa.array(rows, pa.string())
    points, offsets = to_codepoints(array)
    assert to_text(points, offsets, array.is_valid().to_numpy(zero_copy_only=False)).to_pylist() == rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=8))
def test_canonical_composition_equals_nfc(rows):
    assert canonical_array(pa.array(rows, pa.string()), canonical_only=True).to_pylist() == [unicodedata.normalize("NFC", r) for r in rows]


def test_mark_heavy_text_equals_nfc():
    random.seed(1)
    pool = [chr(c) for c in [*range(0x41, 0x250), *range(0x300, 0x370), *range(0x900, 0xA00), *range(0xAC00, 0xAC40), *range(0x1100, 0x1200), *range(0x1F00, 0x2000), 0xF900, 0x110BA]]
    rows = ["".join(random.choice(pool) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    assert canonical_array(pa.array(rows), canonical_only=True).to_pylist() == [unicodedata.normalize("NFC", r) for r in rows]


def test_forms_and_what_stays():
    same = [("Ｍｉｇ", "Mig"), ("wееk", "week"), ("在⼤雨", "在大雨"), ("a​b⁠", "ab"), ("a\xa0b　c", "a b c"), ("Heﬁ", "Hefi"), ("é", "é"), ("ｶﾞ", "ガ")]
    assert canonical_array(pa.array([a for a, _ in same])).to_pylist() == [b for _, b in same]
    kept = ["x²", "A", "a", "é", "a  b", "a\nb", "…", ""]
    assert canonical_array(pa.array(kept)).to_pylist() == kept


def test_pairs_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "abc", 0), (2, "аbc", 0), (3, "abc", 0), (4, None, 0), (5, "", 0), (6, "x", 0), (7, "a​bc", 0), (8, "é", 0), (9, "é", 0)]
    df = spark.createDataFrame(rows, "sent_id long, text string, canonical int")
    got = sorted(tuple(r) for r in lookalike_pairs(df, "sent_id", "text").collect())
    assert got == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7), (8, 9)]
    assert canonical(df, "text").where("sent_id = 2").first()["canonical"] == "abc"


def test_empty_table(spark):
    assert lookalike_pairs(spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0


def test_words_keep_their_script_and_look_alikes_agree():
    same = ["Москва сор ёж", "Mосква cop ёж", "Мoсква соp ёж"]  # Latin letters hidden in the second and third
    assert set(canonical_array(pa.array(same)).to_pylist()) == {"Москва сор ёж"}
    assert canonical_array(pa.array(["καλό νόμος", "pаypal сор"])).to_pylist() == ["καλό νόμος", "paypal cop"]


def test_classes_have_a_row_a_record_and_lose_no_link(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, "x"), (6, "x"), (7, "a​bc")]
    got = {r["id"]: (r["class_id"], r["spelling_id"], r["n_links"]) for r in lookalike_classes(spark.createDataFrame(rows, "sent_id long, text string"), "sent_id", "text").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 3), 3: (1, 1, 2), 7: (1, 7, 3)}
