"""Cleaning and filtering of raw text records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked

MAX_LENGTH = 256
MAX_NUMERIC = 0.25
SHORT_PARAGRAPH = 5
# Code points removed from every record.
BAD_CODES = (
    "2022 F1 2002 AE 200B E6CE E63C 200D DC FFFC 25B6 25B7 261F FF64 25D0 B3 27A4 2776 4A3B 2665 B2 B9AC 10E6 B4 FF65 1D17 "
    "2ED3 2590 2003 D734 2F94 22EF 30FB D6 2F6F 2F08 2F2F 20E3 2F5A 2F00 FFFD F0FC 207A 25FE 25BA CD1D 301C EC69 EDE0 EDC6 2FA6 2FB0 "
    "2F64 1F920 2F8F 2F47 2EDB 2F79 F06C FE0F E60A E404 2122 D55C AC15 AE40 D604 C6B1 2113 1F929 EC49 EE07 EC65 ED8C ECFD ED70 ED33 2084 "
    "ED94 F6 25AA 2F29 FEFF F0D6 F0F0 A0 31CF 25E6 2EC4 FF61 2B06 A3 20AC 202C 40FC F0B7 F020 25C9 25C8 25CD 2207 FF89 E056 FF9E "
    "200C 25B5 FF62 FF63 2217 F0A3 E34 AB BB 2044 F052 20BF 25B4 B9 AD 3D6 2011 2666 A5 2006 202D 2005 F236 F525 F098"
).split()
BAD_CHARACTERS = "".join(chr(int(c, 16)) for c in BAD_CODES)
# Numerals of Chinese text count as numeric too, as in Unicode's numeric property.
NUMERIC = r"[\p{N}一二三四五六七八九十百千万亿零〇两]"
SENTENCE_ZH = r"(?s).*?(?:。|[!?！？]+)"
# A word with an end mark and what may close after it.
SENTENCE_EN = r"[.!?][\"'”’)\]]*$"
# An abbreviation by the published unsupervised scheme: its score from the counts of a word with and without a full stop.
LEAST_ABBREVIATION, LEAST_USES = 0.3, 5
# Traditional characters and the simplified ones; a longer table can be given.
SIMPLIFIED = {
    "這個們來時會國學說對後過還沒開進間問題現實發動與關於產業經濟場價錢門長東車馬鳥魚書畫電話機構總統議員選舉黨軍戰爭歷史區縣鄉鎮灣島廣華陽陳劉張趙楊黃吳鄭孫許鄧蕭葉蘭蘇藝術體務員醫藥護衛環評論報紙聞網絡際聯盟證券銀貿購買賣費額億萬":
    "这个们来时会国学说对后过还没开进间问题现实发动与关于产业经济场价钱门长东车马鸟鱼书画电话机构总统议员选举党军战争历史区县乡镇湾岛广华阳陈刘张赵杨黄吴郑孙许邓萧叶兰苏艺术体务员医药护卫环评论报纸闻网络际联盟证券银贸购买卖费额亿万",
}


def cleaned(text: Column) -> Column:
    return F.translate(text, BAD_CHARACTERS, "")


def tokens(text: Column) -> Column:
    """Runs of characters that aren't Unicode white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def text_length(text: Column, chinese: Column) -> Column:
    """Length that the length limit applies to: characters in Chinese, tokens elsewhere."""
    return F.when(chinese, F.char_length(text)).otherwise(F.size(tokens(text)))


def numeric_share(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(NUMERIC)) / n).otherwise(F.lit(0.0))


def with_filters(df: DataFrame, text: str, chinese: Column) -> DataFrame:
    """``df`` with cleaned text and the flags ``too_long`` and ``too_numeric``; null texts have null flags.

    Length and numeric share are those of the text as it came; its bad characters go afterwards.
    """
    df = df.withColumn("length", text_length(F.col(text), chinese)).withColumn("too_numeric", numeric_share(F.col(text)) > MAX_NUMERIC)
    return df.withColumn("too_long", F.col("length") >= MAX_LENGTH).withColumn(text, cleaned(F.col(text)))


def split_chinese(text: Column) -> Column:
    """Sentences closed by an end mark; text after the last one is dropped, and a text without any gives none."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_ZH), F.lit(0))


def abbreviations(words: DataFrame, word: str) -> DataFrame:
    """``term, score`` of the abbreviations among ``words``: small-letter words, without their last stop, that carry one far
    oftener than chance, the more so the shorter they are and the more stops they have inside."""
    dotted = F.col(word).endswith(".")
    rows = words.select(F.regexp_replace(F.lower(word), r"\.$", "").alias("term"), dotted.cast("int").alias("d")).where(F.col("term").rlike(r"^\p{L}[\p{L}.]*$"))
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d").cast("double").alias("k"))
    chance = counted.agg(F.sum("k") / F.sum("n")).scalar()
    bare = F.col("n") - F.col("k")
    log = lambda p: F.col("k") * F.log(p) + bare * F.log(1 - p)
    letters = F.char_length(F.replace("term", F.lit("."), F.lit("")))
    stops = F.char_length("term") - letters + 1
    score = -2 * (log(chance) - log(F.lit(0.99))) * F.exp(-letters.cast("double")) * stops * F.pow(letters.cast("double"), -bare)
    scored = counted.where((F.col("k") >= LEAST_USES) & (F.col("k") < F.col("n") + 1)).withColumn("score", F.round(score, 6))
    return scored.where(F.col("score") >= LEAST_ABBREVIATION).select("term", "score")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), make)[0]


def split_english(text: Column, known: Column) -> Column:
    """Sentences of words parted by single blanks. A word with an end mark closes one, unless its stop belongs to an
    abbreviation of ``known`` (an array of words in small letters) or an initial, or a small letter follows."""

    def ends_of(words: Column) -> Column:
        def closes(w: Column, i: Column) -> Column:
            bare = F.regexp_replace(F.lower(w), r"\.$|^[\"'“‘(\[]+", "")
            held = w.endswith(".") & (F.array_contains(known, bare) | w.rlike(r"^[\"'“‘(\[]*\p{Lu}\.$"))
            goes_on = F.coalesce(F.get(words, i + 1).rlike(r"^\p{Ll}"), F.lit(False))
            return F.when(i == F.size(words) - 1, i + 1).when(w.rlike(SENTENCE_EN), F.when(~held & ~goes_on, i + 1))

        return F.filter(F.transform(words, closes), lambda e: e.isNotNull())

    def joined(words: Column, ends: Column) -> Column:
        before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        return F.transform(ends, lambda e, k: F.array_join(F.slice(words, before(k) + 1, e - before(k)), " "))

    return bound(tokens(text), lambda words: bound(ends_of(words), lambda ends: joined(words, ends)))


def simplified(text: Column, table: dict[str, str] | None = None) -> Column:
    """Traditional characters replaced by simplified ones (``table``: strings of equal length)."""
    for old, new in (table or SIMPLIFIED).items():
        text = F.translate(text, old, new)
    return text


def repaired_text(text: Column, title: Column, chinese: Column) -> Column:
    """A text whose subject was lost gets its title back: one that begins with "is", "was", "were" or "are", or in Chinese with
    a copula where the first two characters are not the title's."""
    bare = F.regexp_replace(text, r"^[\p{Z}\s]+", "")
    english = F.when(bare.rlike(r"^(is|was|were|are) "), F.concat_ws(" ", F.trim(title), bare)).otherwise(text)
    differs = F.substring(text, 1, 2) != F.substring(title, 1, 2)
    return F.when(chinese, F.when(bare.startswith("是") & differs & title.isNotNull(), F.concat(title, text)).otherwise(text)).otherwise(english)


def repaired_opening(paragraph: Column, title: Column) -> Column:
    """A paragraph whose subject was lost ("is a ...") gets the page title back."""
    return F.when(paragraph.rlike(r"^(is|was|were|are) "), F.concat_ws(" ", title, paragraph)).otherwise(paragraph)


def is_short(paragraph: Column, chinese: Column) -> Column:
    return F.when(chinese, F.char_length(paragraph)).otherwise(F.size(tokens(paragraph))) <= SHORT_PARAGRAPH


def is_chinese(text: Column) -> Column:
    """Whether most letters of a text are ideographs."""
    return F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")) * 2 > F.regexp_count(text, F.lit(r"\p{L}"))


def without_neighbours(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows in ``order`` whose ``key`` differs from that of the row just before; numbers and not a window over all rows find it."""
    rows = ranked(df, [], order, "_n")
    before = rows.select((F.col("_n") + 1).alias("_n"), F.col(key).alias("_last"))
    kept = rows.join(before, "_n", "left").where(~F.col(key).eqNullSafe(F.col("_last")) | (F.col("_n") == 1))
    return kept.drop("_n", "_last")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 1234) -> DataFrame:
    """``n`` rows in an order that depends on seed and id alone."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))
    return df.orderBy(key, id_col).limit(n)
