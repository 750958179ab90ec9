"""Statistics of each text, and which texts are not natural prose.

Each statistic is summarised per language by a mergeable KLL quantile sketch, built map-side and merged in one
small shuffle. Values become robust z-scores: distances from the language's median in a unit that the sketches
give. Where values spread, the unit is the width of the middle of the distribution; where most texts share one
value (no symbols, every line ended), it comes from the gap that parts the sketch of all texts into two groups.
The tails decide.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.session import deliver_once

MAX_COMMON_WORDS = 50_000
# What ends a sentence or a quotation at the end of a line, and what may open or close around it.
LINE_END = r"""[.!?…。！？．।॥؟:：;；][”"'’»“」』）)\]]*$"""
BULLET = r"^(?:[-–—•·►▪◦*‣]|\(?\p{L}[.)]|\(\p{L}\)|\(?\d{1,3}[.)]|[一二三四五六七八九十]{1,3}、)\s*"
# Punctuation of running text; other marks that are neither letter nor digit count as symbols.
TEXT_MARKS = r""".,:;!?'"’‘“”„«»()¿¡、。，！？：；「」『』（）．…–—।\-‐‑％%$€£§№º°"""
# Code points of ideographs with their radicals, and of kana. Ranges, as a script property costs a search a character.
HAN, KANA = r"\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}", r"\x{3041}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
IDEOGRAPH = f"[{HAN}{KANA}]"
CYRILLIC, DEVANAGARI = r"\x{400}-\x{52F}", r"\x{900}-\x{97F}"
WORD = rf"{IDEOGRAPH}|[\p{{L}}\p{{M}}\p{{N}}&&[^{HAN}{KANA}]]+(?:['’][\p{{L}}\p{{M}}]+)*"
NO_SYMBOL = rf"[\s\p{{Z}}\p{{L}}\p{{M}}\p{{N}}{HAN}{TEXT_MARKS}]+"
SYMBOL = rf"[^\s\p{{Z}}\p{{L}}\p{{M}}\p{{N}}{HAN}{TEXT_MARKS}]"
NO_VOWEL = r"(?<![\p{L}\p{N}])[b-df-hj-np-tv-xz]{3,}(?![\p{L}\p{N}.])"
OVERLONG = rf"[\p{{L}}\p{{N}}&&[^{HAN}{KANA}]]{{25,}}"
CELL_EDGE = r"\s*[|│;；,，、·\t&•/]\s*|\s{2,}"
QUOTE = r"[«»“”„\"「」]"
ITEM_EXTENT, A_FEW = 4.5, 5
NO_LANGUAGE, LEAST_COMMON = "und", 0.1
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}]"


def common_words(words: DataFrame) -> dict[str, list[str]]:
    """The table of frequent words as a dictionary; it's a fixed list, and a long one is refused."""
    rows = words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words: this is no list of frequent words")
    out: dict[str, list[str]] = {}
    for lang, word in sorted(rows):
        out.setdefault(lang, []).append(word)
    return out


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def characters_of(text: Column, members: str) -> Column:
    """How many characters belong to a class: the length of what is left without the runs of others."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", ""))


def is_one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def where(there: Column, count: Column) -> Column:
    """``count``, which is 0 unless ``there``; a cheap look spares the costly search."""
    return F.when(there, count).otherwise(F.lit(0))


def extent(text: Column) -> Column:
    """Length of a piece of text in words; an ideograph is 0.6 of a word."""
    return count_of(text, WORD) - 0.4 * count_of(text, IDEOGRAPH)


def text_statistics(df: DataFrame, text: str, common: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``lang_guess`` and the statistics of ``text``, from built-in expressions only.

    Null, empty and blank texts get null statistics.
    """
    plain = F.regexp_replace(F.col(text), INVISIBLE, "")
    df = df.withColumn("_t", F.when(plain.rlike(r"[^\t-\r\x1c-\x20\x85\p{Z}]"), plain))
    df = df.withColumn("_words", F.regexp_extract_all(F.lower("_t"), F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.transform(F.split("_t", r"[\n\r]+"), lambda x: F.regexp_replace(x, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")), lambda x: x != ""))
    df = df.withColumns({"_wide": F.col("_t").rlike(IDEOGRAPH), "_beyond": F.col("_t").rlike(r"[^\x00-\x7F]")})
    n_words = F.size("_words")
    marks = F.char_length(F.regexp_replace("_t", r"[\s\p{Z}]+", ""))
    hits = {}
    for lang, words in common.items():
        if any(is_cjk(w) for w in words):
            pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
            there = F.col("_wide") if all(is_cjk(w) or is_kana(w) for w in words) else F.lit(True)
            hits[lang] = where(there, count_of(F.lower("_t"), pattern))
        else:
            there = F.lit(True) if any(w.isascii() for w in words) else F.col("_beyond")
            hits[lang] = where(there, F.size(F.filter("_words", is_one_of(words))))
    df = df.withColumn("_hits", F.array(*(F.struct(h.alias("n"), F.lit(lang).alias("lang")) for lang, h in hits.items())))
    best = F.array_max("_hits")
    sure = ratio(best["n"], n_words) >= LEAST_COMMON
    han = ratio(where(F.col("_wide"), characters_of(F.col("_t"), HAN + KANA)), marks)
    kana = where(F.col("_wide"), characters_of(F.col("_t"), KANA))
    cyrillic, indic = (ratio(where(F.col("_beyond"), characters_of(F.col("_t"), s)), marks) for s in (CYRILLIC, DEVANAGARI))
    df = df.withColumns({
        "lang_guess": F.when((han > 0.3) & (kana > 0), "ja").when(han > 0.3, "zh").when(indic > 0.3, "hi").when(cyrillic > 0.3, "ru")
                       .when(sure, best["lang"]).otherwise(NO_LANGUAGE),
    })
    # Only lines without an end mark can be items or rows of cells.
    df = df.withColumn("_open", F.filter("_lines", lambda x: ~x.rlike(LINE_END)))
    df = df.withColumns({
        "_brief": F.transform("_open", lambda x: extent(F.regexp_replace(x, BULLET, ""))),
        "_cells": F.transform("_open", lambda x: F.when(x.rlike(QUOTE), F.array(F.lit(99.0))).otherwise(F.transform(F.split(x, CELL_EDGE), extent))),
    })
    # Words of small letters without a vowel, no abbreviations, or words longer than any language's words.
    odd = count_of(F.col("_t"), NO_VOWEL) + where(F.exists("_words", lambda w: F.length(w) >= 25), count_of(F.col("_t"), OVERLONG))
    # One such word in a sentence is a misspelling.
    odd = F.when((n_words > A_FEW) & (odd == 1), 0).otherwise(odd)
    is_row = lambda c: (F.size(c) > 2) & (F.array_max(c) <= ITEM_EXTENT)
    known = F.col("_t").isNotNull()
    stats = {
        "n_words": n_words.cast("double"),
        "mean_word_length": ratio(F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)), n_words),
        "symbol_ratio": F.when(n_words == 0, F.lit(1.0)).otherwise(ratio(where(F.col("_t").rlike(SYMBOL), F.char_length(F.regexp_replace("_t", NO_SYMBOL, ""))), marks)),
        "digit_ratio": ratio(characters_of(F.col("_t"), r"\p{N}"), marks),
        "line_end_share": ratio(F.size("_lines") - F.size("_open"), F.size("_lines")),
        "common_share": ratio(F.coalesce(best["n"], F.lit(0)), n_words),
        "odd_word_share": ratio(odd, n_words),
        "item_line_share": F.when(F.size("_lines") > 1, ratio(F.size(F.filter("_brief", lambda n: n <= ITEM_EXTENT)), F.size("_lines"))).otherwise(F.lit(0.0)),
        "repeat_share": F.when(n_words > 5, 1 - ratio(F.size(F.array_distinct("_words")), n_words)).otherwise(F.lit(0.0)),
        # Share of lines that are rows of short cells and no sentence.
        "cell_line_share": ratio(F.size(F.filter("_cells", is_row)), F.size("_lines")),
    }
    df = df.withColumns({k: F.when(known, v) for k, v in stats.items()})
    return df.drop("_t", "_words", "_wide", "_beyond", "_lines", "_hits", "_open", "_brief", "_cells")


def is_kana(word: str) -> bool:
    return any("\u3041" <= c <= "\u30ff" for c in word)


def is_cjk(word: str) -> bool:
    return any("⺀" <= c <= "鿿" for c in word)


# Per statistic the weight of its lower and of its upper tail (0: no sign). What is a sign of its own (symbols, odd
# words, lines of items or cells) weighs 1; what prose shows now and then, as headlines show no end mark, needs another.
TAILS = {
    "mean_word_length": (0.5, 0.5),
    "symbol_ratio": (0.0, 1.0),
    "digit_ratio": (0.0, 0.4),
    "line_end_share": (0.5, 0.0),
    "common_share": (0.5, 0.0),
    "odd_word_share": (0.0, 1.0),
    "repeat_share": (0.0, 0.5),
    "item_line_share": (0.0, 1.0),
    "cell_line_share": (0.0, 1.0),
}
# Ranks at which sketches are read: the middles of hundred equal parts.
PARTS = 100
RANKS = [(i + 0.5) / PARTS for i in range(PARTS)]
# Places in RANKS of lower decile, quartile, median, upper quartile, decile, and their distances from the median of a normal distribution.
DECILE, QUARTILE, MEDIAN = 10, 25, 50
NORMAL_QUARTILE, NORMAL_DECILE = 0.6745, 1.2816
# A language's unit isn't taken below this share of that of all texts, as a small language shows little of its spread.
LEAST_OF_ALL = 0.5
Z_TAIL = 3.0


def language_sketches(stats: DataFrame, k: int = 800) -> DataFrame:
    """One KLL sketch a language and statistic; sketches of parts or deliveries merge by ``kll_merge_agg_double``."""
    return stats.where("n_words is not null").groupBy("lang_guess").agg(*(F.kll_sketch_agg_double(F.col(c), F.lit(k)).alias(c) for c in TAILS))


def all_texts(sketches: DataFrame, k: int = 800) -> DataFrame:
    """The sketches of the languages merged: one row."""
    return sketches.agg(*(F.kll_merge_agg_double(F.col(c), F.lit(k)).alias(c) for c in TAILS))


def at_ranks(sketches: DataFrame) -> DataFrame:
    """``lang_guess, stat, values, least, most``: each sketch's values at RANKS and its ends, a row a language and statistic."""
    ranks = F.array(*(F.lit(r) for r in RANKS))
    read = lambda c, at: F.kll_sketch_get_quantile_double(F.col(c), at)
    rows = [F.struct(F.lit(c).alias("stat"), read(c, ranks).alias("values"), read(c, F.lit(0.0)).alias("least"), read(c, F.lit(1.0)).alias("most")) for c in TAILS]
    return sketches.select("lang_guess", F.inline(F.array(*rows)))


def unit_of(values: Column) -> Column:
    """The widest of the distances of quartiles and deciles from the median, over those of a normal distribution."""
    m = values[MEDIAN]
    widths = [(values[PARTS - 1 - QUARTILE] - m) / NORMAL_QUARTILE, (m - values[QUARTILE]) / NORMAL_QUARTILE,
              (values[PARTS - 1 - DECILE] - m) / NORMAL_DECILE, (m - values[DECILE]) / NORMAL_DECILE]
    return F.greatest(*widths)


def with_cut(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``cut``, the value that parts a distribution into two groups.

    It is that of the greatest variance between the groups, on the scale of square roots, in the middle of the gap.
    With less than a hundredth of the texts off the common value, it is halfway to the farthest one; null where all
    values are equal.
    """
    df = ranked.withColumn("_roots", F.transform("values", lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))))
    df = df.withColumn("_sums", F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda i: F.aggregate(F.slice("_roots", 1, i), F.lit(0.0), lambda s, v: s + v)))

    def between(i: Column) -> Column:
        apart = F.get("_sums", i - 1) / i - (F.col("_sums")[PARTS - 1] - F.get("_sums", i - 1)) / (PARTS - i)
        return F.struct((i * (PARTS - i) * apart * apart).alias("variance"), (-i).alias("place"))

    gaps = F.filter(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda i: F.get("values", i - 1) < F.get("values", i))
    df = df.withColumn("_place", -F.array_max(F.transform(gaps, between))["place"])
    m = F.col("values")[MEDIAN]
    farthest = F.when(F.col("most") - m >= m - F.col("least"), F.col("most")).otherwise(F.col("least"))
    middle = (F.get("values", F.col("_place") - 1) + F.get("values", F.col("_place"))) / 2
    return df.withColumn("cut", F.coalesce(middle, F.when(F.col("most") > F.col("least"), (m + farthest) / 2))).drop("_roots", "_sums", "_place")


def language_scales(sketches: DataFrame) -> DataFrame:
    """``lang_guess`` and per statistic a struct ``scale_<statistic>`` of ``median, low, high``, the units of the z-scores
    below and above the median.

    Where a side's quartile is the median, most texts share one value: its unit is a Z_TAIL-th of the way to the
    value that parts all texts into two groups (null if that lies on the other side: no tail). Texts in no known
    language are measured against all texts, as most of them may be junk.
    """
    every = with_cut(at_ranks(all_texts(sketches).withColumn("lang_guess", F.lit(NO_LANGUAGE))))
    own = at_ranks(sketches.where(F.col("lang_guess") != NO_LANGUAGE)).unionByName(every.drop("cut"))
    # One row a language and statistic on the one side, one a statistic on the other.
    rows = own.join(every.select("stat", "cut", unit_of(F.col("values")).alias("_all")), "stat")
    values, m = F.col("values"), F.col("values")[MEDIAN]
    wide = F.greatest(unit_of(values), F.lit(LEAST_OF_ALL) * F.col("_all"))
    high = F.when(values[PARTS - 1 - QUARTILE] > m, wide).otherwise(F.when(F.col("cut") > m, (F.col("cut") - m) / Z_TAIL))
    low = F.when(values[QUARTILE] < m, wide).otherwise(F.when(F.col("cut") < m, (m - F.col("cut")) / Z_TAIL))
    units = rows.select("lang_guess", "stat", F.struct(m.alias("median"), low.alias("low"), high.alias("high")).alias("scale"))
    return units.groupBy("lang_guess").agg(*(F.max(F.when(F.col("stat") == c, F.col("scale"))).alias(f"scale_{c}") for c in TAILS))


def robust_z(value: Column, scale: Column) -> Column:
    """Distance from the median in units of the value's side; 0 on a side without a unit."""
    away = value - scale["median"]
    return F.when(value.isNotNull(), F.coalesce(F.try_divide(away, F.when(away > 0, scale["high"]).otherwise(scale["low"])), F.lit(0.0)))


def judged(stats: DataFrame, scales: DataFrame, z_tail: float = Z_TAIL) -> DataFrame:
    """``stats`` with ``z_<statistic>``, ``tail_score`` and ``is_prose`` (null for blank texts).

    ``scales`` has one row a language, so the join is small whatever the number of texts. A text isn't prose
    if the weights of the tails it lies in add up to 1.
    """
    df = stats.join(scales, "lang_guess", "left")
    df = df.withColumns({f"z_{c}": robust_z(F.col(c), F.col(f"scale_{c}")) for c in TAILS})
    # A text in which no language has LEAST_COMMON common words lies in the lower tail of their share.
    df = df.withColumn("z_common_share", F.when(F.col("lang_guess") == NO_LANGUAGE, F.least("z_common_share", F.lit(-z_tail - 1))).otherwise(F.col("z_common_share")))
    weights = [
        F.when(F.col(f"z_{c}") > z_tail, F.lit(high)).when(F.col(f"z_{c}") < -z_tail, F.lit(low)).otherwise(F.lit(0.0))
        for c, (low, high) in TAILS.items()
    ]
    return df.withColumn("tail_score", reduce(lambda a, b: a + b, weights)).withColumn("is_prose", F.when(F.col("n_words").isNotNull(), F.col("tail_score") < 1.0))


def text_quality(df: DataFrame, record: str, text: str, common: DataFrame) -> DataFrame:
    """Statistics, language, tail score and ``is_prose`` of every record, each once.

    Texts are reduced to their statistics before rows are shuffled by record. Of deliveries with different
    texts the one whose text's digest sorts first counts; null, empty and blank texts keep null statistics.
    """
    rows = df.select(F.col(record).alias("rec"), F.md5(F.col(text)).alias("_digest"), F.col(text).alias("_text"))
    stats = text_statistics(rows, "_text", common_words(common)).drop("_text")
    once = deliver_once(stats, "rec", ["_digest", *(c for c in stats.columns if c != "_digest")]).drop("_digest")
    return judged(once, language_scales(language_sketches(once))).drop(*(f"scale_{c}" for c in TAILS)).withColumnRenamed("rec", record)
