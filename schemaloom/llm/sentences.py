"""Sentences of texts in any language and script.

Document-centred disambiguation: whether a full stop belongs to an abbreviation, and whether a capital after it
starts a sentence, is read from unambiguous occurrences elsewhere in the document (the word without its stop,
the stop before a small letter, the next word in small letters, or with a capital inside a sentence). What the
document leaves open is decided by the same counts over the whole corpus. Scripts without case or blanks have
their own end marks and quotation rules.

The corpus lexicon is a table. Up to BROADCAST_WORDS entries go to every task; a longer one is joined to the words
that each text asks for. Both ways give the same sentences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.session import with_checkpoints

# Uses that a word must have to be judged, and that a share of a few hundredths can be read from: the same for a
# corpus of any size.
LEAST_USES, LEAST_FOR_SHARE = 5, 30
# Entries of the lexicon that are sent to every task (some 100 bytes each).
BROADCAST_WORDS = 200_000
SHORT = 5

LETTER = r"(?:[^\W\d_]|[̀-ͯऀ-ॣॱ-ॿ])"
TOKEN = re.compile(rf"{LETTER}+(?:[.'’\-]{LETTER}+)*")
CLOSERS = "\"'”’»)]}」』）】》›"
OPENERS = "\"'“‘„«([{「『（【《‹¿¡"
DASHES = "-–—―"
# Marks that end sentences in scripts without case.
WIDE_ENDS = "。！？｡．"
INDIC_ENDS = "।॥۔።"
MARK = re.compile(rf"(?:\.{{2,}}|…+|[.!?؟]|[{WIDE_ENDS}{INDIC_ENDS}])[.!?…؟{WIDE_ENDS}{INDIC_ENDS}]*")
BULLET = re.compile(r"[-–—•·►▪◦*‣]\s|\(?\d{1,3}[.)]\s|\(\w\)\s")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿︀-️]")
JOINED = re.compile(r"^.*[a-z]{3,}\.(?=[A-Z])")  # the sentence before, where no blank follows its stop
CJK_HEAD = re.compile(r"^.*[぀-ヿ㐀-鿿豈-﫿](?=[A-Za-z])")
CJK_GAP = re.compile(r"(?<=[぀-ヿ㐀-鿿”」』）])[^\S\n]+(?=[“「『（]?[぀-ヿ㐀-鿿])")
# Verbs and particles of scripts without blanks with which a sentence goes on after a quotation.
SAYING_CJK = re.compile(r"[说說道问問称稱喊答叫告言話述語尋]|表示|^と")
# A name of so many words may stand between a closed quotation and its verb of saying.
NAME_WORDS = 3
BEFORE_QUOTE_ENDS, REPORTED = {",", "!", "?", "…"}, {*CLOSERS, "“"}
WIDE_QUOTES = {"“": "”", "「": "」", "『": "』"}


@dataclass
class Lexicon:
    """What the corpus says: abbreviations with the share that ends a sentence, words in small letters, names that
    never start one, words whose full stop mostly stands before a number, and words that often go on after a quotation."""

    abbreviations: dict[str, float] = field(default_factory=dict)
    common: set[str] = field(default_factory=set)
    never_first: set[str] = field(default_factory=set)
    before_number: set[str] = field(default_factory=set)
    saying: set[str] = field(default_factory=set)

    def add(self, word: str, ends: float | None, common: bool, never_first: bool, before_number: bool, saying: bool) -> None:
        if ends is not None:
            self.abbreviations[word] = float(ends)
        if common:
            self.common.add(word.lower())
        for wanted, into in ((never_first, self.never_first), (before_number, self.before_number), (saying, self.saying)):
            if wanted:
                into.add(word)


def shape_of_next(text: str, at: int) -> tuple[str, str]:
    """What follows ``at`` after blanks, dashes and opening marks: kind and word.

    Kinds: end, line (a line break first, then nothing), low, cap, digit, wide (a letter without case), mark.
    """
    n, i = len(text), at
    while i < n and (text[i].isspace() or text[i] in OPENERS or text[i] in DASHES):
        i += 1
    if i >= n:
        return "end", ""
    c = text[i]
    if c.isdigit():
        return "digit", ""
    m = TOKEN.match(text, i)
    if not m:
        return "mark", c
    word = m.group()
    if c.isupper() or c.istitle():
        return "cap", word
    if c.islower():
        return ("cap" if any(x.isupper() for x in word) else "low"), word
    return "wide", word


def word_before(text: str, at: int) -> str:
    """The word that ends at ``at``, with stops inside it, without what isn't drawn or belongs to the sentence before."""
    i = at
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] in ".'’" or 0x300 <= ord(text[i - 1]) < 0x370 or 0x900 <= ord(text[i - 1]) < 0x980 or INVISIBLE.match(text[i - 1])):
        i -= 1
    return JOINED.sub("", CJK_HEAD.sub("", INVISIBLE.sub("", text[i:at]))).lstrip(".'’")


def words_asked(text: str) -> set[str]:
    """All words of ``text`` that the splitter may look up in the lexicon: those at end marks and line breaks, and those
    up to four after a mark."""
    out = set()
    for m in MARK.finditer(text):
        out.add(word_before(text, m.start()))
        at = m.end()
        for _ in range(5):
            token = TOKEN.search(text, at)
            if token is None:
                break
            out |= {token.group(), token.group().lower()}
            at = token.end()
    for m in re.finditer(r"\n", text):
        if token := TOKEN.search(text, m.end()):
            out |= {token.group(), token.group().lower()}
    return out - {""}


# What is counted of a word: spelling, place, and what stands before or after it.
KINDS = ("low", "high", "first", "named", "saying", "bare", "inside", "low_after", "end_after", "digit_after", "other_after", "cap_after")
AFTER = {"end": "end_after", "low": "low_after", "digit": "digit_after"}


def no_counts() -> dict[str, defaultdict]:
    return {kind: defaultdict(int) for kind in KINDS}


def counts_of(text: str, into: dict[str, defaultdict]) -> None:
    """Add the unambiguous evidence of ``text`` to ``into``: by kind the counts of words, for cap_after of pairs of word and next word."""
    low_, high, first_, named, saying, bare, inside = (into[k] for k in KINDS[:7])
    for line in text.split("\n"):
        first, doubtful = True, False  # doubtful: the word stands after a stop that may end a sentence
        for m in TOKEN.finditer(line):
            word = m.group()
            begin, end = m.span()
            if not word.isascii():
                word = CJK_HEAD.sub("", word)
            if not word or line[begin - 1 : begin] in ("@", "#", "/", "_"):
                continue
            low = word.islower()
            if low:
                low_[word] += 1
                if line[begin - 2 : begin - 1] in REPORTED and line[: begin - 2].rstrip()[-1:] in BEFORE_QUOTE_ENDS:
                    saying[word] += 1
            else:
                high[word] += 1
                if first:
                    first_[word] += 1
                elif not doubtful:
                    named[word] += 1
            first = doubtful = False
            following = line[end : end + 1]
            if following != ".":
                bare[word] += 1
                if following in ("!", "?"):
                    first = True
                continue
            j = end + 1
            while j < len(line) and line[j] in CLOSERS:
                j += 1
            if j < len(line) and not line[j].isspace():
                (into["low_after"] if line[j] in ",;:" else inside)[word] += 1
                continue
            kind, after = shape_of_next(line, j)
            if kind == "cap":
                into["cap_after"][word, after] += 1
                first = len(word) > SHORT and low
                doubtful = True
            else:
                into[AFTER.get(kind, "other_after")][word] += 1


def evidence(texts: DataFrame) -> DataFrame:
    """``word, kind, next, n`` over all of the one text column of ``texts``, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = no_counts()
            for text in batch.column(0).to_pylist():
                if text:
                    counts_of(text, found)
            rows = [(*(key if kind == "cap_after" else (key, "")), kind, n) for kind, counted in found.items() for key, n in counted.items()]
            if rows:
                word, after, kind, n = zip(*rows)
                yield pa.record_batch([pa.array(word, pa.string()), pa.array(kind, pa.string()), pa.array(after, pa.string()), pa.array(n, pa.int64())], names=["word", "kind", "next", "n"])

    counted = texts.mapInArrow(count, "word string, kind string, next string, n bigint")
    return counted.groupBy("word", "kind", "next").agg(F.sum("n").alias("n"))


def lexicon_table(texts: DataFrame, least: int = LEAST_USES) -> DataFrame:
    """The corpus lexicon of the one text column of ``texts``: ``word, ends, common, never_first, before_number, saying``.

    One row a spelling that has any of these; ``ends`` is the share of an abbreviation's stops that end a sentence.
    """
    with_checkpoints(texts.sparkSession)
    found = evidence(texts).checkpoint()  # counted once, read by each of the steps below
    spelled = found.groupBy(F.lower("word").alias("lower")).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("low", "high")))
    # Common words are written small, not only capital with an exception here and there.
    small = spelled.where("low > 0 and low >= 0.2 * high").select("lower")
    after = found.where("kind = 'cap_after'").withColumn("lower", F.lower("next")).join(small, "lower", "left_semi")
    common_after = after.select("word", F.lit("common_after").alias("kind"), F.lit("").alias("next"), "n")
    is_small = small.select(F.col("lower").alias("word"), F.lit("small").alias("kind"), F.lit("").alias("next"), F.lit(1).cast("bigint").alias("n"))
    kinds = ("low", "high", "first", "bare", "low_after", "digit_after", "cap_after", "end_after", "other_after", "common_after", "small", "saying")
    words = found.unionByName(common_after).unionByName(is_small).groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds))
    dotted = F.col("low_after") + F.col("digit_after") + F.col("cap_after") + F.col("end_after") + F.col("other_after")
    in_sentence = F.col("low_after") + F.col("digit_after") + F.col("other_after")
    before_names = F.col("cap_after") - F.col("common_after")
    shape = (F.length("word") == 1) | F.col("word").contains(".")
    words = words.withColumns({"dotted": dotted, "in_sentence": in_sentence, "before_names": before_names})
    never_bare = (F.length("word") <= SHORT + 1) & (F.col("bare") <= 0.03 * F.col("dotted"))
    goes_on = (F.col("in_sentence") >= 0.1 * F.col("dotted")) | ((F.col("before_names") >= 0.9 * F.col("dotted")) & (F.col("end_after") <= 0.02 * F.col("dotted")))
    is_abbreviation = (F.col("dotted") >= least) & (shape | (never_bare & goes_on))
    ends = (F.col("common_after") + 0.5) / (F.col("cap_after") + 1.0)
    # A capital that mostly stands first is owed to the place: the word counts as one written small.
    often_first = (F.col("high") >= least) & (F.col("first") >= 0.5 * F.col("high"))
    return words.select(
        "word",
        F.when(is_abbreviation, ends).alias("ends"),
        ((F.col("low") >= least) & (F.col("small") > 0) | often_first).alias("common"),
        # A stray line-initial use takes no name out; LEAST_FOR_SHARE uses are the least that such a share can be judged by.
        ((F.col("high") >= LEAST_FOR_SHARE) & (F.col("first") <= 0.02 * F.col("high")) & F.col("word").rlike(r"^\p{Lu}")).alias("never_first"),
        ((F.col("dotted") >= least) & (F.length("word") <= SHORT) & (F.col("digit_after") >= 0.5 * F.col("dotted"))).alias("before_number"),
        ((F.col("saying") >= least) & (F.col("saying") >= 0.1 * F.col("low"))).alias("saying"),
    ).where("ends is not null or common or never_first or before_number or saying")


def learn(texts: DataFrame, least: int = LEAST_USES) -> Lexicon:
    """The whole lexicon on the driver, for corpora with few words; ``split_sentences`` has no such bound."""
    return collected(lexicon_table(texts, least))


def collected(entries: DataFrame) -> Lexicon:
    out = Lexicon()
    for row in entries.collect():
        out.add(*row)
    return out


class OwnWords(NamedTuple):
    """Words of one document: without a stop after them, with one before a small letter, in small letters, and names: with a
    capital where no sentence starts and never small."""

    bare: set[str]
    before_small: set[str]
    small: set[str]
    names: set[str]


class Splitter:
    """Sentence ends of one document."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def ends(self, text: str) -> list[int]:
        """Ends of the sentences in code points, with end marks and closing quotes; [] for a blank text."""
        self.own = None
        self.text = text
        self.width = max(len(line) for line in text.split("\n"))
        cuts: list[int] = []
        start = 0
        for at, to, kind in self.candidates(text):
            if at < start:
                continue
            if kind == "line":
                cut = self.line_ends(start, at, to)
            elif kind == "gap":
                cut = True
            else:
                to = self.closing(start, to)
                cut = self.mark_ends(start, at, to)
            if cut and any(c.isalnum() for c in text[start:to]):
                end = len(text[:to].rstrip()) if kind in ("line", "gap") else to
                if end > start:
                    cuts.append(end)
                start = to
        tail = text[start:].rstrip()
        if any(c.isalnum() for c in tail) or (tail.strip() and not cuts):
            cuts.append(start + len(tail))
        elif tail.strip():
            cuts[-1] = start + len(tail)
        return cuts

    def evidence(self) -> OwnWords:
        """What the document itself says; read only once something is open."""
        if self.own is None:
            found = no_counts()
            counts_of(self.text, found)
            small = set(found["low"])
            self.own = OwnWords(set(found["bare"]), set(found["low_after"]), small, {w for w in found["named"] if w.lower() not in small})
        return self.own

    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "mark") for m in MARK.finditer(text)]
        found += [(m.start(), m.end(), "line") for m in re.finditer(r"[^\S\n]*\n\s*", text)]
        found += [(m.start(), m.end(), "gap") for m in CJK_GAP.finditer(text)]
        return sorted(found)

    def closing(self, start: int, to: int) -> int:
        """Past the closing quotes and brackets after an end mark; French ones may stand after a blank."""
        text = self.text
        while to < len(text):
            c = text[to]
            if c in "\"'":
                opened = text.count(c, start, to) % 2 == 1
                if not opened:
                    break
                to += 1
            elif c in CLOSERS or c == "“" and "„" in text[start:to]:
                to += 1
            elif c in "   " and text[to + 1 : to + 2] == "»" and "«" in text[start:to]:
                to += 2
            elif c in ".。" and text[to - 1] in CLOSERS:
                to += 1
            else:
                break
        return to

    def is_common(self, word: str) -> bool:
        low = word.lower()
        return low in self.lexicon.common or low in self.evidence().small

    def mark_ends(self, start: int, at: int, to: int) -> bool:
        text = self.text
        mark, following = text[at], text[to : to + 1]
        if mark in WIDE_ENDS or CJK.match(text[at - 1 : at]) and mark in "!?…":
            return self.wide_ends(start, at, to)
        if mark in INDIC_ENDS:
            return True
        if not following:
            return True
        kind, word = shape_of_next(text, to)
        if kind == "end":
            return True
        closed = text[to - 1] in CLOSERS
        if not following.isspace():  # nothing parts the sentences but the mark
            if following in ",;:" or kind in ("low", "digit", "mark") or closed and following in DASHES:
                return False
            if kind == "wide":
                return not self.abbreviated(at)[0] if mark == "." else True
            before = text[at - 1 : at]
            if mark == "." and (not (before.islower() or before.isdigit() or before in CLOSERS) or len(word) < 2 or not word[1].islower()):
                return False
            return mark != "." or not self.abbreviated(at)[0]
        if kind == "low":
            return False
        line_break = "\n" in text[to : to + 3]
        if text[to - 1] in REPORTED and mark in "!?" and kind == "cap" and self.verb_after_name(to) in self.lexicon.saying:
            return False
        if mark != "." or text[at : at + 2] == "..":
            return kind != "mark" or line_break
        is_short, share, base = self.abbreviated(at)
        if kind == "digit" and base in self.lexicon.before_number:
            return False
        if base.isdigit():
            if closed or len(base) > 2:
                return True
            if not text[start : at - len(base)].strip(" \t\n-–—•·►(\"'"):
                return False  # the number of a list item
            if line_break and self.would_fit(at + 1, to):
                return True
            return kind == "cap" and self.is_common(word) and word not in self.lexicon.never_first
        if not is_short:
            return True
        if kind in ("digit", "wide"):
            return share >= 0.6
        if kind != "cap":
            return line_break
        if share < 0.12:
            return False
        if self.is_common(word):
            return True
        return share >= (0.6 if word in self.evidence().names else 0.4) and word not in self.lexicon.never_first

    def abbreviated(self, at: int) -> tuple[bool, float, str]:
        """Whether the word before the full stop at ``at`` is an abbreviation, how often such ends a sentence, and the word."""
        base = word_before(self.text, at)
        if not base or base.isdigit():
            return False, 1.0, base
        if re.fullmatch(r"[\d.,]+", base):
            return False, 1.0, base
        known = self.lexicon.abbreviations.get(base)
        letters = base.replace(".", "")
        if len(letters) == 1 and letters.isalpha() and not CJK.match(letters):
            return True, 0.0 if known is None or len(base) == 1 else known, base
        if "." in base and len(max(base.split("."), key=len)) <= 2:
            return True, 0.5 if known is None else known, base
        if known is None and len(base) > SHORT:
            return False, 1.0, base
        own = self.evidence()
        if base in own.bare and base not in own.before_small:
            return False, 1.0, base
        if known is not None:
            return True, known, base
        if base in own.before_small:
            return True, 0.3, base
        return False, 1.0, base

    def verb_after_name(self, at: int) -> str:
        """The first word in small letters after the name that stands at ``at``."""
        for _ in range(NAME_WORDS + 1):
            token = TOKEN.search(self.text, at)
            if token is None or token.group().islower():
                return token.group() if token else ""
            at = token.end()
        return ""

    def wide_ends(self, start: int, at: int, to: int) -> bool:
        """End marks of scripts without blanks: not inside a quotation, nor after one that the sentence goes on from."""
        text = self.text
        before = text[start:at]
        for opening, close in WIDE_QUOTES.items():
            opened = before.rfind(opening)
            if opened < 0 or close in before[opened:]:
                continue
            if close not in text[at:to]:
                if self.closes(opening, close, to):
                    return False
                continue
            if before[:opened].strip(" \t\n　-–—•·"):
                return True  # words introduced the quotation
            rest = re.match(r"[^。！？!?\n]*", text[to:]).group()
            return not (rest.strip() and SAYING_CJK.search(rest))
        return text[to : to + 1] not in ("，", "、", "；", "：", ",")

    def closes(self, opening: str, close: str, at: int) -> bool:
        """Whether a quotation that is open at ``at`` ends on its line; others of its kind may stand in between."""
        text, depth = self.text, 1
        end = text.find("\n", at) % (len(text) + 1)
        while depth:
            shut = text.find(close, at, end)
            if shut < 0:
                return False
            depth += text.count(opening, at, shut) - 1
            at = shut + 1
        return True

    def would_fit(self, at: int, to: int) -> bool:
        """Whether the first word of the next line had room on the line that ends at ``at``: then the break is no hard wrap."""
        begin, end = self.text.rfind("\n", 0, at) + 1, to
        while end < len(self.text) and self.text[end].isspace():
            end += 1
        nxt = end
        while nxt < len(self.text) and not self.text[nxt].isspace():
            nxt += 1
        return at - begin + 1 + nxt - end <= 0.9 * self.width

    def line_ends(self, start: int, at: int, to: int) -> bool:
        """Whether a line break ends a sentence that has no end mark, or is a hard wrap."""
        text = self.text
        before = text[start:at].rstrip()
        if not before:
            return False
        if text.count("\n", at, to) > 1 or to >= len(text) or BULLET.match(text, to):
            return True
        last = before[-1]
        if last in ",;:，、；：" or last in DASHES:
            return False
        kind, word = shape_of_next(text, to)
        if last in ".!?…":
            return kind == "mark"  # the end mark has been judged already
        if kind == "low":
            return False
        fits = self.would_fit(at, to)
        if CJK.match(last):
            return True
        if kind == "cap" and self.is_common(word) and word not in self.lexicon.never_first:
            return True
        return fits


def sentence_ends(df: DataFrame, kept: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """Columns ``kept`` and ``end_pos``: one row a sentence of each text, by a lexicon that every task gets.

    ``end_pos`` counts code points of the stored text up to the end of the sentence. Null, empty and blank
    texts have no sentences; a text of marks alone is one. Rows aren't merged, whatever they repeat.
    """
    source = df.select(*kept, F.col(text).alias("_text")).where("_text is not null")
    schema = ends_schema(df, kept)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(lexicon)
        for batch in batches:
            found = [splitter.ends(t) if t.strip() else [] for t in batch.column(len(kept)).to_pylist()]
            yield ends_batch(batch.columns[: len(kept)], found, schema)

    return source.mapInArrow(split, schema)


def ends_schema(df: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([*df.select(*kept).schema.fields, T.StructField("end_pos", T.IntegerType())])


def ends_batch(columns: list[pa.Array], found: list[list[int]], schema: T.StructType) -> pa.RecordBatch:
    row = pa.array([i for i, e in enumerate(found) for _ in e], pa.int64())
    return pa.RecordBatch.from_arrays([*(c.take(row) for c in columns), pa.array([x for e in found for x in e], pa.int32())], names=schema.names)


def joined_sentence_ends(df: DataFrame, kept: list[str], text: str, entries: DataFrame) -> DataFrame:
    """As ``sentence_ends`` with a lexicon table of any size: each text gets the entries of the words it asks for.

    Texts are known by their digest, so equal texts share one list; a list is bounded by the text's own words. A
    word that most texts ask for makes a skewed join, which AQE splits.
    """
    source = df.select(*kept, F.col(text).alias("_text"), F.unhex(F.md5(text)).alias("_key")).where("_text is not null")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [sorted(words_asked(t)) for t in batch.column(0).to_pylist()]
            row = pa.array([i for i, words in enumerate(asked) for _ in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(row), pa.array([w for words in asked for w in words], pa.string())], names=["_key", "word"])

    asked = source.select("_text", "_key").mapInArrow(ask, "_key binary, word string").distinct()
    # ``common`` counts for all spellings of a word, so it is asked for by the word in small letters.
    spelled = entries.groupBy(F.lower("word").alias("word")).agg(F.max("common").alias("common")).where("common")
    rows = entries.withColumn("common", F.lit(False)).unionByName(
        spelled.select("word", F.lit(None).cast("double").alias("ends"), "common", *(F.lit(False).alias(c) for c in ("never_first", "before_number", "saying"))))
    fields = ["word", "ends", "common", "never_first", "before_number", "saying"]
    own = asked.join(rows, "word").groupBy("_key").agg(F.collect_list(F.struct(*fields)).alias("_words"))
    both = source.join(own, "_key", "left").select(*kept, "_text", "_words")
    schema = ends_schema(df, kept)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, words in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                lexicon = Lexicon()
                for w in words or ():
                    lexicon.add(*(w[f] for f in fields))
                found.append(Splitter(lexicon).ends(t) if t.strip() else [])
            yield ends_batch(batch.columns[: len(kept)], found, schema)

    return both.mapInArrow(split, schema)


def split_sentences(df: DataFrame, kept: list[str], text: str, evidence_texts: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Sentence ends of ``text`` (see ``sentence_ends``) by the lexicon of ``evidence_texts`` (one text column), whatever its size."""
    with_checkpoints(df.sparkSession)
    entries = lexicon_table(evidence_texts).checkpoint()
    if entries.count() <= broadcast_words:
        return sentence_ends(df, kept, text, collected(entries))
    return joined_sentence_ends(df, kept, text, entries)
