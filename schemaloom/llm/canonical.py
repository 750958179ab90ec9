"""One consistent form for text that looks the same.

Text goes from Arrow to code-point arrays; a lookup table gives every code point the offset and length of its
expansion, so removal, mapping and decomposition of a whole batch are a few gathers. Marks are then brought
into canonical order and composed with array operations over all marks of equal rank at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.llm.codepoints import to_codepoints, to_text
from schemaloom.session import with_checkpoints

# Look-alike letters and the Latin letter each is drawn like, by script.
LOOKALIKES = {
    "cyrillic": {"АВЕЅІЈКМНОРСТХУԚԜҮӀ": "ABESIJKMHOPCTXYQWYI", "асеһіјорѕухԁԛԝѵүӏ": "acehijopsyxdqwvyl"},
    "greek": {"ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX", "ονϲϳ": "ovcj"},
    "armenian": {"օ": "o"},
    "cherokee": {"ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ": "ABCDEGHJKLMPSTVWZR"},
}
# Latin variants and hyphens, which become the common one everywhere.
VARIANTS = {"ɑɡ": "ag", "‐‑": "--"}
# Blocks of the scripts above, Latin first.
BLOCKS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "cyrillic": [(0x400, 0x52F)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "armenian": [(0x531, 0x587)], "cherokee": [(0x13A0, 0x13FD), (0xAB70, 0xABBF)],
}
# Decompositions that change only width or presentation.
FORMS = {"<wide>", "<narrow>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
# Code points whose <compat> decomposition is drawn alike: ligatures, radicals, digraphs, Roman numerals.
ALIKE_COMPAT = [(0xFB00, 0xFB17), (0x2E80, 0x2FDF), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0x2160, 0x217F)]
# Format characters (category Cf) that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
# Characters without a width that are not in category Cf.
UNDRAWN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

SPACE, NEWLINE = 0x20, 0x0A
HANGUL_S, HANGUL_L, HANGUL_V, HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7


@lru_cache(maxsize=4)
def tables(canonical_only: bool = False) -> dict[str, np.ndarray]:
    """Lookup tables over all code points; built once a worker from the Unicode data of Python.

    ``canonical_only`` leaves out everything but canonical decomposition: the result is then NFC.
    """
    alike = {} if canonical_only else {a: b for k, v in VARIANTS.items() for a, b in zip(k, v, strict=True)}
    compat = {c for a, b in ALIKE_COMPAT for c in range(a, b + 1)}

    def decompose(c: int) -> list[int]:
        said = unicodedata.decomposition(chr(c)).split()
        if said and not said[0].startswith("<"):
            return [x for p in said for x in decompose(int(p, 16))]
        if said and not canonical_only and (said[0] in FORMS or said[0] == "<compat>" and c in compat):
            out = [x for p in said[1:] for x in decompose(int(p, 16))]
            return [c] if SPACE in out and len(out) > 1 else out  # a mark on a blank is drawn otherwise
        return [c]

    def expansion(c: int) -> list[int]:
        char = chr(c)
        kind = unicodedata.category(char)
        if not canonical_only:
            if c in UNDRAWN or kind == "Cf" and c not in DRAWN_FORMAT:
                return []
            if kind == "Zs" or c == 0x09:
                return [SPACE]
            if kind in ("Zl", "Zp"):
                return [NEWLINE]
        return [ord(alike.get(chr(x), chr(x))) for x in decompose(c)]

    size = sys.maxunicode + 1
    length, offset, ccc = np.ones(size, np.int32), np.arange(size, dtype=np.int64), np.zeros(size, np.uint8)
    flat: list[int] = []
    for c in range(size):
        if 0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0xA000 or HANGUL_S <= c < 0xF900 or 0x17000 <= c < 0x18D00 or 0x20000 <= c < 0x2F800 or 0x2FA20 <= c < 0xE0000 or c >= 0xE0200:
            continue  # blocks without decompositions, marks or invisible characters
        out = expansion(c)
        ccc[c] = unicodedata.combining(chr(c))
        if out != [c]:
            length[c], offset[c] = len(out), size + len(flat)
            flat += out
    pairs: dict[int, int] = {}
    for c in range(0x30000):
        said = unicodedata.decomposition(chr(c)).split()
        if len(said) != 2 or said[0].startswith("<") or unicodedata.normalize("NFC", chr(c)) != chr(c):
            continue
        base, mark = chr(int(said[0], 16)), int(said[1], 16)
        pairs[ord(base) << 21 | mark] = c
    keys = np.array(sorted(pairs), np.int64)
    composed = np.array([pairs[k] for k in keys.tolist()], np.uint32)
    return {
        "length": length, "offset": offset, "ccc": ccc, "keys": keys, "composed": composed,
        "flat": np.concatenate([np.arange(size, dtype=np.uint32), np.array(flat, np.uint32)]),
        "second": np.unique(keys & 0x1FFFFF).astype(np.uint32),
    }


@lru_cache(maxsize=1)
def script_tables() -> dict[str, np.ndarray]:
    """``latin``: the Latin look-alike of a letter; ``script``: 0 no letter of BLOCKS, 1 drawn like letters of several
    scripts, 2 Latin alone, 3 and on the others; ``own``: by script and Latin letter, the letter drawn alike."""
    size = sys.maxunicode + 1
    latin, script = np.arange(size, dtype=np.uint32), np.zeros(size, np.uint8)
    own = np.tile(np.arange(0x250, dtype=np.uint32), (len(BLOCKS) + 2, 1))
    for i, (name, blocks) in enumerate(BLOCKS.items(), 2):
        for c in (c for a, b in blocks for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "L"):
            script[c] = i
        for letters, drawn in LOOKALIKES.get(name, {}).items():
            for a, b in zip(letters, drawn, strict=True):
                latin[ord(a)] = ord(b)
                if own[i, ord(b)] == ord(b):
                    own[i, ord(b)] = ord(a)
    script[np.unique(latin[script > 2])[np.unique(latin[script > 2]) < 0x250]] = 1
    return {"latin": latin, "script": script, "own": own}


def one_script_a_word(points: np.ndarray, offsets: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Decomposed code points with the look-alike letters of each word in one script.

    The script of a word is that of its letters that only one script has (Latin, if it has some); a word of
    look-alike letters alone takes the script that most of its text's other letters have, Latin if there is
    none. What looks the same has the same unmistakable letters, so it becomes the same.
    """
    t = script_tables()
    if not (t["script"][points] > 2).any():
        return points
    drawn = t["latin"][points]
    script = t["script"][drawn]
    row_start = np.zeros(len(points) + 1, bool)
    row_start[offsets] = True
    inside = (script > 0) | (ccc > 0)
    word = np.cumsum(~inside | row_start[:-1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(BLOCKS)
    sure = np.flatnonzero(script > 1)
    kind = script[sure].astype(np.int64) - 2
    by_word = np.bincount(word[sure] * n + kind, minlength=(int(word[-1]) + 1) * n).reshape(-1, n)
    by_row = np.bincount(row[sure] * n + kind, minlength=(len(offsets) - 1) * n).reshape(-1, n)
    of_word = np.where(by_word[:, 0] > 0, 0, by_word.argmax(axis=1))
    open_word = by_word.sum(axis=1) == 0
    at = np.flatnonzero(script == 1)
    chosen = np.where(open_word[word[at]], by_row.argmax(axis=1)[row[at]], of_word[word[at]])
    drawn = drawn.copy()
    drawn[at] = t["own"][chosen + 2, drawn[at]]
    return drawn


def lookup_pairs(t: dict[str, np.ndarray], base: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The composed character of each pair, 0 where there is none."""
    key = (base.astype(np.int64) << 21) | mark
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    out = np.where(t["keys"][at] == key, t["composed"][at], 0).astype(np.uint32)
    lead = (base >= HANGUL_L) & (base < HANGUL_L + 19) & (mark >= HANGUL_V) & (mark < HANGUL_V + 21)
    out = np.where(lead, HANGUL_S + ((base - HANGUL_L) * 21 + (mark - HANGUL_V)) * 28, out)
    open_syllable = (base >= HANGUL_S) & (base < HANGUL_S + 11172) & ((base - HANGUL_S) % 28 == 0)
    return np.where(open_syllable & (mark > HANGUL_T) & (mark < HANGUL_T + 28), base + (mark - HANGUL_T), out).astype(np.uint32)


def canonical_points(points: np.ndarray, offsets: np.ndarray, canonical_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of the consistent form."""
    t = tables(canonical_only)
    points = points.astype(np.int64)
    lens = t["length"][points].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lens)])
    shift = np.repeat(t["offset"][points] - ends[:-1], lens)
    points = t["flat"][shift + np.arange(ends[-1])]
    offsets = ends[offsets]
    ccc = t["ccc"][points]
    if not canonical_only and len(points):
        points = one_script_a_word(points, offsets, ccc)
    marks = ccc > 0
    row_start = np.zeros(len(points) + 1, bool)
    row_start[offsets] = True
    row_start = row_start[:-1]
    if marks.any():
        segment = np.cumsum(~marks | row_start)
        if ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0) & (segment[1:] == segment[:-1])).any():
            order = np.lexsort((ccc, segment))
            points, ccc = points[order], ccc[order]
            marks = ccc > 0
    keep = np.ones(len(points), bool)
    points = points.copy()
    if marks.any():
        where = np.arange(len(points))
        starter = np.maximum.accumulate(np.where(~marks | row_start, where, 0))
        headless = marks[starter]  # a row that begins with a mark has nothing to carry it
        rank = where - starter
        todo = np.flatnonzero(marks & ~headless)
        todo = todo[np.argsort(rank[todo], kind="stable")]
        last = np.zeros(len(points), np.uint8)
        for step in np.split(todo, np.flatnonzero(np.diff(rank[todo])) + 1):
            base = starter[step]
            made = lookup_pairs(t, points[base], points[step])
            made[(last[base] >= ccc[step]) & (last[base] > 0)] = 0
            hit = made > 0
            points[base[hit]] = made[hit]
            keep[step[hit]] = False
            last[base[~hit]] = ccc[step[~hit]]
    counted = np.concatenate([[0], np.cumsum(keep)])
    points, offsets, row_start = points[keep], counted[offsets], row_start[keep]
    while len(points) > 1:
        second = np.isin(points[1:], t["second"]) | ((points[1:] >= HANGUL_V) & (points[1:] < HANGUL_T + 28))
        at = np.flatnonzero(second & ~row_start[1:] & (t["ccc"][points[1:]] == 0))
        made = lookup_pairs(t, points[at], points[at + 1])
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1  # of neighbouring pairs the leftmost goes first
        at, made = at[first], made[first]
        points[at] = made
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        counted = np.concatenate([[0], np.cumsum(keep)])
        points, offsets, row_start = points[keep], counted[offsets], row_start[keep]
    return points, offsets


def canonical_array(text: pa.Array, canonical_only: bool = False) -> pa.Array:
    points, offsets = canonical_points(*to_codepoints(text), canonical_only)
    return to_text(points, offsets, text.is_valid().to_numpy(zero_copy_only=False))


def canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out``.

    Unified: width and presentation forms, kinds of blank (tab too), order and composition of marks, and
    look-alike letters, which take the script of their word (``one_script_a_word``): a Cyrillic word stays
    Cyrillic. Characters without a width go. Kept: case, visible accents, raised digits, the number of blanks,
    line breaks. Texts look the same exactly if their forms are equal. Null stays null, empty stays empty; rows
    aren't merged. A column named ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    narrow = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*narrow.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = canonical_array(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, form], names=schema.names)

    return narrow.mapInArrow(run, schema)


def spellings(df: DataFrame, record: str, text: str) -> DataFrame:
    """``id, form, spelling`` of the records in classes of several spellings: digests of the look of a text and of the text.

    One pass makes the digests, and only these are shuffled; they are written to the checkpoint folder and read from
    there. Of deliveries of one id that differ, the text whose digest sorts first counts. Null ids and texts are left out.
    """
    with_checkpoints(df.sparkSession)
    forms = canonical(df.select(F.col(record).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"), "text")
    keyed = forms.select("id", F.unhex(F.md5("canonical")).alias("form"), F.unhex(F.md5("text")).alias("spelling"))
    once = keyed.groupBy("id").agg(F.min(F.struct("spelling", "form")).alias("_x"))
    keyed = once.select("id", "_x.form", "_x.spelling").checkpoint()
    # Two numbers a form, combined in each task before the shuffle: a form that most records have costs no more.
    several = keyed.groupBy("form").agg(F.min("spelling").alias("_a"), F.max("spelling").alias("_b")).where("_a <> _b").select("form")
    return keyed.join(several, "form", "left_semi")


def lookalike_classes(df: DataFrame, record: str, text: str) -> DataFrame:
    """``id, class_id, spelling_id, n_links`` of every record that looks like one with another text.

    ``class_id`` is the smallest id of records that look the same, ``spelling_id`` that of records with the same
    text, ``n_links`` the number of records in the class with another text.
    """
    rows = spellings(df, record, text)
    each = rows.groupBy("form", "spelling").agg(F.min("id").alias("spelling_id"), F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("form").agg(F.min("spelling_id").alias("class_id"), F.sum("n").alias("n_all"))
    numbered = each.join(whole, "form").select("form", "spelling", "spelling_id", "class_id", (F.col("n_all") - F.col("n")).alias("n_links"))
    return rows.join(numbered, ["form", "spelling"]).select("id", "class_id", "spelling_id", "n_links")


def lookalike_pairs(df: DataFrame, record: str, text: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of records with different texts that look the same.

    Texts are compared by 128-bit digests of text and look. Only looks
    with more than one spelling go on, and spellings are paired before records, so that equal texts, however
    often they are repeated, are never matched with each other. Null texts have no partners. Where all pairs are
    not wanted, ``lookalike_classes`` says the same in one row a record.
    """
    keyed = spellings(df, record, text)
    kinds = keyed.select("form", "spelling").distinct()
    pairs = kinds.alias("a").join(kinds.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.spelling") < F.col("b.spelling")))
    pairs = pairs.select(F.col("a.form").alias("form"), F.col("a.spelling").alias("one"), F.col("b.spelling").alias("two"))
    left = keyed.select("form", F.col("spelling").alias("one"), F.col("id").alias("x"))
    right = keyed.select("form", F.col("spelling").alias("two"), F.col("id").alias("y"))
    joined = pairs.join(left, ["form", "one"]).join(right, ["form", "two"])
    return joined.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
