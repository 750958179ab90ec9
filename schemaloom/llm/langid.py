"""Language of documents and of the segments of mixed ones.

String-kernel classification. A unit of text is the set of its character n-grams (n = 1 to ORDER); two units'
kernel is the number of shared n-grams over the geometric mean of the sets' sizes. Nyström landmarks turn the
kernel into features, and one ridge regression a language is fitted on them, on a bounded sample of labelled
units. Scores are products of the batch's sparse presence matrix with the n-gram weights: the kernel is linear
in the presence of landmark n-grams, so landmarks, whitening and regression fold into one weight matrix.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two-letter language codes that are assigned; a label must be one of them to name a language.
ASSIGNED = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
ORDER = 4
MAX_UNIT = 2000
# Letters that a sentence has at least; shorter pieces go with the next one.
LEAST_SENTENCE = 14
# Size of the training sample, whatever the size of the data.
UNITS_PER_LABEL = 400
LANDMARKS_PER_LABEL = 60
# A label is a language to learn if held-out units with it are mostly given to it; fewer units than these can't show that.
LEAST_HELD_OUT, LEAST_OWN = 10, 0.5
RIDGE = 0.3
CHUNK_CHARS = 200_000
# Bits of an n-gram's key; the rest number the units of a chunk.
KEY_BITS = 42
SLOT_BITS = 17

# Opening and closing quotation marks.
QUOTED = re.compile("\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|「[^「」\n]+」|『[^『』\n]+』")
# A full stop after fewer than four letters may belong to an abbreviation, so it parts nothing here.
BREAK = re.compile(r"\n+|(?:(?<=[!?…।॥])|(?<=[^\W\d_]{4}\.)|(?<=\d{4}\.)|(?<=\.[\"”’»]))[\"”’»)]*\s+(?![a-zà-ÿа-я])|(?<=[。！？])[”」』）\"]*\s*")
ENDS = ".!?…。！？।"
WORD_GAP = re.compile(r"\s")
NO_LETTER = re.compile(r"[\W\d_]+")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")


def stands_alone(text: str, at: int, to: int) -> bool:
    """Whether the quotation text[at:to] is a sentence of its own and not part of one."""
    before, after = text[:at].rstrip(" \t")[-1:], text[to:]
    rest = after.lstrip(" \t")[:1]
    closed = text[at + 1 : to - 1].rstrip()[-1:] in (*ENDS,)
    return closed and (not before or before in ENDS + "\n\"”»") and (not rest or rest == "\n" or after[:1].isspace() and not rest.islower())


def units_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, words)`` of the sentences of ``text``, without what they quote.

    Pieces too short to be a sentence (abbreviations, numbers) go with the next one; a piece over MAX_UNIT
    characters is cut at a blank.
    """
    return [unit[:3] for unit in weighed_units(text)]


def weighed_units(text: str) -> list[tuple[int, int, str, int]]:
    """``units_of`` with the weight of each."""
    bare = QUOTED.sub(lambda m: m.group() if stands_alone(text, m.start(), m.end()) else " " * len(m.group()), text)
    if not any(c.isalpha() for c in bare):
        bare = text
    edges = [0]
    for m in BREAK.finditer(bare):
        if m.end() > edges[-1]:
            edges.append(m.end())
    edges.append(len(bare))
    out: list[tuple[int, int, str, int]] = []
    start, pieces = 0, list(zip(edges, edges[1:]))
    for i, (_, end) in enumerate(pieces):
        piece = bare[start:end]
        heavy = weight(piece)
        if heavy < LEAST_SENTENCE and i + 1 < len(pieces) and "\n" not in piece:
            continue
        while end - start > MAX_UNIT:
            gap = WORD_GAP.search(bare, start + MAX_UNIT - 200, start + MAX_UNIT)
            cut = gap.end() if gap else start + MAX_UNIT
            out.append((start, cut, bare[start:cut], weight(bare[start:cut])))
            start, heavy = cut, -1
        if heavy > 0 or any(c.isalpha() for c in bare[start:end]):
            out.append((start, end, bare[start:end], heavy if heavy >= 0 else weight(bare[start:end])))
        start = end
    return out


def weight(piece: str) -> int:
    """Letters of ``piece``; an ideograph or kana counts as four."""
    return len(NO_LETTER.sub("", piece)) + 3 * len(WIDE.findall(piece))


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for letters and marks of the basic plane; all code points beyond it are letters."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])


def grams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(unit number, n-gram key)`` of the distinct n-grams of every unit, sorted by both."""
    joined = " " + " \n ".join(u.lower().replace("\n", " ") for u in units) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    edge = c == 10
    letter = np.where(c < 0x10000, letter_table()[np.minimum(c, 0xFFFF).astype(np.int64)], True)
    c = np.where(letter | edge, c, np.uint64(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, edge = c[keep], edge[keep]
    unit = np.cumsum(edge)
    blank = c == 32
    rows, keys = [], []
    mixed = np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            last = len(c) - n + 1
            if last <= 0:
                break
            mixed = mixed[:last] * np.uint64(0x9E3779B97F4A7C15) + (c[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
            inside = ~edge[:last] & ~edge[n - 1 :] & (unit[:last] == unit[n - 1 :])
            if n == 1:
                inside &= ~blank
            rows.append(unit[:last][inside])
            keys.append(mixed[inside])
    # One integer a pair, unit first, so that a plain sort orders both.
    both = np.sort(np.concatenate(rows).astype(np.uint64) << np.uint64(KEY_BITS) | np.concatenate(keys) >> np.uint64(64 - KEY_BITS))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    return (both >> np.uint64(KEY_BITS)).astype(np.int64), both & np.uint64((1 << KEY_BITS) - 1)


def places_of(key: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted ``vocabulary``, -1 if it isn't there. Keys are hashes, so their first bits tell
    where to look, and few entries share them."""
    begin = np.searchsorted(vocabulary, np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - SLOT_BITS))
    at = begin[(key >> np.uint64(KEY_BITS - SLOT_BITS)).astype(np.int64)]
    padded = np.concatenate([vocabulary, np.full(int(np.diff(begin).max(initial=0)) + 1, np.uint64((1 << 63) - 1))])
    out = np.full(len(key), -1)
    for step in range(int(np.diff(begin).max(initial=0))):
        hit = padded[at + step] == key
        out[hit] = at[hit] + step
    return out


def presence_product(row: np.ndarray, key: np.ndarray, n: int, vocabulary: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Presence matrix (``n`` units by vocabulary) times ``weights``, each row over the root of its number of n-grams."""
    out = np.zeros((n, weights.shape[1]), np.float32)
    size = np.bincount(row, minlength=n)
    place = places_of(key, vocabulary)
    known = place >= 0
    row, at = row[known], place[known]
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[starts]] = np.add.reduceat(weights[at], starts, axis=0)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


@dataclass
class LanguageModel:
    languages: tuple[str, ...]
    vocabulary: np.ndarray
    weights: np.ndarray

    def scores(self, units: list[str]) -> np.ndarray:
        """One row a unit, one column a language; about 1 for its own language and -1 for the others."""
        out, part, size = [], [], 0
        for i, u in enumerate(units):
            part.append(u)
            size += len(u)
            if size >= CHUNK_CHARS or i == len(units) - 1:
                row, key = grams(part)
                out.append(presence_product(row, key, len(part), self.vocabulary, self.weights))
                part, size = [], 0
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def fit(units: list[str], labels: list[str], landmarks: int = LANDMARKS_PER_LABEL, ridge: float = RIDGE, rounds: int = 2) -> LanguageModel:
    """The classifier of ``units``. Labels may be partly wrong: after a round, units that the model clearly gives
    to another language are left out of the next. Without units of two languages it can't be fitted."""
    languages = tuple(sorted(set(labels)))
    if len(languages) < 2:
        raise ValueError("labelled texts of two languages at least are needed")
    model = None
    for _ in range(rounds):
        if model is not None:
            score = model.scores(units)
            own = score[np.arange(len(units)), [languages.index(x) for x in labels]]
            kept = np.flatnonzero(own >= score.max(axis=1) - 0.2)
            units, labels = [units[i] for i in kept], [labels[i] for i in kept]
        marks = [i for x in languages for i in [j for j, y in enumerate(labels) if y == x][:landmarks]]
        row, key = grams([units[i] for i in marks])
        vocabulary, column = np.unique(key, return_inverse=True)
        incidence = np.zeros((len(vocabulary), len(marks)), np.float32)
        incidence[column, row] = 1.0
        incidence /= np.sqrt(np.maximum(np.bincount(row, minlength=len(marks)), 1))
        between = np.concatenate([
            presence_product(*grams(units[i : i + 50]), len(units[i : i + 50]), vocabulary, incidence) for i in range(0, len(units), 50)
        ])
        value, vector = np.linalg.eigh(between[marks].astype(np.float64))
        whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        features = between @ whiten
        target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        solved = np.linalg.solve(features.T @ features + ridge * np.eye(len(marks)), features.T @ target)
        model = LanguageModel(languages, vocabulary, (incidence @ (whiten @ solved)).astype(np.float32))
    return model


def label_language(label: Column) -> Column:
    """The language that a label names, without case and region; null if it names none."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code.isin(*ASSIGNED), code)


def training_units(documents: DataFrame, item: str, text: str, label: str, per_label: int = UNITS_PER_LABEL, seed: int = 3) -> list[tuple[str, str]]:
    """At most ``per_label`` units a label, drawn by hash from all labelled documents: ``(label, unit)``.

    Up to two units of a document are taken, of at most MAX_UNIT characters, so what comes to the driver is
    bounded by the parameters and the number of codes. One pass counts the labels, one cuts the texts drawn.
    """
    known = documents.select(F.xxhash64(F.lit(seed), item).alias("h"), F.col(text).alias("text"), label_language(F.col(label)).alias("label"))
    known = known.where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("label") == lang, min(1.0, 3.0 * per_label / n)).otherwise(chance)
    drawn = known.where(F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003.0 < chance)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, body, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = [u for _, _, u, w in weighed_units(body) if w >= 20]
                rows += [(h, lang, found[(h + k * 7919) % len(found)]) for k in range(min(2, len(found)))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["h", "label", "unit"])

    found = drawn.mapInArrow(cut, "h bigint, label string, unit string")
    # The sample is bounded by now; each label's units in hash order.
    first = Window.partitionBy("label").orderBy("h", "unit")
    rows = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_label).collect()
    return [(r["label"], r["unit"]) for r in sorted(rows, key=lambda r: (r["label"], r["_n"]))]


def learnable(sample: list[tuple[str, str]]) -> set[str]:
    """Labels that stand for one language: a model of every other unit gives most of the remaining ones to them."""
    fitted, held = sample[::2], sample[1::2]
    labels = {x for x, _ in fitted}
    counted = Counter(x for x, _ in held)
    doubtful = {x for x in labels if counted[x] >= LEAST_HELD_OUT}
    if len(labels) < 2 or not doubtful:
        return {x for x, _ in sample}
    model = fit([u for _, u in fitted], [x for x, _ in fitted], rounds=1)
    best = [model.languages[i] for i in model.scores([u for _, u in held]).argmax(axis=1)]
    own = Counter(x for (x, _), y in zip(held, best) if x == y)
    return {x for x, _ in sample} - {x for x in doubtful if own[x] < LEAST_OWN * counted[x]}


def fit_documents(documents: DataFrame, item: str, text: str, label: str) -> LanguageModel:
    """The model of the languages that the labels of ``documents`` name and whose texts can be told from the others'."""
    sample = training_units(documents, item, text, label)
    languages = learnable(sample)
    kept = [(x, u) for x, u in sample if x in languages]
    return fit([u for _, u in kept], [x for x, _ in kept])


SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double,sure:boolean>>"


def identify(documents: DataFrame, kept: list[str], text: str, model: LanguageModel, margin: float = 0.45) -> DataFrame:
    """Columns ``kept`` and ``lang, confidence, languages, segments`` of every document.

    A segment is a run of sentences in one language, ``start`` and ``end`` in code points of the stored text.
    ``languages`` are those with a whole sentence that beats every other language by ``margin``, most text
    first; ``lang`` is the first. Null, blank and wordless texts have null ``lang`` and no segments.
    """
    source = documents.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*documents.select(*kept).schema.fields, *T._parse_datatype_string(f"lang string, confidence double, languages array<string>, segments {SEGMENTS}").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                cut = [weighed_units(t) if t else [] for t in batch.column(len(kept)).to_pylist()]
                flat = [u for units in cut for u in units]
                scores = model.scores([u for _, _, u, _ in flat])
                order = np.argsort(scores, axis=1)
                best = order[:, -1] if len(flat) else np.zeros(0, int)
                place = np.arange(len(flat))
                gap = scores[place, best] - scores[place, order[:, -2]] if len(flat) else np.zeros(0)
                shifted = np.exp(3.0 * (scores - scores.max(axis=1, keepdims=True))) if len(flat) else scores
                sure = shifted[place, best] / shifted.sum(axis=1) if len(flat) else np.zeros(0)
                out, k = [], 0
                for units in cut:
                    segments, size, trust, used = [], {}, {}, {}
                    for start, end, _, w in units:
                        lang = str(names[best[k]])
                        size[lang], trust[lang] = size.get(lang, 0) + w, trust.get(lang, 0.0) + w * float(sure[k])
                        certain = bool(gap[k] >= margin and w >= LEAST_SENTENCE)
                        if certain:
                            used[lang] = used.get(lang, 0) + w
                        if segments and segments[-1]["lang"] == lang:
                            last = segments[-1]
                            total = last["w"] + w
                            last.update(end=end, confidence=(last["confidence"] * last["w"] + float(sure[k]) * w) / max(total, 1), w=total, sure=last["sure"] or certain)
                        else:
                            segments.append({"start": start, "end": end, "lang": lang, "confidence": float(sure[k]), "w": w, "sure": certain})
                        k += 1
                    ranked = sorted(used or size, key=lambda x: (-(used or size)[x], x))
                    if not used:
                        ranked = ranked[:1]
                    top = ranked[0] if ranked else None
                    share = size[top] / max(sum(size.values()), 1) if top else None
                    clean = [{x: s[x] for x in ("start", "end", "lang", "confidence", "sure")} for s in segments]
                    out.append((top, share * trust[top] / max(size[top], 1) if top else None, ranked, clean))
                cols = list(zip(*out)) if out else [[]] * 4
                kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), SEGMENT_TYPE]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=schema.names)

    return source.mapInArrow(score, schema)


SEGMENT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sure", pa.bool_())]))
