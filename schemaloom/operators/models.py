"""Boundaries to outside models: parsers, encoders, generators. A model is a function on a batch of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, STEP = 510, 255
MOST_WORDS = 256


def apply_model(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list]], out: str, kind: str, batch: int = 256) -> DataFrame:
    """``df`` with ``out``, what the model says of ``text``. ``load`` is called once a task; null texts give null."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), *T._parse_datatype_string(f"{out} {kind}").fields])
    rows = df.select(*(f.name for f in schema.fields[:-1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            there = part[text].notna()
            texts, said = part.loc[there, text].tolist(), []
            for i in range(0, len(texts), batch):
                said += list(model(texts[i : i + batch]))
            result = pd.Series([None] * len(part), index=part.index, dtype=object)
            result[there] = pd.Series(said, index=part.index[there], dtype=object)
            yield part.assign(**{out: result})

    return rows.mapInPandas(run, schema)


def hashed_encoder(size: int = 64) -> Callable[[], Callable[[list[str]], list]]:
    """A stand-in encoder: hashed character trigrams, of unit length."""
    import zlib

    def load() -> Callable[[list[str]], list]:
        def encode(texts: list[str]) -> list:
            out = []
            for t in texts:
                v = np.zeros(size, np.float32)
                for i in range(max(1, len(t) - 2)):
                    v[zlib.crc32(t[i : i + 3].encode()) % size] += 1
                out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
            return out

        return encode

    return load


def bigram_similarity(a: str, b: str) -> float:
    """Stand-in for a lexical network's similarity: Jaccard of character bigrams."""
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} or {w} for w in (a, b))
    return len(x & y) / len(x | y)


def windows(df: DataFrame, tokens: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """``df`` with ``window_no, begin, window``: overlapping windows of a long token array; a short one is one window."""
    last = F.greatest(F.ceil((F.size(tokens) - size) / step), F.lit(0)).cast("int")
    numbered = df.withColumn("window_no", F.explode(F.sequence(F.lit(0), last)))
    return numbered.withColumn("begin", F.col("window_no") * step).withColumn("window", F.slice(tokens, F.col("begin") + 1, size))


@dataclass(frozen=True)
class Generation:
    """How a generating model is asked: most new words, sampling, sequences a prompt, beams. More than MOST_WORDS are refused."""

    length: int = 64
    sample: bool = True
    sequences: int = 3
    beams: int = 1

    def __post_init__(self) -> None:
        if not 0 < self.length <= MOST_WORDS or self.sequences < 1 or self.beams < 1:
            raise ValueError(f"length from 1 to {MOST_WORDS}, at least one sequence and beam")


def generated(df: DataFrame, prompt: str, load: Callable[[], Callable[[list[str], Generation], list[list[str]]]], how: Generation = Generation(), batch: int = 16) -> DataFrame:
    """``df`` with ``sequence_no, raw``: a row a completion of ``prompt``. ``load`` is called once a task, so that a model is loaded once
    or a client of a hosted one is opened; a null prompt, or one that the model can't take (RuntimeError), has no rows."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("sequence_no int, raw string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def ask(texts: list[str]) -> list[list[str]]:
            try:
                return model(texts, how)
            except RuntimeError:
                return [[]] if len(texts) == 1 else [ask([t])[0] for t in texts]

        for part in batches:
            kept = part[part[prompt].notna()]
            said = [s for i in range(0, len(kept), batch) for s in ask(kept[prompt].tolist()[i : i + batch])]
            count = [len(s) for s in said]
            out = kept.loc[kept.index.repeat(count)]
            yield out.assign(sequence_no=np.concatenate([np.arange(c) for c in count] or [np.zeros(0)]).astype("int32"), raw=pd.Series([x for s in said for x in s], index=out.index, dtype=object))

    return df.mapInPandas(run, schema)


def chunked(words: list[list[int]], most: int = WINDOW) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """``(chunks, spans)`` of words cut into pieces: chunks of at most ``most`` pieces, each beginning with the last half of the one
    before; of each word the chunk, the first piece and the end. No word is cut unless it is longer than a chunk."""
    chunks: list[list[int]] = []
    chunk: list[int] = []
    spans = []
    for pieces in words:
        if chunk and len(chunk) + len(pieces) > most:
            chunks.append(chunk)
            chunk = chunk[-(most // 2) :] if most // 2 else []
            if len(chunk) + len(pieces) > most:
                chunk = []
        spans.append((len(chunks), len(chunk), len(chunk) + len(pieces)))
        chunk = chunk + list(pieces)
    return chunks + [chunk], spans


def word_vectors(df: DataFrame, tokens: str, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], np.ndarray]]], out: str = "vectors") -> DataFrame:
    """``df`` with a vector for each token: the mean of its pieces' vectors, from the chunk that it is whole in.

    ``load`` gives, once a task, a function from a word to its pieces and one from the pieces of a chunk to a vector
    each. A token without pieces has a vector of zeros; null arrays stay null.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, encode = load()
        for part in batches:
            found = []
            for words in part[tokens]:
                if words is None:
                    found.append(None)
                    continue
                chunks, spans = chunked([cut(w) if w is not None else [] for w in words])
                encoded = [np.asarray(encode(c), np.float32) for c in chunks]
                size = next((e.shape[1] for e in encoded if e.size), 0)
                found.append([encoded[c][a:b].mean(0).tolist() if b > a else [0.0] * size for c, a, b in spans])
            yield part.assign(**{out: pd.Series(found, index=part.index, dtype=object)})

    return df.select(*kept).mapInPandas(run, schema)


def masked_expansions(df: DataFrame, item: str, tokens: str, index: str, load: Callable[[], Callable[[list[str]], list]], k: int = 50, mask: str = "[MASK]") -> DataFrame:
    """``item, place, word, prob``: the ``k`` words that a masked model finds likeliest in place of the token at ``index`` (from 0).

    The model gives (word, probability) pairs for each sentence, in any order; equal ones go by the word. An index outside
    of the sentence gives nothing.
    """
    inside = df.where((F.col(index) >= 0) & (F.col(index) < F.size(tokens)))
    words = F.transform(tokens, lambda w, i: F.when(i == F.col(index), F.lit(mask)).otherwise(F.lower(w)))
    asked = inside.select(item, F.array_join(words, " ").alias("_masked"))
    said = apply_model(asked, "_masked", load, "_said", "array<struct<word:string,prob:double>>")
    best = F.slice(F.array_sort(F.transform("_said", lambda x: F.struct((-x["prob"]).alias("p"), x["word"].alias("w")))), 1, k)
    return said.select(item, F.posexplode(best).alias("place", "x")).select(item, "place", F.col("x.w").alias("word"), (-F.col("x.p")).alias("prob"))


def network_similarity(pairs: DataFrame, senses: DataFrame, paths: DataFrame) -> DataFrame:
    """``a, b, similarity``: the greatest similarity between a sense of each word of a pair, 0 where there is none.

    ``senses`` is ``word, sense``, ``paths`` is ``s, t, similarity`` (either order). Words have few senses, so joins by word stay small.
    """
    one = pairs.select("a", "b").distinct().join(senses.select(F.col("word").alias("a"), F.col("sense").alias("s")), "a", "left").join(senses.select(F.col("word").alias("b"), F.col("sense").alias("t")), "b", "left")
    both = paths.select("s", "t", "similarity").unionByName(paths.select(F.col("t").alias("s"), F.col("s").alias("t"), "similarity")).groupBy("s", "t").agg(F.max("similarity").alias("_p"))
    met = one.join(both, ["s", "t"], "left").withColumn("_p", F.when(F.col("s") == F.col("t"), F.lit(1.0)).otherwise(F.coalesce("_p", F.lit(0.0))))
    return met.groupBy("a", "b").agg(F.max("_p").alias("similarity"))
