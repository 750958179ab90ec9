"""How often every term occurs and in how many records, and which terms are too rare or too common.

(term, record) pairs are range-partitioned on both columns, sorted externally within partitions and scanned for
runs: a frequent term spreads over several partitions, and its parts are stitched from partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.range_runs import per_key_states

LETTERS = r"\p{L}+"


def words_of(text: Column) -> Column:
    """Maximal runs of letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def record_terms(df: DataFrame, record: str, terms: str) -> DataFrame:
    """``key, value, piece, n``: per record and term the term's count in the record.

    ``terms`` is an array. Each record must be there once; null terms and null or empty arrays count nothing.
    """
    counted = F.transform(
        F.array_distinct(F.filter(terms, lambda t: t.isNotNull())),
        lambda t: F.struct(t.alias("key"), F.size(F.filter(terms, lambda x: x == t)).cast("bigint").alias("n")),
    )
    return df.select(F.col(record).alias("value"), F.inline(counted)).select("key", "value", F.lit(0).cast("bigint").alias("piece"), "n")


def long_record_terms(df: DataFrame, record: str, terms: str) -> DataFrame:
    """As ``record_terms`` with one row an occurrence, for records of any length: counting is left to the scan."""
    rows = df.select(F.col(record).alias("value"), F.explode(terms).alias("key")).where("key is not null")
    return rows.select("key", "value", F.lit(0).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("n"))


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """``term, n_occurrences, n_records`` of ``key, value (record), piece, n``. A record id must not be null."""
    states = per_key_states(pairs)
    return states.select(F.col("key").alias("term"), F.col("n_rows").alias("n_occurrences"), F.col("n_values").alias("n_records"))


def marked(frequencies: DataFrame, total: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``frequencies`` with ``mark``: 'rare' in at most ``rare`` records, 'common' in more than ``common`` of all, else null.

    ``total`` is one row with ``n_all``. A term that is both (tiny collections) is common.
    """
    n_all = total.select("n_all").scalar()
    return frequencies.withColumn("mark", F.when(F.col("n_records") > F.lit(common) * n_all, "common").when(F.col("n_records") <= rare, "rare"))
