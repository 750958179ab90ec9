"""Columns of parsed subject-verb-object records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.session import BLANK, deliver_once, squeeze


def lemma_of(lemma: Column) -> Column:
    """A verb lemma without outer white space and the negation mark, in lower case; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(lemma, f"^{BLANK}+|{BLANK}+$", ""), f"^!{BLANK}*", "")
    return F.nullif(F.lower(bare), F.lit(""))


def is_negated(lemma: Column) -> Column:
    return F.regexp_replace(lemma, f"^{BLANK}+", "").startswith("!")


def phrase_of(text: Column) -> Column:
    """A phrase in lower case with single blanks; null if nothing is left."""
    return F.nullif(F.lower(squeeze(text)), F.lit(""))


def triples_once(parsed: DataFrame) -> DataFrame:
    """``sent_id, subj, lemma, negated, obj`` of every triple that isn't null, each record counted once."""
    clean = F.transform(
        F.filter("svos", lambda s: s.isNotNull()),
        lambda s: F.struct(
            phrase_of(s["subj"]["text"]).alias("subj"),
            lemma_of(s["verb"]["lemma"]).alias("lemma"),
            F.coalesce(is_negated(s["verb"]["lemma"]), F.lit(False)).alias("negated"),
            phrase_of(s["obj"]["text"]).alias("obj"),
        ),
    )
    rows = parsed.select("sent_id", clean.alias("triples")).where(F.size("triples") > 0)
    once = deliver_once(rows, "sent_id", ["sent_id", "triples"])
    return once.select("sent_id", F.inline("triples"))
