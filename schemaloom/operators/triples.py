"""Weighted predicate-subject-object triples: pruning, vocabularies, set operations, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked
from schemaloom.session import with_checkpoints


def without_pos(word: Column) -> Column:
    """``a#b#NN`` is ``a#b``; a mark at the very start isn't one."""
    return F.when(word.rlike(".#"), F.regexp_replace(word, "#[^#]*$", "")).otherwise(word)


def lemma_of(word: Column) -> Column:
    return F.lower(F.split_part(word, F.lit("#"), F.lit(1)))


# Part-of-speech tags and the class a lemma with the tag is generalised to.
POS_CLASSES = {"PERSON": ("PRP", "PR", "FW"), "DET": ("DT", "DET"), "CONJ": ("CC", "CONJ"), "NUM": ("CD", "NU", "NUM")}
THINGS, PERSONS = ("it", "its"), ("who",)


def generalised(lemma: Column, pos: Column) -> Column:
    """The class of a lemma with a closed part of speech; ``it`` is a THING, ``who`` a PERSON whatever its part of speech."""
    out = lemma
    for name, tags in POS_CLASSES.items():
        out = F.when(pos.isin(*tags), name).otherwise(out)
    out = F.when(pos.isin(*POS_CLASSES["PERSON"]) & F.lower(lemma).isin(*THINGS), "THING").otherwise(out)
    return F.when(lemma.isin(*PERSONS), "PERSON").otherwise(out)


def merged(triples: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Equal triples once with the sum of their weights."""
    return triples.groupBy(*keys).agg(F.sum(weight).alias(weight))


def at_least(triples: DataFrame, weight: str, least: float | None) -> DataFrame:
    return triples if least is None else triples.where(F.col(weight) >= least)


def in_vocabulary(triples: DataFrame, columns: list[str], vocabulary: DataFrame) -> DataFrame:
    """Triples whose words all are in ``vocabulary`` (column ``term``)."""
    for c in columns:
        triples = triples.join(vocabulary.select(F.col("term").alias(c)).distinct(), c, "left_semi")
    return triples


# Pronouns and the like, which name nothing.
PRONOUNS = ("i", "he", "she", "it", "they", "you", "this", "we", "them", "their", "us", "my", "those", "who", "what", "that", "which", "each", "some", "me", "one", "the")


def without_pronouns(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """A vocabulary without pronouns. It is only the vocabulary that loses them: triples keep theirs."""
    return vocabulary.where(~F.lower(term).isin(*PRONOUNS))


def vocabularies(triples: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """``place, term, n``: total weight of every word in each place, in one pass over grouping sets."""
    unpivoted = triples.select(F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.col(c).alias("term")) for c in columns))).alias("x"), F.col(weight).alias("w"))
    return unpivoted.select("x.place", "x.term", "w").where("term is not null").groupBy("place", "term").agg(F.sum("w").alias("n"))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times; a row with less than 1 goes."""
    return df.withColumn("_n", times.cast("int")).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def largest(df: DataFrame, key: str, size: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest rows of each key, numbered by ``place``; a key with most rows is numbered in several tasks."""
    numbered = ranked(df, [key], [F.desc(size), F.col(tie)], "place")
    return numbered.withColumn("place", F.col("place").cast("int")).where(F.col("place") <= n)


def frame_members(triples: DataFrame, cluster: str, columns: dict[str, str]) -> DataFrame:
    """``cluster, role, member``: the distinct members of each role of a cluster, a row each."""
    roles = F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("member")) for role, c in columns.items()))
    return triples.select(F.col(cluster).alias("cluster"), F.explode(roles).alias("x")).select("cluster", "x.role", "x.member").where("member is not null").distinct()


def telling_clusters(members: DataFrame, stop: DataFrame) -> DataFrame:
    """Clusters with more than one member in every role once stop words are out."""
    kept = members.join(stop.select(F.col("term").alias("member")), "member", "left_anti")
    sizes = kept.groupBy("cluster", "role").agg(F.count(F.lit(1)).alias("n"))
    roles = members.select("role").distinct().agg(F.count(F.lit(1))).scalar()
    return sizes.where("n > 1").groupBy("cluster").agg(F.count(F.lit(1)).alias("roles"), F.sum("n").alias("n_members")).where(F.col("roles") == roles).select("cluster", "n_members")


def purity_scores(members: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: modified purity, inverse purity and F1 of predicted against gold clusters of weighted elements.

    Both have ``cluster, element``; predicted clusters of a single element count nothing.
    """
    predicted = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # Members are counted before they meet, so an element that is often in a cluster makes one row a side.
    one, two = (df.groupBy("cluster", "element").agg(F.count(F.lit(1)).alias("n")).alias(a) for df, a in ((members, "m"), (gold, "g")))
    joined = one.join(two, F.col("m.element") == F.col("g.element"))
    overlap = joined.groupBy(F.col("m.cluster").alias("p"), F.col("g.cluster").alias("g")).agg(F.sum(F.col("m.n") * F.col("g.n")).alias("n"))
    best = overlap.join(predicted.where("size > 1"), overlap["p"] == predicted["cluster"]).groupBy("p").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"))
    inverse = overlap.groupBy("g").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))
    total, golds = members.agg(F.count(F.lit(1))).scalar(), gold.agg(F.count(F.lit(1))).scalar()
    row = best.withColumn("_k", F.lit(1)).join(inverse.withColumn("_k", F.lit(1)), "_k")
    pu, ipu = F.col("a") / total, F.col("b") / golds
    return row.select(F.round(pu, 6).alias("purity"), F.round(ipu, 6).alias("inverse_purity"), F.round(F.try_divide(2 * pu * ipu, pu + ipu), 6).alias("f1"))


def normalised_purity(members: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row a group of ``by`` (one row without): normalised modified purity, inverse purity and F1.

    Both tables have ``cluster, element`` and the columns ``by``. An element in several clusters shares its weight of 1
    among them; predicted clusters of one element count nothing. Weights meet by (cluster, element), so repeated
    members are summed first.
    """
    by = by or []

    def weighted(df: DataFrame) -> DataFrame:
        own = df.groupBy(*by, "cluster", "element").agg(F.count(F.lit(1)).alias("n"))
        total = own.groupBy(*by, "element").agg(F.sum("n").alias("_all"))
        return own.join(total, [*by, "element"]).select(*by, "cluster", "element", (F.col("n") / F.col("_all")).alias("w"))

    p, g = weighted(members), weighted(gold)
    sized = p.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select(*by, F.col("cluster").alias("p"))
    met = p.withColumnsRenamed({"cluster": "p", "w": "wp"}).join(g.withColumnsRenamed({"cluster": "g", "w": "wg"}), [*by, "element"])
    overlap = met.groupBy(*by, "p", "g").agg(F.sum("wp").alias("wp"), F.sum("wg").alias("wg"))
    best = overlap.join(sized, [*by, "p"], "left_semi").groupBy(*by, "p").agg(F.max("wp").alias("m")).groupBy(*by).agg(F.sum("m").alias("a"))
    inverse = overlap.groupBy(*by, "g").agg(F.max("wg").alias("m")).groupBy(*by).agg(F.sum("m").alias("b"))
    n_p, n_g = p.groupBy(*by).agg(F.sum("w").alias("np")), g.groupBy(*by).agg(F.sum("w").alias("ng"))
    rows = n_p.withColumn("_k", F.lit(1))
    for one in (n_g, best, inverse):
        rows = rows.join(one.withColumn("_k", F.lit(1)), [*by, "_k"], "left")
    pu, ipu = F.coalesce(F.col("a") / F.col("np"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("ng"), F.lit(0.0))
    return rows.select(*by, F.round(pu, 6).alias("purity"), F.round(ipu, 6).alias("inverse_purity"), F.round(F.try_divide(2 * pu * ipu, pu + ipu), 6).alias("f1"))


def purity_bootstrap(members: DataFrame, gold: DataFrame, draws: int = 1000, seed: int = 1337) -> DataFrame:
    """``draw, purity, inverse_purity, f1``: the scores of ``purity_scores`` over predicted clusters drawn with replacement.

    Each draw takes as many clusters as there are, numbers by hash. An element must be in one cluster a side: the copies
    of a cluster then share the weight of its elements, so that they count as one.
    """
    with_checkpoints(members.sparkSession)
    joined = members.alias("m").join(gold.alias("g"), F.col("m.element") == F.col("g.element"))
    overlap = joined.groupBy(F.col("m.cluster").alias("p"), F.col("g.cluster").alias("g")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    best = overlap.groupBy("p").agg(F.max("n").alias("best"))
    sized = members.groupBy(F.col("cluster").alias("p")).agg(F.count(F.lit(1)).alias("size")).join(best, "p", "left")
    clusters = ranked(sized.withColumn("best", F.when(F.col("size") > 1, F.col("best")).otherwise(0)), [], [F.col("p")]).checkpoint()
    count, golds = clusters.agg(F.count(F.lit(1))).scalar(), gold.agg(F.count(F.lit(1))).scalar()
    picks = clusters.select("rank", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn_number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("rank").cast("string"))), 1, 8), 16, 10).cast("bigint")
    picks = picks.select("draw", (F.pmod(drawn_number, count) + 1).alias("rank")).distinct()
    drawn = picks.join(clusters, "rank").select("draw", "p", "size", "best").checkpoint()
    pu = drawn.groupBy("draw").agg((F.sum(F.coalesce("best", F.lit(0))) / F.sum("size")).alias("purity"))
    most = drawn.join(overlap, "p").groupBy("draw", "g").agg(F.max("n").alias("n"))
    ipu = most.groupBy("draw").agg((F.sum("n") / golds).alias("inverse_purity"))
    rows = pu.join(ipu, "draw", "left").withColumn("inverse_purity", F.coalesce("inverse_purity", F.lit(0.0)))
    f1 = F.try_divide(2 * F.col("purity") * F.col("inverse_purity"), F.col("purity") + F.col("inverse_purity"))
    return rows.select("draw", F.round("purity", 6).alias("purity"), F.round("inverse_purity", 6).alias("inverse_purity"), F.round(f1, 6).alias("f1"))


def sharing_two(triples: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """``a, b``: each pair of items (``a < b``) once whose triples agree in at least two of the three ``fields``; nulls count as empty, as in the reference."""
    rows = triples.select(F.col(item).alias("item"), *(F.coalesce(F.col(c), F.lit("")).alias(f"_{i}") for i, c in enumerate(fields)))
    pairs = None
    for i, j in ((0, 1), (0, 2), (1, 2)):
        keys = [f"_{i}", f"_{j}"]
        found = rows.withColumnRenamed("item", "a").join(rows.withColumnRenamed("item", "b"), keys).where("a < b").select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def overlapping_entities(objects: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows of ``objects`` (``key, idx``) with each row of ``entities`` (``key, start, end``) whose [start, end) holds the first or the last index."""
    o, e = objects.alias("o"), entities.alias("e")
    holds = lambda at: (at >= F.col("e.start")) & (at < F.col("e.end"))
    first, last = F.try_element_at(F.col("o.idx"), F.lit(1)), F.try_element_at(F.col("o.idx"), F.lit(-1))
    rest = [F.col(f"e.{c}") for c in entities.columns if c != key]
    return o.join(e, (F.col(f"o.{key}") == F.col(f"e.{key}")) & (holds(first) | holds(last))).select("o.*", *rest)


def inverted_weights(edges: DataFrame) -> DataFrame:
    """Similarities as distances: the greatest weight over each weight; null where a weight is 0."""
    return edges.withColumn("w", F.try_divide(edges.agg(F.max("w")).scalar(), F.col("w")))
