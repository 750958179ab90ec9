"""Queries over vectors, clusterings and raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import clustering, metrics, triples
from schemaloom.operators import vectors as op
from schemaloom.operators.ranking import ranked
from schemaloom.plans.triples import _W, frame_clusters
from schemaloom.session import deliver_once, table


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    found = op.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), 10)
    return found.select("query", "item", "rank", F.round("similarity", 5).alias("similarity"))


def label_means(spark: SparkSession, d: str) -> DataFrame:
    return op.mean_vectors(embeddings(spark, d), "label", "embedding").select("label", "place", F.round("mean", 6).alias("mean"))


def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the label of the most similar label mean; labels are few, so their means are a small table."""
    means = op.packed(op.mean_vectors(embeddings(spark, d), "label", "embedding"), "label")
    table_of = means.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("pred"), "vector"))).alias("m")).scalar()
    rows = embeddings(spark, d).withColumn("_m", table_of)
    scored = F.transform("_m", lambda m: F.struct((-F.round(op.cosine(F.col("embedding"), m["vector"]), 9)).alias("s"), m["pred"].alias("pred")))
    return rows.withColumn("x", F.array_min(scored)).select("vec_id", "label", "x.pred", F.round(-F.col("x.s"), 6).alias("similarity"))


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_scores(metrics.contingency(nearest_label(spark, d), "label", "pred"))


def kmeans_scores(spark: SparkSession, d: str) -> DataFrame:
    clusters = op.k_means(embeddings(spark, d), "vec_id", "embedding", 10)
    rows = clusters.join(embeddings(spark, d).select("vec_id", "label"), "vec_id")
    return metrics.cluster_scores(metrics.contingency(rows, "label", "cluster"))


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Clusterings of the vectors by different methods against their labels."""
    return clustering.comparison(embeddings(spark, d), "vec_id", "embedding", "label", 10, tuple(clustering.METHODS))


def fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the graph of five nearest neighbours in which a vector may be in several."""
    return clustering.fuzzy_clusters(clustering.neighbour_graph(embeddings(spark, d), "vec_id", "embedding", 5))


def reduced_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Share of a row's squared length that its ten leading directions keep, by label."""
    rows = clustering.reduced(embeddings(spark, d), "vec_id", "embedding", 10).join(embeddings(spark, d).select("vec_id", "label"), "vec_id")
    return op.mean_vectors(rows, "label", "vector").select("label", "place", F.round("mean", 4).alias("mean"))


def members_by_centre(spark: SparkSession, d: str) -> DataFrame:
    return op.by_centre(embeddings(spark, d), "vec_id", "embedding", "label")


def repeat_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of the similarity to the own label's mean."""
    rows = nearest_label(spark, d)
    return rows.groupBy("label").agg(F.round(F.avg("similarity"), 5).alias("mean"), F.round(F.stddev_pop("similarity"), 5).alias("std"), F.count(F.lit(1)).alias("n"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Three simple raters of every text: is it short, does it end in a mark, is it free of digits."""
    rows = deliver_once(table(spark, d, "corpus"), "sent_id", ["sent_id", "text"]).where("text is not null")
    raters = F.array(F.char_length("text") > 60, F.col("text").rlike("[.。!?]$"), ~F.col("text").rlike("[0-9]"))
    return rows.select(F.col("sent_id").alias("item"), F.explode(raters).alias("vote"))


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rater_agreement(votes(spark, d))


def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(votes(spark, d))


def agreement_classes(spark: SparkSession, d: str) -> DataFrame:
    return majority_votes(spark, d).groupBy("unanimous", "vote").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("unanimous"), "vote")


def bootstrap_means(spark: SparkSession, d: str, draws: int = 200) -> DataFrame:
    """Bootstrap of mean text length by data set: every record's number of copies in a draw is a hashed Poisson variate.

    Copies of all records together approach resampling with replacement, and no draw needs a global index.
    """
    rows = deliver_once(table(spark, d, "corpus"), "sent_id", ["sent_id", "text", "dataset"]).where("text is not null")
    each = rows.select("dataset", "sent_id", F.char_length("text").alias("length"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = F.pmod(F.xxhash64("sent_id", "draw"), F.lit(1 << 31)) / float(1 << 31)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    copies = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = each.withColumn("c", copies).groupBy("dataset", "draw").agg(F.try_divide(F.sum(F.col("length") * F.col("c")), F.sum("c")).alias("mean"))
    return means.groupBy("dataset").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.count(F.lit(1)).alias("draws"))


def bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 of frames_purity in each of the reference's 1000 draws of the predicted clusters."""
    return triples.purity_bootstrap(*frame_clusters(spark, d)).select("draw", "f1")


def expansion_weights(spark: SparkSession, d: str) -> DataFrame:
    """Per data set and word the sum of 1 / ln(1 + rank) over the year-months of arrival; ``rank`` is the word's best one.

    Each month lists its 50 most frequent words, as deep as the reference's lists; records without a time are a list of their own.
    """
    rows = deliver_once(table(spark, d, "corpus"), "sent_id", ["sent_id", "text", "dataset", "arrived_at"])
    words = rows.select("dataset", F.trunc("arrived_at", "month").alias("month"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    counted = words.groupBy("dataset", "month", "term").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(counted, ["dataset", "month"], [F.desc("n"), F.col("term")]).where("rank <= 50")
    lists = top.groupBy("dataset", "month").agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("terms"))
    return op.reciprocal_rank_weights(lists, "dataset", "terms").select("dataset", "term", "rank", F.round("weight", 6).alias("weight"))


QUERIES = {
    "vectors_nearest": nearest_neighbours,
    "vectors_label_means": label_means,
    "vectors_nearest_label": nearest_label,
    "metrics_cluster_scores": cluster_scores,
    "metrics_kmeans_scores": kmeans_scores,
    "metrics_comparison": method_comparison,
    "vectors_fuzzy_clusters": fuzzy_clusters,
    "vectors_reduced": reduced_vectors,
    "vectors_by_centre": members_by_centre,
    "metrics_repeats": repeat_statistics,
    "metrics_rater_agreement": rater_agreement,
    "metrics_majority": majority_votes,
    "metrics_agreement_classes": agreement_classes,
    "metrics_bootstrap": bootstrap_f1,
    "metrics_bootstrap_means": bootstrap_means,
    "stats_expansion_weights": expansion_weights,
}

_NEAR = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY label, i),
cv AS (SELECT label AS pred, list(m ORDER BY i) AS cv FROM c GROUP BY label),
s AS (SELECT vec_id, label, pred, round(list_cosine_similarity(e, cv), 9) AS s FROM v CROSS JOIN cv),
near AS (SELECT vec_id, label, pred, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pred) = 1)
"""
_VOTES = """WITH rec AS (SELECT DISTINCT sent_id, text FROM corpus WHERE text IS NOT NULL),
vote AS (SELECT sent_id AS item, unnest([length(text) > 60, regexp_matches(text, '[.。!?]$'), NOT regexp_matches(text, '[0-9]')]) AS vote FROM rec),
per AS (SELECT item, vote, count(*) AS n FROM vote GROUP BY ALL),
maj AS (SELECT item, vote, n, sum(n) OVER (PARTITION BY item)::BIGINT AS n_votes FROM per QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, vote) = 1)
"""
SQL = {
    "metrics_bootstrap": _W
    + """, o AS (SELECT predicate AS p, subject AS g, count(*) AS n FROM w GROUP BY ALL), sz AS (SELECT p, sum(n)::DOUBLE AS size, max(n) AS best FROM o GROUP BY p),
cl AS (SELECT p, size, CASE WHEN size > 1 THEN best ELSE 0 END AS best, row_number() OVER (ORDER BY p) AS r FROM sz), k AS (SELECT count(*) AS k FROM cl), gd AS (SELECT count(*)::DOUBLE AS golds FROM w),
dr AS (SELECT DISTINCT d AS draw, ('0x' || substr(md5('1337-' || d || '-' || r), 1, 8))::BIGINT % k + 1 AS r FROM range(1, 1001) t(d), cl, k),
pk AS (SELECT draw, p, size, best FROM dr JOIN cl USING (r)), pu AS (SELECT draw, sum(best) / sum(size) AS pu FROM pk GROUP BY draw),
ip AS (SELECT draw, sum(n) / any_value(golds) AS ipu FROM (SELECT draw, g, max(n) AS n FROM pk JOIN o USING (p) GROUP BY draw, g), gd GROUP BY draw)
SELECT draw::INT AS draw, round(2 * pu * ipu / (pu + ipu), 6) AS f1 FROM pu JOIN ip USING (draw)""",
    "vectors_nearest": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT query, item, rank, round(s, 5) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(a.e, b.e), 9) AS s,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id)::INT AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "vectors_label_means": _NEAR + "SELECT label, (i - 1)::INT AS place, round(m, 6) AS mean FROM c",
    "vectors_nearest_label": _NEAR + "SELECT * FROM near",
    "vectors_by_centre": _NEAR
    + """, ds AS (SELECT label, vec_id, round(list_distance(e, cv), 6) AS distance FROM v JOIN cv ON label = pred)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank, distance FROM ds""",
    "metrics_repeats": _NEAR + "SELECT label, round(avg(similarity), 5) AS mean, round(stddev_pop(similarity), 5) AS std, count(*) AS n FROM near GROUP BY label",
    "metrics_cluster_scores": _NEAR + """, t AS (SELECT label AS g, pred AS p, count(*)::DOUBLE AS n FROM near GROUP BY ALL),
g AS (SELECT g, sum(n) AS gn FROM t GROUP BY g), p AS (SELECT p, sum(n) AS pn FROM t GROUP BY p), k AS (SELECT sum(n) AS t FROM t),
a AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n / k.t * ln(n * k.t / (gn * pn))) AS mi, sum(n * n / pn) / any_value(k.t) AS bp, sum(n * n / gn) / any_value(k.t) AS br, any_value(k.t) AS t FROM t JOIN g USING (g) JOIN p USING (p) CROSS JOIN k),
b AS (SELECT sum(gn * (gn - 1) / 2) AS sg, -sum(gn / k.t * ln(gn / k.t)) AS hg FROM g CROSS JOIN k), c2 AS (SELECT sum(pn * (pn - 1) / 2) AS sp, -sum(pn / k.t * ln(pn / k.t)) AS hp FROM p CROSS JOIN k),
pu AS (SELECT sum(m) AS pu FROM (SELECT max(n) AS m FROM t GROUP BY p)), ip AS (SELECT sum(m) AS ip FROM (SELECT max(n) AS m FROM t GROUP BY g))
SELECT round((s - sg * sp / (t * (t - 1) / 2)) / ((sg + sp) / 2 - sg * sp / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((hg + hp) / 2), 6) AS nmi,
round(bp, 6) AS b3_precision, round(br, 6) AS b3_recall, round(2 * bp * br / (bp + br), 6) AS b3_f, round(pu / t, 6) AS purity, round(ip / t, 6) AS inverse_purity FROM a, b, c2, pu, ip""",
    "metrics_majority": _VOTES + "SELECT item, vote, n, n_votes, n = n_votes AS unanimous FROM maj",
    "metrics_agreement_classes": _VOTES + "SELECT n = n_votes AS unanimous, vote, count(*) AS n FROM maj GROUP BY 1, 2",
    "metrics_rater_agreement": _VOTES + """, i AS (SELECT item, sum(n)::DOUBLE AS r, sum(n * (n - 1))::DOUBLE AS same FROM per GROUP BY item),
m AS (SELECT vote, sum(n)::DOUBLE AS m FROM per GROUP BY vote), t AS (SELECT sum(r) AS t, avg(same / (r * (r - 1))) AS po, sum(same / (r - 1)) AS co FROM i),
e AS (SELECT sum(pow(m / (SELECT sum(m) FROM m), 2)) AS pe, sum(m * (m - 1)) AS mm, count(*) AS k FROM m)
SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS fleiss_kappa, round((po - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k), 6) AS randolph_kappa,
round(1 - (t - co) * (t - 1) / (t * t - t - mm), 6) AS krippendorff_alpha FROM t, e""",
    "stats_expansion_weights": """WITH w AS (SELECT dataset, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM (SELECT DISTINCT sent_id, text, dataset FROM corpus)),
c AS (SELECT dataset, term, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT dataset, term, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, term)::INT AS rank FROM c)
SELECT dataset, term, rank, round(1 / ln(1 + rank), 6) AS weight FROM r WHERE rank <= 50""",
}
