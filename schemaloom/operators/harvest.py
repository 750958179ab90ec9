"""From completions to schemas: instances, slot scores, event names, clusters of instances and of slots.

An instance is a verb-object pair with a fixed number of samples; a sample has an event name and slots. Tables:
``samples`` has ``instance, verb, head, salience, sample, event, slots``; a sample's slots are distinct.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators import prompts
from schemaloom.operators.graph import louvain, page_rank
from schemaloom.operators.slots import tfidf

THRESHOLD = 1 / 3
VERB_WEIGHT, TYPE_WEIGHT = 3.0, 1.0
SLOT_WEIGHT, SLOT_STEP, MOST_SLOT_WEIGHT = 1.0, 0.5, 5.0


def parsed_completions(raw: DataFrame, text: str = "raw") -> DataFrame:
    """``raw`` with ``vo, verb, head, event, slots``; completions without two words before the mark go."""
    parsed = raw.withColumn("_c", prompts.parsed_completion(F.col(text)))
    words = F.filter(F.split("_c.vo", r"\s+"), lambda w: w != "")
    parsed = parsed.withColumn("_w", words).where(F.size("_w") > 1)
    vo = F.concat_ws(" ", F.col("_w")[0], F.col("_w")[1])
    return parsed.select("*", vo.alias("vo"), F.col("_w")[0].alias("verb"), F.col("_w")[1].alias("head"), "_c.event", "_c.slots").drop("_c", "_w")


def salient_completions(parsed: DataFrame, verbs: DataFrame, heads: DataFrame) -> DataFrame:
    """Completions whose verb and head are salient, with ``salience``, the product; filtered before samples are counted off."""
    v = verbs.select(F.col("term").alias("verb"), F.col("salience").alias("_v"))
    h = heads.select(F.col("term").alias("head"), F.col("salience").alias("_h"))
    return parsed.join(v, "verb").join(h, "head").withColumn("salience", F.round(F.col("_v") * F.col("_h"), 4)).drop("_v", "_h")


def instances(completions: DataFrame, ordinal: str, samples: int = 3) -> DataFrame:
    """``samples`` rows: every ``samples`` consecutive completions of a pair are an instance; incomplete ones go."""
    rows = prompts.batches(completions, "vo", ordinal, samples)
    return rows.select(F.concat_ws("#", "vo", "batch").alias("instance"), "verb", "head", "salience", F.col("place").alias("sample"), "event", "slots")


def top_instances(samples: DataFrame, n: int) -> DataFrame:
    """The samples of the ``n`` most salient instances (of equals those that sort first); all with ``n`` 0."""
    if not n:
        return samples
    best = samples.select("instance", "salience").distinct().orderBy(F.desc("salience"), "instance").limit(n)
    return samples.join(best.select("instance"), "instance", "left_semi")


def bigrams(word: Column) -> Column:
    return F.when(F.char_length(word) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substr(word, i, F.lit(2))))).otherwise(F.array(word))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Stand-in for the similarity of a lexical network: Jaccard of character bigrams. Any function of two columns can replace it."""
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")


def same_bag(a: Column, b: Column) -> Column:
    """1 where two arrays hold the same words equally often, else 0."""
    return (F.array_sort(a) == F.array_sort(b)).cast("int")


def lexical_overlap(a: Column, b: Column) -> Column:
    """Equal pairs of two arrays over all pairs; null if one is empty."""
    equal = F.aggregate(F.transform(a, lambda x: F.size(F.filter(b, lambda y: x == y))), F.lit(0), lambda s, n: s + n)
    return F.try_divide(equal, F.size(a) * F.size(b))


def type_similarity(a: Column, b: Column) -> Column:
    """Overlap of the parts of two event names, parted at ``/`` alone; 0 where one begins with 'none'."""
    one, two = F.split(F.lower(F.trim(a)), "/"), F.split(F.lower(F.trim(b)), "/")
    return F.when((one[0] == "none") | (two[0] == "none"), 0.0).otherwise(lexical_overlap(one, two))


def refined_event(event: Column, verb: Column, head: Column, similarity: Callable[[Column, Column], Column] = bigram_jaccard) -> Column:
    """``event, similarity`` of an event name: of the parts of a name with ``/``, else with ``-``, the one most like the verb
    or the head (the first of equals, none if no part is like either); a name nearer to the head than to the verb
    gets ``-head`` appended."""
    parts = F.when(F.contains(event, F.lit("/")), F.split(event, "/")).when(F.contains(event, F.lit("-")), F.split(event, "-")).otherwise(F.array(event))
    each = F.transform(parts, lambda p, i: F.struct(similarity(p, verb).alias("v"), similarity(p, head).alias("o"), (-i).alias("i"), p.alias("part")))
    scored = F.transform(each, lambda s: F.struct(F.greatest(s["v"], s["o"]).alias("s"), s["i"].alias("i"), s["part"].alias("part")))
    best = F.array_max(F.filter(scored, lambda s: s["s"] > 0))
    to_head = F.exists(each, lambda s: s["o"] > s["v"])
    single = F.size(parts) == 1
    chosen = F.when(single, event).otherwise(best["part"])
    appended = F.when(to_head & chosen.isNotNull() & (chosen != head), F.concat(chosen, F.lit("-"), head))
    whole = F.when(chosen.isNull() & to_head & (event != head), F.concat(event, F.lit("-"), head))
    return F.struct(F.coalesce(appended, whole, chosen, event).alias("event"), F.coalesce(best["s"], F.lit(0.0)).alias("similarity"))


def with_refined_events(samples: DataFrame, similarity: Callable[[Column, Column], Column] = bigram_jaccard) -> DataFrame:
    """``samples`` with the refined ``event`` and its ``similarity``."""
    df = samples.withColumn("_e", refined_event(F.col("event"), F.col("verb"), F.col("head"), similarity))
    return df.withColumn("event", F.col("_e.event")).withColumn("similarity", F.col("_e.similarity")).drop("_e")


def frequencies(samples: DataFrame) -> DataFrame:
    """``instance, slot, local, overall, tfidf``; the document count of the TF-IDF is the number of instances."""
    total = samples.agg(F.count_distinct("instance")).scalar()
    slots = samples.select("instance", F.explode("slots").alias("slot"))
    local = slots.groupBy("instance", "slot").agg(F.count(F.lit(1)).alias("local"))
    overall = local.groupBy("slot").agg(F.sum("local").alias("overall"))
    return local.join(overall, "slot").withColumn("tfidf", tfidf(F.col("local"), total.cast("double"), F.col("overall")))


def sense_scores(samples: DataFrame) -> DataFrame:
    """``instance, slot, sense``: the greatest similarity of a sample with the slot, null where an instance has none above 0."""
    rows = samples.select("instance", "similarity", F.explode("slots").alias("slot"))
    scored = rows.groupBy("instance", "slot").agg(F.round(F.max("similarity"), 4).alias("sense"))
    best = scored.groupBy("instance").agg(F.max("sense").alias("_best"))
    return scored.join(best, "instance").withColumn("sense", F.when(F.col("_best") > 0, F.col("sense"))).drop("_best")


def rank_scores(samples: DataFrame, scored: DataFrame) -> DataFrame:
    """``instance, slot, rank``: PageRank over the slots of an instance, times the sum of the instance's TF-IDF (1 if that is 0).

    Links weigh how often two slots meet in a sample of any instance. An instance's slots are those of its few samples,
    so each graph is small.
    """
    met = samples.select(F.array_sort("slots").alias("s")).select("s", F.posexplode("s").alias("i", "a"))
    pairs = met.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg((2 * F.count(F.lit(1))).alias("w"))
    own = scored.groupBy("instance").agg(F.array_sort(F.collect_set("slot")).alias("s"), F.sum("tfidf").alias("total"))
    inside = own.select("instance", "s", F.posexplode("s").alias("i", "a")).select("instance", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    links = inside.join(pairs, ["a", "b"]).groupBy("instance").agg(F.collect_list(F.struct("a", "b", "w")).alias("links"))
    graphs = own.join(links, "instance", "left")

    def run(batches):
        for part in batches:
            rows = []
            for r in part.itertuples():
                at = {x: i for i, x in enumerate(r.s)}
                m = np.zeros((len(at), len(at)))
                for link in r.links if r.links is not None else ():
                    i, j = at[link["a"]], at[link["b"]]
                    m[i, j] = m[j, i] = link["w"]
                rows += [(r.instance, slot, round(float(x) * (r.total or 1.0), 4)) for slot, x in zip(r.s, page_rank(m))]
            yield pd.DataFrame(rows, columns=["instance", "slot", "rank"])

    return graphs.mapInPandas(run, "instance string, slot string, rank double")


def slot_scores(samples: DataFrame, modes: tuple[str, ...] = ("tfidf", "rank"), tfidf_weight: float = 1.0, rank_weight: float = 1.0, threshold: float = THRESHOLD) -> DataFrame:
    """``instance, slot, tfidf, rank, sense, total, score, kept``: the weighted sum of the scores of ``modes`` (``tfidf, rank``),
    times that of ``sense``; ``score`` is its min-max value in the instance, null where all totals are equal (nothing is
    kept there). ``samples`` must have ``similarity`` for ``sense``."""
    rows = frequencies(samples)
    rows = rows.join(rank_scores(samples, rows), ["instance", "slot"]) if "rank" in modes else rows.withColumn("rank", F.lit(None).cast("double"))
    rows = rows.join(sense_scores(samples), ["instance", "slot"]) if "sense" in modes else rows.withColumn("sense", F.lit(None).cast("double"))
    total = (F.col("tfidf") * tfidf_weight if "tfidf" in modes else F.lit(0.0)) + F.coalesce(F.col("rank") * rank_weight, F.lit(0.0))
    rows = rows.withColumn("total", F.round(total * F.coalesce("sense", F.lit(1.0)), 4))
    ends = rows.groupBy("instance").agg(F.min("total").alias("_low"), F.max("total").alias("_high"))
    rows = rows.join(ends, "instance").withColumn("score", F.round(F.try_divide(F.col("total") - F.col("_low"), F.col("_high") - F.col("_low")), 4))
    return rows.select("instance", "slot", "tfidf", "rank", "sense", "total", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("kept"))


def chosen_events(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """``instance, event, total``: the event of the sample whose kept slots have the greatest sum of scores, the first of equals."""
    kept = scores.where("kept").select("instance", "slot", "score")
    found = samples.select("instance", "sample", F.explode("slots").alias("slot")).join(kept, ["instance", "slot"])
    summed = found.groupBy("instance", "sample").agg(F.sum(F.col("score").cast("decimal(18,4)")).alias("_sum"))
    rows = samples.select("instance", "sample", "event").join(summed, ["instance", "sample"], "left").withColumn("_sum", F.coalesce("_sum", F.lit(0).cast("decimal(18,4)")))
    best = rows.groupBy("instance").agg(F.min(F.struct((-F.col("_sum")).alias("s"), "sample", "event")).alias("x"))
    return best.select("instance", "x.event", (-F.col("x.s")).cast("double").alias("total"))


def instance_edges(events: DataFrame, mode: str = "TypeMatch", verb_weight: float = VERB_WEIGHT, type_weight: float = TYPE_WEIGHT) -> DataFrame:
    """``a, b, w`` of similar instances (``instance, verb, event``): the same verb weighs ``verb_weight``; with TypeMatch the
    share of equal pairs among the parts of the two event names (parted at ``/``) weighs ``type_weight``, nothing for
    names that begin with 'none'. Pairs come from equal verbs or parts alone; the number of instances is a parameter.
    """
    verbs = events.select("instance", "verb")
    pairs = verbs.withColumnRenamed("instance", "a").join(verbs.withColumnRenamed("instance", "b"), "verb").where("a < b").select("a", "b", F.lit(verb_weight).alias("w"))
    if mode == "TypeMatch":
        parts = events.select("instance", F.split(F.lower(F.trim("event")), "/").alias("_p")).where(F.col("_p")[0] != "none")
        counted = parts.select("instance", F.size("_p").alias("n"), F.explode("_p").alias("part"))
        x, y = (counted.select(F.col("instance").alias(c), F.col("n").alias(f"n_{c}"), "part") for c in ("a", "b"))
        met = x.join(y, "part").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.unionByName(met.select("a", "b", (F.lit(type_weight) * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("w")))
    return pairs.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("w"))


def slot_communities(slots: list[str], vectors: np.ndarray, weight: float = SLOT_WEIGHT) -> tuple[list[int], float]:
    """Community of each slot by Louvain on cosines times ``weight``, and the weight at the end: it rises by SLOT_STEP while
    one community has more than half of the slots."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    while True:
        edges = {(i, j): float(near[i, j]) * weight for i in range(len(slots)) for j in range(i + 1, len(slots)) if near[i, j]}
        found = louvain(list(range(len(slots))), edges)
        largest = max(np.bincount(list(found.values())), default=0)
        if largest <= 1 or largest <= len(slots) / 2 or weight >= MOST_SLOT_WEIGHT:
            return [found[i] for i in range(len(slots))], weight
        weight += SLOT_STEP


def slot_clusters(scores: DataFrame, encode: Callable[[], Callable[[list[str]], list]], weight: float = SLOT_WEIGHT) -> DataFrame:
    """``cluster, slot, community, name, community_score``: the slots of each cluster (``scores``: ``instance, slot, score, kept``, an
    instance being a cluster) gathered by likeness; a community is named by its best slot and scores the sum of its slots.

    The weight starts anew in each cluster, so the order of clusters doesn't matter.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "slot"], ascending=[False, True])
        slots = part["slot"].tolist()
        homes, _ = slot_communities(slots, np.array(encode()(slots), np.float64), weight)
        out = pd.DataFrame({"cluster": part["instance"].iloc[0], "slot": slots, "community": homes, "score": part["score"].tolist()})
        out["name"] = out.groupby("community")["slot"].transform("first")
        out["community_score"] = out.groupby("community")["score"].transform("sum").round(4)
        return out[["cluster", "slot", "community", "name", "community_score"]]

    kept = scores.where("kept").select("instance", "slot", "score")
    return kept.groupBy("instance").applyInPandas(run, "cluster string, slot string, community int, name string, community_score double")


def schema_table(members: DataFrame, events: DataFrame, scores: DataFrame, encode: Callable, threshold: float = THRESHOLD) -> DataFrame:
    """``cluster, n_members, event, slot, slot_score``: the schema of each cluster of instances.

    ``members`` is ``instance, cluster, salience``, ``events`` and ``scores`` are those of the instances. The kept slots of
    a cluster's instances are its samples; they are scored, clustered, and communities above ``threshold`` stay. The
    event is that of the instance whose slots weigh most: the sum of their communities' scores times its salience. A
    cluster without slots keeps its row, with a null slot.
    """
    kept = scores.where("kept").groupBy("instance").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    chosen = members.join(events.select("instance", "event"), "instance").join(kept, "instance", "left")
    samples = chosen.select(F.col("cluster").cast("string").alias("instance"), F.col("instance").alias("sample"), "event", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), "salience")
    found = slot_clusters(slot_scores(samples, threshold=0.0), encode)
    good = found.where(F.col("community_score") > threshold)
    named = good.where("slot = name").select(F.col("cluster").alias("instance"), "slot", "community_score")
    worth = samples.select("instance", "sample", "event", "salience", F.explode_outer("slots").alias("slot")).join(named, ["instance", "slot"], "left")
    summed = worth.groupBy("instance", "sample", "event").agg(F.sum(F.coalesce(F.col("community_score") * F.col("salience"), F.lit(0.0))).alias("total"))
    best = summed.groupBy("instance").agg(F.min(F.struct((-F.round("total", 6)).alias("t"), "sample", "event")).alias("x"), F.count(F.lit(1)).alias("n_members"))
    return best.join(named, "instance", "left").select(F.col("instance").cast("int").alias("cluster"), "n_members", F.col("x.event").alias("event"), "slot", F.col("community_score").alias("slot_score"))
