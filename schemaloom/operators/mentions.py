"""Verb-object mentions of gold events: matching, senses, and the features of predicate-object tuples.

Tables: ``mentions`` has ``mention, verb, verb_index, obj, obj_head, event_type``; ``expansions`` has
``mention, place, word, prob``, the words a masked model offers for a mention's verb or head, best first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.operators.triples import overlapping_entities
from schemaloom.operators.vectors import cosine, rank_biased_overlap, reciprocal_rank_weights

MOST_TYPES, SENSE_WORDS = 15, 10
NO_VECTOR, UNKNOWN_LEMMA, ONLY_SENSE = -2, -1, 0


def at_position(triples: DataFrame, gold: DataFrame, sentence: str = "sent_id") -> DataFrame:
    """Triples (``sentence, svo_no, lemma, verb_index, obj, obj_idx``) with the gold record of the same sentence."""
    return triples.join(gold, sentence)


def matched_triggers(triples: DataFrame, events: DataFrame, sentence: str = "sent_id") -> DataFrame:
    """``sentence, svo_no, event_type``: triples whose verb is the one token of a trigger; of several events the last."""
    one = events.where("trigger_end - trigger_start = 1").select(sentence, "event_no", "event_type", F.col("trigger_start").alias("verb_index"))
    met = triples.select(sentence, "svo_no", "verb_index").join(one, [sentence, "verb_index"])
    last = met.groupBy(sentence, "svo_no").agg(F.max(F.struct("event_no", "event_type")).alias("x"))
    return last.select(sentence, "svo_no", "x.event_type")


def matched_objects(triples: DataFrame, arguments: DataFrame, entities: DataFrame, sentence: str = "sent_id") -> DataFrame:
    """``sentence, svo_no`` of triples whose object's first or last token lies in an entity, no pronoun, that is an argument."""
    named = entities.where("kind is null or kind <> 'PRO'").join(arguments.select(sentence, "entity_id").distinct(), [sentence, "entity_id"], "left_semi")
    objects = triples.select(sentence, "svo_no", F.col("obj_idx").alias("idx"))
    return overlapping_entities(objects, named.select(sentence, "start", "end"), sentence).select(sentence, "svo_no").distinct()


def gold_mentions(triples: DataFrame, events: DataFrame, arguments: DataFrame, entities: DataFrame, sentence: str = "sent_id") -> DataFrame:
    """Triples that match a gold event by trigger and object: ``mention, verb, verb_index, obj, event_type``."""
    typed = triples.join(matched_triggers(triples, events, sentence), [sentence, "svo_no"])
    kept = typed.join(matched_objects(triples, arguments, entities, sentence), [sentence, "svo_no"], "left_semi")
    return kept.select(F.concat_ws("_", F.col(sentence).cast("string"), F.col("svo_no").cast("string")).alias("mention"), sentence, F.col("lemma").alias("verb"), "verb_index", "obj", "event_type")


def sense_label(verb: Column, sense: Column) -> Column:
    return F.concat_ws("_", verb, sense.cast("string"))


def verb_of_label(label: Column) -> Column:
    """The verb of a sense label: what stands before the last ``_``."""
    return F.regexp_replace(label, "_[^_]*$", "")


def sense_features(examples: DataFrame, most: int = SENSE_WORDS) -> DataFrame:
    """``verb, sense, words, n_words`` of an inventory (``verb, sense, terms``: the ranked words of each example): words by the sum of
    1 / ln(1 + rank) over the examples, the ``most`` best of them in order."""
    keyed = examples.select(F.struct("verb", "sense").alias("_key"), "terms")
    weights = reciprocal_rank_weights(keyed, "_key", "terms").select("_key.*", "term", F.round("weight", 9).alias("weight"))
    w = Window.partitionBy("verb", "sense").orderBy(F.desc("weight"), "term")
    best = weights.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return best.groupBy("verb", "sense").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]).alias("words"))


def ranked_expansions(expansions: DataFrame) -> DataFrame:
    """``mention, ranked``: a mention's words by the sum of 1 / ln(2 + place) over their places; equal sums go by the word."""
    weights = expansions.groupBy("mention", "word").agg(F.round(F.sum(1 / F.log(2 + F.col("place"))), 9).alias("w"))
    return weights.groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "word"))), lambda x: x["word"]).alias("ranked"))


def disambiguated(mentions: DataFrame, expansions: DataFrame, inventory: DataFrame, depth: int = SENSE_WORDS) -> DataFrame:
    """``mention, sense``: of the verb's senses (``verb, sense, words, vector``) that with the greatest rank-biased overlap of words
    times cosine of vectors (0 without a vector); of equals the smallest.

    NO_VECTOR where the mention (``mention, verb, vector``) has no vector, UNKNOWN_LEMMA for a verb without senses, ONLY_SENSE for
    a verb with one.
    """
    counted = inventory.groupBy("verb").agg(F.count(F.lit(1)).alias("_n"))
    rows = mentions.select("mention", "verb", "vector").join(counted, "verb", "left")
    open_rows = rows.where("vector is not null and _n > 1").join(ranked_expansions(expansions), "mention", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    met = open_rows.drop("_n").join(inventory.select("verb", "sense", "words", F.col("vector").alias("sense_vector")), "verb")
    score = rank_biased_overlap(F.col("ranked"), F.col("words"), depth) * F.coalesce(cosine(F.col("vector"), F.col("sense_vector")), F.lit(0.0))
    best = met.groupBy("mention").agg(F.min(F.struct((-F.round(score, 9)).alias("s"), "sense")).alias("x")).select("mention", F.col("x.sense").alias("_best"))
    code = F.when(F.col("vector").isNull(), NO_VECTOR).when(F.col("_n").isNull(), UNKNOWN_LEMMA).when(F.col("_n") == 1, ONLY_SENSE).otherwise(F.col("_best"))
    return rows.join(best, "mention", "left").select("mention", "verb", code.cast("int").alias("sense"))


def expansion_sums(expansions: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key, word, weight``: the probabilities of the words offered for all mentions of a sense or head (``keys``: ``mention, key``)."""
    return expansions.join(keys.select("mention", key), "mention").groupBy(key, "word").agg(F.round(F.sum("prob"), 6).alias("weight"))


def type_ranks(mentions: DataFrame, most: int = MOST_TYPES) -> DataFrame:
    """``event_type, n, rank`` of the ``most`` frequent event types; equal counts go by name."""
    counted = mentions.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(most)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))  # at most ``most`` rows


def tuples(mentions: DataFrame, ranks: DataFrame) -> DataFrame:
    """``verb_sense, obj_head, freq, event_type`` of mentions (``verb_sense, obj_head, event_type``) of a ranked type; a tuple's type is
    that of its mentions which is the most frequent over all."""
    kept = mentions.join(ranks.select("event_type", "rank"), "event_type")
    rows = kept.groupBy("verb_sense", "obj_head").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("rank", "event_type")).alias("x"))
    return rows.select("verb_sense", "obj_head", "freq", "x.event_type")


def tfidf_vectors(weights: DataFrame, frequency: DataFrame, item: str) -> DataFrame:
    """``item, word, value``: of items' words (``item, word, weight``) as if each item were a text with a word ceil(weight x freq)
    times (``frequency``: ``item, freq``): 1 + ln of the count, times smoothed idf, of unit length an item."""
    counted = weights.join(frequency.select(item, "freq"), item).withColumn("n", F.ceil(F.col("weight") * F.col("freq"))).where("n > 0")
    total = frequency.select(item).distinct().agg(F.count(F.lit(1))).scalar()
    df = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    valued = counted.join(df, "word").withColumn("v", (1 + F.log("n")) * (F.log((1 + total) / (1 + F.col("df"))) + 1))
    norm = valued.groupBy(item).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
    return valued.join(norm, item).select(item, "word", F.round(F.col("v") / F.col("_norm"), 6).alias("value"))
