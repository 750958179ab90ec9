"""Frames with roles and lexical units, features of verbs, and the triples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.operators.triples import generalised, normalised_purity

# Tags (also in place of a lemma) and lemmas of words that tell nothing.
SKIP_POS = ("-lrb-", "-LRB-", "-RRB-", "-rrb-", "-lsb-", "-LSB-", "-rsb-", "-RSB-", "SYM", "SY")
FUNCTIONAL_LEMMAS = ("whom", "that", "which", "where", "what")
FUNCTIONAL_POS = ("PRP", "PR", "FW", "DT", "DET", "CC", "CONJ", "CD", "NUM", "WH", "WP")
# Fixed value: a verb of the thesaurus, alone or with a particle.
VERB_PATTERN = r"^[a-zA-Z]+#VB( +[a-zA-Z]+#(VB|RP|RB|IN))?$"
TRIGGER_ROLE = "FEE"


def is_functional(lemma: Column, pos: Column) -> tuple[Column, Column]:
    by_pos = F.coalesce(lemma.isin(*SKIP_POS) | pos.isin(*SKIP_POS), F.lit(False))
    by_lemma = F.coalesce(lemma.isin(*FUNCTIONAL_LEMMAS) | pos.isin(*FUNCTIONAL_POS), F.lit(False))
    return by_pos, by_lemma


def skipped(subject: tuple[Column, Column], obj: tuple[Column, Column], strict: bool = True) -> Column:
    """Whether a triple's subject or object (lemma, part of speech) tells nothing; not strict: only if both do."""
    (sp, sl), (op, ol) = is_functional(*subject), is_functional(*obj)
    return (sp | op) | (sl | ol) if strict else (sp & op) | (sl & ol)


def verb_rows(df: DataFrame, word: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Rows whose ``word`` is a verb; with a vocabulary (``term``) only single words of it."""
    rows = df.where(F.trim(word).rlike(VERB_PATTERN))
    if vocabulary is None:
        return rows
    known = vocabulary.select(F.col("term").alias("_term")).distinct()
    rows = rows.where(~F.trim(word).contains(" ")).withColumn("_term", F.split_part(F.trim(word), F.lit("#"), F.lit(1)))
    return rows.join(known, "_term", "left_semi").drop("_term")


def parsed_features(text: Column) -> Column:
    """``lemma#POS_lemma#POS:score, ...`` as an array of structs ``subj, subj_pos, obj, obj_pos, score``; other pieces go."""
    pieces = F.transform(F.split(text, ","), lambda p: F.trim(p))
    good = F.filter(pieces, lambda p: p.rlike(r"^[^#_:]+#[^#_:]+_[^#_:]+#[^#_:]+:[-+0-9.eE]+$"))

    def of(p: Column) -> Column:
        part = lambda i, pattern=r"^([^#_:]+)#([^#_:]+)_([^#_:]+)#([^#_:]+):(.*)$": F.regexp_extract(p, pattern, i)
        return F.struct(part(1).alias("subj"), part(2).alias("subj_pos"), part(3).alias("obj"), part(4).alias("obj_pos"), part(5).try_cast("double").alias("score"))

    return F.filter(F.transform(good, of), lambda s: s["score"].isNotNull())


def verb_features(df: DataFrame, verb: str, text: str) -> DataFrame:
    """``verb, feature``: the distinct generalised subject_object features of each verb, those that tell nothing left out."""
    rows = df.select(F.col(verb).alias("verb"), F.explode(parsed_features(F.col(text))).alias("f"))
    rows = rows.where(~skipped((F.col("f.subj"), F.col("f.subj_pos")), (F.col("f.obj"), F.col("f.obj_pos"))))
    feature = F.concat_ws("_", generalised(F.col("f.subj"), F.col("f.subj_pos")), generalised(F.col("f.obj"), F.col("f.obj_pos")))
    return rows.select("verb", feature.alias("feature")).distinct()


def pre_frames(senses: DataFrame, features: DataFrame, most: int = 5, least_common: int = 20) -> DataFrame:
    """``verb, sense, used, features``: related verbs joined to a verb's sense as long as they share features.

    ``senses`` is ``verb, sense, related, similarity``, ``features`` is ``verb, feature``. Of the ``most`` similar related
    verbs, in order, each that shares ``least_common`` of the features still shared by all before is taken; the first that
    shares fewer ends it, one without features (also in small letters) is passed over. A sense without a taken verb has
    no row.
    """
    place = F.row_number().over(Window.partitionBy("verb", "sense").orderBy(F.desc("similarity"), "related"))
    own = features.groupBy("verb").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    best = senses.withColumn("place", place).where(F.col("place") <= most)
    exact = own.select(F.col("verb").alias("related"), F.col("features").alias("_exact"))
    lower = own.select(F.col("verb").alias("_low"), F.col("features").alias("_lower"))
    found = best.join(exact, "related", "left").withColumn("_low", F.lower("related")).join(lower, "_low", "left")
    found = found.withColumn("_f", F.coalesce("_exact", "_lower")).where(F.col("_f").isNotNull())
    lists = found.groupBy("verb", "sense").agg(F.array_sort(F.collect_list(F.struct("place", "related", F.col("_f").alias("f")))).alias("r")).join(own, "verb")
    start = F.struct(F.array(F.struct(F.concat_ws("#", "verb", F.col("sense").cast("string")).alias("word"), F.size("features").alias("n"))).alias("used"), F.col("features").alias("features"), F.lit(False).alias("stop"))

    def step(a: Column, x: Column) -> Column:
        common = F.array_intersect(a["features"], x["f"])
        take = ~a["stop"] & (F.size(common) >= least_common)
        used = F.when(take, F.concat(a["used"], F.array(F.struct(x["related"].alias("word"), F.size(common).alias("n"))))).otherwise(a["used"])
        return F.struct(used.alias("used"), F.when(take, common).otherwise(a["features"]).alias("features"), (a["stop"] | ~take).alias("stop"))

    done = lists.withColumn("_x", F.aggregate("r", start, step)).where((F.size("_x.used") > 1) & (F.size("_x.features") > 0))
    return done.select("verb", "sense", "_x.used", "_x.features")


def sense_graph(frames: DataFrame) -> DataFrame:
    """``a, b, w``: edges both ways between the first sense of each pre-frame (``used``: ``word, n``) and the others."""
    rows = frames.where(F.size("used") > 1).select(F.col("used")[0]["word"].alias("a"), F.explode(F.slice("used", 2, F.size("used"))).alias("x"))
    there = rows.select("a", F.col("x.word").alias("b"), F.col("x.n").alias("w"))
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def unit_bag(text: Column) -> Column:
    """``unit:freq, ...`` as a map; units with a blank and pieces without a whole number go, of a repeated unit the last counts."""
    pairs = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("u"), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("int").alias("n"), (F.size(F.split(p, ":")) == 2).alias("ok")))
    good = F.filter(pairs, lambda x: x["ok"] & x["n"].isNotNull() & (x["u"] != "") & ~x["u"].contains(" "))
    last = F.filter(good, lambda x, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda y: y["u"] == x["u"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["u"]), F.transform(last, lambda x: x["n"]))


def bag_size(text: Column) -> Column:
    """Total frequency in ``unit:freq, ...``; a repeated unit counts each time."""
    pairs = F.filter(F.split(text, ","), lambda p: (F.size(F.split(p, ":")) == 2) & ~F.trim(F.split_part(p, F.lit(":"), F.lit(1))).contains(" "))
    return F.aggregate(F.transform(pairs, lambda p: F.coalesce(F.trim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("int"), F.lit(0))), F.lit(0), lambda a, n: a + n)


def verb_units(text: Column) -> Column:
    """The verbs of a list of lexical units, without ``.v``."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(text, ","), lambda u: F.trim(u)), lambda u: u.contains(".v") & ~u.contains(" ")), lambda u: F.replace(u, F.lit(".v"), F.lit(""))))


def role_units(mentions: DataFrame) -> DataFrame:
    """``frame, role, units, n``: the lexical units of each role with their counts, the most frequent first, as ``unit:n, ...``."""
    counted = mentions.groupBy("frame", "role", "unit").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "unit", "n")))
    rows = counted.groupBy("frame", "role").agg(listed.alias("l"), F.sum("n").alias("n"))
    return rows.select("frame", "role", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["unit"], x["n"].cast("string"))), ", ").alias("units"), "n")


def largest_roles(sizes: DataFrame, least: int) -> DataFrame:
    """``sizes`` (``frame, role, size``) of the frames with three roles of ``least`` uses, with ``place``: the number by size of such a role that isn't the trigger, else null."""
    large = F.col("size") >= least
    named = large & (F.col("role") != TRIGGER_ROLE)
    frame = Window.partitionBy("frame")
    order = frame.orderBy(F.when(named, 0).otherwise(1), F.desc("size"), "role")
    return sizes.withColumns({"_n": F.count(F.when(large, 1)).over(frame), "place": F.when(named, F.row_number().over(order))}).where("frame is not null and _n >= 3").drop("_n")


def frame_triples(roles: DataFrame, verbs: DataFrame, least: int = 10) -> DataFrame:
    """``frame, subject, verb, object``: all combinations of the units of a frame's two largest roles with its verbs.

    ``roles`` is ``frame, role, unit, n``, ``verbs`` is ``frame, verb``. A role counts with units of ``least`` uses in all; a frame
    counts with three such roles, two of them not the trigger, and a verb. The rows are the product of a frame's lists;
    ``frame_triple_counts`` tells how many without making them.
    """
    sizes = roles.groupBy("frame", "role").agg(F.sum("n").alias("size"))
    top = largest_roles(sizes, least).where("place <= 2")
    units = roles.join(top.select("frame", "role", "place"), ["frame", "role"]).select("frame", "place", "unit").distinct()
    first, second = (units.where(F.col("place") == i).select("frame", F.col("unit").alias(c)) for i, c in ((1, "subject"), (2, "object")))
    return first.join(second, "frame").join(verbs.select("frame", "verb").distinct(), "frame").select("frame", "subject", "verb", "object")


def frame_triple_counts(roles: DataFrame, least: int = 10) -> DataFrame:
    """``frame, n, first_subject, last_object``: number, smallest subject and largest object of the ``frame_triples`` of each frame with its trigger's units as verbs.

    Subjects, verbs and objects meet in every combination, so their number is the product of the lists' lengths and the
    ends are those of the lists: exact, while the rows would grow with the cube of the lists.
    """
    counted = roles.groupBy("frame", "role", "unit").agg(F.sum("n").alias("n"))
    sizes = counted.groupBy("frame", "role").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("units"), F.min("unit").alias("first"), F.max("unit").alias("last"))
    of = lambda which, c: F.max(F.when(which, F.col(c)))
    subject, obj, verb = F.col("place") == 1, F.col("place") == 2, F.col("role") == TRIGGER_ROLE
    n = of(subject, "units") * of(obj, "units") * of(verb, "units")
    return largest_roles(sizes, least).groupBy("frame").agg(n.alias("n"), of(subject, "first").alias("first_subject"), of(obj, "last").alias("last_object")).where("n is not null")


def with_children(frames: DataFrame, inherits: DataFrame, depth: int | None = None) -> DataFrame:
    """``frame, unit``: the units (``frame, unit``) of each frame with those of all frames below it (``inherits``: ``parent, child``)."""
    from schemaloom.session import with_checkpoints

    with_checkpoints(frames.sparkSession)
    pairs = inherits.select("parent", "child").distinct().checkpoint()
    reach, frontier, level = pairs, pairs, 1
    while depth is None or level < depth:
        step = frontier.alias("f").join(pairs.alias("p"), F.col("f.child") == F.col("p.parent")).select("f.parent", "p.child").distinct()
        frontier = step.join(reach, ["parent", "child"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reach, level = reach.unionByName(frontier).checkpoint(), level + 1
    below = reach.join(frames.withColumnRenamed("frame", "child"), "child").select(F.col("parent").alias("frame"), "unit")
    return frames.select("frame", "unit").unionByName(below).distinct()


def frequent_paths(paths: DataFrame, least: int = 3) -> DataFrame:
    """``path, n`` of the dependency paths met at least ``least`` times, the most frequent first."""
    return paths.where("path <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "path")


def common_triples(one: DataFrame, two: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each side whose triple is on both, repeats kept. Rows with a null in ``columns`` (comments) pass through."""
    shared = one.select(*columns).intersect(two.select(*columns))
    comment = F.lit(False)
    for c in columns:
        comment = comment | F.col(c).isNull()
    keep = lambda df: df.where(~comment).join(shared, columns, "left_semi").unionByName(df.where(comment))
    return keep(one), keep(two)


def cluster_of_pairs(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """``pairs`` (``predicate, object``) with ``cluster``: the last (largest number) of the frames (``cid, predicates, objects``) whose
    predicates and objects hold them; 0 where there is none."""
    p = frames.select(F.col("cid").cast("int").alias("cluster"), F.explode(F.array_distinct("predicates")).alias("predicate"))
    o = frames.select(F.col("cid").cast("int").alias("cluster"), F.explode(F.array_distinct("objects")).alias("object"))
    wanted = pairs.select("predicate", "object").distinct()
    found = wanted.join(p, "predicate").join(o, ["object", "cluster"]).groupBy("predicate", "object").agg(F.max("cluster").alias("cluster"))
    return pairs.join(found, ["predicate", "object"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def restricted_clusters(members: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``cluster, member`` of the members in the lexicon (``member``); clusters left without any are gone."""
    return members.join(lexicon.select("member").distinct(), "member", "left_semi").select("cluster", "member")


def verb_class_purity(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Normalised purity of clusters of verbs (``cluster, element``) against verb classes; verbs without a class leave the clusters first."""
    known = restricted_clusters(members.withColumnRenamed("element", "member"), classes.select(F.col("element").alias("member")))
    return normalised_purity(known.withColumnRenamed("member", "element"), classes)


def whole_frame(triples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``cluster, role, member``: all triples as one frame, the baseline that puts everything together."""
    from schemaloom.operators.triples import frame_members

    return frame_members(triples.withColumn("_all", F.lit(0)), "_all", columns)


def single_frames(triples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``cluster, role, member``: each distinct triple a frame of its own; the cluster is the triple's digest."""
    from schemaloom.operators.triples import frame_members

    once = triples.select(*columns.values()).distinct()
    return frame_members(once.withColumn("_own", F.md5(F.concat_ws("\t", *columns.values()))), "_own", columns)


def named_vectors(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """``name, vector``: vectors (``node, vector``) under the triple that a node stands for (``node, verb, subject, object``)."""
    name = F.concat(F.lit("("), F.concat_ws(" ", "verb", "subject", "object"), F.lit(")"))
    return vectors.join(names, "node").select(name.alias("name"), "vector")
