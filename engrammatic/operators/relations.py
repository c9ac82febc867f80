"""Upkeep of the relation graph: updates as transformations of whole tables.

A relation is (user_id, subject, predicate, object) with confidence, mentions, times and a validity interval whose end
is null while it is current. Null confidences and times never satisfy a condition; a null number of mentions counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrammatic.dims import CATEGORY_OF, HIGH_IMPACT, SYMMETRIC
from engrammatic.tables import DAY

KEY = ["user_id", "subject", "predicate", "object"]
_CURRENT = "effective_to IS NULL"


def text_map(d: dict) -> Column:
    """A map literal."""
    return F.create_map(*(F.lit(x) for p in d.items() for x in p))


def upsert_relations(rows: DataFrame) -> DataFrame:
    """What a sequence of upserts leaves: one row for each normalised key; no loop, one grouping.

    The first row (by observed_at, memory_id) inserts with 0 mentions; each further one adds a mention and 0.05 to the
    confidence, up to 1. Rows with a null or blank part of the key are dropped.
    """
    norm = rows.withColumns({c: F.lower(F.trim(F.col(c))) for c in KEY[1:]}).where("user_id IS NOT NULL AND subject <> '' AND predicate <> '' AND object <> ''")
    order = F.struct("observed_at", "memory_id")
    g = norm.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min_by("confidence", order).alias("first"), F.max_by("memory_id", order).alias("memory_id"),
        F.min("observed_at").alias("created_at"), F.max("observed_at").alias("last_mentioned"),
    )
    return g.select(*KEY, "memory_id", F.least(F.lit(1.0), F.col("first") + 0.05 * (F.col("n") - 1)).alias("confidence"), (F.col("n") - 1).alias("mentions"), "created_at", "last_mentioned")


def merge_duplicates(relations: DataFrame) -> DataFrame:
    """Current relations with one row for each key: the most confident row's memory, mentions added up."""
    best = F.struct("confidence", -F.col("relation_id"))
    return relations.where(_CURRENT).groupBy(*KEY).agg(
        F.max_by("relation_id", best).alias("relation_id"), F.max_by("memory_id", best).alias("memory_id"), F.max("confidence").alias("confidence"),
        F.sum(F.coalesce("mentions", F.lit(0))).alias("mentions"), F.min("created_at").alias("created_at"), F.max("last_mentioned").alias("last_mentioned"), F.count("*").alias("merged"),
    )


def decay_stale(relations: DataFrame, as_of: int, days: int = 90, factor: float = 0.8, floor: float = 0.3) -> DataFrame:
    """Adds action (keep, decay, remove), the new confidence and effective_to. What is removed keeps its confidence."""
    stale = F.expr("effective_to IS NULL") & (F.col("last_mentioned").isNull() | (F.col("last_mentioned") < as_of - days * DAY)) & (F.coalesce("mentions", F.lit(0)) < 2)
    lower = F.col("confidence") * factor
    action = F.when(stale & (lower < floor), "remove").when(stale, "decay").otherwise("keep")
    return relations.withColumn("action", action).withColumn("effective_to", F.when(F.col("action") == "remove", F.lit(as_of)).otherwise(F.col("effective_to"))).withColumn("confidence", F.when(F.col("action") == "decay", lower).otherwise(F.col("confidence")))


def cleanup(relations: DataFrame, as_of: int, days: int = 30, floor: float = 0.3) -> DataFrame:
    """Without relations that are unsure, old and never mentioned again."""
    gone = (F.col("confidence") < floor) & (F.col("created_at") < as_of - days * DAY) & (F.coalesce("mentions", F.lit(0)) == 0)
    return relations.where(~F.coalesce(gone, F.lit(False)))


def supersede(relations: DataFrame, changes: DataFrame, as_of: int) -> DataFrame:
    """Ends the current relations whose relation_id is among the changes."""
    c = changes.select("relation_id", F.lit(True).alias("_hit")).distinct()
    return relations.join(c, "relation_id", "left").withColumn("effective_to", F.when(F.col("_hit") & F.col("effective_to").isNull(), F.lit(as_of)).otherwise(F.col("effective_to"))).drop("_hit")


def reinforce(relations: DataFrame, changes: DataFrame, as_of: int) -> DataFrame:
    """A mention more and 0.05 confidence more, up to 1, for relations among the changes."""
    c = changes.select("relation_id", F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False))
    j = relations.join(c, "relation_id", "left")
    return j.withColumns({"confidence": F.when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")), "mentions": F.coalesce("mentions", F.lit(0)) + hit.cast("long"), "last_mentioned": F.when(hit, F.lit(as_of)).otherwise(F.col("last_mentioned"))}).drop("_hit")


def merge_confidence(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Half of the new confidence for relations that a change (relation_id, new_confidence) resolves by merging."""
    c = changes.groupBy("relation_id").agg(F.max("new_confidence").alias("_new"))
    return relations.join(c, "relation_id", "left").withColumn("confidence", F.coalesce(F.col("_new") * 0.5, F.col("confidence"))).drop("_new")


def contradicting(relations: DataFrame, old: str = "likes", new: str = "dislikes") -> DataFrame:
    """Current relations of one predicate which a later row of the opposite predicate contradicts: (relation_id, new_confidence)."""
    later = relations.where(F.col("predicate") == new).groupBy("user_id", "object").agg(F.max("created_at").alias("_at"), F.max("confidence").alias("new_confidence"))
    return relations.where((F.col("predicate") == old) & F.col("effective_to").isNull()).join(later, ["user_id", "object"]).where("_at > created_at").select("relation_id", "new_confidence")


def repeated(relations: DataFrame) -> DataFrame:
    """Rows whose key was there before: (relation_id)."""
    first = relations.groupBy(*KEY).agg(F.min("relation_id").alias("_first"))
    return relations.join(first, KEY).where("relation_id > _first").select("relation_id")


def added(relations: DataFrame, new: DataFrame) -> DataFrame:
    """The relations and those of ``new`` (the same columns) whose key none of them has as a current one; of several with
    one key the least relation_id."""
    first = new.groupBy(*KEY).agg(F.min("relation_id").alias("relation_id"))
    rows = new.join(first, [*KEY, "relation_id"], "left_semi").join(relations.where(_CURRENT).select(*KEY), KEY, "left_anti")
    return relations.unionByName(rows.select(*relations.columns))


def functional_conflicts(relations: DataFrame, functional=("works_at",)) -> DataFrame:
    """Of current relations of a predicate that takes one object, where there are several: whether each is the latest."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "subject", "predicate")
    cur = relations.where(_CURRENT).where(F.col("predicate").isin(*functional)).groupBy(*KEY).agg(F.max("last_mentioned").alias("last_mentioned"))
    n = cur.withColumn("objects", F.count("*").over(w)).where("objects > 1")
    return n.withColumn("wins", F.row_number().over(w.orderBy(F.desc("last_mentioned"), "object")) == 1)


#: Names of a user that each of the user's memories is searched for one by one; letters by which more names are looked up.
SOUGHT, BEGINNING = 64, 16


def names_within(memories: DataFrame, names: DataFrame) -> DataFrame:
    """(node_id, user_id, name), once each: a user's names (user_id, name) that occur anywhere in a memory's text, in lower
    case.

    Of users with few names all meet all texts. Of others a name is looked up by its beginning among the
    texts' pieces of that length, and then sought whole.
    """
    names = names.where("name <> ''").distinct()
    n = names.groupBy("user_id").agg(F.count("*").alias("_n"), F.collect_set(F.least(F.length("name"), F.lit(BEGINNING))).alias("_sizes"))
    m = memories.select("node_id", "user_id", F.lower("content").alias("_c")).join(n.hint("merge"), "user_id")
    own = names.join(n.hint("merge"), "user_id")
    few = m.where(F.col("_n") <= SOUGHT).join(own.where(F.col("_n") <= SOUGHT).select("user_id", "name").hint("merge"), "user_id")
    places = lambda k: F.transform(F.sequence(F.lit(1), F.length("_c") - k + 1), lambda i: F.substr("_c", i, k))
    pieces = F.flatten(F.transform("_sizes", lambda k: F.when(F.length("_c") >= k, places(k)).otherwise(F.array().cast("array<string>"))))
    by = m.where(F.col("_n") > SOUGHT).select("node_id", "user_id", "_c", F.explode(F.array_distinct(pieces)).alias("_b"))
    many = by.join(own.where(F.col("_n") > SOUGHT).select("user_id", "name", F.substr("name", F.lit(1), F.lit(BEGINNING)).alias("_b")).hint("merge"), ["user_id", "_b"])
    return few.select("node_id", "user_id", "_c", "name").unionByName(many.select("node_id", "user_id", "_c", "name")).where(F.col("_c").contains(F.col("name"))).select("node_id", "user_id", "name").distinct()


def reinforcement_candidates(relations: DataFrame, memories: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """For each memory up to ``most`` of its user's merged relations whose subject or object occurs anywhere in its text or
    is a term (subject, predicate or object) of a relation newly found in it, the surest first.

    new: (memory_id, subject, predicate, object). As only ``most`` are wanted, of each name's relations only the first so
    many meet the memories with that name. Joins don't broadcast: tables of names grow with the input.
    """
    from pyspark.sql import Window

    order = [F.desc("confidence"), F.asc("subject"), F.asc("predicate"), F.asc("object")]
    first = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    r = relations.select(*KEY, "confidence").withColumn("name", F.explode(F.array_distinct(F.array("subject", "object"))))
    r = first(r, "user_id", "name").drop("rank")
    terms = new.select(F.col("memory_id").alias("node_id"), F.explode(F.array(*(F.lower(c) for c in KEY[1:]))).alias("name")).distinct()
    terms = memories.select("node_id", "user_id").join(terms.hint("merge"), "node_id").select("node_id", "user_id", "name")
    named = names_within(memories, r.select("user_id", "name")).unionByName(terms).distinct()
    return first(named.join(r.hint("merge"), ["user_id", "name"]).drop("name").dropDuplicates(["node_id", *KEY]), "node_id")


def localize(relations: DataFrame, names: DataFrame, small: int = 100) -> DataFrame:
    """All relations of users with fewer than ``small``; of others those that touch one of the user's names."""
    n = relations.groupBy("user_id").agg(F.count("*").alias("_n"))
    own = names.select("user_id", F.col("name").alias("_name")).distinct()
    touched = relations.join(own, "user_id").where("subject = _name OR object = _name").select("relation_id").distinct().withColumn("_hit", F.lit(True))
    return relations.join(n, "user_id").join(touched, "relation_id", "left").where((F.col("_n") < small) | F.col("_hit")).drop("_n", "_hit")


def full_reconsolidation(relations: DataFrame, as_of: int) -> DataFrame:
    """Merges duplicates, then lets what is stale decay or end."""
    return decay_stale(merge_duplicates(relations).withColumn("effective_to", F.lit(None).cast("long")), as_of)


def edge_strength(strength: Column, idle_seconds: Column, decay: float = 1.2e-5, boost: float = 0.1) -> Column:
    """Strength after a firing: what decay left plus a boost, up to 1."""
    return F.least(F.lit(1.0), strength * F.exp(-decay * idle_seconds) + boost)


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each edge with its category; edges of symmetric relations also mirrored, each naming the other."""
    e = edges.withColumn("category", F.coalesce(F.try_element_at(text_map(CATEGORY_OF), F.col("relation")), F.lit("temporal")))
    both = F.col("relation").isin(*SYMMETRIC)
    there = e.withColumn("pair", F.when(both, F.concat(F.col("edge_id"), F.lit("~"))))
    back = e.where(both).select(F.concat("edge_id", F.lit("~")).alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "category", F.col("edge_id").alias("pair"))
    return there.select("edge_id", "src", "dst", "relation", "category", "pair").unionByName(back)


def pending(candidates: DataFrame, priority: str, most: int = 100) -> DataFrame:
    """Candidates that wait for consolidation: HIGH by evidence, contradictions or a relation of high impact, MED by
    evidence and sessions, the last fired first; LOW all, the first seen first. The lists overlap."""
    c = candidates.where("status = 'candidate'")
    if priority == "HIGH":
        c = c.where((F.col("evidence") >= 3) | (F.col("contradictions") / 3.0 > 0.7) | F.col("predicate").isin(*HIGH_IMPACT))
    elif priority == "MED":
        c = c.where((F.col("evidence") >= 2) & (F.col("sessions") >= 2))
    return c.orderBy(F.asc("first_seen") if priority == "LOW" else F.desc("last_fired"), "candidate_id").limit(most)


def without_expired(candidates: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Without candidates that were first seen more than so many days ago and never promoted."""
    return candidates.where(~((F.col("status") == "candidate") & (F.floor((F.lit(as_of) - F.col("first_seen")) / float(DAY)) > days)))


def pruning_action(memories: DataFrame, references: DataFrame, as_of: int) -> DataFrame:
    """What the retention schedule does to each memory: archive, delete or keep. references: node_ids that tier 1 or 2 refers to."""
    r = references.select("node_id").distinct().withColumn("_ref", F.lit(True))
    age = (F.lit(as_of) - F.col("observed_at")) / float(DAY)
    action = (
        F.when((F.col("tier") == 1) & (age > 365), "archive").when((F.col("tier") == 2) & (age > 180), "archive")
        .when((F.col("tier") == 3) & (age > 30) & F.col("_ref").isNull(), "delete").when((F.col("tier") == 4) & (age > 600 / 86_400), "delete").otherwise("keep")
    )
    return memories.join(r, "node_id", "left").withColumn("action", action).drop("_ref")
