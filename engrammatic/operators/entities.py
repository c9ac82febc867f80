"""Entity resolution as a cascade of joins: what is known of a name, the name, an alias, edit distance, likeness of tokens;
what is left is a new entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _allowed(length, least: float):
    return F.greatest(F.lit(1), F.floor((1 - least) * length)).cast("int")


def _pieces(n, k) -> object:
    """The k + 1 even pieces of n letters: array<struct<i, first, size>>, first counting from 0."""
    cut = lambda i: F.floor(i * n / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), cut(i).alias("first"), (cut(i + 1) - cut(i)).alias("size")))


def fuzzy(names: DataFrame, entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(user_id, name, entity_id, distance): of a user's entities the nearest within max(1, floor((1 - least) * length)).

    A name within k edits of an entity shares one of its own k + 1 even pieces with it, shifted by k letters at most. The
    join's keys are user, length of the name, number and letters of a piece, so that only such candidates meet; each is
    then measured.
    """
    n = names.select("user_id", "name").distinct().withColumns({"low": F.lower("name"), "n": F.length("name")}).withColumn("k", _allowed(F.col("n"), least))
    n = n.withColumn("p", F.explode(_pieces(F.col("n"), F.col("k")))).select("user_id", "name", "low", "n", "k", F.col("p.i").alias("i"), F.substr("low", F.col("p.first") + 1, F.col("p.size")).alias("piece"))
    e = entities.select("user_id", "entity_id", F.lower("name").alias("known")).withColumn("len", F.length("known"))
    wide = F.ceil(F.col("len") * (1 - least) / least).cast("int") + 1  # lengths of names that may be so near
    e = e.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("len") - wide), F.col("len") + wide))).withColumn("k", _allowed(F.col("n"), least)).where("abs(n - len) <= k")
    e = e.withColumn("p", F.explode(_pieces(F.col("n"), F.col("k")))).withColumn("at", F.explode(F.sequence(F.col("p.first") - F.col("k"), F.col("p.first") + F.col("k")))).where("at >= 0 AND at + p.size <= len")
    e = e.select("user_id", "entity_id", "known", "n", F.col("p.i").alias("i"), F.substr("known", F.col("at") + 1, F.col("p.size")).alias("piece")).distinct()
    j = n.join(e, ["user_id", "n", "i", "piece"]).select("user_id", "name", "low", "k", "entity_id", "known").distinct()
    j = j.withColumn("distance", F.levenshtein("low", "known").cast("long")).where("distance <= k")
    w = Window.partitionBy("user_id", "name").orderBy("distance", "entity_id")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "name", "entity_id", "distance")


def by_embedding(names: DataFrame, entities: DataFrame, least: float = 0.9) -> DataFrame:
    """(user_id, name, entity_id): of a user's entities the one whose name's tokens are most alike, from ``least`` on, of
    equally near ones the least entity_id. Sparse vectors meet in an equi-join on user and place."""
    from engrammatic.operators.text import embedded

    sparse = lambda df, c: df.select("user_id", c, F.explode(embedded(F.col("name"))).alias("v")).select("user_id", c, F.col("v.place").alias("place"), F.col("v.value").alias(f"{c}_value"))
    q, d = sparse(names.select("user_id", "name").distinct(), "name"), sparse(entities, "entity_id")
    s = q.join(d, ["user_id", "place"]).groupBy("user_id", "name", "entity_id").agg(F.round(F.sum(F.col("name_value") * F.col("entity_id_value")), 9).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("user_id", "name").orderBy(F.desc("similarity"), "entity_id")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "name", "entity_id")


def resolve(names: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user_id, name, entity_id, method): known, exact, alias, fuzzy, embedding or new, the first that applies; a null name
    resolves to nothing. known: (alias, name), what a knowledge base calls things; such a name stands for the other."""
    n = names.select("user_id", "name").where("name IS NOT NULL").distinct()
    exact = entities.groupBy("user_id", F.lower("name").alias("_n")).agg(F.min("entity_id").alias("_exact"))
    alias = entities.select("user_id", "entity_id", F.explode(F.array("alias1", "alias2")).alias("a")).groupBy("user_id", F.lower("a").alias("_n")).agg(F.min("entity_id").alias("_alias"))
    near = fuzzy(n, entities).select("user_id", "name", F.col("entity_id").alias("_fuzzy"))
    like = by_embedding(n, entities).select("user_id", "name", F.col("entity_id").alias("_like"))
    j = n.withColumn("_n", F.lower("name")).join(exact, ["user_id", "_n"], "left").join(alias, ["user_id", "_n"], "left").join(near, ["user_id", "name"], "left").join(like, ["user_id", "name"], "left")
    if known is None:
        j = j.withColumn("_known", F.lit(None).cast("string"))
    else:
        k = known.groupBy(F.lower("alias").alias("_n")).agg(F.lower(F.min("name")).alias("_to"))
        j = j.join(k, "_n", "left").join(exact.select("user_id", F.col("_n").alias("_to"), F.col("_exact").alias("_known")), ["user_id", "_to"], "left")
    levels = ("_known", "_exact", "_alias", "_fuzzy", "_like")
    method = F.coalesce(*(F.when(F.col(c).isNotNull(), m) for c, m in zip(levels, ("known", "exact", "alias", "fuzzy", "embedding"))), F.lit("new"))
    return j.select("user_id", "name", F.coalesce(*levels, F.concat(F.lit("new:"), F.col("_n"))).alias("entity_id"), method.alias("method"))
