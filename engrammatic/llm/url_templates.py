"""URL filters by path-template trees.

The paths of each host form a tree of segments; a segment that looks variable (digits, hexadecimal ids) is '*'. From the
deepest level up, sibling branches are compared: those that go on alike (with the same templates below them), or all
children of a parent with very many, are a family. Branches of a family whose share of bad pages doesn't differ
significantly from the family's are merged under '+', those significantly above it under '+high', those below under
'+low'; what a merger makes equal is compared again until nothing changes. Each template that results is rejected if
its purity, the share of bad pages among its labelled ones smoothed towards its host's and all hosts' shares, is too
high. The tree is a table of different paths with their numbers; every level is one grouped pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrammatic.llm._shared import drop_written, written

#: All children of a parent with more different ones than this are a family, however they go on.
MOST_CHILDREN = 20
#: Segments of a path from this one on count as one.
LEVELS = 24
#: Templates up to this many are broadcast to the pages.
BROADCAST_TEMPLATES = 300_000
#: Pseudo-counts with which a host's share enters a template's, and the share of all hosts a host's.
SMOOTHING = 4.0
#: A branch's share differs from its family's by more than so many standard errors, or isn't different.
DIFFER = 1.96
#: Smoothed share of bad pages from which a template is rejected.
REJECT = 0.5


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a leading 'www.' or 'm.'."""
    h = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(h, r"^(?:www|m)\.", "")


def path_of(url: Column) -> Column:
    """The path's segments in lower case; without query, fragment, empty segments and the ending of a page's name."""
    p = F.regexp_replace(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"\.(?:html?|php|aspx?|jsp)/?$", "")
    return F.filter(F.split(F.lower(F.trim(p)), "/"), lambda s: s != "")


def looks_variable(segment: Column) -> Column:
    """Numbers, dates, hexadecimal ids, UUIDs, and names that hold a long number."""
    return segment.rlike(r"^[0-9][0-9._-]*$|^[0-9a-f]{8,}$|^[0-9a-f]{8}-[0-9a-f-]{27}$|[0-9]{4,}")


def segments(url: Column) -> Column:
    """The path's segments, '*' for those that look variable; from LEVELS on they are one."""
    p = F.transform(path_of(url), lambda x: F.when(looks_variable(x), F.lit("*")).otherwise(x))
    return F.when(F.size(p) <= LEVELS, p).otherwise(F.concat(F.slice(p, 1, LEVELS - 1), F.array(F.array_join(F.slice(p, LEVELS, F.greatest(F.size(p), F.lit(1))), "/"))))


def counted(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path, pages, labelled, bad) for each different path of a host."""
    b = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), segments(F.col("url")).alias("path")).where("host <> ''")
    return p.join(b, "page_id", "left").groupBy("host", "path").agg(F.count("*").alias("pages"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def _levels(tree: DataFrame) -> list[int]:
    """The levels, deepest first, at which some parent has more than one child."""
    at = tree.where(F.size("t") > 0).select("host", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("level"))
    at = at.select("host", "level", F.slice("t", 1, F.col("level") - 1).alias("parent"), F.get("t", F.col("level") - 1).alias("seg"))
    forks = at.groupBy("host", "level", "parent").agg(F.min("seg").alias("a"), F.max("seg").alias("z")).where("a <> z")
    return sorted((r.level for r in forks.select("level").distinct().collect()), reverse=True)  # at most LEVELS rows


def _merged_at(tree: DataFrame, level: int) -> DataFrame:
    """The tree with the families of one level merged: its column t changes."""
    deep = tree.where(F.size("t") >= level).select("host", F.slice("t", 1, level - 1).alias("parent"), F.get("t", F.lit(level - 1)).alias("seg"), F.expr(f"slice(t, {level + 1}, size(t))").alias("tail"), "labelled", "bad")
    tails = deep.groupBy("host", "parent", "seg", "tail").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    branch = tails.groupBy("host", "parent", "seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("tail")).alias("h"))
    branch = written(branch.withColumn("below", F.struct("n", "h")).drop("n", "h"))
    many = branch.groupBy("host", "parent").agg((F.count("*") > MOST_CHILDREN).alias("many"))
    branch_ = branch.join(many, ["host", "parent"]).withColumn("family", F.when(~F.col("many"), F.col("below"))).drop("many", "below")
    pooled = branch_.groupBy("host", "parent", "family").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    same = (F.col("x.host") == F.col("y.host")) & (F.col("x.parent") == F.col("y.parent")) & F.col("x.family").eqNullSafe(F.col("y.family"))
    b = branch_.alias("x").join(pooled.alias("y"), same).select("x.*", "all_labelled", "all_bad")
    share, together = F.col("bad") / F.col("labelled"), F.col("all_bad") / F.col("all_labelled")
    apart = F.round(share - together, 9)
    room = F.round(DIFFER * F.sqrt(together * (1 - together) / F.col("labelled")), 9)
    kind = F.when(F.col("labelled") == 0, "+").when(apart > room, "+high").when(apart < -room, "+low").otherwise("+")
    b = written(b.select("host", "parent", "seg", "family", kind.alias("kind")))
    few = b.groupBy("host", "parent", "family", "kind").agg(F.count("*").alias("members")).where("members > 1")
    same &= F.col("x.kind") == F.col("y.kind")
    new = b.alias("x").join(few.alias("y"), same).where("x.seg <> x.kind").select("x.host", "x.parent", "x.seg", "x.kind")
    here = tree.withColumn("parent", F.when(F.size("t") >= level, F.slice("t", 1, level - 1))).withColumn("seg", F.get("t", F.lit(level - 1)))
    out = here.join(new, ["host", "parent", "seg"], "left")
    t = F.when(F.col("kind").isNull(), F.col("t")).otherwise(F.concat(F.slice("t", 1, level - 1), F.array("kind"), F.expr(f"slice(t, {level + 1}, size(t))")))
    out = written(out.select("host", "path", t.alias("t"), "pages", "labelled", "bad", (F.col("changed") | F.col("kind").isNotNull()).alias("changed")))
    drop_written(branch, b)
    return out


def merged_templates(paths: DataFrame) -> DataFrame:
    """(host, path, t, pages, labelled, bad) as a written table: t is the path's template after all mergers.

    A merger makes different templates equal or gives a branch its last name, so the passes come to an end.
    """
    tree = written(paths.select("host", "path", F.col("path").alias("t"), "pages", "labelled", "bad", F.lit(False).alias("changed")))
    while True:
        for level in _levels(tree):
            new = _merged_at(tree, level)
            drop_written(tree)
            tree = new
        if tree.where("changed").isEmpty():
            return tree.drop("changed")
        new = written(tree.withColumn("changed", F.lit(False)))
        drop_written(tree)
        tree = new


def judged_templates(tree: DataFrame) -> DataFrame:
    """(host, path, template, purity, rejected) for each path of a tree that merged_templates() gave."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled", "bad")]
    every = tree.agg(*sums).first()  # one row
    hosts = tree.groupBy("host").agg(*sums).select("host", F.col("labelled").alias("h_labelled"), F.col("bad").alias("h_bad"))
    t = tree.groupBy("host", "t").agg(*sums).join(hosts, "host")
    everywhere = (every.bad + 0.5) / (every.labelled + 1.0)
    on_host = (F.col("h_bad") + SMOOTHING * everywhere) / (F.col("h_labelled") + SMOOTHING)
    purity = F.round((F.col("bad") + SMOOTHING * on_host) / (F.col("labelled") + SMOOTHING), 6)
    t = t.select("host", "t", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), purity.alias("purity"))
    return tree.select("host", "path", "t").join(t, ["host", "t"]).select("host", "path", "template", "purity", (F.col("purity") >= REJECT).alias("rejected"))


def filter_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, template, purity, rejected) for each row of pages.

    pages needs page_id and url, labels page_id and bad (0 or 1, any number of rows for a page). A row whose url is
    null, empty or has no host gets host and template null, purity null and is not rejected; a URL without a path has
    the template '/'. URLs of any length are read whole; the segments of a path from the LEVELS-th on are one. Pages of
    a host without labels get the share of all hosts. Rows of pages with a null page_id are judged but their labels
    aren't found. Branches with equal shares are ties and not different. Repeated rows give repeated results and count
    as often; an empty pages table gives no rows and empty labels a share of one half everywhere. Other columns may
    have any name and are not returned.
    """
    p = pages.select("page_id", "url")
    judged = written(judged_templates(merged_templates(counted(p, labels.select("page_id", "bad")))))
    if judged.count() <= BROADCAST_TEMPLATES:
        judged = F.broadcast(judged)
    rows = p.select("page_id", F.when(host_of(F.col("url")) != "", host_of(F.col("url"))).alias("host"), segments(F.col("url")).alias("path"))
    out = rows.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "template", "purity", F.coalesce("rejected", F.lit(False)).alias("rejected"))
