"""Relations from parsed sentences: every pattern looks within one sentence, whose tokens are gathered in one row.

tokens: (doc_id, sent, i, text, lemma, pos, dep, head, ent), i counting within the document and a root being its own
head. What a parser makes is such a table; the operators don't care which one. Tokens are shuffled once, by sentence.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrammatic import dims as D
from engrammatic.operators.text import text_map

AT = ["doc_id", "sent"]
OBJECTS, SUBJECTS, CLAUSES = ("dobj", "obj"), ("nsubj", "nsubjpass"), ("ccomp", "xcomp", "advcl")


_TOKEN = "i text low lemma pos dep head".split()
_FOUND = "array<struct<pattern:string,span:string,own:string,before:string,lemma:string,object:string,owned:boolean,depth:int,passive:boolean,negated:boolean,modality:string>>"


def patterns(tokens: list) -> list[tuple]:
    """What the eight patterns find in a sentence, as _FOUND has it. tokens: tuples of _TOKEN, low and lemma in lower case."""
    tokens = [dict(zip(_TOKEN, t)) for t in tokens]
    at, below = defaultdict(list), defaultdict(list)
    for t in tokens:
        if t["i"] is not None:
            at[t["i"]].append(t)
            if t["head"] is not None and t["i"] != t["head"]:
                below[t["head"]].append(t)

    def children(head, *deps):
        return sorted(t["i"] for t in below.get(head, ()) if t["dep"] in deps)

    def one(head, *deps):
        return children(head, *deps)[:1]

    def climbed(step) -> list[tuple]:
        """(place, top): each token with itself and all that it reaches by steps; a cycle ends."""
        out = []
        for i, same in at.items():
            front, n = [i] * len(same), 0
            while front and n <= len(tokens):
                out += [(i, top) for top in front]
                front, n = [t["head"] for top in front for t in at.get(top, ()) if t["head"] is not None and step(t)], n + 1
        return out

    found = []  # (pattern, subject, predicate, object, lemma, depth, passive)
    svo = []
    verbs = [t for t in tokens if t["pos"] == "VERB" and t["i"] is not None]
    for v in verbs:
        i = v["i"]
        for s in one(i, "nsubj"):
            svo += [(s, i, o, v["lemma"]) for o in one(i, *OBJECTS)]
            for p in children(i, "prep"):
                found += [("nsubj_verb_prep_pobj", s, i, o, "_".join(x for x in (v["lemma"], w["low"]) if x is not None), 0, False) for o in one(p, "pobj", "dobj") for w in at[p]]
            found += [("relative_clause", s, i, t["head"], v["lemma"], 0, False) for t in at[i] if t["dep"] == "relcl"]
        found += [("passive_voice", s, i, o, v["lemma"], 0, True) for o in one(i, "nsubjpass") for g in one(i, "agent") for s in one(g, "pobj")]
    found += [("nsubj_verb_dobj", *x, 0, False) for x in svo]
    for head in list(below):
        for s in one(head, *SUBJECTS):
            found += [("copula_attr", s, head, o, t["lemma"], 0, False) for o in children(head, "attr", "acomp") for t in at.get(head, ())]
            found += [("copula_attr", s, c, head, t["lemma"], 0, False) for c in one(head, "cop") for r in at.get(head, ()) if r["dep"] == "ROOT" for t in at[c]]
    found += [("apposition", t["head"], t["i"], t["i"], "holds_title", 0, False) for t in tokens if t["dep"] == "appos"]
    if svo:
        joined = defaultdict(list)
        for i, top in climbed(lambda t: t["dep"] == "conj"):
            joined[top].append(i)
        found += [("coordination", s, p, o, lemma, 0, False) for a, p, b, lemma in svo for s in joined[a] for o in joined[b]]
        level = [t["i"] for t in tokens if t["dep"] == "ROOT" and t["i"] is not None]
        for depth in range(4):
            found += [("nested_clause", *x, depth, False) for x in svo for i in level if i == x[1]]
            level = [c for i in level for c in children(i, *CLAUSES)]
    if not found:
        return []
    ends = {}
    for i, top in climbed(lambda t: t["i"] != t["head"]):
        a, z = ends.get(top, (i, i))
        ends[top] = min(a, i), max(z, i)
    texts = lambda ts: " ".join(t["text"] for t in sorted(ts, key=lambda t: (t["i"], t["text"] is not None, t["text"] or "")) if t["text"] is not None)
    spans = {}

    def span(top):
        """The words from the first to the last of the subtree; whether they hold a possessive."""
        if top not in spans:
            a, z = ends[top]
            words = [t for t in tokens if t["i"] is not None and a <= t["i"] <= z]
            spans[top] = texts(words), any(t["dep"] in ("poss", "det") and t["low"] in D.POSSESSIVES for t in words)
        return spans[top]

    out = []
    for pattern, s, p, o, lemma, depth, passive in found:
        if s not in ends or o not in ends:
            continue
        short = [t for t in below.get(s, ()) if t["dep"] in ("compound", "amod", "det") and t["i"] < s]
        modal = min(((t["i"], t["lemma"]) for t in tokens if t["dep"] == "aux" and t["head"] == p and t["i"] is not None and t["lemma"] in D.MODALITY), default=(0, None))[1]
        for t in at.get(s, ()):
            out.append((pattern, span(s)[0], t["text"], texts(short) if short else None, lemma, *span(o), depth, passive, bool(children(p, "neg")), modal))
    return out


def triples(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, pattern, subject, predicate, object, confidence, negated, passive, question, modality) of all patterns.

    A negated predicate loses 0.15, a modal multiplies; a possessive complement gains 5 %, each level of nesting loses
    4 %. The subject of an apposition is its head with what stands directly before it.
    """
    t = tokens.select(*AT, F.struct("i", "text", F.lower("text").alias("low"), F.lower("lemma").alias("lemma"), "pos", "dep", "head").alias("t"))
    of = t.groupBy(*AT).agg(F.collect_list("t").alias("ts"), F.max_by("t.text", "t.i").alias("last"), F.min_by(F.struct("t.dep", "t.pos"), "t.i").alias("one"))
    ask = (F.col("last") == "?") | ((F.col("one.dep") == "aux") & (F.col("one.pos") == "AUX"))
    p = of.where(" AND ".join(f"{c} IS NOT NULL" for c in AT)).select(*AT, ask.alias("question"), F.inline(F.udf(patterns, _FOUND)("ts")))
    p = p.withColumns({"s_text": F.when(F.col("pattern") == "apposition", F.concat_ws(" ", "before", "own")).otherwise(F.col("span")), "factor": F.pow(F.lit(0.96), "depth")})
    base = F.coalesce(F.try_element_at(text_map(D.PATTERN_CONFIDENCE), F.col("pattern")), F.lit(0.8))
    is_no = F.col("negated")
    sure = F.round(F.greatest(F.lit(0.0), (base - F.when(is_no, 0.15).otherwise(0.0)) * F.coalesce(F.try_element_at(text_map(D.MODALITY), F.col("modality")), F.lit(1.0))), 3)
    owned = (F.col("pattern") == "copula_attr") & F.col("owned")
    sure = F.when(owned, F.least(F.lit(1.0), sure * 1.05)).otherwise(sure * F.col("factor"))
    return p.select(*AT, "pattern", F.col("s_text").alias("subject"), F.col("lemma").alias("predicate"), "object", sure.alias("confidence"), is_no.alias("negated"), "passive", (F.col("question") & (F.col("pattern") != "apposition")).alias("question"), "modality")


def distinct_triples(found: DataFrame) -> DataFrame:
    """Of triples that differ in nothing but case the surest; of equally sure ones that of the earlier pattern."""
    order = text_map({p: float(i) for i, p in enumerate(D.PATTERN_CONFIDENCE)})
    w = Window.partitionBy("doc_id", F.lower("subject"), "predicate", F.lower("object")).orderBy(F.desc("confidence"), F.try_element_at(order, F.col("pattern")), "sent")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coreferences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, i, text, resolved): pronouns and demonstratives with the last person named up to the sentence's end.

    Relative pronouns ('who', 'which', and 'that' as subject or object) stay as they are.
    """
    ends = tokens.groupBy(*AT).agg(F.max("i").alias("end"), F.max(F.when(F.col("ent") == "PERSON", F.struct("i", "text"))).alias("last"))
    w = Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, 0)
    known = ends.select(*AT, F.last("last", ignorenulls=True).over(w).alias("person")).where("person IS NOT NULL")
    low = F.lower("text")
    personal = (F.col("pos") == "PRON") & low.isin(*D.PERSONAL_PRONOUNS)
    pointing = low.isin("this", "these", "those") & F.col("dep").isin("nsubj", "dobj", "pobj")
    return tokens.where(personal | pointing).join(known, AT).select(*AT, "i", "text", F.col("person.text").alias("resolved"))


def noun_phrase_type(span: Column, entity: Column, lemma: Column, pos: Column) -> Column:
    """The kind of a noun phrase: what its entity label maps to; else by its last word's lemma (without a plural s where
    none is known), by an age, or as an attribute if the last word is an adjective; else null."""
    words = F.split(F.trim(span), r"\s+")
    head = F.lower(F.element_at(words, -1))
    base = F.coalesce(F.lower(lemma), F.regexp_replace(head, "s+$", ""))
    out = F.when(F.lower(span).rlike("years? old") | (pos == "ADJ"), F.lit("ATTRIBUTE"))
    for kind, lexicon in reversed(D.NOUN_TYPES.items()):
        out = F.when(base.isin(*lexicon.split()), F.lit(kind)).otherwise(out)
    return F.when(entity.isNotNull(), F.coalesce(F.try_element_at(text_map(D.ENTITY_TYPES), F.upper(entity)), entity)).when(F.trim(span) != "", out)
