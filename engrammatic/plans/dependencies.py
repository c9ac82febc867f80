"""Relations, references and kinds of noun phrases over parsed sentences."""

from pyspark.sql import functions as F

from engrammatic import dims as D
from engrammatic.operators import dependencies as P
from engrammatic.registry import query
from engrammatic.tables import table


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def case(mapping: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in mapping.items()) + " END"


_FIRST = "SELECT doc_id, head, min(i) AS {n} FROM _tokens WHERE dep IN {deps} AND i <> head GROUP BY ALL"
_TRIPLES = f"""
    WITH RECURSIVE up AS (SELECT doc_id, i, i AS t FROM _tokens UNION ALL SELECT u.doc_id, u.i, k.head FROM up u JOIN _tokens k ON k.doc_id = u.doc_id AND k.i = u.t AND k.head <> k.i),
    cj AS (SELECT doc_id, i, i AS t FROM _tokens UNION ALL SELECT u.doc_id, u.i, k.head FROM cj u JOIN _tokens k ON k.doc_id = u.doc_id AND k.i = u.t AND k.dep = 'conj'),
    deep AS (SELECT doc_id, i, 0 AS depth FROM _tokens WHERE dep = 'ROOT' UNION ALL SELECT d.doc_id, k.i, depth + 1 FROM deep d JOIN _tokens k ON k.doc_id = d.doc_id AND k.head = d.i AND k.i <> k.head AND k.dep IN ('ccomp', 'xcomp', 'advcl') AND depth < 3),
    ends AS (SELECT doc_id, t, min(i) AS a, max(i) AS z FROM up GROUP BY ALL),
    sp AS (SELECT e.doc_id, e.t, string_agg(k.text, ' ' ORDER BY k.i) AS text, bool_or(k.dep IN ('poss', 'det') AND lower(k.text) IN {quoted(D.POSSESSIVES)}) AS owned FROM ends e JOIN _tokens k ON k.doc_id = e.doc_id AND k.i BETWEEN e.a AND e.z GROUP BY ALL),
    su AS ({_FIRST.format(n='s', deps="('nsubj')")}), asu AS ({_FIRST.format(n='s', deps="('nsubj', 'nsubjpass')")}), ob AS ({_FIRST.format(n='o', deps="('dobj', 'obj')")}),
    po AS ({_FIRST.format(n='o', deps="('pobj', 'dobj')")}), pa AS ({_FIRST.format(n='o', deps="('nsubjpass')")}), ag AS ({_FIRST.format(n='g', deps="('agent')")}), gp AS ({_FIRST.format(n='o', deps="('pobj')")}),
    v AS (SELECT doc_id, i, lower(lemma) AS lemma FROM _tokens WHERE pos = 'VERB'),
    svo AS (SELECT v.doc_id, s, v.i AS p, o, lemma FROM v JOIN su ON su.doc_id = v.doc_id AND su.head = v.i JOIN ob ON ob.doc_id = v.doc_id AND ob.head = v.i),
    f AS (
      SELECT 'nsubj_verb_dobj' AS pattern, doc_id, s, p, o, lemma, 1e0 AS factor, false AS passive FROM svo
      UNION ALL SELECT 'nsubj_verb_prep_pobj', v.doc_id, s, v.i, po.o, v.lemma || '_' || lower(k.text), 1, false FROM v JOIN su ON su.doc_id = v.doc_id AND su.head = v.i JOIN _tokens k ON k.doc_id = v.doc_id AND k.head = v.i AND k.dep = 'prep' JOIN po ON po.doc_id = v.doc_id AND po.head = k.i
      UNION ALL SELECT 'copula_attr', c.doc_id, s, h.i, c.i, lower(h.lemma), 1, false FROM _tokens c JOIN _tokens h ON h.doc_id = c.doc_id AND h.i = c.head JOIN asu ON asu.doc_id = c.doc_id AND asu.head = h.i WHERE c.dep IN ('attr', 'acomp')
      UNION ALL SELECT 'copula_attr', r.doc_id, s, c.i, r.i, lower(c.lemma), 1, false FROM _tokens r JOIN _tokens c ON c.doc_id = r.doc_id AND c.head = r.i AND c.dep = 'cop' JOIN asu ON asu.doc_id = r.doc_id AND asu.head = r.i WHERE r.dep = 'ROOT'
      UNION ALL SELECT 'apposition', doc_id, head, i, i, 'holds_title', 1, false FROM _tokens WHERE dep = 'appos'
      UNION ALL SELECT 'passive_voice', v.doc_id, gp.o, v.i, pa.o, v.lemma, 1, true FROM v JOIN pa ON pa.doc_id = v.doc_id AND pa.head = v.i JOIN ag ON ag.doc_id = v.doc_id AND ag.head = v.i JOIN gp ON gp.doc_id = v.doc_id AND gp.head = ag.g
      UNION ALL SELECT 'coordination', svo.doc_id, x.i, p, y.i, lemma, 1, false FROM svo JOIN cj x ON x.doc_id = svo.doc_id AND x.t = s JOIN cj y ON y.doc_id = svo.doc_id AND y.t = o
      UNION ALL SELECT 'nested_clause', svo.doc_id, s, p, o, lemma, pow(0.96e0, depth), false FROM svo JOIN deep d ON d.doc_id = svo.doc_id AND d.i = p
      UNION ALL SELECT 'relative_clause', v.doc_id, s, v.i, k.head, v.lemma, 1, false FROM v JOIN _tokens k ON k.doc_id = v.doc_id AND k.i = v.i AND k.dep = 'relcl' JOIN su ON su.doc_id = v.doc_id AND su.head = v.i),
    neg AS (SELECT DISTINCT doc_id, head FROM _tokens WHERE dep = 'neg'), mo AS (SELECT doc_id, head, arg_min(lower(lemma), i) AS modality FROM _tokens WHERE dep = 'aux' AND lower(lemma) IN {quoted(D.MODALITY)} GROUP BY ALL),
    ask AS (SELECT doc_id, sent, arg_max(text, i) = '?' OR (arg_min(dep, i) = 'aux' AND arg_min(pos, i) = 'AUX') AS question FROM _tokens GROUP BY ALL),
    bf AS (SELECT k.doc_id, k.i, concat_ws(' ', (SELECT string_agg(b.text, ' ' ORDER BY b.i) FROM _tokens b WHERE b.doc_id = k.doc_id AND b.head = k.i AND b.i < k.i AND b.dep IN ('compound', 'amod', 'det')), k.text) AS text FROM _tokens k WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.s = k.i AND f.pattern = 'apposition')),
    c AS (SELECT f.*, k.sent, CASE WHEN pattern = 'apposition' THEN bf.text ELSE x.text END AS subject, y.text AS object, y.owned, neg.doc_id IS NOT NULL AS negated, modality, question AND pattern <> 'apposition' AS question,
        round(greatest(0, ({case(D.PATTERN_CONFIDENCE, 'pattern')} - CASE WHEN neg.doc_id IS NULL THEN 0 ELSE 0.15e0 END) * coalesce({case(D.MODALITY, 'modality')}, 1)), 3) AS sure
      FROM f JOIN _tokens k ON k.doc_id = f.doc_id AND k.i = f.p JOIN sp x ON x.doc_id = f.doc_id AND x.t = s JOIN sp y ON y.doc_id = f.doc_id AND y.t = o LEFT JOIN neg ON neg.doc_id = f.doc_id AND neg.head = p
      LEFT JOIN mo ON mo.doc_id = f.doc_id AND mo.head = p LEFT JOIN bf ON bf.doc_id = f.doc_id AND bf.i = s JOIN ask ON ask.doc_id = f.doc_id AND ask.sent = k.sent),
    tr AS (SELECT doc_id, sent, pattern, subject, lemma AS predicate, object, CASE WHEN pattern = 'copula_attr' AND owned THEN least(1, sure * 1.05e0) ELSE sure * factor END AS confidence, negated, passive, question, modality FROM c)"""
_COLUMNS = "doc_id, sent, pattern, subject, predicate, object, round(confidence, 6) AS confidence, negated, passive, question, coalesce(modality, '') AS modality"


def found(spark, d):
    return P.triples(table(spark, d, "tokens"))


def shown(df):
    return df.select("doc_id", "sent", "pattern", "subject", "predicate", "object", F.round("confidence", 6).alias("confidence"), "negated", "passive", "question", F.coalesce("modality", F.lit("")).alias("modality"))


@query("dependency_extract", f"{_TRIPLES} SELECT {_COLUMNS} FROM tr")
def dependency_extract(spark, d):
    return shown(found(spark, d))


_RANK = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(D.PATTERN_CONFIDENCE))


@query("dependency_triples", f"{_TRIPLES} SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(subject), predicate, lower(object) ORDER BY confidence DESC, CASE pattern {_RANK} END, sent) AS n FROM tr) WHERE n = 1")
def dependency_triples(spark, d):
    return shown(P.distinct_triples(found(spark, d)))


@query("coref_simple", f"""
    WITH e AS (SELECT doc_id, sent, max(i) AS z FROM _tokens GROUP BY ALL),
    r AS (SELECT t.doc_id, t.sent, t.i, t.text, (SELECT arg_max(p.text, p.i) FROM _tokens p WHERE p.doc_id = t.doc_id AND p.ent = 'PERSON' AND p.i <= e.z) AS resolved FROM _tokens t JOIN e ON e.doc_id = t.doc_id AND e.sent = t.sent
      WHERE (t.pos = 'PRON' AND lower(t.text) IN {quoted(D.PERSONAL_PRONOUNS)}) OR (lower(t.text) IN ('this', 'these', 'those') AND t.dep IN ('nsubj', 'dobj', 'pobj')))
    SELECT * FROM r WHERE resolved IS NOT NULL""")
def coref_simple(spark, d):
    return P.coreferences(table(spark, d, "tokens"))


_KINDS = " ".join(f"WHEN base IN {quoted(words.split())} THEN '{kind}'" for kind, words in D.NOUN_TYPES.items())
_MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ENTITY_TYPES.items())


@query("np_type_infer", f"""
    WITH n AS (SELECT doc_id, i, text, lemma, pos, ent FROM _tokens WHERE pos IN ('NOUN', 'PROPN', 'ADJ', 'NUM')
        UNION ALL SELECT p_partkey, -1, p_name, NULL, NULL, NULL FROM part UNION ALL SELECT p_partkey, -2, concat(p_size, ' years old ', p_type), NULL, NULL, NULL FROM part),
    b AS (SELECT *, coalesce(lower(lemma), regexp_replace(lower(regexp_split_to_array(trim(text), '\\s+')[-1]), 's+$', '')) AS base FROM n)
    SELECT doc_id, i, text, coalesce(CASE WHEN ent IS NOT NULL THEN CASE upper(ent) {_MAPPED} ELSE ent END {_KINDS} WHEN regexp_matches(lower(text), 'years? old') OR pos = 'ADJ' THEN 'ATTRIBUTE' END, 'none') AS kind FROM b""")
def np_type_infer(spark, d):
    from engrammatic.tables import read

    t = table(spark, d, "tokens").where("pos IN ('NOUN', 'PROPN', 'ADJ', 'NUM')").select("doc_id", "i", "text", "lemma", "pos", "ent")
    none = [F.lit(None).cast("string").alias(c) for c in ("lemma", "pos", "ent")]
    p = read(spark, d, "part")
    n = t.unionAll(p.select("p_partkey", F.lit(-1), "p_name", *none)).unionAll(p.select("p_partkey", F.lit(-2), F.concat_ws(" ", "p_size", F.lit("years old"), "p_type"), *none))
    return n.select("doc_id", "i", "text", F.coalesce(P.noun_phrase_type(F.col("text"), F.col("ent"), F.col("lemma"), F.col("pos")), F.lit("none")).alias("kind"))
