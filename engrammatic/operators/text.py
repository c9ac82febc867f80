"""Text rules as Column expressions. A null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engrammatic import dims as D
from engrammatic.operators.relations import text_map

WORD = r"[\p{L}\p{N}_]+"


def _one_of(words) -> Column:
    return F.array(*map(F.lit, words))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    return all_matches(F.lower(F.coalesce(text, F.lit(""))), WORD)


def sentiment(text: Column) -> Column:
    """Signed sum over tokens divided by their number: a word before may negate, strengthen or weaken. 0 without tokens."""
    t = tokens(text)
    base = lambda w: F.when(w.isin(*D.POSITIVE), 1.0).when(w.isin(*D.NEGATIVE), -1.0).otherwise(0.0)
    factor = lambda p: F.when(p.isin(*D.NEGATIONS), -1.0).when(p.isin(*D.INTENSIFIERS), 1.5).when(p.isin(*D.DIMINISHERS), 0.5).otherwise(1.0)
    pairs = F.arrays_zip(t.alias("w"), F.concat(F.array(F.lit("")), t).alias("p"))
    scores = F.transform(F.slice(pairs, 1, F.greatest(F.size(t), F.lit(1))), lambda x: F.coalesce(base(x["w"]) * factor(x["p"]), F.lit(0.0)))
    return F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(t), F.lit(1))


def triggers(text: Column) -> Column:
    """The names of the triggers that the text has, in their order."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p in D.TRIGGERS.items())), lambda x: x.isNotNull())


def pii_kinds(text: Column) -> Column:
    """For each kind of personal data how often it occurs, as a map."""
    t = F.coalesce(text, F.lit(""))
    return F.create_map(*(x for k, (p, _) in D.PII.items() for x in (F.lit(k), F.size(all_matches(t, p)).cast("long"))))


def pii_masked(text: Column) -> Column:
    """The text with personal data replaced, kind by kind. Secrets go with their name."""
    for p, to in D.PII.values():
        text = F.regexp_replace(text, p, to)
    return text


def intent(text: Column) -> Column:
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("fact")
    for name, p in reversed(D.INTENTS.items()):
        out = F.when(t.rlike(p), name).otherwise(out)
    return out


def heuristic_relation(context: Column) -> Column:
    """struct(relation, category, confidence) by the first rule that has a substring in the context."""
    low = F.lower(F.coalesce(context, F.lit("")))
    s = lambda r, c, x: F.struct(F.lit(r).alias("relation"), F.lit(c).alias("category"), F.lit(x).alias("confidence"))
    out = s("knows", "personal", 0.3)
    for words, r, c, x in reversed(D.HEURISTIC_RELATIONS):
        out = F.when(low.rlike(words), s(r, c, x)).otherwise(out)
    return out


def label_kept(label: Column, score: Column, text: Column) -> Column:
    """Whether a label survives its threshold and rules."""
    keep = score >= F.coalesce(F.try_element_at(text_map(D.LABEL_THRESHOLDS), label), F.lit(0.5))
    for name, (no, yes, least) in D.LABEL_RULES.items():
        bad = text.rlike(no) | (F.length(text) < least)
        bad = bad | ~text.rlike(yes) if yes else bad
        keep = keep & ~((label == name) & bad)
    return keep


def sentences(text: Column) -> Column:
    """Sentences of three words or more; the whole text where there is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(t, r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


QUESTION_WORDS = "what|how|why|when|where|tell me|can you|could you|would you"


def memory_sentences(text: Column) -> Column:
    """Without questions; all sentences if only questions are there."""
    s = sentences(text)
    kept = F.filter(s, lambda x: ~F.rtrim(x).endswith("?") & ~F.lower(F.substring(x, 1, 20)).rlike(QUESTION_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(s)


SPEAKER = r"(?m)^(\w+):\s*(.+)$"


def dialogue_format(text: Column) -> Column:
    """locomo, raw_dialogue or narrative."""
    said = text.rlike(r"(?i)\bDATE:") | text.rlike(r'\w+ said, ?"')
    return F.when(said, "locomo").when((F.size(all_matches(text, r"(?m)^\w+:\s+\S")) >= 2) | (F.size(all_matches(text, r"\b[A-Z][a-z]+:\s+")) >= 2), "raw_dialogue").otherwise("narrative")


def dialogue_turns(text: Column) -> Column:
    """array<struct<speaker, said>> of the lines 'Speaker: words'."""
    return F.transform(F.arrays_zip(all_matches(text, SPEAKER, 1).alias("speaker"), all_matches(text, SPEAKER, 2).alias("said")), lambda x: F.struct(x["speaker"].alias("speaker"), F.trim(x["said"]).alias("said")))


_THIRD = ((r"\bI'm\b", " is"), (r"\bI've\b", " has"), (r"\bI'll\b", " will"), (r"\bI'd\b", " would"), (r"\b(?:I|me|myself)\b", ""), (r"\b(?:my|mine)\b", "'s"))
_VERBS = "agree|believe|enjoy|feel|know|like|live|love|need|play|think|understand|want|work"


def third_person(text: Column, speaker: Column) -> Column:
    """First person becomes the speaker's name, with verbs after it in the third person."""
    for p, ending in _THIRD:
        text = F.regexp_replace(text, F.lit(p), F.concat(speaker, F.lit(ending)))
    text = F.regexp_replace(text, F.concat(F.lit(r"\b("), speaker, F.lit(rf")\s+({_VERBS})\b")), F.lit("$1 $2s"))
    return F.regexp_replace(text, F.concat(F.lit(r"\b("), speaker, F.lit(r")\s+study\b")), F.lit("$1 studies"))


def date_parsed(text: Column) -> Column:
    """A date in one of four layouts, or null."""
    first = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"))
    return F.coalesce(first, F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "d MMMM yyyy"))


TEMPORAL = {"yesterday": -1, "today": 0, "tomorrow": 1, "last week": -7, "next week": 7, "last month": -30, "next month": 30}


def temporal_resolved(text: Column, day: Column) -> Column:
    """Relative days with the date in brackets after them."""
    for word, n in TEMPORAL.items():
        text = F.regexp_replace(text, F.lit(rf"(?i)\b{word}\b"), F.concat(F.lit(f"{word} ("), F.date_format(F.date_add(day, n), "MMMM dd, yyyy"), F.lit(")")))
    return text


def commands(text: Column) -> Column:
    """struct(names, weight, tier, target) of the commands a message starts with; reading stops at an unknown one.

    weight is the greatest (0.5 without commands), tier the first that is forced.
    """
    known = sorted({*D.COMMANDS, *D.COMMAND_ALIASES}, key=len, reverse=True)
    run = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)^\s*((?:/(?:{'|'.join(known)})(?:\s+|$))*)", 1)
    names = F.transform(all_matches(F.lower(run), r"/(\S+)", 1), lambda c: F.coalesce(F.try_element_at(text_map(D.COMMAND_ALIASES), c), c))
    weights, tiers = text_map({k: v[2] for k, v in D.COMMANDS.items()}), text_map({k: v[3] for k, v in D.COMMANDS.items() if v[3]})
    weight = F.coalesce(F.array_max(F.transform(names, lambda c: F.try_element_at(weights, c))), F.lit(0.5))
    forced = F.filter(F.transform(names, lambda c: F.try_element_at(tiers, c)), lambda t: t.isNotNull())
    return F.struct(names.alias("names"), weight.alias("weight"), F.try_element_at(forced, F.lit(1)).alias("tier"), F.trim(F.substr(F.ltrim(F.coalesce(text, F.lit(""))), F.length(F.ltrim(run)) + 1)).alias("target"))


def command_pattern(text: Column) -> Column:
    """A general form of the text; its first three words where there is none; null under five characters."""
    low = F.lower(F.trim(text))
    out = F.array_join(F.slice(F.split(low, r"\s+"), 1, 3), " ")
    for p, form in reversed(D.COMMAND_PATTERNS):
        out = F.when(low.rlike(p), form).otherwise(out)
    return F.when(F.length(text) >= 5, out)


def entity_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("|".join(D.ORG_WORDS)), "organization").when(low.rlike("|".join(D.PLACE_WORDS)), "location").otherwise("person")


def predicate_normalised(predicate: Column, subject_type: Column, object_type: Column) -> Column:
    """struct(predicate, confidence, method): by the lexicon, by what the types prefer, or as it is."""
    p = F.lower(F.trim(predicate))
    mapped = F.try_element_at(text_map(D.PREDICATES), p)
    prefer = F.split(F.coalesce(F.try_element_at(text_map(D.TYPE_PREFERENCES), F.concat_ws("|", subject_type, object_type)), F.lit("")), " ")
    typed = F.try_element_at(F.filter(prefer, lambda x: (x != "") & (x.contains(p) | p.contains(x))), F.lit(1))
    s = lambda a, b, c: F.struct(a.alias("predicate"), F.lit(b).alias("confidence"), F.lit(c).alias("method"))
    return F.when(mapped.isNotNull(), s(mapped, 0.95, "lexicon")).when(typed.isNotNull(), s(typed, 0.85, "types")).otherwise(s(p, 0.70, "original"))


def relation_multiplier(predicate: Column, subject_type: Column, object_text: Column, object_type: Column) -> Column:
    """What a relation's confidence is multiplied by: 1, or less where types or the object make no sense."""
    persons, roles = ("person", "PERSON"), ("ROLE", "role", "person")
    subject_bad = predicate.isin("holds_title", "employed_by", "has_age") & ~subject_type.isin(*persons)
    allowed = {"holds_title": roles, "employed_by": ("organization", "ORG", "ORG_LIKE", "FACILITY"), "located_in": ("location", "LOC", "GPE", "FACILITY"), "is_a": ("ROLE", "CATEGORY", "ATTRIBUTE", "person", "temporal"), "has_age": ("temporal", "DATE", "value")}
    object_bad = F.lit(False)
    for p, types in allowed.items():
        object_bad = object_bad | ((predicate == p) & ~object_type.isin(*types))
    return F.when(F.coalesce(subject_bad, F.lit(False)) | F.coalesce(object_bad, F.lit(False)), 0.3).when(F.trim(object_text).rlike(r"^(?:\d+%?$|[<>]=?\d+)"), 0.1).otherwise(1.0)


def preposition_predicate(preposition: Column, object_type: Column, base: Column) -> Column:
    org, place, time, who = (object_type.isin(*x) for x in (("organization", "ORG", "ORG_LIKE", "FACILITY"), ("location", "LOC", "GPE"), ("temporal", "DATE", "TIME"), ("person", "PERSON", "ROLE")))
    return (
        F.when((preposition == "in") & place, "located_in").when((preposition == "at") & org, "works_at").when((preposition == "for") & org, "works_for").when(preposition == "with", "associated_with")
        .when((preposition == "on") & time, "occurred_on").when((preposition == "at") & time, "occurred_at").when((preposition == "in") & time, "occurred_in").when((preposition == "by") & who, "created_by").otherwise(base)
    )


def of_relation(subject_type: Column, object_type: Column, head: Column) -> Column:
    person, org, place = subject_type.isin("person", "PERSON"), object_type.isin("organization", "ORG"), object_type.isin("location", "LOC", "GPE")
    by_head = F.when(head.isin("manager", "head", "director", "leader"), "manages").when(head.isin("owner", "founder"), "owns").otherwise("works_at")
    return F.when(person & place, "located_in").when(person & org, by_head).when((subject_type == "ROLE") & org, "works_at").when(object_type == "MATERIAL", "made_of").otherwise("part_of")


def consolidated(items: Column, most: int = 20) -> Column:
    """Lower-cased, trimmed, longer than one letter, the first ``most``."""
    return F.slice(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 1), 1, most)


def truncated(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


#: Kind: (pattern with one group, relation, confidence).
OPINIONS = (
    (r"(?i)\bi (?:really )?(?:love|like|enjoy) (?:the )?(\w+)", "values", 0.90),
    (r"(?i)\bi (?:really )?(?:hate|dislike) (?:the )?(\w+)", "dislikes", 0.90),
    (r"(?i)\bi (?:think|believe) (?:that )?(\w+)", "believes", 0.85),
    (r"(?i)\b(?:thanks|thank you),? (\w+)", "thanks", 0.85),
    (r"(?i)\b(?:hello|hi|hey),? (\w+)", "greets", 0.80),
)


def opinions(text: Column) -> Column:
    """array<struct<relation, object, confidence>> of evaluations, opinions and speech acts."""

    def found(pattern: str, relation: str, confidence: float) -> Column:
        return F.transform(all_matches(F.coalesce(text, F.lit("")), pattern, 1), lambda o: F.struct(F.lit(relation).alias("relation"), F.lower(o).alias("object"), F.lit(confidence).alias("confidence")))

    return F.flatten(F.array(*(found(*o) for o in OPINIONS)))


def embedded(text: Column, bits: int = 8) -> Column:
    """A text as a sparse vector of 2 ** bits places, array<struct<place, value>> by place: its tokens are counted at the
    place that the beginning of their MD5 names, and the counts divided by their length. Empty without tokens."""
    place = lambda t: F.conv(F.substring(F.md5(t), 1, -(-bits // 4)), 16, 10).cast("int").bitwiseAND(2**bits - 1)
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is worked out once, else at each use

    def runs(p: Column) -> Column:
        """Of sorted places: where each one ends, and how many there are."""
        ends = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == F.size(p)) | (F.get(p, i) != F.get(p, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(p, i - 1).alias("place"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double").alias("n"))))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c["n"] * c["n"]))
        return let(norm, lambda n: F.transform(counts, lambda c: F.struct(c["place"].alias("place"), (c["n"] / n).alias("value"))))

    none = F.array().cast("array<struct<place:int,value:double>>")
    return let(F.array_sort(F.transform(tokens(text), place)), lambda p: F.when(F.size(p) == 0, none).otherwise(let(runs(p), scaled)))
