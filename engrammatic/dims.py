"""Constants of the memory model: taxonomies, importances, thresholds, word lists and patterns.

Patterns are written so that Java's and RE2's regular expressions read them alike.
"""

from __future__ import annotations


def _weights(text: str) -> dict[str, float]:
    """'0.9 a b; 0.5 c' as {a: 0.9, b: 0.9, c: 0.5}."""
    return {k: float(p.split()[0]) for p in text.split(";") for k in p.split()[1:]}


CATEGORIES = {
    "family": "brother_of daughter_of parent_of sibling_of sister_of son_of spouse_of".split(),
    "professional": "collaborates_with colleague_of employed_by manages reports_to works_at".split(),
    "personal": "avoids dislikes enjoys interested_in likes prefers".split(),
    "temporal": "clarifies contradicts evolves_to refines supersedes supports".split(),
    "factual": "has_property located_at member_of owns part_of".split(),
}
CATEGORY_OF = {r: c for c, rs in CATEGORIES.items() for r in [c, *rs]}
HIGH_IMPACT = "brother_of employed_by located_at owns parent_of sister_of spouse_of works_at".split()
SYMMETRIC = "brother_of collaborates_with colleague_of friend_of sibling_of sister_of spouse_of".split()
IMPORTANCE = _weights(
    "0.98 spouse_of; 0.95 brother_of child_of parent_of partner_of sibling_of sister_of; 0.9 family_of; 0.85 allergic_to ceo_of contradicts founded relative_of;"
    "0.8 born_in replaces supersedes works_at; 0.75 employed_by evolves_to graduated_from loves manages updates; 0.7 friend_of hates lives_in reports_to studied_at works_with;"
    "0.65 avoids colleague_of dated prefers; 0.6 dislikes enjoys from likes owns; 0.55 located_at; 0.5 has; 0.45 uses; 0.4 knows visited; 0.35 asked_about met; 0.3 mentioned"
)
IMPORTANCE_WORDS = (
    (0.90, "brother child family parent sister spouse"),
    (0.75, "colleague employ manage report work"),
    (0.65, "avoid enjoy hate like love prefer"),
    (0.80, "contradict evolve replace supersede update"),
)
LABEL_IMPORTANCE = _weights("1 family identity; 0.95 high_value; 0.9 preference; 0.85 goal relationship; 0.7 education fact work; 0.6 event; 0.5 opinion unknown")

#: Tier from a score: (least score, tier) in order, and the tier below.
TIER_POLICIES = {
    "ego": (((0.75, 1), (0.45, 2), (0.20, 3)), 4),
    "ml": (((0.8, 1), (0.6, 2), (0.3, 3)), 4),
    "docs": (((0.8, 1), (0.6, 2), (0.4, 3)), 4),
    "training": (((0.75, 1), (0.50, 2), (0.20, 3)), 4),
    "worker": (((0.75, 1), (0.45, 2), (0.25, 3)), None),
}
HALF_LIFE_DAYS = {1: 180.0, 2: 7.0, 3: 1.0, 4: 300.0 / 86_400}
EGO_WEIGHTS = {"explicit": 0.20, "recency": 0.20, "frequency": 0.10, "sentiment": 0.08, "engagement": 0.12, "references": 0.10, "confidence": 0.10, "source": 0.05, "novelty": 0.05}
ACTIVATION_WEIGHTS = {
    "ego": 0.15, "evidence": 0.15, "recency": 0.10, "rate": 0.10, "diversity": 0.08, "sentiment": 0.05, "importance": 0.12,
    "contradiction": -0.10, "proximity": 0.10, "promoted": 0.05, "demoted": -0.05, "novelty": 0.05,
}
SPACING_HOURS = ((24, 6), (72, 12), (168, 24), (720, 48))

POSITIVE = "adore amazing appreciate awesome best bliss brilliant delighted enjoy excellent excited fantastic favorite favourite glad good grateful great happy hopeful joy like love optimistic perfect pleased positive satisfied thrilled wonderful".split()
NEGATIVE = "afraid angry annoying anxious awful bad concerned despise detest disappointed disgusting dislike dread frustrating grief hate horrible misery negative pessimistic poor regret sad scared stressed terrible unfortunate upset worried worst".split()
INTENSIFIERS = "deeply extremely highly incredibly really super very".split()
DIMINISHERS = "barely hardly slightly somewhat".split()
NEGATIONS = "never no not".split()
HEDGES = ("could", "guess", "i believe", "i think", "likely", "may", "maybe", "might", "not sure", "perhaps", "possibly", "probably", "uncertain", "unclear", "unsure")
DEFINITE = ("absolutely", "certainly", "clearly", "definitely", "exactly", "for sure", "indeed", "obviously", "undoubtedly", "without doubt")

#: One pattern for each trigger, in the order in which triggers are given.
TRIGGERS = {
    "identity": r"(?i)\b(?:(?:they )?call me|i (?:am|go by|identify as)|i'm|my name is|people know me as)\b",
    "family": r"(?i)\bmy (?:(?:aunt|brother|child|cousin|dad|daddy|daughter|father|grandfather|grandma|grandmother|grandpa|husband|kid|ma|mom|mommy|mother|mum|nephew|niece|pa|papa|partner|sibling|sister|son|spouse|uncle|wife)(?:s|'s)?|famil(?:ies|y)|parents)\b",
    "preference": r"(?i)\b(?:i (?:adore|appreciate|can't stand|despise|detest|dislike|enjoy|hate|like|love|prefer)|i'm (?:fascinated by|interested in|not (?:a fan of|interested in|into)|passionate about)|my (?:favou?rite|hobbies|hobby|interest|passion))\b",
    "fact": r"(?i)\b(?:i (?:(?:live|reside|study|work) (?:at|for|in|near)|(?:graduated|studied) (?:at|from))|i'm (?:employed|studying|working) (?:at|for|in)|my (?:apartment|career|college|company|home|house|job|occupation|position|profession|role|school|university|work))\b",
    "high_value": r"(?i)(?:(?:assets|budget|handling|managing|overseeing|portfolio|responsible for|revenue).*(?:billion|million|\$\d+[bm])|\d+\s*(?:billion|million).*(?:asset|dollar|portfolio)|ceo|cfo|cto|director|vice president|vp|(?:head of|lead|leading).*(?:company|department|division|team))",
    "goal": r"(?i)\b(?:i (?:aim|hope|intend|plan|want) to|i'm (?:aiming|hoping|planning) to|in the future,? i|my (?:ambition|aspiration|dream|goal))\b",
    "relationship": r"(?i)\bmy (?:(?:boyfriend|buddy|colleague|coworker|friend|girlfriend|mate|pal|partner|teammate)(?:s|'s)?|best friend|bff)\b",
    "event": r"(?i)\b(?:happened|i (?:attended|experienced|visited|went)|last (?:month|week|year)|occurred|today|tomorrow|took place|when i (?:visited|was|went)|yesterday)\b",
    "opinion": r"(?i)\b(?:i (?:believe|feel|reckon|suppose|think)|i'm (?:certain|convinced|sure) that|in my (?:opinion|perspective|view)|it seems to me)\b",
}
INTENTS = {
    "opinion": r"(?i)\b(?:(?:i|we)\s+(?:assume|believe|feel|guess|suppose|think)|(?:i|we)\s+.*?\s+(?:dis)?agree|(?:dis)?agree\s+with|in\s+my\s+(?:mind|opinion|view))\b",
    "evaluation": r"(?i)\b(?:(?:are|is|was|were)\s+(?:amazing|awful|bad|excellent|fantastic|good|great|horrible|poor|terrible|wonderful)\b|(?:adore|despise|hate|love)\s+|(?:extremely|really|so|very)\s+(?:bad|cool|fun|good|nice)\b)",
    "speech_act": r"(?i)(?:\b(?:bye|goodbye|hello|hey|hi|thank you|thanks)\b|,\s*[a-z]{2,}\s*[.!?]?$)",
    "directive": r"(?i)(?:\b(?:i|we)\s+(?:need|want|wish|would like)\s+to\b|\b(?:ask|help|remind|tell)\s+\w+\s+to\b|^(?:kindly|please)\s+)",
}
#: Kind: (pattern, what a match is replaced by; $1 is written \1 for RE2).
PII = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    "phone": (r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[PHONE]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT_CARD]"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    "api_key": (r"(?i)\b(?:api[_-]?key|secret|token)[:\s]*['\"]?([A-Za-z0-9_\-]{20,})['\"]?", "[API_KEY]"),
    "password": (r"(?i)\b(?:passwd|password|pwd)[:\s]*['\"]?([^\s'\"]{6,})['\"]?", "[PASSWORD]"),
}
LABEL_THRESHOLDS = _weights("0.85 high_value identity; 0.8 expert_opinion medical_condition treatment_implications; 0.75 personal_health; 0.65 event; 0.6 fact family relationship; 0.55 opinion preference")
#: Label: (excluded if this matches, excluded unless this matches, least length).
LABEL_RULES = {
    "identity": (r"(?i)\b(?:animal|bird|car|cat|city|country|dog|fish|house|pet)\b", r"(?i)\b(?:call me|i am|i identify|known as|my name)\b", 0),
    "expert_opinion": (r"(?i)\b(?:i (?:feel|hate|have|like|love|think)|my (?:cat|dog|pet))\b", None, 40),
    "high_value": (r"(?i)\b(?:cat|dog|enjoy|like|love|pet)\b", r"(?i)\b(?:account|bank|credit card|income|password|salary|ssn)\b", 0),
    "medical_condition": (r"(?i)\b(?:health\s+(?:check|status|system)|memory\s+(?:database|manager|project|store|system))\b", None, 0),
    "treatment_implications": (r"(?i)\b(?:approach|method|plan|project|strategy)\b", None, 0),
    "event": (r"(?i)\b(?:i (?:am|have|own))\b", None, 15),
}
#: (substrings, relation, category, confidence) in order of precedence.
HEURISTIC_RELATIONS = (
    ("sister|sis", "sister_of", "family", 0.6),
    ("brother|bro", "brother_of", "family", 0.6),
    ("parent|father|mother|dad|mom", "parent_of", "family", 0.6),
    ("husband|wife|spouse|married", "spouse_of", "family", 0.6),
    ("son|daughter|child", "child_of", "family", 0.6),
    ("works at|work at", "works_at", "professional", 0.7),
    ("colleague|coworker", "colleague_of", "professional", 0.6),
    ("friend", "friend_of", "personal", 0.6),
    ("like|love", "likes", "personal", 0.5),
    ("hate|dislike", "dislikes", "personal", 0.5),
    ("live|from", "lives_in", "factual", 0.5),
)
COMMANDS = {  # name: (action, category, weight, forced tier)
    "remember": ("boost_importance", "memory_control", 0.8, None), "forget": ("delete", "memory_control", 0.0, None), "remember-all": ("bulk_store", "memory_control", 0.7, None),
    "tier2": ("force_tier", "tier_control", 0.8, 2), "tier3": ("force_tier", "tier_control", 0.5, 3), "tier4": ("force_tier", "tier_control", 0.3, 4),
    "private": ("mark_sensitive", "privacy", 0.85, None), "sensitive": ("mark_sensitive", "privacy", 0.85, None),
    "correct": ("trigger_correction", "corrections", 0.75, None), "evolve": ("create_supersedes_edge", "corrections", 0.8, None), "update": ("update_memory", "corrections", 0.7, None),
    "link": ("create_edge", "graph", 0.6, None), "unlink": ("delete_edge", "graph", 0.0, None),
    "search": ("search", "retrieval", 0.0, None), "context": ("show_context", "retrieval", 0.0, None), "recall": ("recall", "retrieval", 0.0, None),
}
COMMAND_ALIASES = dict(p.split("=") for p in "r=remember f=forget ra=remember-all t2=tier2 t3=tier3 t4=tier4 p=private s=search c=context l=link u=unlink tier1=remember core=remember identity=remember t1=remember".split())
COMMAND_PATTERNS = (
    (r"my (?:brother|dad|father|husband|mom|mother|partner|sister|wife)", "my [FAMILY_RELATION]"),
    (r"i (?:enjoy|hate|like|love|prefer)", "i [PREFERENCE_VERB]"),
    (r"my name is", "my name is [NAME]"),
    (r"i am \d+", "i am [AGE]"),
    (r"i work at", "i work at [ORG]"),
    (r"i live in", "i live in [LOCATION]"),
)
PREDICATES = {k: p.split(":")[0].strip() for p in (
    "employed_by: works_at work_at work_for works_for employed_by employee_of; resides_in: lives_in live_in resides_in; located_in: located_in based_in;"
    "enrolled_at: studies_at study_at attends attend enrolled_at student_at; studies_subject: studies study learns learn;"
    "likes: likes like loves love enjoys enjoy; dislikes: dislikes dislike hates hate; visited: visit visits visited; interested_in: interested_in"
).split(";") for k in p.split(":")[1].split()}
TYPE_PREFERENCES = {
    "PERSON|ORG": "employed_by member_of founded leads", "PERSON|GPE": "resides_in born_in citizen_of", "PERSON|LOC": "resides_in visited located_in",
    "PERSON|PERSON": "sibling_of parent_of child_of spouse_of knows met", "ORG|GPE": "located_in based_in headquartered_in", "ORG|ORG": "part_of subsidiary_of partner_of",
}
ORG_WORDS, PLACE_WORDS = "company corp foundation inc llc ltd org university".split(), "avenue city country county road state street".split()

#: What a modal verb leaves of a triple's confidence, and what each dependency pattern starts with, in order of rank.
MODALITY = {"can": 0.8, "could": 0.5, "may": 0.5, "might": 0.4, "must": 0.85, "shall": 0.85, "should": 0.7, "will": 0.9, "would": 0.5}
PATTERN_CONFIDENCE = {"nsubj_verb_dobj": 0.92, "nsubj_verb_prep_pobj": 0.88, "copula_attr": 0.9, "apposition": 0.97, "passive_voice": 0.85, "coordination": 0.92, "nested_clause": 0.88, "relative_clause": 0.85}
POSSESSIVES = ("her", "his", "my", "our", "their", "your")
PERSONAL_PRONOUNS = ("he", "her", "hers", "him", "his", "she", "their", "them", "they")
ENTITY_TYPES = {"DATE": "temporal", "EVENT": "event", "FAC": "FACILITY", "GPE": "location", "LOC": "location", "MONEY": "attribute", "ORG": "organization", "PERCENT": "attribute", "PERSON": "person", "PRODUCT": "product", "QUANTITY": "attribute", "TIME": "temporal"}
NOUN_TYPES = {
    "ROLE": "architect artist author bartender ceo cfo chef consultant cook creator cto designer developer director doctor employee engineer instructor manager member musician nurse owner president professor server staff teacher volunteer waiter worker writer",
    "ORG_LIKE": "academy agency bakery bank bar business cafe clinic college company corporation department diner division factory firm group hospital institute lab laboratory library office pharmacy pub restaurant school shop store team university warehouse",
    "FACILITY": "aquarium building center cinema complex gallery garage garden hangar mall museum park plaza resort stadium studio terminal theater workshop zoo",
    "ARTWORK": "artwork creation drawing installation landscape masterpiece mural painting photograph piece portrait print sculpture sketch work",
    "MATERIAL": "acrylic bronze canvas clay fabric glass leather marble metal oil paper plastic silk steel stone watercolor wood",
}
#: Parsed sentences: text/lemma/POS/label/head, the head counting from 0 and '_' an entity label or none.
PARSED = (
    ["Sarah/Sarah/PROPN/nsubj/1/PERSON studies/study/VERB/ROOT/1/_ physics/physics/NOUN/dobj/1/_"],
    ["John/John/PROPN/nsubj/3/PERSON does/do/AUX/aux/3/_ not/not/PART/neg/3/_ study/study/VERB/ROOT/3/_ physics/physics/NOUN/dobj/3/_"],
    ["Sarah/Sarah/PROPN/nsubj/2/PERSON might/might/AUX/aux/2/_ study/study/VERB/ROOT/2/_ quantum/quantum/ADJ/amod/4/_ physics/physics/NOUN/dobj/2/_"],
    ["Sarah/Sarah/PROPN/nsubj/1/PERSON lives/live/VERB/ROOT/1/_ in/in/ADP/prep/1/_ New/New/PROPN/compound/4/_ York/York/PROPN/pobj/2/GPE"],
    ["Mark/Mark/PROPN/nsubj/5/PERSON ,/,/PUNCT/punct/0/_ our/our/PRON/poss/3/_ CEO/ceo/NOUN/appos/0/_ ,/,/PUNCT/punct/0/_ spoke/speak/VERB/ROOT/5/_"],
    ["Physics/physics/NOUN/nsubjpass/2/_ is/be/AUX/auxpass/2/_ studied/study/VERB/ROOT/2/_ by/by/ADP/agent/2/_ Sarah/Sarah/PROPN/pobj/3/PERSON"],
    ["Sarah/Sarah/PROPN/nsubj/3/PERSON and/and/CCONJ/cc/0/_ John/John/PROPN/conj/0/PERSON study/study/VERB/ROOT/3/_ physics/physics/NOUN/dobj/3/_ and/and/CCONJ/cc/4/_ chemistry/chemistry/NOUN/conj/4/_"],
    ["I/I/PRON/nsubj/1/_ know/know/VERB/ROOT/1/_ that/that/SCONJ/mark/4/_ Sarah/Sarah/PROPN/nsubj/4/PERSON studies/study/VERB/ccomp/1/_ physics/physics/NOUN/dobj/4/_"],
    ["The/the/DET/det/1/_ company/company/NOUN/nsubj/5/_ where/where/SCONJ/advmod/4/_ Sarah/Sarah/PROPN/nsubj/4/PERSON works/work/VERB/relcl/1/_ is/be/AUX/ROOT/5/_ Google/Google/PROPN/attr/5/ORG"],
    ["Sarah/Sarah/PROPN/nsubj/1/PERSON is/be/AUX/ROOT/1/_ my/my/PRON/poss/3/_ sister/sister/NOUN/attr/1/_"],
    ["Does/do/AUX/aux/2/_ Sarah/Sarah/PROPN/nsubj/2/PERSON study/study/VERB/ROOT/2/_ physics/physics/NOUN/dobj/2/_ ?/?/PUNCT/punct/2/_"],
    ["Sarah/Sarah/PROPN/nsubj/1/PERSON met/meet/VERB/ROOT/1/_ two/two/NUM/nummod/3/_ engineers/engineer/NOUN/dobj/1/_", "She/she/PRON/nsubj/5/_ likes/like/VERB/ROOT/5/_ them/they/PRON/dobj/5/_", "Ben/Ben/PROPN/nsubj/8/PERSON thinks/think/VERB/ROOT/8/_ this/this/PRON/nsubj/10/_ helps/help/VERB/ccomp/8/_ him/he/PRON/dobj/10/_"],
)

#: Things people say, for text rules (no quotation marks, so that they can stand in SQL).
SAYINGS = (
    "/remember /private I want to visit place 7", "/tier1 /p keep this one", "/unknown hello there", "  /Remember   buy milk today", "/remember/private no space", "/t2 /t3 two tiers", "/search /unknown /private rest", "/", "/remember",
    "Yesterday we met and tomorrow I fly", "See you next week or next month, not today", "Last week was better than LAST MONTH", "todayish is no word, yesterday is", "My dog likes me and I like my dog",
    "I think I understand what I need", "That book is mine and I study every day", "Nothing personal here", "Do you agree with me and I agree", "I work, I live, I play: I know myself",
)
