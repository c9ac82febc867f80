"""Chat formatting by schema fingerprints.

A record is JSON of some layout: prompt and response, instruction with or without input, a list of messages under one
of several names. The paths of all its nested fields, sorted and hashed, are its fingerprint; each fingerprint belongs
to at most one declarative mapping, and the mapping says which paths hold turns, roles and texts. Everything is
Spark's own JSON and array functions; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What roles are called, and what they become.
ROLES = {"user": "user", "human": "user", "prompter": "user", "customer": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "system": "system", "tool": "tool", "function": "tool"}


@dataclass(frozen=True)
class Mapping:
    """One layout. turns: either (role, path) pairs, joined in order, or the path, role and text keys of a list."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None

    def fingerprints(self) -> list[str]:
        """Those of the required paths with every choice of the optional ones."""
        return [fingerprint_of(self.required + c) for n in range(len(self.optional) + 1) for c in itertools.combinations(self.optional, n)]


def fingerprint_of(paths) -> str:
    """The hash of a set of field paths, '[]' standing for the elements of a list."""
    return hashlib.md5("|".join(sorted(set(paths))).encode()).hexdigest()


MAPPINGS = (
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), ("id", "source"), items=("messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("id", "source", "system"), fields=(("system", ("system",)),), items=("conversations", "from", "value")),
    Mapping("dialog", ("dialog", "dialog[].speaker", "dialog[].text"), ("id", "source"), items=("dialog", "speaker", "text")),
    Mapping("prompt_response", ("prompt", "response"), ("id", "source", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("id", "source", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), ("id", "source", "input", "system"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", ("question", "answer"), ("id", "source", "context"), fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("turn", ("role", "text"), ("id", "source"), items=("$", "role", "text")),
)

_TURN = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The sorted field paths of a JSON object, three levels deep into objects and lists of objects.

    'a.b' is field b of object a, 'a[].b' of the objects in list a. Null for what is no JSON object.
    """

    def below(prefix: Column, value: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
        of_list = F.coalesce(F.flatten(F.transform(F.from_json(value, "array<string>"), lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>")))), F.array().cast("array<string>"))
        is_list = F.ltrim(value).startswith("[")
        return F.when(is_list, F.transform(F.array_distinct(of_list), lambda k: F.concat(prefix, F.lit("[]."), k))).otherwise(F.transform(keys, lambda k: F.concat(prefix, F.lit("."), k)))

    top = F.json_object_keys(record)
    values = F.from_json(record, "map<string,string>")
    nested = F.flatten(F.transform(top, lambda k: below(k, F.coalesce(F.element_at(values, k), F.lit("")))))
    return F.array_sort(F.array_distinct(F.concat(top, nested)))


def _field(record: Column, paths: tuple[str, ...]) -> Column:
    """The values of the fields that are there and not blank, one below the other."""
    values = F.array(*(F.get_json_object(record, f"$.{p}") for p in paths))
    return F.concat_ws("\n", F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")))


def _turns(record: Column, m: Mapping) -> Column:
    parts = [F.array(F.struct(F.lit(role).alias("role"), _field(record, paths).alias("text"))) for role, paths in m.fields]
    if m.items:
        path, role, text = m.items
        elements = F.array(record) if path == "$" else F.from_json(F.get_json_object(record, f"$.{path}"), "array<string>")
        parts.append(F.transform(F.coalesce(elements, F.array().cast("array<string>")), lambda e: F.struct(F.get_json_object(e, f"$.{role}").alias("role"), F.get_json_object(e, f"$.{text}").alias("text"))))
    return F.concat(*parts).cast(_TURN)


def canonical_turns(records: DataFrame, record: str = "record", key: str = "record_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row for each turn: (record_id, layout, fingerprint, turn, role, text).

    Roles become user, assistant, system or tool; a role that isn't known stays in lower case. Turns without text are
    left out and the others counted from 0. A record whose fingerprint no mapping has, or without a turn, gives one
    row with turn, role and text null and layout null if none was found; so does a record that is null or no JSON
    object (its fingerprint is null too). Fields of a layout may stand in any order; a null field counts as there.
    Repeated records give repeated rows, a null key stays null, an empty table gives no rows. Other columns of
    ``records`` may have any name and are not returned.
    """
    r = records.select(F.col(key).alias("record_id"), F.col(record).cast("string").alias("r"))
    r = r.withColumn("paths", field_paths(F.col("r")))
    r = r.withColumn("fingerprint", F.md5(F.array_join("paths", "|")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURN)
    for m in reversed(mappings):
        mine = F.col("fingerprint").isin(m.fingerprints())
        layout = F.when(mine, F.lit(m.name)).otherwise(layout)
        turns = F.when(mine, _turns(F.col("r"), m)).otherwise(turns)
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    r = r.select("record_id", layout.alias("layout"), "fingerprint", turns.alias("turns"))
    kept = F.filter("turns", lambda t: t["text"].isNotNull() & (F.trim(t["text"]) != ""))
    kept = F.transform(kept, lambda t: F.struct(F.coalesce(F.try_element_at(names, F.lower(F.trim(t["role"]))), F.lower(F.trim(t["role"]))).alias("role"), t["text"].alias("text")))
    return r.select("record_id", "layout", "fingerprint", F.posexplode_outer(kept).alias("turn", "t")).select("record_id", "layout", "fingerprint", "turn", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def as_records(conversations: DataFrame) -> DataFrame:
    """Conversations as JSON records (record_id, record) in the layouts that corpora come in.

    conversations needs conv_id, turn, role and text. The layout follows from the conversation: a system turn first or
    not, one exchange or several, and its id. Turns are ordered by (turn, role, text); rows with a null conv_id, role
    or text are left out, repeated rows are kept.
    """
    c = conversations.where("conv_id is not null and role is not null and text is not null")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    text = lambda i: F.try_element_at(F.col("t"), F.lit(i))["text"]
    who = F.abs(F.col("conv_id")) % 3
    lists = lambda role, body: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(body)))
    gpt = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    pair, with_system = roles == "user,assistant", roles == "system,user,assistant"
    layouts = (
        F.when(pair & (who == 0), F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response"))))
        .when(pair & (who == 1), F.to_json(F.struct(text(1).alias("instruction"), F.lit("").alias("input"), text(2).alias("output"))))
        .when(pair, F.to_json(F.struct(text(1).alias("question"), text(2).alias("answer"))))
        .when(with_system & (who == 0), F.to_json(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("completion"))))
        .when(who == 0, F.to_json(F.struct(lists("role", "content").alias("messages"))))
        .when(who == 1, F.to_json(F.struct(gpt.alias("conversations"))))
        .otherwise(F.to_json(F.struct(lists("speaker", "text").alias("dialog"))))
    )
    return g.select(F.col("conv_id").alias("record_id"), layouts.alias("record"))
