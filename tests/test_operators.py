"""Worked examples with numbers that follow from the formulas."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engrammatic.operators import dependencies, graph, relations, scoring, text
from engrammatic.sources import chat
from engrammatic.streaming import events
from engrammatic.tables import DAY, table


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("tier, age, want", [(1, 0, 1.0), (1, 180, 0.5), (1, 360, 0.25), (2, 7, 0.5), (9, 7, 0.5)])
def test_recency_halves_with_each_half_life(spark, tier, age, want):
    assert math.isclose(value(spark, scoring.recency_decay(F.lit(tier), F.lit(float(age)))), want)


def test_upsert_three_times(spark):
    rows = spark.createDataFrame([(1, " A ", "p", "o", i, 0.5, i) for i in range(3)] + [(1, None, "p", "o", 9, 0.5, 9), (1, " ", "p", "o", 9, 0.5, 9)], "user_id long, subject string, predicate string, object string, memory_id long, confidence double, observed_at long")
    r = relations.upsert_relations(rows).collect()
    assert len(r) == 1 and r[0].subject == "a" and r[0].mentions == 2 and math.isclose(r[0].confidence, 0.6) and r[0].memory_id == 2


def test_stale_relations_decay_or_end(spark):
    rows = spark.createDataFrame([(1, 0.37, 0, 0, None), (2, 0.40, None, 0, None), (3, 0.9, 2, 0, None), (4, 0.9, 0, 0, 5)], "relation_id long, confidence double, mentions long, last_mentioned long, effective_to long")
    out = {r.relation_id: r for r in relations.decay_stale(rows, 100 * DAY).collect()}
    assert (out[1].action, out[1].confidence, out[1].effective_to) == ("remove", 0.37, 100 * DAY)
    assert out[2].action == "decay" and math.isclose(out[2].confidence, 0.32) and out[3].action == out[4].action == "keep"


def test_commands(spark):
    c = value(spark, text.commands(F.lit("/remember /private My SSN is 123")))
    assert (c["names"], c["weight"], c["target"]) == (["remember", "private"], 0.85, "My SSN is 123")
    assert value(spark, text.commands(F.lit("/tier1 x")))["names"] == ["remember"]
    assert value(spark, text.commands(F.lit("/t3 /unknown x")))["tier"] == 3
    assert value(spark, text.commands(F.lit(None).cast("string")))["names"] == []


def test_turn_pairing(spark):
    roles = ["user", "assistant", "user", "user", "assistant", "assistant"]
    m = spark.createDataFrame([("s", i, i, r, f"{r[0]}{i}") for i, r in enumerate(roles)], "session_id string, turn long, message_id long, role string, text string")
    assert [(r.content, r.context) for r in chat.paired_turns(m).orderBy("turn").collect()] == [("u0", "a1"), ("u2", None), ("u3", "a4"), ("a5", None)]


def test_versions_keep_the_first_of_the_greatest(spark):
    e = spark.createDataFrame([(1, v, i) for i, v in enumerate((1, 3, 2, 3))], "node_id long, version long, arrival long")
    assert events.latest_versions(e).first().arrival == 1


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i % 5, (i * 7) % 4, i) for i in range(60)], "node_id long, version long, arrival long")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.run_upsert(s, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(events.read_upserted(spark, f"{tmp_path}/out").select(e.columns).collect()) == sorted(events.latest_versions(e).collect())
    assert all(len([g for g in b.iterdir() if g.name.startswith("g=")]) <= 2 for b in (tmp_path / "out").iterdir() if b.name.startswith("bucket="))


def test_unreadable_payloads_of_a_stream_go_to_the_dead_letters(spark, tmp_path):
    rows = [(i, json.dumps({"node_id": i % 7, "version": i % 5}) if i % 4 else "broken") for i in range(40)]
    spark.createDataFrame(rows, "arrival long, payload string").repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("arrival long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.run_upsert(s, f"{tmp_path}/out", f"{tmp_path}/check", dead=f"{tmp_path}/dead", schema="node_id long, version long").awaitTermination()
    assert sorted(r.arrival for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == list(range(0, 40, 4))
    best = {}
    for i, p in rows:
        if i % 4 and (i % 7 not in best or i % 5 > best[i % 7][0]):
            best[i % 7] = (i % 5, i)
    assert {r.node_id: (r.version, r.arrival) for r in events.read_upserted(spark, f"{tmp_path}/out").collect()} == best


def test_dead_letters(spark):
    e = spark.createDataFrame([(1, '{"node_id": 5}'), (2, "broken"), (3, None)], "arrival long, payload string")
    good, bad = events.split_bad(e, "node_id long")
    assert good.first().node_id == 5 and sorted(r.arrival for r in bad.collect()) == [2, 3]


def test_paths_and_pagerank(spark):
    e = spark.createDataFrame([("user", "sarah", 1.0), ("sarah", "mom", 1.0), ("mom", "grandma", 1.0), ("user", "dog", 0.2), ("x", "y", 1.0)], "src string, dst string, weight double")
    pairs = spark.createDataFrame([("user", "grandma"), ("user", "y")], "source string, target string")
    assert [r.path for r in graph.shortest_paths(e, pairs).collect()] == [["user", "sarah", "mom", "grandma"]]
    rank = {r.node: r["rank"] for r in graph.pagerank(e, spark.createDataFrame([("user",)], "seed string"), 20).collect()}
    assert rank["user"] > rank["sarah"] > rank["dog"] > rank["x"] == 0 and math.isclose(sum(rank.values()), 1.0)


def test_session_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sessionId": "s", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}))
    assert [(r.content, r.context) for r in chat.paired_turns(chat.read_sessions(spark, f"{tmp_path}/a.json")).collect()] == [("hi", "yo")]
    (tmp_path / "n.md").write_text(" note ")
    (r,) = chat.read_text(spark, f"{tmp_path}/n.md").collect()
    assert (r.content, r.kind) == ("note", "markdown")


def test_share_files(spark, tmp_path):
    def node(parent, children, role=None, text=None):
        return {"parent": parent, "children": children, "message": role and {"author": {"role": role}, "content": {"parts": [text, None, ""]}, "create_time": 1.5}}

    tree = {"r": node(None, ["s"]), "s": node("r", ["u1"], "system", "be kind"), "u1": node("s", ["a1", "a2"], "user", " hi "), "a1": node("u1", ["u2"], "assistant", "yo"), "a2": node("u1", [], "assistant", "other"), "u2": node("a1", ["u3"], "user", "still there?"), "u3": node("u2", ["u1"], "user", "bye")}
    (tmp_path / "share1.json").write_text(json.dumps({"title": "t", "create_time": 1.0, "mapping": tree}))
    (tmp_path / "share2.json").write_text(json.dumps({"title": "empty", "mapping": {}}))
    got = chat.read(spark, f"{tmp_path}/share*.json").orderBy("turn").collect()
    assert [(r.title, r.content, r.context, r.at) for r in got] == [("t", "hi", "yo", 1.5), ("t", "still there?", None, 1.5), ("t", "bye", None, 1.5)]
    for path, kind in ((f"{tmp_path}/a.pdf", None), (f"{tmp_path}/share1.json", "pdf")):
        with pytest.raises(ValueError):
            chat.read(spark, path, kind)


def test_entities_only_patches(spark):
    rows = [(1, 1, False, "s", "c", "a"), (1, 2, True, None, None, "b"), (2, 1, True, None, None, "x"), (3, 1, False, "", "c", "a"), (3, 2, False, "", "", "z"), (4, 2, False, None, "new", "n"), (4, 1, True, None, None, "old")]
    e = spark.createDataFrame(rows, "node_id long, arrival long, entities_only boolean, summary string, content string, entities string")
    assert sorted(map(tuple, events.vector_upserts(e).collect())) == [(1, "s", "b"), (3, "c", "a"), (4, "new", "n")]


def test_nearest_in_parts_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from engrammatic.operators import vectors

    r = np.random.default_rng(3)
    x = r.normal(size=(90, 6)).round(3)
    rows = [(i, i % 2, x[i].tolist()) for i in range(90)] + [(90, 0, None), (91, 1, [0.0] * 6)]
    v = spark.createDataFrame(rows, "node_id long, user_id long, embedding array<double>")
    want = {}
    for i, u, e in rows:
        if e is not None:
            sims = [(-round(float(np.dot(e, f) / max(np.linalg.norm(e) * np.linalg.norm(f), 1e-300)), 9), j) for j, w, f in rows if f is not None and w == u and j != i]
            want[i] = [j for _, j in sorted(sims)[:4]]
    for chunk in (2048, 11):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        got = {}
        for n in sorted(vectors.neighbours(v, 4).collect(), key=lambda n: n["rank"]):
            got.setdefault(n.node_id, []).append(n.other_id)
        assert got == want


def test_facade_and_sql_functions(spark):
    from engrammatic import functions
    from engrammatic.engine import MemoryEngine

    e = MemoryEngine.over(spark, "/root/testdata/sf0.001")
    as_of = 1_706_745_600_000_000
    user = e.table("memories").first().user_id
    for df in (e.relations(user), e.context(user), e.recent("item love", user), e.reconsolidate(as_of), e.cleanup(as_of), e.conflicts(), e.pending("HIGH"), e.ego(as_of), e.stats(), e.search([1.0] * 64, 1), e.neighbourhood(["s:1"]), e.paths([("s:1", "r:1")])):
        assert df.columns and df.count() >= 0
    assert e.ego(as_of).where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert "mem_cosine" in functions.register(spark)
    r = spark.sql("SELECT mem_cosine(array(1D, 0D), array(1D, 1D)) AS c, mem_tier_of(0.65D) AS t, mem_relation_category('works_at') AS k, mem_recency_decay(1, 180D) AS d").first()
    assert (round(r.c, 6), r.t, round(r.d, 6)) == (0.707107, 2, 0.5) and r.k


def test_dependency_patterns_of_known_sentences(spark):
    from engrammatic.operators import dependencies
    from engrammatic.tables import table

    found = dependencies.triples(table(spark, "/root/testdata/sf0.001", "parsed").withColumnRenamed("tpl", "doc_id")).collect()
    got = {(r.doc_id, r.pattern, r.subject, r.predicate, r.object, round(r.confidence, 6)) for r in found}
    assert {
        (0, "nsubj_verb_dobj", "Sarah", "study", "physics", 0.92), (1, "nsubj_verb_dobj", "John", "study", "physics", 0.77), (2, "nsubj_verb_dobj", "Sarah", "study", "quantum physics", 0.368),
        (3, "nsubj_verb_prep_pobj", "Sarah", "live_in", "New York", 0.88), (4, "apposition", "Mark", "holds_title", "our CEO", 0.97), (5, "passive_voice", "Sarah", "study", "Physics", 0.85),
        (6, "coordination", "John", "study", "chemistry", 0.92), (7, "nested_clause", "Sarah", "study", "physics", round(0.88 * 0.96, 6)), (8, "relative_clause", "Sarah", "work", "The company where Sarah works", 0.85), (9, "copula_attr", "Sarah", "be", "my sister", 0.945),
    } <= got
    assert {r.question for r in found if r.doc_id == 10} == {True} and {r.modality for r in found if r.doc_id == 2} == {"might"}


def test_learned_scores_on_held_out_rows(spark):
    from engrammatic.operators import learned
    from engrammatic.plans.scoring import examples
    from engrammatic.storage import written

    rows = written(examples(spark, "/root/testdata/sf0.001"))
    model = learned.fit(rows.where("node_id % 5 <> 0"))
    held = learned.predict(model, rows.where("node_id % 5 = 0")).select("label", "ego").toPandas()
    r2 = 1 - ((held.label - held.ego) ** 2).sum() / ((held.label - held.label.mean()) ** 2).sum()
    assert len(held) > 100 and r2 > 0.85
    assert learned.predict(model, rows.limit(1).withColumn("novelty", F.lit(None).cast("double"))).first().ego is not None


def stream_of(spark, tmp_path, schema, *batches):
    """A stream of one file for each batch, in order."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{i}")
        for p in (tmp_path / f"b{i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            p.rename(tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def collected(df, tmp_path):
    def keep(b, n):
        b.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")

    df.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{tmp_path}/out").drop("n" if "reason" not in df.columns else "_").collect()


def at(day, hour=0):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def test_shadow_lifecycle_with_timers(spark, tmp_path):
    from engrammatic.streaming import state

    s = stream_of(
        spark, tmp_path, "node_id long, kind string, at timestamp",
        [(1, "created", at(0)), (2, "created", at(0)), (3, "created", at(0)), (9, "approved", at(0))], [(1, "approved", at(2)), (2, "rejected", at(3)), (2, "approved", at(4))],
        [(4, "created", at(9))], [(5, "created", at(10))], [(6, "created", at(11))],
    )
    got = sorted((r.node_id, r.state) for r in collected(state.shadow_lifecycle(s), tmp_path))
    assert got == [(1, "approved"), (1, "pending"), (2, "pending"), (2, "rejected"), (3, "auto_promoted"), (3, "pending"), (4, "pending"), (5, "pending"), (6, "pending")]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    from engrammatic.streaming import state

    rows = [(1, "a", at(0, 0)), (1, "a", at(0, 0.2)), (1, "b", at(0, 2)), (2, "a", at(0, 0.1))]
    for name, f, want in (("w", state.counts_in_windows, 2), ("s", state.sessions, 3)):
        (tmp_path / name).mkdir()
        s = stream_of(spark, tmp_path / name, "node_id long, kind string, at timestamp", rows, [(7, "z", at(5))], [(7, "z", at(6))])
        got = collected(f(s).withColumnRenamed("n", "events"), tmp_path / name)
        assert sum(r.start < at(1) for r in got) == want and sum(r.events for r in got if r.start < at(1)) == 4


def test_items_in_batches_of_a_size(spark):
    from engrammatic.streaming import state

    e = spark.createDataFrame([(i % 3 == 0, i) for i in range(1000)], "user boolean, item_id long").select(F.col("user").cast("int").alias("user_id"), "item_id")
    got = state.batches_of(e, 50).collect()
    assert sorted(i for r in got for i in r["items"]) == list(range(1000)) and max(len(r["items"]) for r in got) < 100


def test_edges_around_groups_of_seeds_are_those_around_each(spark, monkeypatch):
    """Shared and own groups, loops, repeated and antiparallel edges, and seeds without edges, against sets."""
    monkeypatch.setattr(graph, "FEW", 2)
    monkeypatch.setattr(graph, "PIECE", 3)
    rnd = random.Random(3)
    pairs = [(f"s{i}", f"h{i % 3}") for i in range(12)] + [(f"h{i}", "top") for i in range(3)] + [("s0", "s0"), ("h1", "s1"), ("s2", "h1"), ("s2", "h0")] + [(f"v{rnd.randrange(9)}", f"v{rnd.randrange(9)}") for _ in range(14)]
    rows = [(a, b, f"{a}>{b}", "x" if k % 3 else "y") for k, (a, b) in enumerate(dict.fromkeys(pairs))]
    e = spark.createDataFrame(rows, "src string, dst string, edge_id string, category string")
    seeds = [f"s{i}" for i in range(12)] + ["h0", "h1", "top", "v0", "v1", "nobody"]
    df = spark.createDataFrame([(s,) for s in seeds], "seed string")
    for hops in (1, 2, 3):
        want = set()
        for s in seeds:
            near = {s}
            for _ in range(hops - 1):
                near |= {b for r in rows for a, b in (r[:2], r[1::-1]) if a in near}
            want |= {(s, r[2]) for r in rows if near & {*r[:2]}}
        got = [tuple(r) for r in graph.edges_within(e, df, hops).select("seed", "edge_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        kinds = {s: Counter(r[3] for r in rows if (s, r[2]) in want) for s in seeds}
        best = {s: min(((-n, c) for c, n in kinds[s].items()), default=(0, "personal")) for s in seeds}
        assert {(r.seed, -r.n, r.category) for r in graph.contexts(e, df, hops).collect()} == {(s, *best[s]) for s in seeds}
    of, around = graph.edges_around(e, df, 2)
    groups = {r.seed: r.grp for r in of.collect()}
    assert groups["s4"] == groups["s7"] == "s1" and groups["h0"] == "h0" and around.count() < len(graph.edges_within(e, df, 2).collect())


def test_khop_by_groups_of_seeds_walks_no_edge_twice(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 1)
    monkeypatch.setattr(graph, "PIECE", 2)
    rows = [("a", "h"), ("b", "h"), ("h", "b"), ("c", "h"), ("c", "c"), ("h", "top"), ("d", "h"), ("d", "top"), ("top", "x"), ("e", "f")]
    e = spark.createDataFrame([(s, d, f"{s}>{d}") for s, d in rows], "src string, dst string, edge_id string")
    seeds = ["a", "b", "c", "d", "e", "h", "nobody"]
    ends = [(a, b, i) for i, r in enumerate(rows) for a, b in (r, r[::-1])]
    for hops in (1, 2):
        want = {}
        for s in seeds:
            paths = [(s, ())]
            for depth in range(1, hops + 1):
                paths = [(b, (*used, i)) for n, used in paths for a, b, i in ends if a == n and i not in used]
                for n, _ in paths:
                    want.setdefault((s, n), depth)
        got = graph.khop(e, spark.createDataFrame([(s,) for s in seeds], "seed string"), hops).collect()
        assert len(got) == len(want) and {(r.seed, r.node): r.depth for r in got} == want


def test_long_texts_are_embedded_in_one_pass(spark):
    words = [f"w{i % 700}" for i in range(5000)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, None), (2, " ! "), (3, "one")], "id long, t string")
    got = {r.id: {p.place: p.value for p in r.v} for r in df.select("id", text.embedded(F.col("t")).alias("v")).collect()}
    n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:2], 16) for w in words)
    length = math.sqrt(sum(x * x for x in n.values()))
    assert got[0] == pytest.approx({p: x / length for p, x in n.items()}) and list(got[0]) == sorted(n)
    assert got[1] == got[2] == {} and [*got[3].values()] == [1.0]


def test_dependency_triples_shuffle_each_sentence_once(spark):
    """No join of tokens with tokens is left, whose sides the driver would gather to broadcast them."""
    found = dependencies.triples(table(spark, "/root/testdata/sf0.001", "parsed").withColumnRenamed("tpl", "doc_id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_dependency_patterns_with_odd_tokens(spark):
    """A cycle of heads ends, and null texts, places and labels are passed over."""
    rows = [(1, 0, 0, "A", "a", "PROPN", "nsubj", 1, None), (1, 0, 1, "sees", "see", "VERB", "ROOT", 1, None), (1, 0, 2, "B", "b", "PROPN", "dobj", 1, None), (1, 0, 3, None, None, None, None, 2, None),
            (1, 0, 4, "x", "x", "X", "conj", 5, None), (1, 0, 5, "y", "y", "X", "conj", 4, None), (1, 0, None, "z", "z", "VERB", "neg", 1, None), (2, 0, 0, None, None, None, None, None, None)]
    found = dependencies.triples(spark.createDataFrame(rows, "doc_id long, sent int, i int, text string, lemma string, pos string, dep string, head int, ent string")).collect()
    assert {(r.doc_id, r.subject, r.predicate, r.object, r.negated) for r in found} == {(1, "A", "see", "B", False)}
    assert sorted(r.pattern for r in found) == ["coordination", "nested_clause", "nsubj_verb_dobj"]


@pytest.mark.parametrize("sought", [64, 0])
def test_reinforcement_candidates_are_parts_of_texts_or_new_terms(spark, monkeypatch, sought):
    """Names within words count, as do terms of new relations; of a name's many relations the first ten come."""
    monkeypatch.setattr(relations, "SOUGHT", sought)
    r = spark.createDataFrame([(1, "ann", "likes", "item3", 0.9), (1, "bob", "works_at", "org", 0.8), (1, "cy", "likes", "a very long name of a thing", 0.7), (2, "ann", "likes", "tea", 0.9), *((3, "dee", "likes", f"x{i:02d}", 0.5) for i in range(40))], "user_id long, subject string, predicate string, object string, confidence double")
    m = spark.createDataFrame([(10, 1, "See ITEM35"), (11, 1, "nothing"), (12, 1, "A very long name of a thingy"), (13, 2, None), (14, 2, "steal"), (15, 1, "a very long name of no thing"), (16, 3, "deep x39"), (17, 1, "")], "node_id long, user_id long, content string")
    new = spark.createDataFrame([(11, "x", "y", "ORG"), (13, "Ann", "y", "z")], "memory_id long, subject string, predicate string, object string")
    df = relations.reinforcement_candidates(r, m, new)
    got = {(x.node_id, x.object, x["rank"]) for x in df.collect()}
    assert got == {(10, "item3", 1), (11, "org", 1), (12, "a very long name of a thing", 1), (13, "tea", 1), (14, "tea", 1), *((16, f"x{i:02d}", i + 1) for i in range(10))}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
