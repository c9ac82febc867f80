"""Every query outside the training-data subpackage against its SQL in DuckDB, on the smallest tables."""

import json
import math
import os

import duckdb
import pytest

from engrammatic import registry

D = "/root/testdata/sf0.001"
Q, S = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return str(v) if isinstance(v, (str, bool)) else round(float(v), 5) + 0.0

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(S))
def test_query(spark, duck, name):
    got = Q[name](spark, D)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({S[name]})").fetchall()
    assert normal(got.select(*cols).collect()) == normal(want)


def on_events(spark, duck, folder, name, rows):
    """The rows of a query on its own events (value, event_type), in Spark and in DuckDB."""
    e = "SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, CAST(7 AS BIGINT) AS user_id, v AS value, t AS event_type, '{\"k\": 1}' AS props FROM e"
    c = duck.cursor()
    c.execute("CREATE TEMP TABLE e (i BIGINT, v DOUBLE, t VARCHAR)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    c.execute(f"COPY ({e}) TO '{folder}/events.parquet'")
    c.execute(f"CREATE TEMP VIEW events AS FROM '{folder}/events.parquet'")
    got = Q[name](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({S[name]})").fetchall())


def test_confidences_round_as_in_sql(spark, duck, tmp_path):
    rows = [(v, "click") for v in (56.5, 57.5, -14.5, -0.3, 0.5, 99.5, 500.0, None, *(k + 0.5 for k in range(100)))]
    got, want = on_events(spark, duck, tmp_path, "relation_context_format", rows)
    assert got == want and [x.split()[-1] for x in got[0][1].split("\n")[:4]] == ["0.56)", "0.57)", "-0.14)", "-0.00)"]


def test_exported_scores_round_as_in_sql(spark, duck, tmp_path):
    rows = [(95.55, "click"), (95.55, "click"), *((490 * (k / 500 + 0.001), "click") for k in range(150))]
    got, want = on_events(spark, duck, tmp_path, "snk_training_export", rows)
    assert got == want and [json.loads(x)["label_scores"] for _, x in got[:2]] == [[0.0, 0.81], [0.81]]


def test_exported_labels_may_be_null(spark, duck, tmp_path):
    rows = [(3.0, None), (3.0, None), (3.0, 'a "b" \\ /ü'), (None, "view")]
    got, want = on_events(spark, duck, tmp_path, "snk_training_export", rows)
    assert got == want and [json.loads(x)["labels"] for _, x in got[:2]] == [["view", None], [None, None]]


@pytest.mark.parametrize("name", ["current_relationships", "g_entity_context", "professional_history"])
def test_ranks_are_given_by_group_of_seeds(spark, name):
    """What the seeds' lists are joined to is ranked already; nothing is sorted or grouped for each seed."""
    plan = Q[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Window" not in plan and "Aggregate [seed" not in plan


def test_dependency_triples_join_only_to_make_the_tokens(spark):
    plan = Q["dependency_triples"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
