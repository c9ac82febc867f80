"""The pipeline over planted documents, stage by stage and as a whole."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_cases(spark, tmp_path):
    from tests.llm.test_operators import WORDS, toxic_rows

    r = random.Random(9)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    labelled = toxic_rows(600, r)
    rows = [(i, t) for i, (t, _) in enumerate(labelled)]
    clean = [(1000 + i, make(120)) for i in range(50)]
    copies = [(2000 + i, clean[i][1]) for i in range(10)]
    near = [(3000 + i, clean[i][1].replace(clean[i][1].split()[40], "edited", 1)) for i in range(10, 20)]
    item = make(40)
    leaked = [(4000, f"{make(50)} {item} {make(50)}")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = [(i, t, "en", "s", len(t)) for i, t in rows + clean + copies + near + leaked]
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(labelled)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = {x.doc_id for x in out}
    assert all(x.decodes for x in out)
    assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in copies + near + leaked}
    toxic = [i for i, (_, y) in enumerate(labelled) if y]
    assert sum(i in kept for i in toxic) <= 0.05 * len(toxic)
    assert sum(i in kept for i, (_, y) in enumerate(labelled) if not y) >= 0.97 * (len(labelled) - len(toxic))
