"""The registered neighbour queries on a small table."""

import numpy as np

from quern.llm import queries


def test_every_usable_vector_has_its_five(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 48))
    x[1] = x[0] + 0.01 * rng.normal(size=48)
    rows = [(i, "lark-embed-s", [float(v) for v in r]) for i, r in enumerate(x)] + [(99, "lark-embed-s", [0.0] * 48)]
    spark.createDataFrame(rows, "vec_id bigint, model string, embedding array<float>").write.parquet(f"{tmp_path}/embedding_responses.parquet")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -9)
    truth = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5]}
    assert {(r.a, r.b) for r in queries.p3_neighbours(spark, str(tmp_path)).collect()} == truth
    assert [tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()] == [(0, 1)]
