import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import common, neighbours, queries


def brute_force(rows, queries, wanted=20):
    out = {}
    for q, v in queries:
        found = sorted((-float(np.dot(np.array(x, np.float64), np.array(v, np.float64))), i) for i, x in rows if i != q)
        out[q] = found[:wanted]
    return out


def found(spark, rows, queries, **kw):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], schema)
    got = neighbours.nearest(df, spark.createDataFrame([(i, v, 0) for i, v in queries], schema), common.work_dir(spark), **kw)
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_on_few_vectors_with_ties_and_copies(spark):
    rng = np.random.RandomState(3)
    rows = [(k, rng.standard_normal(8).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100 + k, rows[5][1]) for k in range(50)]  # copies: the smallest ids come first
    queries = [rows[0], rows[5], (120, rows[5][1])]
    got, want = found(spark, rows, queries), brute_force(rows, queries)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 64)
    rng = np.random.RandomState(4)
    rows = [(k, (rng.standard_normal(32) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for k in range(3000)]
    queries = rows[::50]
    got, want = found(spark, rows, queries), brute_force(rows, queries)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (9, [1.0])]
    assert {q: [i for _, i in v] for q, v in found(spark, rows, rows).items()} == {1: [8], 8: [1]}  # 9 has no other vector of its length
    assert found(spark, [], []) == {} and found(spark, rows[:2], []) == {} and found(spark, rows[1:3], rows[:1]) == {}


def test_the_smallest_ids_of_many_tied_vectors_are_taken(spark):
    rng = np.random.RandomState(5)
    rows = [(1000 - k, [1.0] + [float(k >> j & 1) for j in range(7)]) for k in rng.permutation(100).tolist()]
    queries = [(5000, [1.0] + [0.0] * 7), rows[0]]
    assert found(spark, rows, queries) == brute_force(rows, queries)


def test_each_length_has_its_own_neighbours(spark):
    rng = np.random.RandomState(6)
    rows = [(k, rng.standard_normal(3 + k % 3).astype(np.float32).tolist()) for k in range(90)] + [(1000, [1.0] * 7)]
    got = found(spark, rows, rows, wanted=5, recall=0.999)
    assert 1000 not in got and set(got) == set(range(90))
    for size in (3, 4, 5):
        own = [r for r in rows if len(r[1]) == size]
        want = brute_force(own, own, 5)
        assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.98 * 5 * 30


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    """The registered query, with its own settings, on the embeddings; k is above 0, so the tables are at work."""
    folder = f"/root/testdata/sf{sf}"
    got, table = {}, common.table(spark, folder, "embeddings")
    for r in queries.op10_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hit += len(set(got[q]) & set(ids[np.argsort(-scores)[:20]].tolist()))
        total += 20
    assert hit >= 0.9 * total
    assert all(t.k > 0 for t in neighbours._fit(table.select(F.col("embedding").alias("vector")), 20).values())


def test_columns_with_the_names_of_its_own(spark):
    rows = [(k, [float(k), 1.0], 1, 2, 3, "x") for k in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int, t int, cell int, ids string")
    assert [r.vec_id for r in neighbours.nearest(df, df.filter("vec_id = 1"), common.work_dir(spark)).orderBy("rank").collect()] == [5, 4, 3, 2]
