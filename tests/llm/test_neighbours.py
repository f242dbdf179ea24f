import numpy as np

from larch.llm import neighbours


def dot(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += a * b
    return total


def brute(q, c, k):
    out = {}
    for i, x in q:
        rows = sorted((-(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))), j) for j, y in c if j != i)
        out[i] = [(j, -s) for s, j in rows[:k]]
    return out


def vectors(n=300, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    v[20:60] = v[20]  # ties
    v[100] *= np.float32(2.0**-60)
    return v


def check(spark, v, monkeypatch=None, **blocks):
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df.filter("vec_id % 10 = 0"), df, 5, **blocks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = [(i, y.astype(float)) for i, y in enumerate(v)]
    want = brute([y for y in x if y[0] % 10 == 0], x, 5)
    assert set(got) == set(want)
    for i, rows in want.items():
        assert [r[0] for r in got[i]] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in got[i]] == rows  # the same ids and the same bits of the scores
    return got


def test_against_brute_force(spark):
    v = vectors()
    got = check(spark, v)
    assert check(spark, v, query_block=7, candidate_block=40) == got
    assert [r[1] for r in got[20]] == [21, 22, 23, 24, 25]  # equal vectors: smaller ids first


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, df, 5).orderBy("query_id", "rank", "vec_id").collect()]
    assert {q for q, _, _ in got} == {0, 6}  # 7 is alone with its length
    more = spark.createDataFrame([(10, [1.0]), (11, [-2.0])], "vec_id long, embedding array<float>")
    both = [(r["query_id"], r["vec_id"], r["score"]) for r in neighbours.nearest(df.unionByName(more), df.unionByName(more), 5).collect() if r["query_id"] in (7, 10, 11)]
    assert sorted(both) == [(7, 10, 1.0), (7, 11, -1.0), (10, 7, 1.0), (10, 11, -1.0), (11, 7, -1.0), (11, 10, -1.0)]
    assert all(q != v for q, _, v in got)
    assert neighbours.nearest(df.limit(0), df, 5).count() == 0
    assert neighbours.nearest(df, df.limit(0), 5).count() == 0


def test_error_bound_holds():
    u = neighbours._unit(np.random.default_rng(1).standard_normal((200, 30)))
    code, scale, norm, error = neighbours.quantise(u)
    near = (code.astype(float) @ code.T) * scale[:, None] * scale[None, :]
    assert (np.abs(u @ u.T - near) <= error[:, None] + norm[:, None] * error[None, :] + 1e-12).all()
