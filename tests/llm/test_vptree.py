import numpy as np
import pytest

from lodestrata.llm import vptree as V

SCHEMA = "content_hash string, model_id string, vector array<float>, dimension int, rank int, shard int"


def planted(n, dim, pairs, seed, noise=0.02):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    y = x[:pairs] / np.linalg.norm(x[:pairs], axis=1, keepdims=True) + noise * rng.normal(size=(pairs, dim))
    return np.vstack([x, y])


def frame(spark, data):
    return spark.createDataFrame([(h, m, None if v is None else [None if e is None else float(e) for e in v], d, 1, 1) for h, m, v, d in data], SCHEMA)


def brute(x, least):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b = np.nonzero(u @ u.T >= least)
    return {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}


@pytest.fixture(scope="module")
def vectors(spark):
    x = planted(3000, 32, 400, 3)
    return x, frame(spark, [(f"h{i:05d}", "m", v, 32) for i, v in enumerate(x)])


def test_pairs_over_many_shards_against_brute_force(vectors):
    x, df = vectors
    reps, _ = V.classes(V.usable(df))
    names = {r.vector_key: r["class"] for r in V.classes(V.usable(df))[1].collect()}
    number = {c: int(k[1:]) for k, c in names.items()}
    true = brute(x, 0.92)
    exact = {tuple(sorted((number[r.key_a], number[r.key_b]))) for r in V.similar_pairs(reps, 0.92, factor=1.0, shard_rows=512).collect()}
    assert exact == true
    relaxed = {tuple(sorted((number[r.key_a], number[r.key_b]))) for r in V.similar_pairs(reps, 0.92, shard_rows=512).collect()}
    assert relaxed <= true and len(relaxed) >= 0.99 * len(true)


def test_relaxed_pruning_prunes():
    x = V._matrix(__import__("pyarrow").array([list(map(float, v)) for v in planted(4000, 32, 0, 5)]))
    seen = lambda f: sum(c.size for _, _, c in V.search(x, x, np.full(len(x), 0.4), f))
    assert seen(V.PAIR_FACTOR) < 0.4 * seen(1.0)


def test_topk_against_brute_force(vectors):
    x, df = vectors
    rows = V.usable(df).distinct()
    queries = V.similar_queries(rows)
    asked = {r.vector_key for r in queries.collect()}
    got = V.most_similar(rows, queries, k=10, shard_rows=512).collect()
    assert {r.query_key for r in got} == asked and len(got) == 10 * len(asked)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for key in asked:
        at = int(key[1:])
        order = np.argsort(-(u @ u[at]))
        true = {f"h{i:05d}" for i in order[order != at][:10]}
        hit += len(true & {r.vector_key for r in got if r.query_key == key})
    assert hit >= 0.9 * len(got)
    assert V.most_similar(rows, queries, k=10, factor=1.0, shard_rows=512).count() == len(got)


def test_rows_that_do_not_count_copies_scales_and_groups(spark, rows):
    v, w = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    data = [("a", "m", v, 3), ("a", "m", v, 3), ("b", "m", [9 * e for e in v], 3), ("c", "m", v, 3), ("d", "m", w, 3), ("e", "other", v, 3), ("f", "m", [*v, 0.0], 4)]
    data += [("n1", "m", None, 3), ("n2", "m", [], 0), ("n3", "m", [0.0, 0.0, 0.0], 3), ("n4", "m", [1.0, None, 0.0], 3), ("n5", "m", [float("nan"), 1.0, 0.0], 3), ("n6", "m", v, 4), ("n7", "m", v, None), (None, "m", v, 3), ("n8", None, v, 3)]
    df = frame(spark, data)
    assert rows(V.found_pairs(df)) == [("m", x, y) for x, y in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"))]
    assert rows(V.found_pairs(df.limit(0))) == []
    assert rows(V.found_pairs(frame(spark, data[7:]))) == []


def test_a_third_of_all_rows_share_one_vector(spark):
    x = planted(600, 16, 0, 9)
    data = [(f"h{i}", "m", v, 16) for i, v in enumerate(x)] + [("copy", "m", x[0], 16)] * 300
    df = frame(spark, data)
    reps, members = V.classes(V.usable(df))
    assert (reps.count(), members.count()) == (600, 601)
    assert ("m", "copy", "h0") in {tuple(r) for r in V.found_pairs(df).collect()}


def test_router_cannot_split_equal_rows():
    router = V.fit_router(np.ones((50, 4), dtype=np.float32) / 2, 4)
    assert router.shards == 1 and [len(r) for _, r in V.route(router, np.ones((3, 4), dtype=np.float32) / 2, 0.0)] == [3]
