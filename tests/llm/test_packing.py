import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import packing as P
from lodestrata.llm.tokens import VOCABULARY


def used(plan):
    out = Counter()
    for n, sizes in plan:
        for s in sizes:
            out[s] += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_item_once_and_never_overfills(seed):
    rng = random.Random(seed)
    hist = Counter(max(1, min(2048, int(rng.lognormvariate(5.5 + seed / 3, 1)))) for _ in range(5000))
    plan = P.plan_packing(hist)
    assert used(plan) == hist
    assert all(sum(sizes) <= 2048 and n > 0 for n, sizes in plan)
    bound = -(-sum(s * n for s, n in hist.items()) // 2048)
    need = max(bound, sum(n for s, n in hist.items() if s > 1024))
    assert sum(n for n, _ in plan) <= 1.03 * need + 2


def test_least_squares_finds_exact_combinations():
    plan = P.plan_packing({1000: 50, 600: 30, 448: 30, 1048: 50}, 2048)
    assert sum(n for n, _ in plan) == 50 + 15 + 15 or sum(n * sum(s) for n, s in plan) == 50 * 1000 + 30 * 600 + 30 * 448 + 50 * 1048
    assert P.plan_packing({}) == [] and P.plan_packing({2048: 3}) == [(3, (2048,))]
    with pytest.raises(ValueError):
        P.plan_packing({2049: 1})
    x = P.nnls(np.array([[1, 2, 3], [1, 3, 3]]), np.array([0.0, 5.0, 5.0, 5.0, 0.0]))
    assert x[0] > 3 and (x >= 0).all()


def check(packed, sizes, capacity):
    by, seen = defaultdict(list), Counter()
    for r in packed.collect():
        seen[r.doc_id] += r["size"]
        if r.container_id is not None:
            by[r.container_id].append((r.slot, r.container_offset, r["size"]))
        else:
            assert r["size"] == 0
    for items in by.values():
        at = 0
        for n, (slot, offset, size) in enumerate(sorted(items)):
            assert (slot, offset) == (n, at)
            at += size
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by), seen


def test_pack_ties_nulls_oversized_hot_sizes(spark):
    data = [(n, 7) for n in range(900)] + [(1000 + n, n % 90) for n in range(500)] + [(5000, None), (5001, 0), (5002, 250), (5003, 100), (5004, 101)]
    df = spark.createDataFrame([(k, s, 1, "x") for k, s in data], "doc_id bigint, n_tokens bigint, size int, bucket string")
    n, seen = check(P.pack(df, capacity=100), data, 100)
    assert seen == Counter({k: s or 0 for k, s in data if s}) + Counter() and n <= -(-sum(s or 0 for _, s in data) // 100) + 5
    parts = [(r.part, r.part_start, r["size"]) for r in P.pack(df, capacity=100).filter("doc_id = 5002").orderBy("part").collect()]
    assert parts == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert P.pack(df, capacity=100).filter("container_id is null").count() == 2 + sum(n % 90 == 0 for n in range(500))
    assert P.pack(df.limit(0), capacity=100).collect() == []


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000)], "doc_id bigint, text string")
    packed = P.pack_documents(docs)
    fill = P.container_fill(packed).agg(F.sum("n_tokens"), F.count("*")).collect()[0]
    assert tuple(fill) == (3 + 3001, 2)
