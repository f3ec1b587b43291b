from datetime import datetime

from lodestrata.operators import orphans as O
from lodestrata.operators import snapshots as S

META = [("v1", "release", "2031-01-01", 5), ("v2", "release", "2031-02-01", 3), ("v3", "release", "2031-02-01", 9), ("p1", "pre", "2031-01-05", 1)]
EDGES = "id bigint, slug string, source_id string, target_id string, target_resolved int, patchline string"
NODES = "slug string, id string, content string, at int"
FILES = "slug string, file_path string, file_hash string, indexed_at timestamp_ntz, batch_id bigint"


def meta(spark):
    return spark.createDataFrame(META, "slug string, patchline string, version_date string, build_number int")


def test_orphans_by_kind_whatever_the_flag_says(spark, rows):
    nodes = spark.createDataFrame([("v1", "old", "c", 1), ("v2", "here", "c", 1), ("v2", "here", "c", 1), ("v3", "new", "c", 1), ("p1", "other", "c", 1), ("v2", None, "c", 1)], NODES)
    edges = spark.createDataFrame([(1, "v2", "here", "old", 1, "x"), (1, "v2", "here", "old", 1, "x"), (2, "v2", "new", "here", 1, "x"), (3, "v2", "other", "Here", 0, "x"), (4, "v2", None, "", None, "x"), (5, "v2", "virtual:a", "here", 0, "x"), (6, "v2", "here", None, 1, "x"), (7, "??", "here", "here", 1, "x")], EDGES)
    got = rows(O.found_orphans(edges, nodes, meta(spark)))
    assert got == sorted([(1, "target", "deleted"), (2, "source", "later"), (3, "source", "missing"), (3, "target", "missing"), (7, "source", "missing"), (7, "target", "missing")], key=str)
    counts = {tuple(r)[1:4]: tuple(r)[4:] for r in O.orphan_counts(edges, nodes, meta(spark)).collect()}
    assert counts["v2", "target", "deleted"] == (1, 2)
    assert rows(O.found_orphans(edges.limit(0), nodes, meta(spark))) == []
    assert len(rows(O.found_orphans(edges, nodes.limit(0), meta(spark)))) == 10


def test_a_key_both_earlier_and_later_is_deleted(spark, rows):
    nodes = spark.createDataFrame([("v1", "k", "", 0), ("v3", "k", "", 0)], NODES)
    edges = spark.createDataFrame([(1, "v2", "k", None, 1, "x")], EDGES)
    assert rows(O.found_orphans(edges, nodes, meta(spark))) == [(1, "source", "deleted")]


def test_snapshot_changes(spark, rows):
    nodes = spark.createDataFrame([("v1", "gone", "c", 1), ("v1", "same", None, 1), ("v2", "same", None, 2), ("v2", "same", None, 3), ("v1", "empty", None, 1), ("v2", "empty", "", 1), ("v2", "new", "c", 1), ("v3", "new", "C", 1), ("p1", "x", "c", 1), ("v1", None, "c", 1)], NODES)
    got = rows(S.node_changes(nodes, meta(spark)))
    assert got == sorted([("v1", "v2", "empty", "changed"), ("v1", "v2", "gone", "removed"), ("v1", "v2", "new", "added"), ("v2", "v3", "empty", "removed"), ("v2", "v3", "new", "changed"), ("v2", "v3", "same", "removed")], key=str)
    assert rows(S.node_changes(nodes.limit(0), meta(spark))) == []


def test_file_changes_take_the_latest_state(spark, rows):
    d = datetime(2031, 1, 1)
    files = spark.createDataFrame([("v1", "a", "H1", d, 1), ("v2", ".\\a", "h0", d, 1), ("v2", "a", "h1", d, 2), ("v1", "b", "h1", d.replace(day=2), 1), ("v1", "b", "h9", d, 7), ("v2", "b", "h9", None, 1), ("v2", None, "h", d, 1), ("v2", "c", None, d, 1), ("v2", "", "h", d, 1)], FILES)
    got = [r for r in rows(S.file_changes(files, meta(spark))) if r[0] == "v1"]
    assert got == [("v1", "v2", "b", "changed")]


def test_a_hot_key_and_copies(spark, rows):
    edges = spark.createDataFrame([(n, "v1", "hub", f"m{n % 3}", 1, "x") for n in range(3000)] * 2, EDGES)
    nodes = spark.createDataFrame([("v1", "m0", "", 0)], NODES)
    got = O.found_orphans(edges, nodes, meta(spark))
    assert got.count() == 3000 + 2000
