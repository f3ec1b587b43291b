from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.operators import incremental as I

T0 = datetime(2031, 1, 1)
FILES = "slug string, file_path string, file_hash string, corpus_type string, indexed_at timestamp_ntz, batch_id bigint, patchline string"
RUNS = "run_id bigint, patchline string, corpus_type string, through_batch bigint, run_status string"
META = "slug string, patchline string, version_date string, build_number int"


def t(n):
    return T0.replace(day=n)


def make(spark, files, runs, meta=(("s1", "release", "1", 1), ("s2", "release", "2", 2))):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(list(meta), META)


def test_deltas_late_rows_spelling_case_and_failed_runs(spark, rows):
    files = [
        ("s1", "a", "H1", "code", t(1), 1, "x"),
        ("s1", "./a", "h1", "code", t(2), 2, "x"),  # the same file and hash
        ("s1", "a", "old", "code", t(1), 3, "x"),  # arrives late with an older state: equal time, later batch
        ("s2", "b\\c", "h2", "code", t(3), 2, "x"),
        ("s2", "b/c", "h3", "code", t(2), 3, "x"),  # older than what is current
        ("s1", None, "h", "code", t(4), 3, "x"),
        ("s1", "n", None, "code", t(4), 3, "x"),
        ("s1", "d", "h4", "docs", t(4), 3, "x"),
        ("s1", "late", "h5", "code", None, 4, "x"),
        ("zz", "e", "h4", "code", t(4), 3, "x"),
    ]
    runs = [(1, "release", "code", 1, "Success"), (2, "release", "code", 2, "failed"), (3, "release", "code", 2, "success"), (3, "release", "code", 2, "success"), (4, "release", "code", 3, "SUCCESS"), (5, "release", "code", 3, "success"), (6, "release", "code", 4, "success")]
    got = rows(I.found_deltas(*make(spark, files, runs)))
    assert got == [(1, "a"), (3, "b/c"), (6, "late")]


def test_a_run_that_covers_less_sees_the_earlier_state(spark, rows):
    files = [("s1", "a", "h1", "code", t(1), 1, "x"), ("s1", "a", "h2", "code", t(2), 2, "x"), ("s1", "b", "h1", "code", t(2), 2, "x")]
    runs = [(1, "release", "code", 2, "success"), (2, "release", "code", 1, "success"), (3, "release", "code", 2, "success")]
    assert rows(I.found_deltas(*make(spark, files, runs))) == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")]


def test_empty_tables(spark, rows):
    files, runs, meta = make(spark, [("s1", "a", "h", "code", t(1), 1, "x")], [(1, "release", "code", 1, "success")])
    for a, b, c in ((files.limit(0), runs, meta), (files, runs.limit(0), meta), (files, runs, meta.limit(0))):
        assert rows(I.found_deltas(a, b, c)) == []


def source(spark, data):
    return spark.createDataFrame(data, "k string, v string, tx bigint")


def test_ledger_runs_skip_nothing_and_repeat_nothing(spark, rows, tmp_path):
    run = I.IncrementalRun(spark, str(tmp_path), ["k"], "v", "tx")
    first = source(spark, [("a", "1", 1), ("b", "1", 3), (None, "1", 2), ("a", "1", 1)])
    assert rows(run.run(first, open_from=2)) == [("a", "1", 1), ("b", "1", 3), (None, "1", 2)]
    # transaction 2 was open: a row of it arrives only now
    second = source(spark, [("a", "1", 1), ("b", "1", 3), (None, "1", 2), ("c", "1", 2), ("b", "2", 4)])
    assert rows(run.pending(second)) == [("b", "2", 4), ("c", "1", 2)]
    assert rows(run.run(second, open_from=5)) == [("b", "2", 4), ("c", "1", 2)]
    assert rows(run.run(second, open_from=5)) == []
    run.compact()
    run.compact()
    assert rows(run.pending(second)) == [] and run._compacted() == [3]
    # back to an earlier version
    assert rows(run.run(source(spark, [("b", "1", 6)]), open_from=7)) == [("b", "1", 6)]


def test_a_failed_run_never_happened(spark, rows, tmp_path):
    run = I.IncrementalRun(spark, str(tmp_path), ["k"], "v", "tx")
    data = source(spark, [("a", "1", 1)])
    run.pending(data).write.parquet(f"{tmp_path}/output/run=1")  # failed before its marker
    assert run.done() == []
    assert rows(run.run(data, open_from=2)) == [("a", "1", 1)]
    assert run.done() == [(1, 2)]
    assert run.current_ledger().filter(F.col("__l_k") == "a").count() == 1


def test_rereads_neither_repeat_older_versions_nor_null_positions(spark, rows, tmp_path):
    run = I.IncrementalRun(spark, str(tmp_path), ["k"], "v", "tx")
    assert rows(run.run(source(spark, [("a", "v0", None)]), open_from=1)) == [("a", "v0", None)]
    both = source(spark, [("a", "v0", None), ("a", "v1", 5)])
    assert rows(run.run(both, open_from=1)) == [("a", "v1", 5)]
    assert rows(run.run(both, open_from=10)) == [] and rows(run.run(both, open_from=0)) == []
    run.compact()
    assert rows(run.pending(both)) == []
    # without any position each version comes once
    loose = I.IncrementalRun(spark, f"{tmp_path}/loose", ["k"], "v", "tx")
    assert rows(loose.run(source(spark, [("a", "z", None)]), open_from=0)) == [("a", "z", None)]
    more = source(spark, [("a", "z", None), ("a", "b", None)])
    assert rows(loose.run(more, open_from=0)) == [("a", "b", None)] and rows(loose.run(more, open_from=0)) == []


def test_late_batches_with_an_older_state_are_no_change(spark, rows, tmp_path):
    run = I.IncrementalRun(spark, str(tmp_path), ["k"], "v", "tx")
    assert rows(run.run(source(spark, [("a", "v1", 6)]), 0)) == [("a", "v1", 6)]
    assert rows(run.run(source(spark, [("a", "v0", 3)]), 0)) == []
    assert rows(run.run(source(spark, [("a", "v1", 9)]), 0)) == []  # the same version, seen later
    assert rows(run.run(source(spark, [("a", "v0", 7)]), 0)) == []  # older than what was seen
    assert rows(run.run(source(spark, [("a", "v0", 10)]), 0)) == [("a", "v0", 10)]


def test_deltas_agree_with_a_replay_run_by_run(spark, rows):
    import random

    rng = random.Random(7)
    files = [("s1", f"f{rng.randrange(6)}", f"h{rng.randrange(3)}", "code", t(rng.randrange(1, 9)), rng.randrange(1, 9), "x") for _ in range(80)]
    through = [2, 2, 5, 3, 7, 8]
    want, before = [], {}
    for n, b in enumerate(through):
        seen = {}
        for _, path, h, _, at, batch, _ in files:
            if batch <= b:
                seen[path] = max(seen.get(path, ()), (at, batch, h))
        now = {k: v[2] for k, v in seen.items()}
        want += [(n, k) for k, h in now.items() if before.get(k) != h]
        before = now
    assert rows(I.found_deltas(*make(spark, files, [(n, "release", "code", b, "success") for n, b in enumerate(through)]))) == sorted(want)
