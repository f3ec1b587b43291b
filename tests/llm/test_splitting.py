import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import splitting as S

ALPHABET = ["a", "word", " ", "  ", "\n", "\n\n", ". ", "! ", "。", "é", "e\u0301", "😀", "x" * 30, "\r\n"]


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 <= b - a <= limit and (b > a or not text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b and b - c <= overlap and d > b


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=120), st.sampled_from([(20, 0), (20, 5), (35, 10), (50, 49)]))
def test_pieces_cover_within_limit_and_overlap(parts, sizes):
    text = "".join(parts)
    pieces = S.split_text(text, *sizes)
    check(text, pieces, *sizes)
    if len(text) > sizes[0]:
        assert S.inside_line(pieces) == any(len(line) > sizes[0] for line in text.split("\n"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=200), st.sampled_from([16, 40, 64]))
def test_ranges_with_halos_find_the_boundaries_of_the_whole(parts, width):
    text = "".join(parts)
    whole, found = S.boundaries(text), {k: set() for k in S.KINDS}
    for offset in range(0, len(text), width):
        lead = min(S.HALO, offset)
        part = text[offset - lead : offset + width + S.HALO]
        for k, v in S.boundaries(part, offset - lead, lead, lead + width).items():
            found[k] |= set(v.tolist())
    for k in ("line",):
        assert found[k] | {len(text)} == set(whole[k].tolist()) | {len(text)}


def test_natural_boundaries_are_preferred():
    text = "First para one.\n\nSecond line here\nthird line. Fourth sentence here."
    kinds = [k for _, _, k in S.split_text(text, 30, 0)]
    assert kinds[0] == "paragraph" and kinds[-1] == "end"
    assert S.split_text("x" * 50, 20, 0) == [(0, 20, "hard"), (20, 40, "hard"), (40, 50, "end")]
    line = "y" * 20
    assert not S.inside_line(S.split_text(f"{line}\n{line}\n{line}", 20, 5))
    with pytest.raises(ValueError):
        S.split_text("abc" * 20, 10, 10)


def frame(spark, data):
    return spark.createDataFrame([(s, i, c, "f.md", 0, "x") for s, i, c in data], "slug string, id string, content string, owning_file string, chunk_index int, piece string")


def test_short_and_long_paths_agree(spark):
    rng = random.Random(4)
    data = [("s", f"n{k}", "".join(rng.choice(ALPHABET) for _ in range(900))) for k in range(20)]
    df = frame(spark, data).withColumnRenamed("piece", "other")
    run = lambda chars: sorted(map(tuple, S.split_items(df, ["slug", "id"], "content", 100, 10, range_chars=chars).collect()))
    whole, ranged = run(1 << 20), run(64)
    for i, _, text in [(d[1], 0, d[2]) for d in data]:
        mine = sorted(r for r in ranged if r[1] == i)
        check(text, [(r[3], r[4], r[5]) for r in sorted(mine, key=lambda r: r[2])], 100, 10)
        assert all(text[r[3] : r[4]] == r[6] for r in mine)
    assert {r[1] for r in whole} == {r[1] for r in ranged}


def test_found_and_pieces_with_nulls_copies_and_empty_tables(spark, rows):
    long_line, lines = "word " * 500, "short line\n" * 400
    data = [("s", "a", long_line), ("s", "a", long_line), ("s", "b", lines), ("s", "c", "x" * 2000), ("s", "d", None), ("s", "e", ""), (None, None, lines), ("s", "f", "é" * 2001)]
    df = frame(spark, data)
    assert rows(S.found_split(df)) == sorted([("s", "a", "inside_line"), ("s", "b", "line"), (None, None, "line"), ("s", "f", "inside_line")], key=str)
    pieces = S.all_pieces(df)
    assert pieces.filter("length(piece) > 2000").count() == 0
    assert {r.node_id for r in pieces.collect()} == {"a", "b", "c", "e", "f", None}
    assert rows(S.found_split(df.limit(0))) == [] and S.all_pieces(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.split_items(df, ["slug", "piece"], "content")


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(7)
    texts = {"a.txt": "".join(rng.choice(ALPHABET) for _ in range(4000)), "b.txt": "x" * 3000 + "é" * 2000, "c.txt": "", "d.txt": "short"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = S.split_files(spark, [str(tmp_path / n) for n in texts], 200, 20, range_bytes=256).collect()
    for name, text in texts.items():
        mine = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.piece_no)
        check(text, [(r.char_start, r.char_end, r.cut_kind) for r in mine], 200, 20)
        for r in mine:
            assert S.read_piece(r.path, r.byte_start, r.byte_end) == text[r.char_start : r.char_end]
