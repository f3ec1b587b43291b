"""Splitting oversized items at natural boundaries.

A text is seen in ranges with halos. Workers find the boundaries in each
range, the ranges' boundary tables are stitched by their offsets, and the cuts
are chosen on the boundaries alone; pieces are emitted by offset. A giant text
is thus never held by the step that decides about it. Files of any size are
split the same way by byte ranges (``split_files``), with prefix sums of the
ranges' lengths in characters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.ranges import slices, text_hash
from lodestrata.session import spread

#: Characters of a piece and of the overlap of two pieces, at most.
LIMIT, OVERLAP = 2000, 200
#: Characters (bytes for files) of a range.
RANGE = 1 << 18
HALO = 8
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?。！？][\"')\]]*\s+|[。！？]")
_SPACE = re.compile(r"\s+")
#: Kinds of boundaries, best first.
KINDS = ("paragraph", "line", "sentence", "word")


def boundaries(text: str, offset: int = 0, start: int = 0, end: int | None = None) -> dict[str, np.ndarray]:
    """Places in [start, end) of ``text``, plus ``offset``, at which a piece may end, by kind.

    A line may be cut before or after its line feed, so that a line of just the
    limit still fits; anything else is cut after its white space.
    """
    end = len(text) if end is None else end
    out = {
        "paragraph": [m.end() for m in _PARAGRAPH.finditer(text)],
        "line": [p for m in _LINE.finditer(text) for p in (m.start(), m.end())],
        "sentence": [m.end() for m in _SENTENCE.finditer(text)],
        "word": [m.end() for m in _SPACE.finditer(text)],
    }
    return {k: np.unique(np.array([p + offset for p in v if start <= p < end or (p == end == len(text))], dtype=np.int64)) for k, v in out.items()}


def _latest(places: np.ndarray, low: int, high: int) -> int | None:
    """The greatest place in (low, high]."""
    n = np.searchsorted(places, high, side="right")
    return int(places[n - 1]) if n and places[n - 1] > low else None


def _earliest(places: np.ndarray, low: int, high: int) -> int | None:
    """The least place in [low, high)."""
    n = np.searchsorted(places, low, side="left")
    return int(places[n]) if n < len(places) and places[n] < high else None


def choose_cuts(total: int, at: dict[str, np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of a text of ``total`` characters; kind says where the piece ends.

    ``end`` for the last piece. A paragraph's end in the further half is best,
    else the latest line's end, else a sentence's or word's end in the further
    half, else any word's end, else a cut at the limit (``hard``). The next
    piece begins up to ``overlap`` characters earlier at the best boundary
    there, unless that would keep it from reaching the end of a line that it
    could reach without.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    pieces, start, end = [], 0, 0
    while total - start > limit:
        end, kind = _cut(start, end, at, limit)
        pieces.append((start, end, kind))
        start = _resume(start, end, total, at, limit, overlap)
    if total > 0 or not pieces:
        pieces.append((start, total, "end"))
    return pieces


def _cut(start: int, beyond: int, at: dict[str, np.ndarray], limit: int) -> tuple[int, str]:
    high, half = start + limit, max(beyond, start + limit // 2)
    for kind, low in (("paragraph", half), ("line", beyond), ("sentence", half), ("word", half), ("word", beyond)):
        place = _latest(at[kind], low, high)
        if place is not None:
            return place, kind
    return high, "hard"


def _resume(start: int, end: int, total: int, at: dict[str, np.ndarray], limit: int, overlap: int) -> int:
    reaches = lambda place: total <= place + limit or _latest(at["line"], end, place + limit) is not None
    for kind in KINDS if overlap else ():
        back = _earliest(at[kind], max(end - overlap, start + 1), end)
        if back is not None and (reaches(back) or not reaches(end)):
            return back
    return end


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """The pieces of one text that is at hand."""
    return choose_cuts(len(text), boundaries(text), limit, overlap)


def inside_line(pieces: list[tuple[int, int, str]]) -> bool:
    return any(k in ("sentence", "word", "hard") for _, _, k in pieces)


def split_items(items: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, range_chars: int = RANGE) -> DataFrame:
    """(keys, piece_no, char_start, char_end, cut_kind[, piece]) of each item with more than ``limit`` characters.

    Pieces have ``limit`` characters at most, cover the text in order, and
    overlap by ``overlap`` at most; characters are code points. cut_kind is
    the kind of boundary at the piece's end, ``end`` for the last. Shorter,
    empty and null texts give no rows (see ``all_pieces``); rows that come
    twice give their pieces twice; other columns aren't read. Keys must not be
    named as a result column (ValueError).
    """
    out = ["piece_no", "char_start", "char_end", "cut_kind", "piece", "text_hash", "starts", "ends", "kinds"]
    if clash := set(keys) & set(out):
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    slim = items.select(*keys, F.col(text).alias("piece")).filter(F.length("piece") > limit)
    schema = T.StructType([*(items.schema[k] for k in keys), T.StructField("piece_no", T.IntegerType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()), T.StructField("cut_kind", T.StringType()), *([T.StructField("piece", T.StringType())] if with_text else [])])
    width = len(keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows, texts = [], [], []
            for i, t in enumerate(batch.column(width).to_pylist()):
                for no, (a, b, kind) in enumerate(split_text(t, limit, overlap)):
                    take.append(i)
                    rows.append((no, a, b, kind))
                    if with_text:
                        texts.append(t[a:b])
            if rows:
                no, a, b, kind = zip(*rows)
                index = pa.array(take, pa.int64())
                columns = [batch.column(k).take(index) for k in range(width)] + [pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    short = spread(slim.filter(F.length("piece") <= range_chars)).mapInArrow(whole, schema)

    long = slim.filter(F.length("piece") > range_chars).withColumn("text_hash", text_hash("piece"))
    ranges = slices(long.select("text_hash", F.col("piece").alias("text")), range_chars, HALO, HALO)
    table = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("total", T.IntegerType()), T.StructField("offset", T.IntegerType()), *(T.StructField(k, T.ArrayType(T.LongType())) for k in KINDS)])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, total, offset, part in zip(*(c.to_pylist() for c in batch.columns)):
                lead = min(HALO, offset)
                found = boundaries(part, offset - lead, lead, lead + range_chars)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int32()), pa.array([offset], pa.int32()), *(pa.array([found[k]], pa.list_(pa.int64())) for k in KINDS)], [f.name for f in table])

    def stitch(t: pa.Table) -> pa.Table:
        at = {k: np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in t[k].to_pylist()])) for k in KINDS}
        starts, ends, kinds = zip(*choose_cuts(t["total"][0].as_py(), at, limit, overlap))
        return pa.table({"text_hash": t["text_hash"].slice(0, 1), "starts": pa.array([starts], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())), "kinds": pa.array([kinds], pa.list_(pa.string()))})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.schema.names
            for i in range(batch.num_rows):
                starts, ends, kinds = (batch.column(last.index(c))[i].as_py() for c in ("starts", "ends", "kinds"))
                text = batch.column(width)[i].as_py() if with_text else None
                index = pa.array([i] * len(starts), pa.int64())
                columns = [batch.column(k).take(index) for k in range(width)] + [pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([text[a:b] for a, b in zip(starts, ends)], pa.string())] if with_text else []), [f.name for f in schema])

    cuts = ranges.mapInArrow(detect, table).groupBy("text_hash").applyInArrow(stitch, "text_hash string, starts array<bigint>, ends array<bigint>, kinds array<string>")
    kept = long if with_text else long.drop("piece")
    emitted = kept.join(cuts, "text_hash").select(*keys, *(["piece"] if with_text else []), "starts", "ends", "kinds").mapInArrow(emit, schema)
    return short.unionByName(emitted)


def all_pieces(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(slug, node_id, owning_file, chunk_index, piece_no, char_start, char_end, cut_kind, piece) of all nodes with content.

    Equal rows count once. A content within the limit is one piece with
    cut_kind ``end``; null content gives no piece.
    """
    keys = ["slug", "node_id", "owning_file", "chunk_index"]
    rows = nodes.select("slug", F.col("id").alias("node_id"), "owning_file", "chunk_index", "content").filter("content is not null").distinct()
    small = rows.filter(F.length("content") <= limit).select(*keys, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("char_start"), F.length("content").cast("bigint").alias("char_end"), F.lit("end").alias("cut_kind"), F.col("content").alias("piece"))
    return small.unionByName(split_items(rows, keys, "content", limit, overlap))


def found_split(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Distinct (slug, node_id, cut_kind) of the nodes that must be split.

    ``inside_line`` if a cut lies within a line, which happens just if a line
    alone is over the limit, else ``line``.
    """
    pieces = split_items(nodes.select("slug", F.col("id").alias("node_id"), "content"), ["slug", "node_id"], "content", limit, with_text=False)
    inside = F.max(F.col("cut_kind").isin("sentence", "word", "hard"))
    return pieces.groupBy("slug", "node_id").agg(inside.alias("inside")).select("slug", "node_id", F.when(F.col("inside"), "inside_line").otherwise("line").alias("cut_kind"))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """(path, piece_no, byte_start, byte_end, char_start, char_end, cut_kind) of UTF-8 files that the workers can read.

    Each worker opens a file at its range's offset. Ranges end where a
    character ends; prefix sums of their lengths turn places in ranges into
    places in the file. Empty files give one empty piece; bytes that aren't
    UTF-8 count as one character each.
    """
    plan = [(p, k, size) for p in paths for size in [os.path.getsize(p)] for k in range(0, max(size, 1), range_bytes)]
    ranges = spark.createDataFrame(plan, "path string, start bigint, size bigint").repartition(max(1, len(plan)), "path", "start")
    fields = ", ".join(f"{k} array<bigint>" for k in KINDS)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, before, own = _read_range(row["path"], row["start"], row["size"], range_bytes)
                found = boundaries(text, -before, before, before + own)
                lengths = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text[before : before + own]], dtype=np.int32)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "start": row["start"], "n_chars": own, "widths": _runs(lengths), **{k: v.tolist() for k, v in found.items()}}], pa.schema([("path", pa.string()), ("start", pa.int64()), ("n_chars", pa.int64()), ("widths", pa.list_(pa.int64())), *((k, pa.list_(pa.int64())) for k in KINDS)]))

    def stitch(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["start"])
        base = np.concatenate([[0], np.cumsum([r["n_chars"] for r in rows])])
        at = {k: np.unique(np.concatenate([np.asarray(r[k], dtype=np.int64) + b for r, b in zip(rows, base)])) for k in KINDS}
        widths = np.concatenate([np.asarray(r["widths"], dtype=np.int64).reshape(-1, 2) for r in rows]) if rows else np.empty((0, 2), dtype=np.int64)
        chars, nbytes = np.concatenate([[0], np.cumsum(widths[:, 0])]), np.concatenate([[0], np.cumsum(widths[:, 0] * widths[:, 1])])
        byte_at = lambda p: int(np.interp(p, chars, nbytes))
        pieces = choose_cuts(int(base[-1]), at, limit, overlap)
        return pa.Table.from_pylist([{"path": rows[0]["path"], "piece_no": n, "byte_start": byte_at(a), "byte_end": byte_at(b), "char_start": a, "char_end": b, "cut_kind": kind} for n, (a, b, kind) in enumerate(pieces)], pa.schema([("path", pa.string()), ("piece_no", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("cut_kind", pa.string())]))

    found = ranges.mapInArrow(detect, f"path string, start bigint, n_chars bigint, widths array<bigint>, {fields}")
    return found.groupBy("path").applyInArrow(stitch, "path string, piece_no int, byte_start bigint, byte_end bigint, char_start bigint, char_end bigint, cut_kind string")


def _runs(widths: np.ndarray) -> list[int]:
    """Run lengths of equal widths: count, width, count, width ..."""
    if not len(widths):
        return []
    edges = np.flatnonzero(np.diff(widths)) + 1
    starts = np.concatenate([[0], edges])
    return np.column_stack([np.diff(np.concatenate([starts, [len(widths)]])), widths[starts]]).ravel().tolist()


def _whole_chars(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


def _read_range(path: str, start: int, size: int, range_bytes: int) -> tuple[str, int, int]:
    """(text with halos, its characters before the range, characters of the range)."""
    halo = 4 * HALO
    low, high = max(0, start - halo), min(size, start + range_bytes + halo)
    with open(path, "rb") as f:
        f.seek(low)
        data = f.read(high - low)
    first = _whole_chars(data, 0)
    own, end = _whole_chars(data, start - low) if start else 0, _whole_chars(data, min(start + range_bytes, size) - low)
    last = len(data)
    while last > end and 0x80 <= data[last - 1] < 0xC0:
        last -= 1
    last = last - 1 if high < size and last > end and data[last - 1] >= 0xC0 else last if high < size else len(data)
    texts = [data[a:b].decode("utf-8", "surrogateescape") for a, b in ((min(first, own), own), (own, end), (end, max(end, last)))]
    return "".join(texts), len(texts[0]), len(texts[1])


def read_piece(path: str, byte_start: int, byte_end: int) -> str:
    """One piece's text, by its offsets alone."""
    with open(path, "rb") as f:
        f.seek(byte_start)
        return f.read(byte_end - byte_start).decode("utf-8", "surrogateescape")
