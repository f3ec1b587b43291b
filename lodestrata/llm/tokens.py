"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are encoded in Arrow batches. A text that is longer than a segment is
cut into segments that are encoded apart, in parallel. Cuts go where the
tokenizer's pattern always begins a new word, so that the parts' ids are the
text's ids. Only in an unsplit run, a stretch of one character class longer
than a segment, is there no such place; it is cut anywhere and its parts are
joined as a tree: around each join a growing window of tokens is encoded again
until its ids agree with both sides. They agree when each pair of neighbours
at the window's ends is what the pair's own bytes encode to, which for BPE
makes the whole sequence the encoding of the whole run.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.ranges import slices, text_hash
from lodestrata.session import spread

#: The vocabulary's file; a parameter, never part of this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into words before BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a segment.
SEGMENT = 1 << 16
_CLASS = regex.compile(r"(\p{L})|(\p{N})|(\s)")
_RUN_END = {kind: regex.compile(p) for kind, p in (("L", r"[^\p{L}]"), ("N", r"[^\p{N}]"), ("S", r"\S"), ("O", r"[\s\p{L}\p{N}]"))}


@cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks; read once a process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def char_class(c: str) -> str:
    m = _CLASS.match(c)
    return "O" if m is None else "LNS"[m.lastindex - 1]


def safe_cut(text: str, start: int, end: int) -> int | None:
    """The first place in [start, end) where the pattern begins a new word whatever stands around; None if there is none.

    Such a place lies between characters of different classes, of which the
    first is no white space and no apostrophe.
    """
    at = max(1, start)
    while at < end:
        before, here = text[at - 1], text[at]
        kind = char_class(before)
        if kind != char_class(here):
            if kind != "S" and before != "'":
                return at
            at += 1
            continue
        m = _RUN_END[kind].search(text, at, end)
        if m is None:
            return None
        at = m.start()
    return None


def segment_bounds(text: str, offset: int, total: int, segment: int) -> tuple[int, int, bool]:
    """(start, end, raw) of a segment within ``text``, its range with one range of halo behind.

    ``offset`` is the range's place in the whole text of ``total`` characters.
    Both neighbours of a cut see the same range and so agree on it. raw: there
    was no safe cut at the start, so that it must be joined.
    """
    lead = 1 if offset else 0
    start, raw = lead, False
    if offset:
        cut = safe_cut(text, lead, min(lead + segment, len(text)))
        raw = cut is None
        start = lead if cut is None else cut
    after = lead + segment
    if offset + segment >= total:
        return start, len(text), raw
    cut = safe_cut(text, after, min(after + segment, len(text)))
    return start, after if cut is None else cut, raw


def pair_holds(enc: tiktoken.Encoding, a: int, b: int) -> bool:
    """Whether the bytes of two neighbours encode to just these two, as one word."""
    return enc._encode_single_piece(enc.decode_single_token_bytes(a) + enc.decode_single_token_bytes(b)) == [a, b]


def _tail_bytes(enc: tiktoken.Encoding, ids: list[int], from_end: bool, least: int) -> tuple[int, str]:
    """(number of tokens, text) of a stretch at an end of ids that is text by itself and has ``least`` tokens or more."""
    n = min(least, len(ids))
    while True:
        part = ids[len(ids) - n :] if from_end else ids[:n]
        data = b"".join(map(enc.decode_single_token_bytes, part))
        try:
            return n, data.decode("utf-8")
        except UnicodeDecodeError:
            if n == len(ids):
                raise
            n += 1


def join_texts(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """The ids of two neighbouring texts from the ids of each, wherever the cut is.

    The windows grow until each reaches a safe cut on its side or, within one
    unsplit run, until the BPE pairs at both ends agree.
    """
    if not left or not right:
        return left + right
    width = 8
    while True:
        i, a = _tail_bytes(enc, left, True, width)
        j, b = _tail_bytes(enc, right, False, width)
        ends = i == len(left) and j == len(right)
        # the last safe place of a and the first of b; what lies outside of them stays as it is
        low = 0 if i == len(left) else _last_safe(a)
        high = len(b) if j == len(right) else safe_cut(b, 1, len(b))
        if low is not None and high is not None:
            keep = enc.encode_ordinary(a[:low]) if low else []
            tail = enc.encode_ordinary(b[high:]) if high < len(b) else []
            if left[len(left) - i :][: len(keep)] == keep and (not tail or right[:j][len(right[:j]) - len(tail) :] == tail):
                return left[: len(left) - i] + keep + enc.encode_ordinary(a[low:] + b[:high]) + tail + right[j:]
        kinds = {char_class(c) for c in (a[0], a[-1], b[0], b[-1])}
        if not ends and len(kinds) == 1 and kinds != {"S"} and low is None and high is None:
            window = enc._encode_single_piece((a + b).encode())
            if pair_holds(enc, left[len(left) - i - 1], window[0]) and pair_holds(enc, window[-1], right[j]):
                return left[: len(left) - i] + window + right[j:]
        if ends:
            return enc.encode_ordinary(a + b)
        width *= 2


def _last_safe(text: str) -> int | None:
    """The last place where a new word surely begins."""
    at = len(text) - 1
    while at > 0:
        before = text[at - 1]
        if before != "'" and (kind := char_class(before)) != "S" and kind != char_class(text[at]):
            return at
        at -= 1
    return None


def _ids_array(lists: list) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, segment: int = SEGMENT, counts_only: bool = False) -> DataFrame:
    """(key, ids): each row's token ids, without special tokens; or (key, n_tokens).

    A null text has null ids (n_tokens 0), an empty one an empty list. Strings
    of special tokens are ordinary text. Rows that come twice come out twice;
    other columns aren't read. Texts of up to ``segment`` characters take one
    Arrow pass without a shuffle; only segments of longer ones are shuffled.
    """
    kind = documents.schema[key].dataType
    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    short = slim.filter(F.col("text").isNull() | (F.length("text") <= segment))
    out = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    counted = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], pa.int64())], ["key", "n_tokens"])
                continue
            for k in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1000), _ids_array([None if t is None else enc.encode_ordinary(t) for t in texts[k : k + 1000]])], ["key", "ids"])

    done = spread(short).mapInArrow(whole, counted if counts_only else out)

    # a range, one character before it and one range of halo after it
    long = slim.filter(F.length("text") > segment).withColumn("text_hash", text_hash("text"))
    ranges = slices(long, segment, 1, segment)
    pieces = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("raw", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for name, total, offset, part in zip(*(c.to_pylist() for c in batch.columns)):
                start, end, raw = segment_bounds(part, offset, total, segment)
                ids = enc.encode_ordinary(part[start:end]) if end > start else []
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([offset], pa.int32()), pa.array([raw]), _ids_array([ids])], [f.name for f in pieces])

    def stitch(table: pa.Table) -> pa.Table:
        enc = encoding(vocabulary)
        order = sorted(range(table.num_rows), key=lambda n: table["offset"][n].as_py())
        sides = [(table["raw"][n].as_py(), table["ids"][n].as_py()) for n in order]
        while len(sides) > 1:  # neighbours join as a tree
            sides = [(a[0], join_texts(enc, a[1], b[1]) if b[0] else a[1] + b[1]) for a, b in zip(sides[::2], sides[1::2])] + ([sides[-1]] if len(sides) % 2 else [])
        made = pa.array([len(sides[0][1])], pa.int64()) if counts_only else _ids_array([sides[0][1]])
        return pa.table({"text_hash": table["text_hash"].slice(0, 1), "made": made})

    stitched = ranges.mapInArrow(parts, pieces).groupBy("text_hash").applyInArrow(stitch, f"text_hash string, made {'bigint' if counts_only else 'array<int>'}")
    joined = long.select("key", "text_hash").join(stitched, "text_hash").select("key", F.col("made").alias("n_tokens" if counts_only else "ids"))
    return done.unionByName(joined).withColumnRenamed("key", key)
