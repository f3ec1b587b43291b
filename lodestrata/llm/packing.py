"""Filling fixed-capacity containers with items.

The items' sizes are brought to a histogram, which is bounded by the capacity
and all that the planner sees. Shallow combinations of sizes that fill a
container to within a window are enumerated, non-negative least squares finds
how often to repeat each so that together they use up the histogram, the
counts are rounded down to what there is, and the residual goes best fit
decreasing into the room that is left and into new containers. The plan says
which ranks of each size go where; items get their ranks by a distributed
count, so no size is ever gathered in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.tokens import VOCABULARY, encode_corpus
from lodestrata.session import cut

#: Tokens of a container.
CAPACITY = 2048
#: Sizes in which combinations are enumerated, over the capacity.
GRAIN = 256
#: Items of one size are ranked in so many buckets, so that a frequent size is no hot group.
BUCKETS = 256


def nnls(columns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises the weighted |A x - counts|, by accelerated projected gradient.

    ``columns`` has the row numbers of each column's ones; a missing one points
    at the last row of ``counts``, which has no weight.
    """
    n = len(counts)
    weight = 1.0 / np.sqrt(np.maximum(counts, 1.0))
    weight[-1] = 0.0
    forward = lambda x: np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), n)
    back = lambda y: y[columns].sum(axis=1)
    v = np.ones(len(columns))
    for _ in range(20):
        v = back(weight**2 * forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(np.linalg.norm(back(weight**2 * forward(v))), 1e-12) / 1.05
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(weight**2 * (forward(y) - counts)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def combinations(sizes: np.ndarray, room: int, window: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` of the sizes, largest first, with a sum in [room - window, room]."""
    have, out = sorted(map(int, sizes)), []
    present = set(have)
    for total in range(room - window, room + 1):
        if total in present:
            out.append((total,))
        for a in have:
            b = total - a
            if depth >= 2 and b in present and b <= a:
                out.append((a, b))
            if depth >= 3:
                out.extend((a, b, total - a - b) for b in have if b <= a and 0 < total - a - b <= b and total - a - b in present)
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, window: int = 1) -> list[tuple[int, tuple[int, ...]]]:
    """(number of containers, sizes in each) that use up the histogram of sizes from 1 to ``capacity``."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("sizes must be from 1 to the capacity")
    unit = max(1, capacity // grain)
    room = capacity // unit
    binned: Counter = Counter()
    members: dict[int, list[int]] = {}
    for size in sorted(left):
        b = -(-size // unit)
        binned[b] += left[size]
        members.setdefault(b, []).append(size)
    groups: list[tuple[int, tuple[int, ...]]] = []
    combos = combinations(np.array([b for b in binned if b <= room]), room, window)
    if combos:
        columns = np.full((len(combos), 3), room + 1)
        for n, c in enumerate(combos):
            columns[n, : len(c)] = c
        counts = np.zeros(room + 2)
        for b, n in binned.items():
            if b <= room:
                counts[b] = n
        x = nnls(columns, counts)
        for n in np.argsort(-x, kind="stable"):
            times = int(x[n])
            if times < 1:
                break
            need = Counter(combos[n])
            times = min([times, *(binned[b] // m for b, m in need.items())])
            while times > 0:  # the sizes at hand, largest first, in runs of equal containers
                taken: Counter = Counter()
                concrete = []
                run = times
                for b in combos[n]:
                    size = next(s for s in reversed(members[b]) if left[s] > taken[s])
                    taken[size] += 1
                    concrete.append(size)
                run = min([run, *(left[s] // m for s, m in taken.items())])
                for s, m in taken.items():
                    left[s] -= run * m
                for b, m in need.items():
                    binned[b] -= run * m
                groups.append((run, tuple(concrete)))
                times -= run
    return _best_fit(left, groups, capacity)


def _best_fit(left: Counter, groups: list[tuple[int, tuple[int, ...]]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The residual, largest first, into the tightest room that holds it, else into new containers."""
    open_by_room: dict[int, list[list]] = {}
    for n, sizes in groups:
        open_by_room.setdefault(capacity - sum(sizes), []).append([n, sizes])
    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[size]
        while n > 0:
            room = min((r for r, g in open_by_room.items() if r >= size and g), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(n, each)
                for count, copies in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        open_by_room.setdefault(capacity - copies * size, []).append([count, (size,) * copies])
                break
            group = open_by_room[room][-1]
            used = min(n, group[0])
            group[0] -= used
            if not group[0]:
                open_by_room[room].pop()
            open_by_room.setdefault(room - size, []).append([used, (*group[1], size)])
            n -= used
    return sorted(((n, sizes) for g in open_by_room.values() for n, sizes in g if n), key=lambda g: (tuple(-s for s in g[1]), g[0]))


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: size, first rank, container of the first rank, slot, offset; sorted by size and rank."""
    used: Counter = Counter()
    rows, base = [], 0
    for n, sizes in plan:
        at = 0
        for slot, size in enumerate(sizes):
            rows.append((size, used[size], base, slot, at))
            used[size] += n
            at += size
        base += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "container", "slot", "offset"), table.T))


def items_of(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, part_start, size): an item larger than a container as full parts and a rest; others whole."""
    n = F.col(size)
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / capacity).cast("int") - 1))).alias("part")
    return sizes.select(key, n.alias("n"), parts).select(key, "part", (F.col("part").cast("bigint") * capacity).alias("part_start"), F.least(F.lit(capacity), F.col("n") - F.col("part").cast("bigint") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, part_start, size, container_id, slot, container_offset): where each item goes.

    No item is divided unless it is larger than a container. Items of size 0
    or null take no room: their container, slot and offset are null. Items are
    told apart by key; rows that come twice are two items. ``sizes`` should be
    cheap to read again (see ``cut``); ids of containers run from 0 without
    gaps. Ties in size go by a hash of the key.
    """
    items = items_of(sizes.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("bigint")), key, size, capacity)
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64(key, "part"), F.lit(BUCKETS)).cast("int"))
    real = bucketed.filter("size > 0")
    counts = real.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    plan = plan_packing({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "part")) - 1
    ranked = real.withColumn("within", within).join(starts, ["size", "bucket"]).select(key, "part", "part_start", "size", (F.col("start") + F.col("within")).alias("rank"))
    handle = sizes.sparkSession.sparkContext.broadcast(slots(plan))
    wide = 1 << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = handle.value
        starts_at = table["size"] * wide + table["rank"]
        for batch in batches:
            sizes_, ranks = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            at = np.searchsorted(starts_at, sizes_ * wide + ranks, side="right") - 1
            new = [pa.array(table["container"][at] + ranks - table["rank"][at], pa.int64()), pa.array(table["slot"][at].astype(np.int32), pa.int32()), pa.array(table["offset"][at].astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(4)), *new], [key, "part", "part_start", "size", "container_id", "slot", "container_offset"])

    kind = sizes.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"`{key}` {kind}, part int, part_start bigint, size int, container_id bigint, slot int, container_offset int")
    none = bucketed.filter("size = 0").select(key, "part", "part_start", "size", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("container_offset"))
    return placed.unionByName(none)


def pack_documents(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of the texts' sizes in tokens of byte_bpe_50k. The sizes are counted once and kept on shared storage."""
    return pack(cut(encode_corpus(documents, vocabulary=vocabulary, counts_only=True)), capacity=capacity)


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, n_tokens, n_unused)."""
    return packed.filter("container_id is not null").groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("n_tokens"), (F.lit(capacity) - F.sum("size")).alias("n_unused"))
