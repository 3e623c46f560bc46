"""Filling containers of fixed capacity: windows of several sizes, packed tier by tier over a histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.session import cut_lineage

#: Tokens per container, and the window sizes of the tiers.
CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
#: A window of a shorter tier has at most one part in so many left over.
SPARE = 64
#: Containers per step group.
GROUP = 64
#: Rows of one length are numbered in blocks of about so many.
BLOCK = 200_000


Items = list[tuple[int, int]]


@dataclass
class Pattern:
    """`count` containers that are filled alike: windows of `tier` tokens, given as (how many, items of each)."""

    tier: int
    count: int
    windows: list[tuple[int, Items]]

    @property
    def tokens(self) -> int:
        return sum(n * x * k for n, items in self.windows for x, k in items)


class _Supply:
    """How many documents of each length are left."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {x: n for x, n in histogram.items() if n > 0}
        self.lengths = sorted(self.left)

    def filled(self, length: int, window: int) -> Items:
        """A window that begins with one document of a length; each gap takes the longest documents that fit."""
        items, room, used = [(length, 1)], window - length, {length: 1}
        top = bisect_right(self.lengths, room)
        while top:
            x = self.lengths[top - 1]
            k = min(room // x, self.left[x] - used.get(x, 0))
            if k > 0:
                items.append((x, k))
                used[x] = used.get(x, 0) + k
                room -= k * x
            top = min(top - 1, bisect_right(self.lengths, room))
        return items

    def take(self, items: Items, count: int) -> None:
        for x, k in items:
            self.left[x] -= k * count
            if not self.left[x]:
                del self.left[x]
                self.lengths.pop(bisect_left(self.lengths, x))


def _often(items: Items, left: dict[int, int]) -> int:
    """How often a window can be made."""
    need = Counter()
    for x, k in items:
        need[x] += k
    return min(left[x] // k for x, k in need.items())


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Items]]:
    """(containers, items of each): the lengths, longest first, go where the least room is left that fits them."""
    rooms: list[int] = []
    open_by_room: dict[int, list[tuple[int, Items]]] = {}
    done: list[tuple[int, Items]] = []

    def put(count: int, items: Items, room: int) -> None:
        if count and not room:
            done.append((count, items))
        elif count:
            if room not in open_by_room:
                insort(rooms, room)
            open_by_room.setdefault(room, []).append((count, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                put(full, [(length, each)], capacity - each * length)
                put(min(rest, 1), [(length, rest)], capacity - rest * length)
                break
            room = rooms[i]
            count, items = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
            each = min(room // length, left)
            used = min(count, left // each)
            put(count - used, items, room)
            put(used, [*items, (length, each)], room - each * length)
            left -= used * each
    return done + [x for room in rooms for x in open_by_room[room]]


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns of containers that hold the whole histogram of lengths from 1 to `capacity`.

    A document belongs to the smallest tier that holds it. Tier by tier, from the longest window down, each
    document opens a window of its tier, and the gap behind it is filled from the shorter tiers, longest
    fitting documents first. A window of a shorter tier that stays emptier than one part in SPARE is not
    worth its size: its documents are set aside. Windows of a tier then fill containers of that tier
    alone. What was set aside, and windows too few for a container, are packed by best fit into windows
    of the whole capacity. The work depends on the number of distinct lengths, not on that of documents.
    """
    bounds = sorted({t for t in tiers if t < capacity} | {capacity})
    if any(capacity % t for t in bounds):
        raise ValueError("the capacity has to be a multiple of each tier")
    supply, aside, out = _Supply(histogram), Counter(), []
    for lower, tier in reversed(list(zip([0, *bounds], bounds))):
        windows: list[tuple[int, Items]] = []
        while (top := bisect_right(supply.lengths, tier)) and supply.lengths[top - 1] > lower:
            length = supply.lengths[top - 1]
            items = supply.filled(length, tier)
            if tier < capacity and sum(x * k for x, k in items) * SPARE < tier * (SPARE - 1):
                aside[length] += supply.left[length]
                supply.take([(length, 1)], supply.left[length])
                continue
            count = _often(items, supply.left)
            supply.take(items, count)
            windows.append((count, items))
        each, odd = capacity // tier, []
        for count, items in windows:
            if count >= each:
                out.append(Pattern(tier, count // each, [(each, items)]))
            odd.extend([(1, items)] * (count % each))
        whole = len(odd) // each * each
        out.extend(Pattern(tier, 1, odd[i : i + each]) for i in range(0, whole, each))
        for _, items in odd[whole:]:
            for x, k in items:
                aside[x] += k
    out.extend(Pattern(capacity, count, [(1, items)]) for count, items in _best_fit(aside, capacity))
    return out


def _slots(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows of (first ordinal, items per container, first container, items per window, first window)."""
    out: dict[int, list[tuple[int, ...]]] = {}
    given: Counter = Counter()
    container = 0
    for p in plan:
        at_window = 0
        for n, items in p.windows:
            for length, k in items:
                out.setdefault(length, []).append((given[length], n * k, container, k, at_window))
                given[length] += n * k * p.count
            at_window += n
        container += p.count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, start_token, tokens): one row a document; those above the capacity in full pieces and a rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).alias("length"))


def pack_documents(counts: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(id, piece, start_token, tokens, tier, container, window, step_group, room) for every document of (id, tokens).

    Only documents above the capacity are split. A container holds windows of its tier, numbered from 0;
    room is what the whole container has left. The plan is made on the driver from the histogram of
    lengths, whose size is bounded by the capacity and does not grow with the data; a document finds its
    container from its length and its ordinal among the documents of that length. Ordinals are numbered
    within (length, hash block), so a length that a third of all documents have is never sorted in one
    task, and from the ids alone, so a recomputed task gives the same ones. The containers of a tier are
    dealt to its own step groups in turn, in order of their fill, so a step has windows of one size and
    the groups of a tier hold equally many tokens up to one container. Empty and null texts have 0 tokens
    and are spread over the containers. Repeated rows are packed each. `counts` is written to the shared
    folder once, since tokenizing is the costly part.
    """
    spark = counts.sparkSession
    counts = cut_lineage(counts.select("id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    own = _pieces(counts, capacity)
    total = own.count()
    blocks = max(1, -(-total // block))
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("int"))
    sizes = own.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).filter("length > 0").collect()}
    plan = sorted(plan_containers(histogram, capacity, tiers), key=lambda p: (p.tier, -p.tokens))
    containers = sum(p.count for p in plan)
    of_tier = Counter()
    for p in plan:
        of_tier[p.tier] += p.count
    # Per pattern: first container, room, tier, first container of the tier, groups of the tier, groups before it.
    rows, at, begin, before = [], 0, {}, {}
    for p in plan:
        if p.tier not in begin:
            before[p.tier] = sum(-(-of_tier[t] // group) for t in begin)
            begin[p.tier] = at
        rows.append((at, capacity - p.tokens, p.tier, begin[p.tier], -(-of_tier[p.tier] // group), before[p.tier]))
        at += p.count
    shared = spark.sparkContext.broadcast((_slots(plan), np.array(rows or [(0, capacity, capacity, 0, 1, 0)], np.int64)))

    up_to = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "block", F.coalesce(up_to, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "block").orderBy("id", "piece"))
    placed = own.withColumn("within", within).join(offsets, ["length", "block"])
    placed = placed.select("id", "piece", "start_token", "length", (F.col("before") + F.col("within") - 1).alias("ordinal"))

    fields = [("id", "long"), ("piece", "int"), ("start_token", "long"), ("tokens", "long"), ("tier", "int"), ("container", "long"), ("window", "int"), ("step_group", "long"), ("room", "long")]
    arrow = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, patterns = shared.value
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            ordinal = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            container = np.where(length == 0, ordinal % max(1, containers), 0)
            window = np.zeros(len(length), np.int64)
            for x in np.unique(length[length > 0]):
                of = slots[int(x)]
                mine = length == x
                row = of[np.searchsorted(of[:, 0], ordinal[mine], side="right") - 1]
                nth, inside = np.divmod(ordinal[mine] - row[:, 0], row[:, 1])
                container[mine] = row[:, 2] + nth
                window[mine] = row[:, 4] + inside // row[:, 3]
            p = patterns[np.searchsorted(patterns[:, 0], container, side="right") - 1]
            step = p[:, 5] + (container - p[:, 3]) % p[:, 4]
            made = [batch.column(0), batch.column(1), batch.column(2), length, p[:, 2], container, window, step, p[:, 1]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32 if f.type == pa.int32() else np.int64)) for c, f in zip(made, arrow)], schema=arrow)

    return placed.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
