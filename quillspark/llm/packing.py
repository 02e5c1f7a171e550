"""Filling containers of fixed capacity: bounded-space online packing.

Each partition keeps a fixed number of open containers. An item goes where it leaves the least room; where
none has room and all places are open, the fullest is closed and a new one opened. An item larger than the
capacity is cut into full containers and a rest; nothing else is cut. What a partition leaves open is merged
over fewer and fewer partitions, whole containers being the items then, until one partition ends the rest.

Items of size 0 (null and empty texts) take no room: they come out with container null. Each row of the
input is an item, repeated ids too. An empty table gives no rows. The containers' ids are unique numbers
without meaning of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

OPEN = 64
FAN_IN = 16
_ITEMS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
_ROW = "container long, used int, closed boolean, items array<struct<doc_id:long,start:int,n:int>>"


class Open:
    """The open containers, sorted by free room."""

    def __init__(self, capacity: int, places: int, first_id: int):
        self.capacity, self.places, self.next = capacity, places, first_id
        self.free: list[tuple[int, int]] = []  # (room, container)
        self.items: dict[int, list] = {}

    def put(self, size: int, items: list):
        """Places items of the given size together; yields what gets closed."""
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, c = self.free.pop(i)
        else:
            if len(self.free) >= self.places:
                yield self.close(0)
            room, c = self.capacity, self.next
            self.next += 1
            self.items[c] = []
        self.items[c] += items
        room -= size
        insort(self.free, (room, c))
        if room == 0:
            yield self.close(bisect_left(self.free, (0, c)))

    def close(self, i: int, closed: bool = True):
        room, c = self.free.pop(i)
        return c, self.capacity - room, closed, self.items.pop(c)

    def rest(self, closed: bool):
        while self.free:
            yield self.close(len(self.free) - 1, closed)


def _batch(rows):
    c, used, closed, items = zip(*rows)
    docs = [[{"doc_id": d, "start": s, "n": n} for d, s, n in x] for x in items]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(used, pa.int32()), pa.array(closed, pa.bool_()), pa.array(docs, _ITEMS)], names=["container", "used", "closed", "items"])


def _emit(rows, step=512):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == step:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _first(capacity, places):
    def run(batches):
        box = Open(capacity, places, TaskContext.get().partitionId() << 40)

        def rows():
            for batch in batches:
                for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not n:
                        yield None, 0, True, [(doc, 0, 0)]
                        continue
                    start = 0
                    while n - start >= capacity:
                        yield from Open(capacity, 1, box.next).put(capacity, [(doc, start, capacity)])
                        box.next += 1
                        start += capacity
                    if n > start:
                        yield from box.put(n - start, [(doc, start, n - start)])
            yield from box.rest(False)

        yield from _emit(rows())

    return run


def _merge(capacity, places, level, last):
    def run(batches):
        box = Open(capacity, places, level << 56 | TaskContext.get().partitionId() << 40)

        def rows():
            for batch in batches:
                for used, items in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                    yield from box.put(used, [(x["doc_id"], x["start"], x["n"]) for x in items])
            yield from box.rest(last)

        yield from _emit(rows())

    return run


def pack(sizes: DataFrame, capacity: int = 2048, places: int = OPEN) -> DataFrame:
    """sizes(doc_id, n_tokens) -> container, position, doc_id, start, n_tokens."""
    if capacity < 1 or places < 1:
        raise ValueError("capacity and places must be positive")
    held = cut(sizes.select("doc_id", "n_tokens").mapInArrow(_first(capacity, places), _ROW))
    done, rest, n, level = held.where("closed"), held.where("not closed"), max(1, held.rdd.getNumPartitions()), 0
    while True:
        n, level = -(-n // FAN_IN), level + 1
        merged = rest.repartition(n, F.xxhash64("container")).sortWithinPartitions(F.desc("used"), "container").mapInArrow(_merge(capacity, places, level, n == 1), _ROW)
        if n > 1:
            merged = cut(merged)
        done, rest = done.unionAll(merged.where("closed")), merged.where("not closed")
        if n == 1:
            break
    return done.select("container", F.posexplode("items").alias("position", "x")).select("container", "position", "x.doc_id", "x.start", F.col("x.n").alias("n_tokens"))


def audit(packed: DataFrame, sizes: DataFrame, capacity: int = 2048, fill: float = 0.97) -> DataFrame:
    """One row: items, and of them how many have other sums than their size or are split though they would fit;
    containers over capacity; whether the containers are filled to at least `fill`, the last of all left out."""
    parts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("times"))
    both = whole.join(parts, "doc_id", "full_outer")
    items = both.agg(
        F.sum("times").alias("items"),
        F.count_if(~F.col("packed").eqNullSafe(F.col("n"))).alias("wrong_sums"),
        F.count_if((F.col("n") <= capacity * F.col("times")) & (F.col("times") == 1) & (F.col("parts") > 1)).alias("split_small"),
    )
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    boxes = used.agg(F.count_if(F.col("used") > capacity).alias("over_capacity"), (F.coalesce(F.sum("used"), F.lit(0)) >= (F.count(F.lit(1)) - 1) * capacity * fill).alias("filled"))
    return items.select("items", "wrong_sums", "split_small", boxes.select("over_capacity").scalar().alias("over_capacity"), boxes.select("filled").scalar().alias("filled"))
