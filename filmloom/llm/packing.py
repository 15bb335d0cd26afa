"""Packing of texts into containers of fixed token capacity along a space-filling curve.

Texts become points in few dimensions (hashed token vectors), points become keys
on a Hilbert curve, and the texts are range-sorted by key, so that neighbours in a
container are alike. Each range is packed as it streams by, in blocks of a few
containers: larger texts first, each into the open container it fills best, and
containers that are nearly full are closed. Small blocks and few open containers
keep neighbours together, at the price of a little unused space (fill_report tells
both). A text is split only if it alone exceeds a container;
its full pieces are containers of their own and its rest is packed like a text.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm.tokens import DIMENSIONS, VOCABULARY, measure
from filmloom.session import stage

CAPACITY = 2048
BITS = 12
RANGE_TOKENS = 8_000_000
BLOCK_CONTAINERS = 8
OPEN_CONTAINERS = 8
FULL = 0.985


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (n x d, each below 2**bits), by transposing bits
    after undoing the rotations level by level (J. Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Packer:
    """Open containers sorted by free space; items go where they leave least."""

    def __init__(self, capacity: int, prefix: str):
        self.capacity, self.prefix, self.number = capacity, prefix, 0
        self.free: list[tuple[int, int]] = []
        self.items: dict[int, list[int]] = {}

    def put(self, item: int, size: int) -> None:
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, c = self.free.pop(at)
        else:
            space, c = self.capacity, self.number
            self.number += 1
            self.items[c] = []
        self.items[c].append(item)
        bisect.insort(self.free, (space - size, c))

    def close(self, most_open: int, full: float) -> list[tuple[str, list[int]]]:
        """Take out the containers filled from `full` on, and the fullest of the rest until most_open are left."""
        limit = self.capacity * (1 - full)
        n = bisect.bisect_right(self.free, (int(limit), self.number))
        n = max(n, len(self.free) - most_open)
        gone, self.free = self.free[:n], self.free[n:]
        return [(f"{self.prefix}-{c:07d}", self.items.pop(c)) for _, c in gone]


def pieces_of(n_tokens: int, capacity: int) -> list[int]:
    """Sizes of the pieces of a text: itself, or full containers and a rest."""
    if n_tokens <= capacity:
        return [n_tokens]
    full, rest = divmod(n_tokens, capacity)
    return [capacity] * full + ([rest] if rest else [])


def along_curve(documents: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, curve): every text with its size and its position on the Hilbert curve."""
    points = stage(measure(documents, [key], path, vectors=True))
    names = [f"v{k}" for k in range(DIMENSIONS)]
    stats = points.where("n_tokens > 0").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop)]).collect()[0]
    middle = np.array([stats[f"avg_{c}"] or 0.0 for c in names])
    spread = np.array([stats[f"stddev_pop_{c}"] or 1.0 for c in names])
    kind = dict(points.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = (pdf[names].to_numpy(dtype=np.float64) - middle) / np.where(spread > 0, spread, 1.0)
            share = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))  # about the normal distribution function: even cells
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pd.DataFrame({key: pdf[key], "n_tokens": pdf["n_tokens"], "curve": hilbert_keys(cells, BITS)})

    return points.mapInPandas(run, f"`{key}` {kind}, n_tokens long, curve long")


def pack(documents: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """One row per piece: container_id, key, piece, start_token, n_tokens, n_pieces, curve (the text's place on the curve).

    Every text with a token is in the result exactly once, or once per piece; texts without tokens need no container and
    are left out. Copies share a curve position; the range sort parts them by key, so no range grows with them.
    """
    return pack_placed(stage(along_curve(documents, key, path).where("n_tokens > 0")), key, capacity)


def pack_placed(placed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pack() of texts (key, n_tokens, curve) that have their place already."""
    total = placed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).collect()[0].t
    ranges = max(1, -(-int(total) // RANGE_TOKENS))
    kind = dict(placed.dtypes)[key]
    schema = f"container_id string, `{key}` {kind}, piece int, start_token long, n_tokens long, n_pieces int, curve long"
    columns = ["container_id", key, "piece", "start_token", "n_tokens", "n_pieces", "curve"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, f"{TaskContext.get().partitionId():06d}")
        rows: dict[int, tuple] = {}
        block: list[tuple[int, int]] = []
        serial, waiting = 0, 0

        def flush(most_open: int) -> list[tuple]:
            nonlocal waiting
            for size, item in sorted(block, key=lambda b: (-b[0], b[1])):
                packer.put(item, size)
            block.clear()
            waiting = 0
            return [(c, *rows.pop(i)) for c, items in packer.close(most_open, FULL) for i in sorted(items)]

        for pdf in batches:
            out = []
            for k, n, at in zip(pdf[key], pdf["n_tokens"], pdf["curve"], strict=True):
                sizes = pieces_of(int(n), capacity)
                start = 0
                for p, size in enumerate(sizes):
                    rows[serial] = (k, p, start, size, len(sizes), at)
                    block.append((size, serial))
                    serial += 1
                    start += size
                    waiting += size
                if waiting >= BLOCK_CONTAINERS * capacity:
                    out += flush(OPEN_CONTAINERS)
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = flush(0)
        if out:
            yield pd.DataFrame(out, columns=columns)

    sorted_ = placed.repartitionByRange(ranges, "curve", key).sortWithinPartitions("curve", key)
    return sorted_.mapInPandas(run, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, mean fill, how many containers a packing cannot do without, and how near the
    texts of a container are: their mean distance from its middle along the curve, and that from the middle of all texts
    (what an order by chance comes to), as shares of the curve."""
    share = F.col("curve") / float(1 << (BITS * DIMENSIONS))
    by = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.avg(share).alias("middle"))
    all_ = packed.agg(F.avg(share).alias("middle_of_all"))  # one row
    near = packed.join(by.select("container_id", "middle"), "container_id").crossJoin(F.broadcast(all_))
    distance = near.agg(F.avg(F.abs(share - F.col("middle"))).alias("mean_distance"), F.avg(F.abs(share - F.col("middle_of_all"))).alias("mean_distance_by_chance"))
    fill = by.agg(
        F.count("*").alias("n_containers"),
        F.sum("pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        F.avg(F.col("used") / capacity).alias("mean_fill"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
    return fill.crossJoin(distance)  # one row each
