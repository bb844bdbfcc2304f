"""Benchmark decontamination by size-partitioned containment search with minimum hashes.

An item of n word runs is contained in a document if the share of its runs found there reaches the
threshold. Items are partitioned by size; an item's sketch is its smallest hashes, and how many they
are follows from its size: of n runs at most n - ceil(t n) may be missing, so with `need` more
than that in the sketch, every containing document holds at least `need` sketch hashes. Documents of any
length are probed with all their runs, so a short item is found wherever it lies in a long document
and none is missed. Candidates are verified on the runs themselves.

Rows: null and empty texts match nothing; an item of fewer than five words counts as one run of that
length; repeated rows and ids are matched as rows of their own; a null id is carried as it is; an
empty table gives no rows. Only doc_id, item_id and the texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common, words

THRESHOLD = 0.8
#: Sketch hashes that a containing document must hold, where the item has so many runs.
NEED = 3
#: Text bytes of the items that are held in memory at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 32_000_000

MATCH = "doc_id long, item_id long, item_shingles long, shared long, containment double"
_FILTER_BITS = 22
#: Items whose runs a task keeps for the next document.
KEPT_RUNS = 10_000


def runs_of(text: str, width: int = words.WIDTH) -> set[str]:
    """The distinct word runs of a text; of all its words if they are fewer."""
    w = words.words_of(text)
    k = min(width, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


class Items:
    """Sketches of benchmark items by width of their runs and size class; an item's runs are made when it is a candidate."""

    def __init__(self, ids: list[int | None], texts: list[str], threshold: float = THRESHOLD):
        self.ids, self.texts, self.threshold = ids, texts, threshold
        self._runs: dict[int, frozenset[str]] = {}
        stream = words.hashed_words(pa.array(texts, pa.large_string()))
        self.width = np.minimum(words.WIDTH, stream.lengths())
        self.need = np.zeros(len(ids), np.int64)
        #: by width and size class: sorted hashes, the item of each
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            row, value, _ = words.counted(words.shingles(stream, width))
            own = self.width[row] == width
            row, value = row[own], value[own]
            item, first, n = np.unique(row, return_index=True, return_counts=True)
            must = np.ceil(threshold * n - 1e-9).astype(np.int64)
            self.need[item] = np.minimum(NEED, must)
            size_class = np.frexp(n)[1]
            kept = np.arange(len(row)) - np.repeat(first, n) < np.repeat(n - must + self.need[item], n)  # the smallest hashes
            row, value, size_class = row[kept], value[kept], np.repeat(size_class, n)[kept]
            for k in np.unique(size_class).tolist():
                of = np.flatnonzero(size_class == k)
                of = of[np.argsort(value[of], kind="stable")]
                self.parts[width, k] = (value[of], row[of])
        self.filters = {}
        for width in {w for w, _ in self.parts}:
            there = np.zeros(1 << _FILTER_BITS, bool)
            for (w, _), (h, _) in self.parts.items():
                if w == width:
                    there[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[width] = there

    def runs(self, item: int) -> frozenset[str]:
        """The distinct runs of an item."""
        if item not in self._runs:
            if len(self._runs) >= KEPT_RUNS:
                self._runs.clear()
            self._runs[item] = frozenset(runs_of(self.texts[item]))
        return self._runs[item]

    def candidates(self, stream: words.Ragged) -> list[tuple[int, int]]:
        """Rows and items that share enough sketch hashes."""
        out: list[tuple[int, int]] = []
        for width, there in self.filters.items():
            runs = words.shingles(stream, width)
            at = np.flatnonzero(there[runs.values >> np.uint64(64 - _FILTER_BITS)])
            value, row = runs.values[at], np.searchsorted(runs.offsets, at, side="right") - 1
            row, value, _ = words.counted(words.Ragged(value, np.searchsorted(row, np.arange(len(runs.offsets)))))
            for (w, _), (hashes, items) in self.parts.items():
                if w != width:
                    continue
                low, high = np.searchsorted(hashes, value, side="left"), np.searchsorted(hashes, value, side="right")
                found, _ = words.gather(items, low, high - low, np.arange(len(value)))
                pairs, count = np.unique(np.stack([np.repeat(row, high - low), found]), axis=1, return_counts=True)
                good = count >= self.need[pairs[1]]
                out += list(zip(*pairs[:, good].tolist(), strict=True))
        return sorted(out)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """Row, item and number of shared runs of each contained item."""
        out, held, last = [], set(), None
        for row, item in self.candidates(words.hashed_words(texts)):
            width = int(self.width[item])
            if (row, width) != last:
                held, last = runs_of(texts[row].as_py(), width), (row, width)
            shared = len(self.runs(item) & held)
            if shared >= math.ceil(self.threshold * len(self.runs(item)) - 1e-9):
                out.append((row, item, shared))
        return out


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about so many bytes of text."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def load(block: DataFrame, threshold: float) -> Items:
    rows = block.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).toArrow()
    return Items(rows["item_id"].to_pylist(), rows["text"].to_pylist(), threshold)


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document and item it contains: doc_id, item_id, item_shingles, shared, containment.

    Items are broadcast block by block, each of a bounded size, with sketches but not all runs; the documents
    are read once a block.
    """
    out = None
    for block in blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(load(block, threshold))

        def make(held=held) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
                own, ids = held.value, part.column("doc_id").to_pylist()
                found = own.matches(common.as_text(part.column("text")))
                size = [len(own.runs(i)) for _, i, _ in found]
                return pa.record_batch(
                    [pa.array([ids[r] for r, _, _ in found], pa.int64()), pa.array([own.ids[i] for _, i, _ in found], pa.int64()), pa.array(size, pa.int64()), pa.array([s for *_, s in found], pa.int64()), pa.array([s / n for (*_, s), n in zip(found, size, strict=True)], pa.float64())],
                    ["doc_id", "item_id", "item_shingles", "shared", "containment"],
                )

            return kernel

        part = common.map_text(docs.select("doc_id", "text"), "text", make, MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, in all their columns."""
    for block in blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(load(block, threshold))

        def make(held=held) -> Callable[[pa.Array], pa.Array]:
            def keep(texts: pa.Array) -> pa.Array:
                clean = np.ones(len(texts), bool)
                clean[[r for r, _, _ in held.value.matches(texts)]] = False
                return pa.array(clean)

            return keep

        docs = common.kept(docs, make)
    return docs
