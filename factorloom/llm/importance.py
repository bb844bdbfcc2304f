"""Target-distribution importance resampling over hashed n-grams, with an exact cut.

A document's features are its words and pairs of neighbouring words, by crc32 in BUCKETS buckets. An array of gains,
one a bucket, compares how often the benchmark and the documents have it; a document's weight is the mean gain of
its features. Noise from a hash of the id makes the draw of the highest scores a random draw by weight.

The lowest drawn key is found by weighted medians of medians: in each pass every task gives the median of its remaining
keys on either side of the last pivot, and how many there are; the next pivot is the median of these, weighted by those numbers, so a
pass discards a guaranteed fraction. When most keys are discarded the rest is written anew, so all passes together
read the keys a few times. Only the drawn rows are sorted.

Rows: a null text is the empty one, which has no features and weight 0; a row with a null id has a null score and is not
drawn; repeated rows each count, and may be drawn one by one; an empty table gives no rows; an empty benchmark counts as 0
features. Only doc_id and text are read, and text of the benchmark.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common, words

BUCKETS = 10_000
#: Documents of fewer words are not drawn; of the others, this share in per cent is.
LEAST_WORDS = 20
PER_CENT = 25
SEED = 7
#: Remaining keys, at most, among which the driver picks the cut; more are halved by passes.
LAST_KEYS = 4_096
#: The remaining keys are written anew once they are this fraction of the last table.
REWRITE = 8
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\n")

RESULT = "doc_id long, n_features long, weight long, score long, rank long"

# ---- crc32 of joined strings from those of their parts


@lru_cache(maxsize=1)
def _byte_steps() -> np.ndarray:
    """The state of a crc32 after one zero byte, for each low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _applied(images: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of the single bits."""
    out = np.zeros_like(c)
    for bit in range(32):
        out ^= np.where((c >> np.uint32(bit)) & np.uint32(1), images[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _doubled(power: int) -> np.ndarray:
    """Images of the single bits after 2^power zero bytes."""
    if power == 0:
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return (one >> np.uint32(8)) ^ _byte_steps()[one & 255]
    half = _doubled(power - 1)
    return _applied(half, half)


@lru_cache(maxsize=4096)
def _shift_table(size: int) -> np.ndarray:
    """What `size` zero bytes make of each of the four bytes of a crc: 4 x 256."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()
    for power in range(size.bit_length()):
        if size >> power & 1:
            c = _applied(_doubled(power), c)
    return c


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of a + b from crc32(a), crc32(b) and the bytes of b."""
    known, at = np.unique(sizes, return_inverse=True)
    table = np.concatenate([_shift_table(int(k)) for k in known]) if len(known) else np.zeros(0, np.uint32)
    base = at.astype(np.int64) * 1024
    out = second.copy()
    for k in range(4):
        out ^= table[base + (k * 256 + ((first >> np.uint32(8 * k)) & np.uint32(255)))]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, the text of each, and the number of words of each text."""
    codes, offsets, chunks = words.chunked(texts)
    values, lens, names = words.cut(words.listed(pc.ascii_lower(chunks)), WORDS)
    coded = words.expand(codes, offsets, values, lens)
    raw = [w.encode() for w in names]
    own = np.array([zlib.crc32(w) for w in raw], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in own.tolist()], np.uint32)
    size = np.array([len(w) for w in raw], np.int64)
    w, row, n = coded.values, coded.row_of(), coded.lengths()
    pair = np.flatnonzero(row[1:] == row[:-1])
    a, b = w[pair], w[pair + 1]
    crc = np.concatenate([own[w], joined_crc(spaced[a], own[b], size[b])])
    return (crc % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([row, row[pair]]), n


def bucket_counts(table: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                total += np.bincount(features(common.as_text(part.column("text")))[0], minlength=BUCKETS)
                common.tidy()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    common.bounded(table.sparkSession)
    got = table.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from its counts in the documents and in the target."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            bucket, row, n = features(common.as_text(part.column("text")))
            count = np.where(n > 0, 2 * n - 1, 0)
            # floats hold these sums exactly: a gain is under 2^16, a text has under 2^31 words
            total = np.bincount(row, weights=gain[bucket], minlength=len(n)).astype(np.int64)
            return pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(count), pa.array(total // np.maximum(count, 1))], ["doc_id", "n_words", "n_features", "weight"])

        return kernel

    each = common.map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", make, "doc_id long, n_words long, n_features long, weight long")
    return each.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


# ---- selection


Key = tuple[int, ...]


def weighted_median(found: list[tuple[Key, int]]) -> Key:
    """The least key such that keys up to it have at least half of all weight."""
    total, seen = sum(n for _, n in found), 0
    for key, n in sorted(found):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def lexicographic(batch: np.ndarray, pivot: Key) -> np.ndarray:
    """Which rows of keys are at or before the pivot."""
    below, equal = np.zeros(len(batch), bool), np.ones(len(batch), bool)
    for k, p in enumerate(pivot):
        below |= equal & (batch[:, k] < p)
        equal &= batch[:, k] == p
    return below | equal


def middle(keys: np.ndarray) -> Key:
    """The lower median of rows of keys."""
    order = np.lexsort(keys.T[::-1])
    return tuple(keys[order[(len(keys) - 1) // 2]].tolist())


def medians(table: DataFrame, names: list[str], pivot: Key | None) -> list[tuple[bool, Key, int]]:
    """For each task and side of the pivot: the weighted median of its batches' medians, and how many keys there are."""
    fields = ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[tuple[Key, int]]] = {True: [], False: []}
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in names])
            low = np.ones(len(keys), bool) if pivot is None else lexicographic(keys, pivot)
            for side, own in ((True, keys[low]), (False, keys[~low])):
                if len(own):
                    found[side].append((middle(own), len(own)))
        rows = [(side, *weighted_median(x), sum(n for _, n in x)) for side, x in found.items() if x]
        cols = list(zip(*rows, strict=True)) or [[] for _ in range(len(names) + 2)]
        yield pa.record_batch([pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["low", *names, "n"])

    got = table.select(*names).mapInArrow(run, f"low boolean, {fields}, n long").toArrow().to_pylist()
    return [(r["low"], tuple(r[c] for c in names), r["n"]) for r in got]


def within(names: list[str], key: Key, low: bool) -> Column:
    """Rows at or before a key in the order of the columns, or those after it."""
    row, at = F.struct(*names), F.struct(*(F.lit(k).cast("long").alias(c) for c, k in zip(names, key, strict=True)))
    return row <= at if low else row > at


def kth(table: DataFrame, names: list[str], k: int, folder: str, last: int = LAST_KEYS, rewrite: int = REWRITE) -> Key:
    """The k-th smallest of the distinct keys in the columns `names`, counted from 1."""
    left = held = table.count()
    rest, pivot, step = table, None, 0
    low: Key | None = None  # remaining keys are after this one
    high: Key | None = None  # and up to this one
    while left > last:
        sides = medians(rest, names, pivot)
        if pivot is not None:
            below = sum(n for side, _, n in sides if side)
            side = k <= below
            low, high = (low, pivot) if side else (pivot, high)
            k, left = (k, below) if side else (k - below, left - below)
            sides = [s for s in sides if s[0] == side]
            if left <= last:
                break
            rest = rest.where(within(names, pivot, side))
            if left * rewrite <= held:
                step += 1
                rest, held = common.written(rest, f"{folder}/{step}"), left
        pivot = weighted_median([(key, n) for _, key, n in sides])
    for key, side in ((low, False), (high, True)):
        if key is not None:
            rest = rest.where(within(names, key, side))
    few = rest.select(*names).toArrow()
    keys = np.column_stack([few[c].to_numpy() for c in names])
    return tuple(keys[np.lexsort(keys.T[::-1])[k - 1]].tolist())


def ranked(winners: DataFrame, names: list[str], folder: str) -> DataFrame:
    """Number the rows 1, 2, 3, ... in the order of the columns: dealt by range, sorted in each part, numbered by the sizes of the parts before."""
    at = F.monotonically_increasing_id()
    placed = common.written(winners.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_at", at), f"{folder}/sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r._part, r.n) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a part
    before, seen = [], 0
    for part, n in sizes:
        before.append((part, seen))
        seen += n
    starts = F.broadcast(winners.sparkSession.createDataFrame(before, "_part long, _before long"))
    return placed.join(starts, "_part").withColumn("rank", F.col("_before") + F.col("_pos") + 1)


def resample(docs: DataFrame, target: DataFrame, folder: str, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    # a number of the row tells rows of one id apart, so keys are distinct
    each = common.written(weighed(docs, gain).withColumn("_row", F.monotonically_increasing_id()).withColumn("_less", -F.col("score")), f"{folder}/weighed")
    names = ["_less", "doc_id", "n_features", "_row"]
    open_ = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    shown = ["doc_id", "n_features", "weight", "score"]
    drawn = per_cent * each.where(open_).count() // 100
    nothing = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return each.select(*shown, nothing)
    cut = kth(each.where(open_), names, drawn, f"{folder}/left")
    won = open_ & within(names, cut, True)
    winners = ranked(each.where(won), names, folder)
    return each.where(~F.coalesce(won, F.lit(False))).select(*shown, nothing).unionByName(winners.select(*shown, "rank"))
