"""Near copies by ProbMinHash, banding and verification.

A text is the weighted set of its runs of five words; a run's weight is 1 + ln(times). ProbMinHash lets
every run arrive by a Poisson process whose rate is its weight, each arrival at a random register; a
register keeps the run that came first, and a run stops as soon as its time is beyond all registers
of the text. Two texts agree in a register with their probability Jaccard similarity. A text that repeats
runs has a second set of registers with all weights 1, which agree with those of another text, or with the
only ones of a text without repeats, by plain Jaccard similarity. Bands of registers give candidates, which
are verified on all runs: texts are linked if their probability Jaccard or their plain Jaccard similarity
reaches the threshold. Classes are the connected components.

Texts of the same words are one node. A node's rank is how many others it meets over its buckets, so the
centre of a group of copies ranks above its members. First every node of a bucket is verified against
the bucket's hub, its node of highest rank: g - 1 pairs for g nodes. A bucket whose nodes are then all
in one component can add nothing to the classes and is done. In any other, the highest node outside the
bucket's largest component is verified against the nodes of other components, and in what is still not one
component every node outside the largest is. These two turns take only pairs that a bound leaves
possible: a node's runs are hashed to 1,024 bits by parity, and where two nodes' bits differ in h places,
at least h runs are in one of them only, which limits both similarities from above. The bound is exact, so
no link between components that a bucket could give is lost, and groups of copies are not spelled out in
pairs.

Rows: a null or empty text is a class of its own; a text without words is a copy of equal texts only;
texts of fewer than five words count as one run; a null id takes part, and its class is named by the
smallest id in it (null if there is none); repeated rows are copies; an empty table gives no rows. Only
doc_id and text are read. Nodes are named by 64-bit hashes and runs compared by 32 bits of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factorloom.llm import common, words

THRESHOLD = 0.8
BANDS = 40
ROWS = 7
#: 64-bit words of the parity bits that bound how many runs two nodes share.
BOUND_WORDS = 16
#: Up to so many ids (8 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000

_STEP = np.uint64(0xD1342543DE82EF95)


def registers(row: np.ndarray, run: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash registers (n_rows x m) of weighted runs; 0 where a row has no run."""
    first = np.full(n_rows * m, np.inf)
    kept = np.zeros(n_rows * m, np.uint64)
    most = np.full(n_rows, np.inf)
    time = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        bits = words.mix(run + np.uint64(turn * int(_STEP) % 2**64))
        time = time - np.log1p(-((bits >> np.uint64(11)).astype(float) * 2.0**-53)) / weight
        slot = row * m + (words.mix(bits + _STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        kept[slot[won]] = run[won]
        live = row[np.concatenate([[True], row[1:] != row[:-1]])]
        most[live] = first.reshape(n_rows, m)[live].max(axis=1)
        going = time < most[row]
        row, run, weight, time = row[going], run[going], weight[going], time[going]
    return kept.reshape(n_rows, m)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (n x bands) of the bands of registers."""
    regs = regs.reshape(len(regs), bands, rows)
    key = np.zeros((len(regs), bands), np.uint64)
    for k in range(rows):
        key = words.mix(key * _STEP + regs[:, :, k])
    return words.mix(key + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def row_key() -> Column:
    """64 bits of a row's id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row's node, band keys and runs: doc_id, _row_key, node, bands, runs (32 bits each, sorted), weights (empty: all 1)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(part.column("text"))
            n = len(texts)
            stream = words.hashed_words(texts)
            row, run, times = words.counted(words.shingles(stream))
            weight = 1 + np.log(times)
            key = band_keys(registers(row, run, weight, n, bands * rows), bands, rows)
            repeats = np.unique(row[times > 1])
            own = np.isin(row, repeats)
            plain = band_keys(registers(np.searchsorted(repeats, row[own]), run[own], np.ones(own.sum()), len(repeats), bands * rows), bands, rows)
            second = dict(zip(repeats.tolist(), plain, strict=True))
            short = (run >> np.uint64(32)).astype("<u4")
            alone = np.ones(len(row), bool)  # runs of a text whose 32 bits are equal count as one
            alone[1:] = (short[1:] != short[:-1]) | (row[1:] != row[:-1])
            row, short, light = row[alone], short[alone], weight[alone].astype("<f4")
            ends = np.searchsorted(row, np.arange(n + 1))
            nodes, keys, runs, weights = [], [], [], []
            for i in range(n):
                a, b = stream.offsets[i], stream.offsets[i + 1]
                if a < b:
                    digest = hashlib.blake2b(stream.values[a:b].tobytes(), digest_size=8).digest()
                else:
                    raw = texts[i].as_py()
                    digest = hashlib.blake2b(b"text" + raw.encode("utf-8", "surrogatepass"), digest_size=8).digest() if raw else None
                nodes.append(int.from_bytes(digest, "little", signed=True) if digest else None)
                keys.append((np.union1d(key[i], second[i]) if i in second else key[i]) if a < b else None)
                runs.append(short[ends[i] : ends[i + 1]].tobytes())
                own = light[ends[i] : ends[i + 1]]
                weights.append(b"" if (own == 1).all() else own.tobytes())
            return pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), part.column("_row_key"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(runs, pa.binary()), pa.array(weights, pa.binary())],
                ["doc_id", "_row_key", "node", "bands", "runs", "weights"],
            )

        return kernel

    return common.map_text(docs.select("doc_id", "text", row_key().alias("_row_key")), "text", make, "doc_id long, _row_key long, node long, bands array<long>, runs binary, weights binary")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two sorted sets of runs with weights."""
    both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(both)
    plain = len(both) / union if union else 0.0
    if not len(both) or ((wa == 1).all() and (wb == 1).all()):
        return plain, plain
    # sum over shared d of 1 / sum over d' of max(a'/a, b'/b): by rising ratio b/a, prefix sums of a and suffix sums of b
    only_a, only_b = wa.sum() - wa[at].sum(), wb.sum() - wb[bt].sum()
    x, y = wa[at].astype(float), wb[bt].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    last = np.searchsorted(ratio, ratio, side="right")
    upto = np.concatenate([[0], np.cumsum(x)])[last] + only_a
    beyond = y.sum() - np.concatenate([[0], np.cumsum(y)])[last] + only_b
    return plain, float((1 / (upto / x + beyond / y)).sum())


def _chosen(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with a table of ids: broadcast only if it is known to be small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def verify(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Both similarities of pairs (a, b) of nodes."""

    def compare(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("ra", "wa", "rb", "wb")]
            plain, prob = [], []
            for ra, wa, rb, wb in zip(*cols, strict=True):
                x, y = np.frombuffer(ra, "<u4"), np.frombuffer(rb, "<u4")
                j, p = similarity(x, np.frombuffer(wa, "<f4") if wa else np.ones(len(x), np.float32), y, np.frombuffer(wb, "<f4") if wb else np.ones(len(y), np.float32))
                plain.append(j)
                prob.append(p)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(plain, pa.float64()), pa.array(prob, pa.float64())], ["a", "b", "plain", "prob"])
            common.tidy()

    common.bounded(runs.sparkSession)
    left = runs.select(F.col("node").alias("a"), F.col("runs").alias("ra"), F.col("weights").alias("wa"))
    right = runs.select(F.col("node").alias("b"), F.col("runs").alias("rb"), F.col("weights").alias("wb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long, plain double, prob double")


def bounds(runs: DataFrame) -> DataFrame:
    """For nodes with runs and weights: number of runs, sum of weights, and parity bits of the runs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(r, "<u4") for r in batch.column("runs").to_pylist()]
            size = np.array([len(x) for x in each], np.int64)
            mass = [float(np.frombuffer(w, "<f4").sum()) if w else float(k) for w, k in zip(batch.column("weights").to_pylist(), size, strict=True)]
            flat, bits = np.concatenate([np.zeros(0, "<u4"), *each]).astype(np.int64), np.zeros(len(each) * BOUND_WORDS, np.uint64)
            word = np.repeat(np.arange(len(each)), size) * BOUND_WORDS + (flat >> 6) % BOUND_WORDS
            np.bitwise_xor.at(bits, word, np.uint64(1) << (flat % 64).astype(np.uint64))
            yield pa.record_batch([batch.column("node"), pa.array(size), pa.array(mass), pa.array(list(bits.view(np.int64).reshape(-1, BOUND_WORDS)), pa.list_(pa.int64()))], ["node", "size", "mass", "bits"])
            common.tidy()

    common.bounded(runs.sparkSession)
    return runs.select("node", "runs", "weights").mapInArrow(measure, "node long, size long, mass double, bits array<long>")


def possible(x: str, y: str, threshold: float) -> Column:
    """Whether the bounds of two sides let either similarity reach the threshold."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    apart = sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(BOUND_WORDS)), F.lit(0))
    both = F.least((n + m - apart) / 2, n, m)
    plain = both >= (threshold - 1e-9) * (n + m - both)
    share = lambda side: 1 - (F.col(f"{side}.size") - both) / F.col(f"{side}.mass")  # noqa: E731  runs of one side only weigh at least 1 each
    weighted = (F.col(f"{x}.mass") > n) | (F.col(f"{y}.mass") > m)
    return plain | (weighted & (share(x) >= threshold - 1e-6) & (share(y) >= threshold - 1e-6))


def rooted(sketched: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """Root of every node that is not its own: node, root. `sketched` must be a written table."""
    work = f"{folder}/work"
    like = (F.col("plain") >= threshold) | (F.col("prob") >= threshold)
    nodes = sketched.where("bands is not null").dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    nodes = common.written(nodes, f"{work}/buckets")
    met = common.written(nodes.join(nodes.groupBy("bucket").agg(F.count("*").alias("n")).where("n >= 2"), "bucket"), f"{work}/met")
    ranked = met.join(met.groupBy("node").agg(F.sum("n").alias("rank")), "node").select("bucket", "node", "rank")
    members = common.written(ranked, f"{work}/members")
    needed = members.select("node").distinct()
    runs = common.written(_chosen(sketched.select("node", "runs", "weights"), common.written(needed, f"{work}/needed"), "node", "left_semi").dropDuplicates(["node"]), f"{work}/runs")

    pairs = members.join(members.groupBy("bucket").agg(_highest().alias("hub")), "bucket").where("node != hub")
    found = common.written(verify(_pairs(pairs, "hub", "node"), runs).where(like), f"{work}/links0")
    root = components(found, f"{work}/turn0")
    members = _mixed(members, root, f"{work}/mixed0")
    members = common.written(members.join(bounds(runs), "node"), f"{work}/wide")
    for turn in (1, 2):
        if members.isEmpty():
            break
        outside, once = F.col("root") != F.col("top"), F.lit(True)
        if turn == 1:
            second = members.groupBy("bucket").agg(_highest(outside).alias("hub"))
            asking = members.join(second, "bucket").where("node = hub").drop("hub")
        else:
            asking, once = members.where(outside), (F.col("y.root") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
        x, y = asking.alias("x"), members.alias("y")
        open_ = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & once & possible("x", "y", threshold)
        pairs = x.join(y, open_).select(F.col("x.node").alias("hub"), F.col("y.node").alias("node"))
        found = common.written(verify(_pairs(pairs, "hub", "node"), runs).where(like), f"{work}/links{turn}")
        if found.isEmpty():
            continue
        root = _merged(root, found, f"{work}/turn{turn}")
        if turn == 1:
            members = _mixed(members.drop("root", "top"), root, f"{work}/mixed{turn}")
    root = common.written(root, f"{folder}/roots")
    common.removed(sketched.sparkSession, work)
    return root


def _highest(where: Column | None = None) -> Column:
    """The node of highest rank in a group, of those where a condition holds."""
    rank = F.struct("rank", "node")
    return F.max_by("node", rank if where is None else F.when(where, rank))


def _mixed(members: DataFrame, root: DataFrame, folder: str) -> DataFrame:
    """Members of the buckets that are not one component, with their root and the bucket's largest component."""
    placed = common.written(members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{folder}/placed")
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count("*").alias("parts"))
    return common.written(placed.join(parts.where("parts > 1").drop("parts"), "bucket"), f"{folder}/left")


def _merged(root: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """The roots after more links; only the roots that these join are looked at."""
    of = lambda side: root.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b")
    new = components(ends, folder)
    moved = root.join(new.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return common.written(moved.unionByName(new), f"{folder}/roots")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Root (smallest node) of every node that is not its own, by alternating large and small stars; one written table a turn."""

    def put(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = common.written(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), f"{folder}/{name}")
        return out, (seen.get["n"], seen.get["sum"])

    e, before = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    step = 0
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e, now = put(small.distinct(), f"stars{step}")
        if now == before:
            break
        before, step = now, step + 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def placed(docs: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _row_key, class_id, class_size and kept, the key of the row that stands for the class (null in a class of one), of every row."""
    sketched = common.written(sketch(docs), f"{folder}/sketch")
    root = rooted(sketched, folder, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row_key")).alias("first")
    copies = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), first, F.count("*").alias("copies"))
    named = common.written(copies.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{folder}/named")
    large = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"), F.sum("copies").alias("class_size")).where("class_size > 1")
    large = common.written(large.select("root", "class_id", "class_size", F.col("first._row_key").alias("kept")), f"{folder}/classes")
    of = common.written(named.select("node", "root").join(large, "root").drop("root"), f"{folder}/of")
    return sketched.select("doc_id", "_row_key", "node").join(of, "node", "left").select("doc_id", "_row_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "kept")


def classes(docs: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the class) and class_size of every row."""
    return placed(docs, folder, threshold).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest id, in all its columns.

    Rows are told apart by id and text, so an id may stand in several classes. A row without an id stays
    only if its class has none with one. Of rows with the same id and text one stays; null and
    empty texts are classes of their own, and without an id all of them stay.
    """
    found = common.written(placed(docs, folder, threshold), f"{folder}/result")
    gone = common.written(found.where("_row_key != kept").select("_row_key").distinct(), f"{folder}/gone")
    again = found.where("(kept is null and doc_id is not null) or _row_key = kept").groupBy("_row_key").agg(F.count("*").alias("n")).where("n > 1").select("_row_key")
    again = common.written(again, f"{folder}/again")
    left = _chosen(docs.withColumn("_row_key", row_key()), gone, "_row_key", "left_anti")
    if not again.isEmpty():
        left = _chosen(left, again, "_row_key", "left_anti").unionByName(_chosen(left, again, "_row_key", "left_semi").dropDuplicates(["_row_key"]))
    return left.select(*docs.columns)
