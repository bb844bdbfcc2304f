"""Vector bin packing of examples into training sequences.

An example needs tokens, one segment and loss-bearing tokens; a sequence has a limit on each. An
open sequence takes the example whose need has the largest dot product with what is left of its
limits (each part as a share of the limit). Where cutting is allowed, the gap that no example fits is
filled by cutting one, and the last tokens of a task go to sequences whose lengths are powers of two,
so that nothing is padded.

Rows: a null text is empty; an empty example takes no place in a sequence unless it has an end id;
repeated rows and repeated or null ids are packed as rows of their own; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common, tokens


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Segments and loss-bearing tokens bind instruction data."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    @classmethod
    def documents(cls, tokens: int = 4096) -> Limits:
        """Limits under which only tokens bind: each segment has one token at least."""
        return cls(tokens, tokens, tokens)

    def parts(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, padded_to long"


class Packer:
    """Packs examples in blocks: at each call the pool, what was left of the last one included, is placed.

    An example is (key, first token, tokens left, loss-bearing tokens left); loss-bearing tokens are an
    example's last ones, as in instruction data, where the answer follows the prompt.
    """

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.sequence = 0

    def fit(self, need: np.ndarray, room: np.ndarray, free: np.ndarray) -> int:
        """The example with the largest dot product of need and room among those that fit; -1 if none."""
        size = self.limits.parts()
        ok = free & (need <= room).all(axis=1)
        if not ok.any():
            return -1
        score = (need / size) @ (room / size)
        score[~ok] = -1
        return int(score.argmax())

    def place(self, examples: list[list[int]], last: bool) -> tuple[list[tuple[int, int, int, int, int, int, int, int]], list[list[int]]]:
        """Pieces (key, start, length, sequence, offset, segment, loss, padded) and the examples still waiting.

        Without `last`, packing stops when the pool has less than a few sequences' tokens.
        """
        lim, out = self.limits, []
        pool = []
        for key, start, n, loss in examples:
            while self.cut and n >= lim.tokens and min(loss, lim.tokens) <= lim.loss:  # whole sequences of a long example
                part = max(0, loss - (n - lim.tokens))
                out.append((key, start, lim.tokens, self.sequence, 0, 0, part, lim.tokens))
                self.sequence += 1
                start, n, loss = start + lim.tokens, n - lim.tokens, loss - part
            if n:
                if not self.cut and (n > lim.tokens or loss > lim.loss):
                    raise ValueError(f"example {key} is beyond the limits of a sequence; allow cutting")
                pool.append([key, start, n, loss])
        need = np.array([[n, 1, loss] for _, _, n, loss in pool], float).reshape(-1, 3)
        free = np.ones(len(pool), bool)
        waiting = need[:, 0].sum()
        keep = 0 if last else 8 * lim.tokens
        while free.any() and waiting > keep:
            room, used, seg, own = lim.parts(), 0, 0, []
            target = lim.tokens
            if self.cut and waiting < lim.tokens:
                target = 1 << (int(waiting).bit_length() - 1)
                room[0] = target
            while True:
                i = self.fit(need, room, free)
                if i < 0:
                    break
                key, start, n, loss = pool[i]
                own.append((key, start, n, self.sequence, used, seg, loss))
                free[i] = False
                used, seg, room, waiting = used + n, seg + 1, room - need[i], waiting - n
            gap = int(room[0])
            if gap and self.cut and room[1] >= 1 and free.any():
                long = np.where(free & (need[:, 0] > gap), need[:, 0], 0)
                i = int(long.argmax())
                key, start, n, loss = pool[i]
                part = max(0, loss - (n - gap))
                if long[i] and part <= room[2]:
                    own.append((key, start, gap, self.sequence, used, seg, part))
                    pool[i] = [key, start + gap, n - gap, loss - part]
                    need[i] = [n - gap, 1, loss - part]
                    used, waiting = used + gap, waiting - gap
            if not own:
                raise ValueError("an example fits no empty sequence")
            padded = used if used & (used - 1) == 0 else lim.tokens
            out += [(*p, padded) for p in own]
            self.sequence += 1
        return out, [p for p, f in zip(pool, free, strict=True) if f]


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, limits: Limits | None = None, cut: bool = True, pool_rows: int = 2000) -> DataFrame:
    """Pack every document's token ids, then `end_id`, into sequences; one row a piece.

    Each task packs its own rows, `pool_rows` at a time with what the block before left, so memory
    is bounded and no row is shuffled. All ids of a document bear loss. sequence_id holds the task's
    number in its upper bits.
    """
    path, limits = path or tokens.vocabulary_path(), limits or Limits.documents()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        packer, base = Packer(limits, cut), TaskContext.get().partitionId() << 33
        ids: dict[int, np.ndarray] = {}
        names: dict[int, int | None] = {}
        sizes: dict[int, int] = {}
        waiting: list[list[int]] = []
        key, due = 0, pool_rows

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal waiting
            placed, waiting = packer.place(waiting, last)
            cols = list(zip(*placed, strict=True)) or [[]] * 8
            crc = [zlib.crc32(ids[k][s : s + n].tobytes()) for k, s, n, *_ in placed]
            seqs = [base + s for s in cols[3]]
            out = pa.record_batch([pa.array(c, t) for c, t in (
                ([names[k] for k in cols[0]], pa.int64()), (cols[1], pa.int64()), (cols[2], pa.int64()), (crc, pa.int64()), ([sizes[k] for k in cols[0]], pa.int64()),
                (seqs, pa.int64()), (cols[4], pa.int64()), (cols[5], pa.int32()), (cols[6], pa.int64()), (cols[7], pa.int64()))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens", "padded_to"])
            left = {w[0] for w in waiting}
            for k in [k for k in ids if k not in left]:
                del ids[k], names[k], sizes[k]
            return out

        for batch in batches:
            for part in common.slices(batch, "text"):
                got = encode(common.as_text(part.column("text")))
                for row, name in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(got.values[got.offsets[row] : got.offsets[row + 1]], end_id).astype("<u4")
                    ids[key], names[key], sizes[key] = own, name, len(own)
                    waiting.append([key, 0, len(own), len(own)])
                    key += 1
                    if len(waiting) >= due:
                        yield emit(False)
                        common.tidy()
                        due = len(waiting) + pool_rows  # very short examples wait until they fill some sequences
        yield emit(True)
        common.tidy()

    common.bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits, cut: bool = False, pool_rows: int = 2000) -> DataFrame:
    """Pack examples given by their sizes: columns example_id, n_tokens, n_loss. One row a piece.

    Null sizes count as 0. An example beyond the limits of a sequence is an error unless it may be cut.
    """
    schema = "example_id long, start long, length long, sequence_id long, offset long, segment int, loss_tokens long, padded_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits, cut), TaskContext.get().partitionId() << 33
        waiting: list[list] = []
        names: list = []
        due = pool_rows

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal waiting
            placed, waiting = packer.place(waiting, last)
            cols = list(zip(*placed, strict=True)) or [[]] * 8
            cols = [[names[k] for k in cols[0]], cols[1], cols[2], [base + s for s in cols[3]], *cols[4:]]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["example_id", "start", "length", "sequence_id", "offset", "segment", "loss_tokens", "padded_to"])

        for batch in batches:
            for name, n, loss in zip(*(batch.column(c).to_pylist() for c in ("example_id", "n_tokens", "n_loss")), strict=True):
                waiting.append([len(names), 0, n, min(loss, n)])
                names.append(name)
                if len(waiting) >= due:
                    yield emit(False)
                    due = len(waiting) + pool_rows
        yield emit(True)

    sized = examples.select("example_id", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n_tokens", "n_loss")))
    return sized.mapInArrow(run, schema)
