"""Token ids of whole texts by a public tokenizer, at the cost of its distinct words.

A text is cut at blanks and line ends, which no token of a white-space-dropping tokenizer crosses.
Distinct chunks are encoded once; chunks of plain Latin letters, digits and signs are cut by the
tokenizer's own pattern and encoded many to a call, with the ends of words telling them apart. Any
other chunk goes to the tokenizer as it is. Ids equal those of encoding the text as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factorloom.llm import words

#: Vocabulary file; white space is dropped by this tokenizer and words carry an end mark.
DEFAULT = "word_bpe_49k.json"
#: The tokenizer's own pattern, for chunks of plain Latin characters (fixed values of that vocabulary).
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\n]|_)+|\n")
#: Characters whose lower case and composition are single and plain: ASCII and Latin letters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\n]*")
#: Distinct words a worker remembers, by 64 bits of their hash: about 45 bytes a word.
REMEMBERED = 1_000_000
NONE = np.zeros(0, np.uint32)


def vocabulary_path(name: str = DEFAULT) -> str:
    """Where a public vocabulary file is; a path is taken as it is."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Encodes arrays of texts; use `encoder(path)` to share one a process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for piece, i in pieces.items():
            self.ends[i] = piece.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and which word each is
        self.ids, self.starts, self.lens = NONE, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plainly(self, texts: list[str]) -> words.Ragged:
        """Ids of each text as the tokenizer gives them."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return words.Ragged(np.concatenate([NONE, *ids]), np.cumsum([0, *map(len, ids)]))

    def learn(self, new: list[str], hashes: np.ndarray) -> None:
        """Remember the ids of words, given with their hashes, that the pattern has cut out."""
        ids, lens = [], []
        for i in range(0, len(new), 500):
            some = new[i : i + 500]
            got = self.plainly([" ".join(some)]).values
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(some) and stops[-1] == len(got):
                lens.append(np.diff(stops, prepend=0))
            else:
                each = self.plainly(some)
                got = each.values
                lens.append(each.lengths())
            ids.append(got)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.known, hashes[order])
        self.place = np.insert(self.place, at, (len(self.known) + order).astype(np.int32))
        self.known = np.insert(self.known, at, hashes[order])
        self.ids = np.concatenate([self.ids, *ids])
        self.lens = np.concatenate([self.lens, *lens])
        self.starts = np.cumsum(self.lens) - self.lens

    def words_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of plain Latin characters on end, and how many each has."""
        codes, count, names = words.cut(chunks, PRETOKEN)
        if len(self.known) + len(names) > REMEMBERED:
            self.forget()
        hashes = words.hashes(names)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(names))
        if len(new):
            self.learn([names[i] for i in new], hashes[new])
            at = np.searchsorted(self.known, hashes)
        at = self.place[at][codes]
        ids, ends = words.gather(self.ids, self.starts, self.lens, at)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return ids, np.diff(ends)

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks on end, and how many each has."""
        low, raw = words.listed(pc.utf8_lower(chunks)), words.listed(chunks)
        whole = "\n".join(raw)
        if PLAIN.fullmatch(whole) and "<|" not in whole:
            return self.words_ids(low)
        plain = np.array([PLAIN.fullmatch(c) is not None and "<|" not in c for c in raw], bool)
        ids, n = self.words_ids([c for c, ok in zip(low, plain, strict=True) if ok])
        other = self.plainly([c for c, ok in zip(raw, plain, strict=True) if not ok])
        lens = np.empty(len(raw), np.int64)
        lens[plain], lens[~plain] = n, other.lengths()
        starts = np.empty(len(raw), np.int64)
        starts[plain], starts[~plain] = np.cumsum(n) - n, len(ids) + other.offsets[:-1]
        return words.gather(np.concatenate([ids, other.values]), starts, lens, np.arange(len(raw)))[0], lens

    def encode(self, texts: pa.Array) -> words.Ragged:
        """Ids of each text."""
        codes, offsets, chunks = words.chunked(texts)
        return words.expand(codes, offsets, *self.chunk_ids(chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
