"""Vectorised words and word shingles of whole texts.

A text is first cut at blanks and line ends; the distinct chunks of a slice are then broken into
words once each. A word is a run of letters and digits, in lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\W_]+")
WORDS = re.compile(r"[^\W_]+|\n")
WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Ragged:
    """Values of all rows on end; row i has values[offsets[i]:offsets[i + 1]]."""

    values: np.ndarray
    offsets: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths())


def listed(strings: pa.Array) -> list[str]:
    """The strings of an array without nulls; much faster than to_pylist."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `values` that `codes` name, on end, and where each run ends."""
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(total)
    return values[at], ends


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the chunks between blanks and line ends, row offsets, and the distinct chunks."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else lists.values
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary


def cut(chunks: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What a pattern finds in each chunk: codes on end, how many each chunk has, distinct finds.

    The pattern must also find a line end, which no chunk holds: it keeps the chunks apart.
    """
    found = pa.array(pattern.findall("\n".join(chunks) + "\n"), pa.large_string()).dictionary_encode()
    names = listed(found.dictionary)
    codes = found.indices.to_numpy(zero_copy_only=False)
    stop = codes == names.index("\n")
    ends = np.flatnonzero(stop)
    return codes[~stop], np.diff(ends, prepend=-1) - 1, names


def chunk_words(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes of the chunks on end, how many each has, and the distinct words."""
    return cut(listed(pc.utf8_lower(chunks)), WORDS)


def words(texts: pa.Array) -> tuple[Ragged, list[str]]:
    """Word codes of each text in order, and the distinct words."""
    codes, offsets, chunks = chunked(texts)
    values, lens, names = chunk_words(chunks)
    return expand(codes, offsets, values, lens), names


def expand(codes: np.ndarray, offsets: np.ndarray, values: np.ndarray, lens: np.ndarray) -> Ragged:
    """Replace each chunk of each row by its run of values."""
    out, ends = gather(values, np.cumsum(lens) - lens, lens, codes)
    return Ragged(out, np.concatenate([[0], ends])[offsets])


def hashes(values: list[str]) -> np.ndarray:
    """Stable 64-bit hash of each string."""
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False) if values else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array) -> Ragged:
    """The 64-bit hashes of each text's words in order."""
    coded, names = words(texts)
    return Ragged(hashes(names)[coded.values], coded.offsets)


def words_of(text: str) -> list[str]:
    """The words of one text, as the kernels see them."""
    return WORD.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def shingles(stream: Ragged, width: int = WIDTH) -> Ragged:
    """64-bit hashes of all runs of `width` words. A shorter text that has words gives one shingle of all of them."""
    n = stream.lengths()
    short = (n > 0) & (n < width)
    values, offsets = stream.values, stream.offsets
    if short.any():
        size = np.where(short, width, n)
        at = np.concatenate([[0], np.cumsum(size)])
        padded = np.full(at[-1], _PAD, np.uint64)
        padded[np.arange(len(values)) + np.repeat(at[:-1] - offsets[:-1], n)] = values
        values, offsets, n = padded, at, size
    if len(values) < width:
        return Ragged(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    last = len(values) - width + 1
    code = values[:last].copy()
    for k in range(1, width):
        code = code * _MIX + values[k : k + last]
    count = np.maximum(0, n - width + 1)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    return Ragged(mix(code[at]), ends)


def counted(stream: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value: rows, values, counts."""
    row = stream.row_of()
    order = np.lexsort((stream.values, row))
    row, value = row[order], stream.values[order]
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
    return row[first], value[first], np.diff(np.concatenate([first, [len(row)]]))
