"""Language identification by compression.

Each language has a raw-content dictionary of its own texts for zstandard. A text is encoded once with
every dictionary; the smallest encoding names the language. Long texts are encoded block by block, all
of them, so that the dictionary stays near; sizes are sums over blocks. A prediction whose margin over
the second language is narrow is marked as rejected.

Rows: a null text, and one without letters, is `und` with score 0 and rejected; equal sizes go to
the language with more training documents, then to the smaller name; repeated rows are each
predicted; an empty table gives no rows; where no language can be learned all is `und`. Only doc_id,
text and (in training) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common

#: Training documents a language at most gives about this many excerpts of this many characters.
DOCS_PER_LANGUAGE = 400
EXCERPT_CHARS = 1500
#: Bytes of a dictionary, and of a block of text.
DICTIONARY_BYTES = 112_000
BLOCK_BYTES = 6_000
#: Short greedy matches: three bytes suffice, as the words of short texts need.
ENCODING = {"window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 4, "min_match": 3, "target_length": 16, "strategy": 3}
#: A margin under this many bytes, or under this share of the best size, is narrow.
NARROW_BYTES = 1
NARROW_SHARE = 0.002

OTHER = re.compile(r"[\W\d_]+")
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> str:
    """Words of letters in lower case between single blanks; signs and numerals belong to no language."""
    out = OTHER.sub(" ", text.lower()).strip()
    if out and not out.replace(" ", "").isalpha():  # numerals that are no decimal digits, such as fractions
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return out


@dataclass(frozen=True)
class Model:
    """Names of the languages, the one with most documents first, and their dictionaries."""

    names: list[str]
    dictionaries: list[bytes]


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Learn dictionaries from excerpts of a bounded sample of each language's documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    share = F.create_map(*(F.lit(x) for k in names for x in (k, int(common.sample_share(sizes[k], docs_per_language) * 1_000_003))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003))
    at = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.lit(1), F.length("text") - EXCERPT_CHARS)) + 1
    excerpts = usable.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), "doc_id", F.substring(F.col("text"), at.cast("int"), F.lit(EXCERPT_CHARS)).alias("text")).where(F.length("text") > 0)
    by: dict[str, list[bytes]] = {k: [] for k in names}
    for r in sorted(excerpts.collect(), key=lambda r: (r.draw, r.doc_id)):
        by[r.lang].append(letters(r.text).encode())
    held = [k for k in names if by[k]]
    return Model(held, [b" ".join(by[k])[:dictionary_bytes] for k in held])


def predictor(model: Model) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A kernel from texts to each one's sizes by language, and whether it has letters."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(**ENCODING, write_checksum=False, write_content_size=False, write_dict_id=False)
    coders = []
    for raw in model.dictionaries:
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        coders.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=data))

    def sizes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), len(coders)), np.int64)
        plain = [letters(t) for t in texts]
        lettered = np.fromiter(map(bool, plain), bool, len(texts))
        for i in np.flatnonzero(lettered):
            raw = plain[i].encode("utf-8", "surrogatepass")
            blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
            out[i] = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        return out, lettered

    return sizes


def decide(model: Model, sizes: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names (None: und), scores, margins in bytes and rejections. Each byte more than the best halves a language's odds."""
    n, k = sizes.shape
    if not k:
        return np.full(n, None, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
    best = sizes.argmin(axis=1)
    least = sizes[np.arange(n), best]
    odds = np.exp2(-np.minimum(60, sizes - least[:, None]).astype(float))
    score = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
    margin = (np.sort(sizes, axis=1)[:, 1] - least if k > 1 else least).astype(float)
    rejected = ~lettered | (margin < NARROW_BYTES) | (margin < NARROW_SHARE * least)
    names = np.where(lettered, np.array(model.names, object)[best], None)
    return names, score, np.where(lettered, margin, 0.0), rejected


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language, score, margin and rejection of every document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        sizes = predictor(model)

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            names, score, margin, rejected = decide(model, *sizes(common.as_text(part.column("text")).to_pylist()))
            return pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(["und" if x is None else x for x in names], pa.string()), pa.array(score), pa.array(margin), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

        return kernel

    return common.scored(docs, make, PREDICTION)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is told with a margin that isn't narrow, in all their columns."""

    def make() -> Callable[[pa.Array], pa.Array]:
        sizes = predictor(model)
        return lambda texts: pa.array(~decide(model, *sizes(texts.to_pylist()))[3])

    return common.kept(docs, make)
