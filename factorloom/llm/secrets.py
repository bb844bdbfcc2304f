"""Secrets in whole texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags each token of a text as the begin or inside of a secret, or outside. A token's scores come from its shape
(classes of signs, length, variety), the words around it, whether it touches the token before, and features of the whole
file. The most likely tags come from Viterbi's recursion, which is cut into blocks: the best score from every tag
before a block to every tag at its end is found for all blocks at once, then chained. So very long texts are decoded
exactly, in arrays. The field is fitted by its likelihood to windows of sampled documents, where the patterns
mark secrets, and to written lines with secrets of other forms and with lookalikes. Its spans are added where they overlap no
pattern's.

Rows: a null text is the empty one and has no spans; repeated rows each give their row; an empty table gives no rows;
a null id stays null; spans count code points. Only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common, words

# Fixed patterns of the base rules, in the order in which spans of one start are listed.
KINDS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
#: Least characters of group 2, or of the match where a pattern has no groups.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: What a text must hold for a pattern to find anything that is long enough.
NEEDS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
ADDED = "crf"
#: Least characters of an added span.
LEAST_ADDED = 8

SPAN = "struct<kind:string,start:long,stop:long>"
TOKENS = re.compile(r"[^\W_]++(?:[+/_.~-]++[^\W_]++)*+(?:={1,2}(?![^\W_=]))?|.|\n")

OUTSIDE, BEGIN, INSIDE = range(3)
HASH_BITS = 15
#: Words at these distances count, if short.
AROUND = (-4, -3, -2, -1, 1)
SHORT = 16
#: Sampled documents, windows taken from them, written windows, and tokens of a window, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS, WRITTEN_WINDOWS, WINDOW = 2_000, 1_500, 2_500, 40
EPOCHS, RATE, DECAY = 8, 0.3, 1e-5
FILE_BINS = 6
#: Distinct tokens whose shapes a worker remembers.
REMEMBERED = 100_000


def base_spans(text: str, kind: str) -> list[tuple[int, int]]:
    """Spans of one kind, leftmost and not overlapping; matches that are too short are dropped."""
    group = 2 if KINDS[kind].groups else 0
    return [m.span() for m in KINDS[kind].finditer(text) if len(m[group]) >= LEAST[kind]]


# ---- tokens and features


MASK = (1 << HASH_BITS) - 1


def number(name: str) -> int:
    return zlib.crc32(name.encode()) & MASK


_SHAPE = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "a" * 26 + "A" * 26)
_RUN = re.compile(r"(.)\1+")
_LONG = zlib.crc32(b"a long word")
#: The number of a word itself, and at each distance, is its crc times one of these.
_TIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D][: len(AROUND) + 1], np.uint64)
STUCK = {(stuck, kind): number(f"stuck {stuck} {kind}") for stuck in (False, True) for kind in ("sign", "plain", "mixed")}
PLAIN = np.array([[number("plain"), number(f"plain {k // 4}")] for k in range(SHORT + 1)])
NONE = -1


@lru_cache(maxsize=REMEMBERED)
def shape_features(token: str) -> tuple[int, ...]:
    """What a token that is no short word in lower case looks like."""
    if len(token) == 1:
        return (number("sign"),)
    head = token[:256].translate(_SHAPE)
    bits = len(token).bit_length()
    size = min(2 * bits + (len(token) * 3 // 2 >= 1 << bits), 24)
    short = _RUN.sub(r"\1", head)
    kinds = "".join(k for k in "9aA" if k in head) + ("+" if len(set(head) - set("9aA")) else "")
    variety = 10 * len(set(token[:64])) // min(len(token), 64)
    turns = 10 * (len(short) - 1) // len(head)
    digits = 10 * head.count("9") // len(head)
    names = [f"size {size}", f"shape {short[:8]}", f"kinds {kinds} {size}", f"variety {variety} {size}", f"turns {turns} {kinds}", f"digits {digits} {kinds}", f"turns {turns} {size}"]
    if len(token) > SHORT:
        names.append(f"starts {token[:4]}")
    return tuple(number(n) for n in names)


def token_features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each token's own features (NONE fills up), of what it is to tokens around, and of touching or not the one before."""
    crc = np.array([zlib.crc32(n.lower().encode()) if len(n) <= SHORT else _LONG for n in names], np.uint64)
    ids = ((crc[:, None] * _TIMES) >> np.uint64(16)).astype(np.int64) & MASK
    own = np.full((len(names), 9), NONE, np.int64)
    own[:, 0] = np.where([len(n) <= SHORT for n in names], ids[:, 0], NONE)
    stuck = np.zeros((len(names), 2), np.int64)
    plain = np.array([len(n) <= SHORT and n.isalpha() and n.islower() for n in names], bool)
    own[plain, 1:3] = PLAIN[[len(n) for n, p in zip(names, plain.tolist(), strict=True) if p]]
    for i in np.flatnonzero(~plain).tolist():
        f = shape_features(names[i])
        own[i, 1 : 1 + len(f)] = f
    for kind, which in (("sign", [len(n) == 1 for n in names]), ("plain", [len(n) > 1 and n.isalpha() for n in names]), ("mixed", [len(n) > 1 and not n.isalpha() for n in names])):
        stuck[which] = STUCK[False, kind], STUCK[True, kind]
    return own, ids[:, 1:], stuck


def file_bins(n_tokens: np.ndarray, n_signs: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Numbers of a file's features: share of signs, length of tokens, size."""
    n = np.maximum(n_tokens, 1)
    signs = np.minimum(n_signs * 10 // n, FILE_BINS - 1)
    longish = np.minimum(n_chars // n // 2, FILE_BINS - 1)
    size = np.minimum(np.log2(n).astype(int) // 2, FILE_BINS - 1)
    name = lambda kind, b: [number(f"file {kind} {k}") for k in b.tolist()]
    return np.array([name("signs", signs), name("tokens", longish), name("size", size)], np.int64).T


@dataclass
class Field:
    """Weights of hashed features for each tag (the last row is no feature's), and of steps from tag to tag. Outside stands before and after every text."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((MASK + 2, 3)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))


@dataclass
class Stream:
    """Tokens of texts on end: code and start of each, whether it touches the one before, and how many each text has."""

    codes: np.ndarray
    starts: np.ndarray
    stuck: np.ndarray
    offsets: np.ndarray
    names: list[str]
    lens: np.ndarray
    chars: np.ndarray


def tokenised(texts: pa.Array) -> Stream:
    codes, offsets, chunks = words.chunked(texts)
    values, counts, names = words.cut(words.listed(chunks), TOKENS)
    lens = np.array([len(n) for n in names], np.int64)
    coded = words.expand(codes, offsets, values, counts)
    # in a chunk tokens lie side by side; chunks of a text are one sign apart
    size = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)[codes] + 1
    at = np.cumsum(size) - size
    at -= np.repeat(np.append(at, 0)[offsets[:-1]] if len(at) else np.zeros(len(offsets) - 1, np.int64), np.diff(offsets))
    n = counts[codes]
    own = lens[coded.values]
    ends = np.cumsum(own)
    begin = np.cumsum(n) - n
    inside = ends - own - np.repeat(np.append(ends - own, 0)[begin] if len(own) else np.zeros(len(begin), np.int64), n)
    stuck = np.ones(len(own), bool)
    stuck[begin[n > 0]] = False
    return Stream(coded.values, np.repeat(at, n) + inside, stuck, coded.offsets, names, lens, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))


def files_of(s: Stream) -> np.ndarray:
    sign = np.append(0, np.cumsum(s.lens[s.codes] == 1))
    return file_bins(np.diff(s.offsets), sign[s.offsets[1:]] - sign[s.offsets[:-1]], s.chars)


def scores(model: Field, s: Stream) -> np.ndarray:
    """Scores of every token for every tag."""
    w = model.weights
    own, around, stuck = token_features(s.names)
    own, around, stuck = w[own].sum(axis=1), w[around], w[stuck]
    n, counts = len(s.codes), np.diff(s.offsets)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    out = own[s.codes] + stuck[s.codes, s.stuck.astype(np.int8)] + w[files_of(s)].sum(axis=1)[row]
    for k, d in enumerate(AROUND):
        lo, hi = max(0, -d), n - max(0, d)
        if lo < hi:
            here, there = slice(lo, hi), slice(lo + d, hi + d)
            out[here] += around[s.codes[there], k] * (row[here] == row[there])[:, None]
    return out


# ---- Viterbi


def decode(model: Field, given: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The tags of greatest total score of texts on end; `firsts` marks the first token of each.

    A token whose score as outside leads by more than any change of two steps can give is outside in the best tags, so only the
    runs of other tokens need the recursion; outside stands between runs.
    """
    out = np.zeros(len(given), np.int8)
    lead = given[:, OUTSIDE] - np.maximum(given[:, BEGIN], given[:, INSIDE])
    left = np.flatnonzero(lead <= 2 * (model.steps.max() - model.steps.min()))
    if len(left):
        run = np.cumsum(np.append(False, np.diff(left) > 1) | (firsts[left] & (np.arange(len(left)) > 0)))
        at = np.arange(len(left)) + run
        chain = np.full((at[-1] + 2, 3), -1e9)
        chain[:, OUTSIDE] = 0
        chain[at] = given[left]
        out[left] = chained(model.steps, chain)[at]
    return out


def chained(steps: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Viterbi's tags of one long chain, before which stands outside, by blocks that are worked on side by side."""
    n = len(given)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    e = np.zeros((blocks * width, 3))
    e[:n] = given
    e[n:, 1:] = -1e9
    e = np.ascontiguousarray(e.reshape(blocks, width, 3).transpose(1, 2, 0))  # step, tag, block
    s = steps[:, :, None]
    best = np.where(np.eye(3, dtype=bool)[:, :, None], np.zeros(blocks), -np.inf)  # from the tag before a block to the tag now
    for j in range(width):
        best = np.maximum(np.maximum(best[:, 0, None] + s[0], best[:, 1, None] + s[1]), best[:, 2, None] + s[2]) + e[j]
    entry = np.full((3, blocks), -np.inf)
    entry[OUTSIDE, 0] = 0
    for b in range(1, blocks):
        entry[:, b] = (entry[:, b - 1, None] + best[:, :, b - 1]).max(axis=0)
        entry[:, b] -= entry[:, b].max()
    back, now = np.zeros((width, 3, blocks), np.int8), entry
    for j in range(width):
        a, b, c = now[0] + s[0], now[1] + s[1], now[2] + s[2]
        top = np.maximum(a, b)
        back[j] = np.where(c > top, 2, b > a)
        now = np.maximum(top, c) + e[j]
    every = np.arange(blocks)
    origin = np.repeat(np.arange(3, dtype=np.int8)[:, None], blocks, axis=1)  # which tag before the block each tag at its end leads back to
    for j in range(width - 1, -1, -1):
        origin = back[j][origin, every]
    tag = np.zeros(blocks, np.int8)
    tag[-1] = now[:, -1].argmax()
    for b in range(blocks - 1, 0, -1):
        tag[b - 1] = origin[tag[b], b]
    out = np.zeros((blocks, width), np.int8)
    for j in range(width - 1, -1, -1):
        out[:, j] = tag
        tag = back[j][tag, every]
    return out.ravel()[:n]


def tagged(model: Field, texts: pa.Array) -> list[list[tuple[int, int]]]:
    """Spans of each text by the field alone: a begin or the first inside, and the insides after it."""
    s = tokenised(texts)
    firsts = np.zeros(len(s.codes), bool)
    firsts[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
    tags = decode(model, scores(model, s), firsts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    on = tags != OUTSIDE
    begin = np.flatnonzero(on & (firsts | (tags == BEGIN) | ~np.append(False, on[:-1])))
    stop = np.flatnonzero(~on | firsts | (tags == BEGIN))
    last = np.append(stop, len(tags))[np.searchsorted(stop, begin, "right")] - 1
    text = np.searchsorted(s.offsets, begin, "right") - 1
    ends = s.starts[last] + s.lens[s.codes[last]]
    for t, a, z in zip(text.tolist(), s.starts[begin].tolist(), ends.tolist(), strict=True):
        out[t].append((a, z))
    return out


# ---- training


def windows(texts: list[str], marked: list[list[tuple[int, int]]], model_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and tags of windows of tokens, about `model_rows` of them: all with a secret first, then others by chance."""
    s = tokenised(pa.array(texts, pa.large_string()))
    files, rng = files_of(s), np.random.default_rng(seed)
    own, around, stuck = token_features(s.names)
    tags = np.zeros(len(s.codes), np.int8)
    for i, spans in enumerate(marked):
        a, b = s.offsets[i], s.offsets[i + 1]
        for start, stop in spans:
            lo, hi = a + np.searchsorted(s.starts[a:b], [start, stop])
            tags[lo:hi] = INSIDE
            tags[lo : min(lo + 1, hi)] = BEGIN
    cuts = [(i, at) for i in range(len(texts)) for at in range(int(s.offsets[i]), int(s.offsets[i + 1]), WINDOW)]
    chosen = [c for c in cuts if tags[c[1] : min(c[1] + WINDOW, s.offsets[c[0] + 1])].any()][:model_rows]
    rest = [cuts[k] for k in rng.permutation(len(cuts))[: max(0, model_rows - len(chosen))]]
    x, y = np.full((len(chosen) + len(rest), WINDOW, 10 + 3 + len(AROUND)), NONE, np.int64), np.full((len(chosen) + len(rest), WINDOW), -1, np.int8)
    for k, (i, at) in enumerate(chosen + rest):
        p = np.arange(at, min(at + WINDOW, int(s.offsets[i + 1])))
        c = s.codes[p]
        x[k, : len(p), :9], x[k, : len(p), 9], x[k, : len(p), 10:13] = own[c], stuck[c, s.stuck[p].astype(int)], files[i]
        for j, d in enumerate(AROUND):
            there = (p + d >= s.offsets[i]) & (p + d < s.offsets[i + 1])
            x[k, np.flatnonzero(there), 13 + j] = around[s.codes[p[there] + d], j]
        y[k, : len(p)] = tags[p]
    return x, y


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Field:
    """Maximise the likelihood of the windows' tags by adaptive gradient steps; forward and backward sums run over all windows of a batch at once."""
    model = Field()
    rng = np.random.default_rng(seed)
    seen = [np.full_like(a, 1e-8) for a in (model.weights, model.steps)]
    sizes = (y >= 0).sum(axis=1)
    order = np.flatnonzero(sizes)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(order), max(1, len(order) // 128)):
            n, width = len(batch), int(sizes[batch].max()) + 1  # one more for the outside after the window
            rows, last = np.arange(n), sizes[batch]
            f, tag = np.full((n, width, x.shape[2]), NONE), np.zeros((n, width), int)
            f[:, :-1], tag[:, :-1] = x[batch, : width - 1], np.maximum(y[batch, : width - 1], 0)
            on = np.arange(width) <= last[:, None]
            e = model.weights[f].sum(axis=2)
            e[rows, last] = 0, -1e9, -1e9
            a, c = np.zeros((n, width, 3)), np.zeros((n, width, 3))
            a[:, 0] = model.steps[OUTSIDE] + e[:, 0]
            for t in range(1, width):
                a[:, t] = np.logaddexp.reduce(a[:, t - 1, :, None] + model.steps, axis=1) + e[:, t]
            for t in range(width - 2, -1, -1):
                c[:, t] = np.where(on[:, t + 1, None], np.logaddexp.reduce(model.steps + (e[:, t + 1] + c[:, t + 1])[:, None], axis=2), 0)
            total = np.logaddexp.reduce(a[:, 0] + c[:, 0], axis=1)
            g = -np.exp(a + c - total[:, None, None]) * on[:, :, None]
            at, place = np.nonzero(on)
            g[at, place, tag[at, place]] += 1
            both = on[:, 1:]
            pair = np.exp(a[:, :-1, :, None] + model.steps + (e[:, 1:] + c[:, 1:])[:, :, None] - total[:, None, None, None]) * both[:, :, None, None]
            g_steps = -pair.sum(axis=(0, 1))
            np.add.at(g_steps, (tag[:, :-1][both], tag[:, 1:][both]), 1)
            g_steps[OUTSIDE] += g[:, 0].sum(axis=0)
            flat = f.ravel() % len(model.weights)
            g_w = np.stack([np.bincount(flat, np.repeat(g[:, :, k].ravel(), f.shape[2]), len(model.weights)) for k in range(3)], axis=1)
            g_w[NONE] = 0
            for value, grad, square in zip((model.weights, model.steps), (g_w / n - DECAY * model.weights, g_steps / n), seen, strict=True):
                square += grad * grad
                value += RATE * grad / np.sqrt(square)
    return model


class Writer:
    """Lines of code, settings, logs and prose with secrets in forms that the patterns miss, and with lookalikes."""

    # Beginnings of public token formats.
    STARTS = "ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk- sk_live_ rk_live_ SG. npm_ pypi- dop_v1_ AIza ya29. shpat_ hf_".split()
    NAMES = "pwd pass passphrase credential credentials auth authkey private_key access_key client_key signing_key db_pass session_key encryption_key master_key webhook_key".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.words = ["".join(r.choices("aeiou" if k % 2 else "bcdfghklmnprstvwzéüñß", k=1)[0] for k in range(r.randint(2, 11))) for _ in range(600)]

    def signs(self, low: int, high: int, more: str = "") -> str:
        return "".join(self.r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + more, k=self.r.randint(low, high)))

    def text(self, low: int, high: int) -> str:
        return " ".join(w + self.r.choice(["", "", "", "", ",", "."]) for w in self.r.choices(self.words, k=self.r.randint(low, high)))

    def secret(self) -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after it."""
        r = self.r
        kind, q, name = r.randrange(9), r.choice(["", "", '"', "'"]), r.choice(self.NAMES)
        eq = r.choice([" = ", "=", ": ", ":", " => ", " is "])
        if kind == 0:
            return r.choice([f"{name}{eq}{q}", "", "key ", "use ", "export KEY=", f"{q}"]), r.choice(self.STARTS) + self.signs(20, 44), q
        if kind == 1:
            return r.choice(["Authorization: Bearer ", "bearer ", "Authorization: Basic ", "-H 'X-Auth: "]), self.signs(24, 90, "-_"), r.choice(["", "'", '"'])
        if kind == 2:
            return r.choice(["", "jwt ", "cookie: session=", f"{name}{eq}{q}"]), "eyJ" + self.signs(20, 40, "-_") + ".eyJ" + self.signs(30, 90, "-_") + "." + self.signs(30, 60, "-_"), q
        if kind == 3:
            return f"{r.choice(['postgres', 'mysql', 'mongodb', 'amqp', 'redis', 'https'])}://{r.choice(self.words)}:", self.signs(8, 24), f"@{r.choice(self.words)}.{r.choice(['com', 'local', 'net'])}:{r.randint(1000, 9999)}/{r.choice(self.words)}"
        if kind == 4:
            return r.choice(["AccountKey=", "SharedAccessKey=", f"{name}{eq}{q}", "aws_secret_access_key" + eq]), self.signs(38, 44, "+/") + r.choice(["", "=", "=="]), q
        if kind == 5:
            lines = "\n".join(self.signs(64, 64, "+/") for _ in range(r.randint(2, 5)))
            label = r.choice(["RSA ", "EC ", "", "OPENSSH "])
            return f"-----BEGIN {label}PRIVATE KEY-----\n", lines, f"\n-----END {label}PRIVATE KEY-----"
        if kind == 6:
            return f"{name}{eq}{q}", self.signs(4, 9) + r.choice("!@#$%^&*") + self.signs(4, 9) + str(r.randint(0, 99)), q
        if kind == 7:
            return f"{r.choice(self.NAMES).upper()}{eq}{q}", self.signs(16, 40), q
        return f"{name}{eq}{q}", self.signs(12, 40), q

    def lookalike(self) -> str:
        """What looks like a secret and is none."""
        r = self.r
        hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
        w = lambda: r.choice(self.words)
        return r.choice([
            lambda: f"{r.choice(['id', 'uuid', 'request'])} {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"commit {hexes(r.choice([7, 8, 12]))}", lambda: f"{r.randint(0, 99)}@{w()}{r.randint(0, 9)}.example.com",
            lambda: "".join(r.choices("0123456789", k=r.randint(6, 19))), lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000000, 9999999)}", lambda: f"/{w()}/{w()}/{w()}_{r.randint(0, 99)}.{r.choice(['py', 'txt', 'html', 'tar.gz'])}",
            lambda: f"https://www.{w()}.com/{w()}/{w()}-{w()}?{w()}={r.randint(0, 9999)}", lambda: "_".join(w() for _ in range(r.randint(2, 5))), lambda: w() + w().title() + w().title(), lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 200)}-rc{r.randint(0, 9)}",
            lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z", lambda: f"data:image/png;base64,{self.signs(40, 90, '+/')}==", lambda: "-".join(w() for _ in range(r.randint(2, 5))), lambda: (w() + w()).upper(),
            lambda: f"{r.choice(self.NAMES)} {w()} {w()}", lambda: f"{r.choice(self.NAMES)} = {r.choice(['None', 'null', 'os.environ', 'get_value()', '****', 'xxxxxxxx', '<value>', 'input(prompt)'])}", lambda: f"{r.choice('€$£')}{r.randint(1, 9999)}.{r.randint(10, 99)}", lambda: r.choice("!?*#$%&|") * r.randint(1, 12),
            lambda: f"ISBN 978-{r.randint(0, 9)}-{r.randint(100, 999)}-{r.randint(10000, 99999)}-{r.randint(0, 9)}", lambda: f"etag W/\"{hexes(10)}\"", lambda: f"sha1:{hexes(20)}", lambda: f"{w()}{r.randint(0, 99999)}{w()}", lambda: f"{w()}={w()};{w()}={r.randint(0, 99)}",
        ])()

    def line(self) -> tuple[str, list[tuple[int, int]]]:
        """A text of some lines, and its secrets."""
        r, out, spans = self.r, "", []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.35:
                before, secret, after = self.secret()
                out += self.text(0, 8) + r.choice([" ", "\n", " ", ", "]) + before
                spans.append((len(out), len(out) + len(secret)))
                out += secret + after
            elif kind < 0.8:
                out += self.text(0, 8) + " " + self.lookalike()
            else:
                out += self.text(3, 25)
            out += r.choice([" ", "\n", ". ", ";\n", ","]) + (" " if r.random() < 0.2 else "")
        return out, spans


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit the field to about `sample_docs` distinct texts of at most 4,000 characters, by a hash of the text, and to written lines."""
    share = common.sample_share(docs.count(), sample_docs)
    text = F.col("text").cast("string")
    sample = docs.select(text.alias("text")).where((F.length("text") <= 4_000) & common.hashed_share(F.col("text"), share, 23)).distinct()
    texts = sorted(r.text for r in sample.collect())
    marked, kept = [], []
    for text in texts:
        found = [m.span(2) for m in KINDS["assign"].finditer(text) if len(m[2]) >= LEAST["assign"] and any(c.isdigit() for c in m[2])] + [s for k in ("access", "hex") for s in base_spans(text, k)]
        if found or not KINDS["assign"].search(text):
            kept.append(text)
            marked.append(found)
    writer = Writer(7)
    written = [writer.line() for _ in range(WRITTEN_WINDOWS)]
    parts = [windows([t for t, _ in written], [s for _, s in written], WRITTEN_WINDOWS, 1)]
    if kept:
        parts.append(windows(kept, marked, SAMPLE_WINDOWS, 2))
    return fit(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


# ---- the operator


def spans_of(model: Field, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start and then kind."""
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(texts))]
    for order, kind in enumerate(KINDS):
        for i in np.flatnonzero(pc.match_substring_regex(texts, NEEDS[kind]).to_numpy(zero_copy_only=False)).tolist():
            out[i] += [(a, order, kind, z) for a, z in base_spans(texts[i].as_py(), kind)]
    for i, found in enumerate(tagged(model, texts)):
        if found:
            taken = sorted((a, z) for a, _, _, z in out[i])
            reach = np.maximum.accumulate([z for _, z in taken]) if taken else np.zeros(0)
            begins = [a for a, _ in taken]
            for a, z in found:
                before = int(np.searchsorted(begins, z))  # spans that begin before this one ends
                if z - a >= LEAST_ADDED and not (before and reach[before - 1] > a):
                    out[i].append((a, len(KINDS), ADDED, z))
    return [[(kind, a, z) for a, _, kind, z in sorted(x)] for x in out]


def find(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id and the spans of every document: kind, start and stop in code points, by start and then kind."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            found = spans_of(held.value, common.as_text(part.column("text")))
            return pa.record_batch([part.column("doc_id"), pa.array([[{"kind": k, "start": a, "stop": z} for k, a, z in x] for x in found], kind)], ["doc_id", "spans"])

        return kernel

    return common.map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", make, f"doc_id long, spans array<{SPAN}>", 2_000_000)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans as text."""
    shown: Callable[[Column], Column] = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count(ADDED).alias("n_added"))
