"""Secret scans: fixed patterns, and character Markov models for unlabelled random strings.

Two first-order character models, of random strings and of ordinary identifiers, are trained from
labelled samples. Positive labels are the values that the fixed patterns find in a sample of at most
SAMPLE_DOCS documents (by hash of id) and SYNTHETIC strings drawn with a fixed seed from the usual key
alphabets; negative labels are all other identifier-like words of the sample, and as many SYNTHETIC names put
together from its words as programs spell them. A word of 16 characters
or more becomes a span of kind markov where the log-likelihood ratio per character exceeds a
threshold that MAX_FALSE of the negative labels exceed. Base spans stay, and markov spans do not
overlap them.

Each text is scanned whole in Arrow batches: one pass over the input and no shuffle. The models are
two 66 x 66 tables at any input size.

Edge cases: null text counts as empty; one output row for each input row, repeated rows and null ids
included; an empty table gives an empty result (and trains on synthetic strings alone); other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

SAMPLE_DOCS, SYNTHETIC, MAX_FALSE, MIN_LENGTH = 2000, 3000, 1e-3, 16
KINDS = ("assign", "access", "hex", "markov")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
#: Runs stay greedy and unbounded where a failing match must use up its text.
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

_CHARS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")}
_EDGE, _SIZE = len(_CHARS), len(_CHARS) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(word: str) -> list[int]:
    return [_EDGE, *(_CHARS.get(c, _EDGE) for c in word), _EDGE]


def _train(words: list[str]) -> list[list[float]]:
    counts = [[0.5] * _SIZE for _ in range(_SIZE)]
    for w in words:
        c = _codes(w)
        for a, b in zip(c, c[1:], strict=False):
            counts[a][b] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


class MarkovPair:
    """Models of random strings and identifiers; score() is the log-likelihood ratio a character."""

    def __init__(self, random_strings: list[str], identifiers: list[str], max_false: float = MAX_FALSE):
        a, b = _train(random_strings), _train(identifiers)
        self.ratio = [[x - y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]
        scores = sorted((self.score(w) for w in identifiers if len(w) >= MIN_LENGTH), reverse=True)
        at = int(max_false * len(scores))
        self.threshold = max(0.25, scores[at] + 1e-9 if scores else 0.25)

    def score(self, word: str) -> float:
        c = _codes(word)
        return sum(self.ratio[a][b] for a, b in zip(c, c[1:], strict=False)) / max(1, len(word))


def synthetic_strings(n: int = SYNTHETIC, seed: int = 7) -> list[str]:
    """Random strings over the alphabets of keys and tokens."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (upper + lower + digits, upper + lower + digits + "+/", upper + digits, lower + digits, "0123456789abcdef", upper + lower + digits + "_-")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64))) for i in range(n)]


def synthetic_names(words: list[str], n: int = SYNTHETIC, seed: int = 11) -> list[str]:
    """Names of two to five words in the spellings of programs; the order of words does not matter."""
    words = sorted({w for w in words if w.isalpha() and len(w) <= 12})
    rng = random.Random(seed)
    spell = ("_".join, lambda x: "_".join(x).upper(), "-".join, "/".join, lambda x: "".join(map(str.capitalize, x)), lambda x: x[0].lower() + "".join(map(str.capitalize, x[1:])))
    return [spell[i % len(spell)](rng.choices(words, k=rng.randint(2, 5))) for i in range(n)] if words else []


def train(texts: list[str]) -> MarkovPair:
    positive, negative = synthetic_strings(), []
    for text in texts:
        spans = base_spans(text)
        for start, rank, end in spans:
            positive.append(ASSIGN.match(text, start)[1] if rank == 0 else text[start:end])
        for m in re.finditer(r"[A-Za-z0-9+/_-]{6,}", text):
            if not any(s < m.end() and m.start() < e for s, _, e in spans):
                negative.append(m.group())
    return MarkovPair(positive, negative + synthetic_names(negative))


def all_spans(text: str, model: MarkovPair, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    more, starts, far = [], [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in WORD.finditer(text):
        word = m.group().rstrip("=")
        if model.score(word) > model.threshold:
            k = bisect_left(starts, m.end())  # of the spans that begin before its end, how far do they reach?
            if not k or far[k - 1] <= m.start():
                more.append((m.start(), 3, m.end()))
    return sorted(base + more)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts by kind, digest of the base spans, all spans."""
    rows = bounded_sample(docs, SAMPLE_DOCS, id_col, (text_col,))
    model = train([r[0] for r in rows if r[0]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = all_spans(text, model, base)
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                out.append((doc, *n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, SCHEMA)
