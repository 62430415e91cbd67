"""Language identification by interpolated Kneser-Ney character models.

One model per language, over the characters of lower-case words, up to ORDER characters
deep. Continuation counts below the highest order, absolute discounts estimated from each order's
counts of counts. SLICE languages at a time share one pair of sorted hash arrays per order: n-gram hash ->
discounted probability per language, and context hash -> interpolation weight per language; a lookup
is a binary search. A text's score is its cross-entropy in bits per character, whole text; the lowest
wins. Words are runs of letters. Rejection is calibrated: a text is rejected where its cross-entropy exceeds what MAX_REJECT of
the calibration documents of its language exceed, plus a margin that shrinks with the text's length.

Every label is learned. Training takes a sample of at most DOCS_PER_LANG documents per label, those with the
smallest hash of id and text (rows that repeat both count once), and stops after the document that reaches
CHARS_PER_LANG characters; one in five calibrates. Each label is fitted in a task of its own, and the arrays are
collected, never texts. So the broadcast model grows with the number of labels only, by some MB each. Prediction is one pass of Arrow batches over whole texts, without a shuffle, with a
bounded memo of word scores.

Edge cases: text that is null or has no letter is 'und' with score 0, and rejected; with nothing
learned every text is 'und'; ties go to the smaller label; one output row for each input row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, small_or_shuffled

ORDER, DOCS_PER_LANG, CHARS_PER_LANG, SLICE, MEMO = 5, 250, 1_500_000, 32, 300_000
MAX_REJECT, MARGIN = 0.001, 2.0
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


def _words(text: str) -> list[str]:
    """Runs of letters, in lower case: numbers, keys and signs say nothing about the language."""
    return _RUN.findall(text.lower())


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, each after a space that no n-gram reaches across, and word lengths + 1."""
    joined = "".join(w + " " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


def _places(lengths: np.ndarray) -> np.ndarray:
    """Place of each character in its word."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of n-grams and of their contexts, by n; an n-gram that begins before its word is padded."""
    codes, lengths = _encode(words)
    place = _places(lengths)
    shifted = codes.astype(np.uint64) + np.uint64(1)
    h_ctx = np.zeros(len(codes), np.uint64)
    grams, contexts = [], []
    for n in range(1, ORDER + 1):
        contexts.append(h_ctx)
        grams.append(((h_ctx ^ shifted) + np.uint64(n)) * _MIX ^ (shifted << np.uint64(17)))
        if n < ORDER:
            prev = np.zeros(len(codes), np.uint64)
            prev[n:] = shifted[:-n]
            prev[place < n] = np.uint64(0x1FFFFF)  # the word's edge
            h_ctx = (h_ctx ^ (prev + np.uint64(n << 40))) * _MIX
            h_ctx = h_ctx ^ (h_ctx >> np.uint64(29))
    return grams, contexts


class Memo:
    """Bits of words seen so far; emptied when it holds MEMO words, so its memory is bounded."""

    def __init__(self, langs: int):
        self.rows: dict[str, int] = {}
        self.bits, self.sizes, self.langs = np.zeros((1024, langs), np.float32), np.zeros(1024), langs

    def add(self, model: KneserNey, words: set[str]) -> None:
        if len(self.rows) > MEMO:
            self.__init__(self.langs)
        new = [w for w in words if w not in self.rows]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            n = len(self.rows)
            while n + len(part) > len(self.bits):
                self.bits, self.sizes = np.concatenate([self.bits, np.zeros_like(self.bits)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.bits[n : n + len(part)] = model.word_bits(part)
            self.sizes[n : n + len(part)] = [len(w) + 1 for w in part]
            self.rows.update(zip(part, range(n, n + len(part)), strict=True))


class KneserNey:
    """Sorted hash arrays of all languages' interpolated models."""

    def __init__(self, fitted: dict[str, list], limits: dict[str, float] | None = None):
        """fitted: by language and order, what fit() gives; limits: bits per character that calibration allows."""
        self.langs = sorted(fitted)
        self.floor = 1.0 / 50_000  # share of a character that no language has shown
        self.slices = []
        for first in range(0, len(self.langs), SLICE):
            some = [fitted[lang] for lang in self.langs[first : first + SLICE]]
            tables = []
            for n in range(ORDER):
                pair = []
                for what in (0, 1):
                    keys = np.unique(np.concatenate([p[n][what][0] for p in some]))
                    values = np.full((len(keys), len(some)), 0.0 if what == 0 else 1.0, np.float32)
                    for j, p in enumerate(some):
                        values[np.searchsorted(keys, p[n][what][0]), j] = p[n][what][1]
                    pair.append((keys, values))
                tables.append(pair)
            self.slices.append((first, len(some), tables))
        self.limits = np.array([(limits or {}).get(lang, np.inf) for lang in self.langs])

    @classmethod
    def of(cls, texts: dict[str, list[str]]) -> KneserNey:
        return cls({lang: cls.fit(t) for lang, t in texts.items()})

    @staticmethod
    def fit(texts: list[str]) -> list:
        """By order: (n-gram hashes, discounted shares), (context hashes, weights)."""
        words = Counter(w for t in texts for w in _words(t))
        names = list(words)
        times = np.fromiter(words.values(), np.float64, len(names))
        _, lengths = _encode(names)
        weight = np.repeat(times, lengths)
        grams, contexts = _grams(names)
        out = []
        for n in range(ORDER):
            keys, first, back = np.unique(grams[n], return_index=True, return_inverse=True)
            if n == ORDER - 1:
                count = np.bincount(back, weight, len(keys))
            else:  # continuation: how many different characters stand before
                longer, at = np.unique(grams[n + 1], return_index=True)
                count = np.bincount(back[at], minlength=len(keys)).astype(np.float64)
            ctx = contexts[n][first]
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ckeys, cback = np.unique(ctx, return_inverse=True)
            total = np.bincount(cback, count, len(ckeys))
            kinds = np.bincount(cback, minlength=len(ckeys))
            out.append(((keys, np.maximum(count - d, 0) / total[cback]), (ckeys, d * kinds / total)))
        return out

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word (with its end) under each language."""
        _, lengths = _encode(words)
        grams, contexts = _grams(words)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros((len(words), len(self.langs)))
        for first, k, tables in self.slices:
            p = np.full((len(grams[0]), k), self.floor)
            for (keys, share), (ckeys, weight), g, c in ((*tables[n], grams[n], contexts[n]) for n in range(ORDER)):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(ckeys, c), len(ckeys) - 1)
                hit = ckeys[at] == c
                p[hit] *= weight[at[hit]]
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                hit = keys[at] == g
                p[hit] += share[at[hit]]
            out[:, first : first + k] = np.add.reduceat(-np.log2(p), starts, axis=0)
        return out

    def text_bits(self, texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and its characters."""
        counted = [Counter(_words(t)) for t in texts]
        memo.add(self, {w for c in counted for w in c})
        out, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for i, c in enumerate(counted):
            if c:
                times = np.fromiter(c.values(), np.float64, len(c))
                at = np.fromiter(map(memo.rows.__getitem__, c), np.int64, len(c))
                size[i] = int(times @ memo.sizes[at])
                out[i] = times @ memo.bits[at] / size[i]
        return out, size

    def limit(self, held: list[str]) -> float:
        """Of a model of one language: what its calibration documents allow."""
        texts = [t for t in held if has_letter(t)]
        if not texts:
            return np.inf
        bits, size = self.text_bits(texts, Memo(1))
        own = np.sort(bits[:, 0] - MARGIN * 8 / np.sqrt(np.maximum(size, 1)))
        return float(own[min(len(own) - 1, int(len(own) * (1 - MAX_REJECT)))] + MARGIN)

    def predict(self, texts: list[str | None], memo: Memo) -> list[tuple[str, float, float | None, bool]]:
        """(label, score, bits per character, rejected) of each text."""
        live = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        out = [("und", 0.0, None, True)] * len(texts)
        for a in range(0, len(live), 256):
            part = live[a : a + 256]
            bits, size = self.text_bits([texts[i] for i in part], memo)
            best = bits.argmin(1)
            odds = np.exp2(-np.minimum((bits - bits.min(1, keepdims=True)) * np.minimum(size, 200)[:, None], 60))
            for k, i in enumerate(part):
                j = best[k]
                limit = self.limits[j] + MARGIN * 8 / np.sqrt(size[k])
                out[i] = (self.langs[j], float(1 / odds[k].sum()), float(bits[k, j]), bool(bits[k, j] > limit))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int) -> DataFrame:
    """lang, place, text: the labelled documents that train, at most docs_per_lang different ones of each label."""
    base = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 50))
    base = base.select(F.col(lang_col).cast("string").alias("lang"), place.alias("place"), F.col(text_col).cast("string").alias("text"))
    # a hash range that holds about half as many again as wanted, then the first of them
    counts = base.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n"))
    counts = checkpoint(counts.select("lang", (F.lit(float(1 << 50)) * (1.5 * docs_per_lang + 20) / F.col("n")).alias("below")))
    near = base.select("lang", "place").join(small_or_shuffled(counts), "lang").where("place < below").select("lang", "place").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = checkpoint(near.withColumn("k", first).where(F.col("k") <= docs_per_lang).select("lang", "place"))
    return base.join(small_or_shuffled(chosen), ["lang", "place"]).dropDuplicates(["lang", "place"])


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG
) -> KneserNey:
    """Fit on a bounded sample of the labelled documents that are not held out."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        mine, held, chars = [], [], 0
        for text in rows.sort_values("place")["text"]:
            if chars >= chars_per_lang:
                break
            chars += len(text)
            (held if len(mine) % 5 == 4 and len(held) < len(mine) / 4 else mine).append(text)
        tables = KneserNey.fit(mine)
        limit = KneserNey({"": tables}).limit(held)
        blobs = [[a.astype(kind).tobytes() for pair in order for a, kind in zip(pair, ("<u8", "<f4"), strict=True)] for order in tables]
        return pd.DataFrame([(rows["lang"].iloc[0], n, *b, limit) for n, b in enumerate(blobs)], columns=["lang", "n", "g", "share", "c", "weight", "most"]).astype({"n": "int32"})

    fitted: dict[str, list] = {}
    limits: dict[str, float] = {}
    made = sampled(docs, id_col, text_col, lang_col, docs_per_lang).groupBy("lang").applyInPandas(fit, "lang string, n int, g binary, share binary, c binary, weight binary, most double")
    for r in sorted(made.collect(), key=lambda r: (r["lang"], r["n"])):  # some MB per label
        pairs = [(np.frombuffer(r[k], "<u8"), np.frombuffer(r[v], "<f4")) for k, v in (("g", "share"), ("c", "weight"))]
        fitted.setdefault(r["lang"], []).append(pairs)
        limits[r["lang"]] = r["most"]
    return KneserNey({lang: tables for lang, tables in fitted.items() if len(tables[0][0][0])}, limits)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: KneserNey | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits_per_char, rejected."""
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(len(shared.value.langs))
        for batch in batches:
            got = shared.value.predict(batch.column(2).to_pylist(), memo)
            columns = list(zip(*got, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, SCHEMA)


def keep_identified(docs: DataFrame, model: KneserNey | None = None) -> DataFrame:
    """docs without the rejected rows, all columns; a null lang takes the prediction."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")
    lang = docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(len(shared.value.langs))
        for batch in batches:
            got = shared.value.predict(batch.column(at).to_pylist(), memo)
            labels = [old if old is not None else new[0] for old, new in zip(batch.column(lang).to_pylist(), got, strict=True)]
            columns = [pa.array(labels, pa.string()) if i == lang else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([not x[3] for x in got], pa.bool_()))

    return docs.mapInArrow(keep, schema)
