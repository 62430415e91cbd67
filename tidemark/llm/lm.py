"""Language-model scoring: a Katz backoff bigram model over words, with a plain unigram base.

Tokens are words and one end per text. Level 0 is the share of unknown words, level 1 Good-Turing
discounted word counts, level 2 Good-Turing discounted bigram counts whose backoff weights make each
context's distribution sum to 1 exactly. Every word of the training texts is a word and a context of its
own; words never seen in training are one event. Counts up to K are discounted by Good-Turing (or by half
a count where that estimate leaves (0, 1)), larger ones by DELTA counts, so each context keeps some
backoff mass.

A word's code is its id if it is among the HEAD most frequent ones, else its 64-bit hash. The head decides
only how a number travels, never a result: counts and backoff weights of the head are broadcast, those of
all other words are settled in buckets of hashes.

Texts form chunks of about CHUNK_TOKENS tokens. A chunk sends each different bigram once, with its training
count, to the bigram's bucket: that of the second word if it is outside the head, else of the first if that is, else
of both together, so no frequent word meets in one task. The bucket adds the counts up, which is the partitioned
bigram table, and answers each chunk with the totals in the order it asked. Contexts outside the head gather
their bigrams in a second round, for the backoff weights that unseen bigrams ask for. At last each chunk meets
its answers and scores its texts by itself. All blobs are sorted, delta-coded arrays.

The chunks are made twice, so docs must read the same both times, in the same order: a table, or a
checkpointed result; a chunk that does not match its answers raises an error.

Edge cases: null text counts as empty and scores its end; rows without an id are training rows; one
output row for each input row, repeated rows included; with no training token, base_score and score are
null (0 * log 0 is not defined); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import checkpoint

HEAD, K, DELTA = 65_534, 5, 0.05
CHUNK_TOKENS, BUCKET_TOKENS = 1_500_000, 3_000_000
SLICES = 16  # of the head, for adding its contexts up
OUT, EDGE = 0, 1  # OUT is any word outside the head; EDGE is the start as a context and the end as a word
IDS = 1 << 16  # codes below are ids
END = xxh64_intdigest(b"", 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the contract says."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _pack(a: np.ndarray) -> bytes:
    """A sorted or small-valued integer array, as compressed differences."""
    a = a.astype(np.uint64)
    d = np.diff(a, prepend=np.uint64(0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(d) or int(d.max()) <= np.iinfo(k).max)
    raw = d.astype(kind)
    # planes of bytes compress better than whole numbers
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(size, -1)
    raw = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{size}")
    return np.cumsum(raw.astype(np.uint64), dtype=np.uint64)


def _plain(a: np.ndarray, kind: str) -> bytes:
    return zlib.compress(a.astype(kind).tobytes(), 1)


def _get(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _wide(a: np.ndarray) -> bytes:
    """Any 64-bit numbers, as planes of bytes."""
    return zlib.compress(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(len(a), 8).T).tobytes(), 1)


def _narrow(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a bigram, from its codes."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = ((x ^ (x >> np.uint64(29))) + b) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _at(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of keys, 0 where there is none."""
    if not len(sorted_keys):
        return np.zeros(len(keys), values.dtype)
    found = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[found] == keys, values[found], 0)


def _joined(blobs, get, kind) -> np.ndarray:
    return np.concatenate([get(x) for x in blobs]) if len(blobs) else np.zeros(0, kind)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _mix(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(32))


# ---------------------------------------------------------------- level 1: words


def word_counts(train: DataFrame) -> DataFrame:
    """h (hash of the word; END for ends), c."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.fromiter((xxh64_intdigest(w) for w in seen), np.uint64, len(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["h", "c"])

        seen: Counter[bytes] = Counter()
        ends = 0
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                ends += 1
                if len(seen) > 400_000:
                    yield flush()
                    seen = Counter()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.uint64()).cast(pa.int64(), safe=False), pa.array([ends], pa.int64())], names=["h", "c"])

    return train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0")


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0..K from counts of counts n[1..K + 1]; d[0] is unused."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting; 0 stays 0."""
    return np.where(c <= K, d[np.minimum(c, K)] * c, c - DELTA)


class Unigrams:
    """Level 1, bounded: the head's counts and a few sums."""

    def __init__(self, counts: DataFrame):
        row = counts.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
            F.count(F.lit(1)).alias("types"),
            *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)],
        ).first()
        self.tokens, self.types = row["tokens"], row["types"]
        n = [0, *(row[f"n{r}"] for r in range(1, K + 2))]
        self.d = discounts(n)
        small = sum(r * n[r] for r in range(1, K + 1))
        total = sum(self.d[r] * r * n[r] for r in range(1, K + 1)) + (self.tokens - small) - DELTA * (self.types - sum(n[1 : K + 1]))
        # the least count that the head takes: words with one count are in or out together
        step = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.lit(4096) + F.floor(F.log2(F.col("c").cast("double") / 4096) * 64).cast("long"))
        words = counts.where(F.col("h") != F.lit(END - (1 << 64) if END >> 63 else END)).withColumn("step", step)
        least, room = 1 << 62, HEAD
        for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():  # some thousand rows at any size
            room -= r["count"]
            if room < 0:
                break
            least = r["step"]
        head = words.where(F.col("step") >= least).select("h", "c").orderBy(F.desc("c"), "h").collect()
        ends = counts.where(F.col("h") == F.lit(END - (1 << 64) if END >> 63 else END)).agg(F.sum("c")).first()[0] or 0
        self.docs = ends
        h = np.array([r["h"] for r in head], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], (order + 2).astype(np.uint16)
        c = np.array([r["c"] for r in head], np.int64)
        self.counts = np.concatenate([[0, ends], c])  # by id
        size = max(1, self.tokens)
        self.p = discounted(self.counts, self.d) / size  # by id
        self.p_new = max(1e-300, 1 - total / size)

    def shares(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Level 1 of words by code; count is read outside the head only."""
        inside = code < IDS
        rare = np.where(count > 0, discounted(count, self.d) / max(1, self.tokens), self.p_new)
        return np.where(inside, self.p[np.where(inside, code, 0).astype(np.int64)], rare)


# ---------------------------------------------------------------- chunks of texts


class _Chunks:
    """Words of consecutive texts as numbers, by a memo of words."""

    def __init__(self, uni: Unigrams):
        self.head = dict(zip(uni.hashes.tolist(), uni.ids.tolist(), strict=True))
        self.numbers: dict[bytes, int] = {}
        self.codes: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.rows, self.parts, self.n = [], [], 0
        if len(self.codes) > 600_000 or not self.codes:
            self.numbers, self.codes = {}, [EDGE]  # 0 is the end

    def add(self, row: tuple, text: str | None) -> None:
        w = words_of(text)
        try:
            part = np.fromiter(map(self.numbers.__getitem__, w), np.uint32, len(w))
        except KeyError:
            for x in w:
                if x not in self.numbers:
                    h = xxh64_intdigest(x)
                    self.numbers[x] = len(self.codes)
                    self.codes.append(self.head.get(h) or max(h, IDS))
            part = np.fromiter(map(self.numbers.__getitem__, w), np.uint32, len(w))
        self.rows.append(row)
        self.parts += [part, np.zeros(1, np.uint32)]
        self.n += len(w) + 1

    def take(self) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """The rows, their numbers of tokens, the sorted codes that occur, and every token's place among them."""
        at = np.concatenate(self.parts)
        used = np.zeros(len(self.codes), bool)
        used[at] = True
        words, back = np.unique(np.array(self.codes, np.uint64)[used], return_inverse=True)
        rank = np.zeros(len(used), np.uint32)
        rank[used] = back
        out = self.rows, np.fromiter((len(p) + 1 for p in self.parts[::2]), np.int64, len(self.rows)), words, rank[at]
        self.clear()
        return out


def _chunks(batches: Iterator[pa.RecordBatch], uni: Unigrams, most: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of rows (row number, doc_id, held_out, text), cut every `most` tokens."""
    chunks = _Chunks(uni)
    for batch in batches:
        for *row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            chunks.add(tuple(row), text.as_py())
            if chunks.n >= most:
                yield chunks.take()
    if chunks.n:
        yield chunks.take()


class _Bigrams:
    """The different bigrams of a chunk, by class (0: two head words, 1: first word outside, 2: second word
    outside), bucket, code that deals them, and the other code; back is each token's place among them."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, at: np.ndarray, buckets: int):
        size = np.uint64(len(words))
        y = at.astype(np.uint64)
        x = np.empty_like(y)
        x[1:] = y[:-1]
        x[np.cumsum(lengths) - lengths] = np.searchsorted(words, np.uint64(EDGE))
        # one number per bigram, which sorts as its class wants
        late = (words >= IDS)[at]
        keys, back = np.unique(np.where(late, size * size + y * size + x, x * size + y), return_inverse=True)
        late = keys >= size * size
        a, b = np.divmod(np.where(late, keys - size * size, keys), size)
        x, y = words[np.where(late, b, a)], words[np.where(late, a, b)]
        kind = np.where(late, 2, np.where(x >= IDS, 1, 0))
        dealt = np.where(late, y, np.where(kind == 1, x, x << np.uint64(16) | y))
        place = kind * buckets + (_mix(dealt) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place.astype(np.uint16) if 3 * buckets < 1 << 16 else place, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.x, self.y, self.dealt, self.place, self.back = x[order], y[order], dealt[order], place[order], rank[back]

    def parts(self) -> Iterator[tuple[int, slice]]:
        """Class * buckets + bucket, and where its bigrams are."""
        used, start = np.unique(self.place, return_index=True)
        for p, a, b in zip(used.tolist(), start.tolist(), [*start[1:].tolist(), len(self.place)], strict=True):
            yield p, slice(a, b)


BLOBS = "kind int, bucket int, chunk long, a binary, b binary, c binary"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["kind", "bucket", "chunk", "a", "b", "c"]
TEXTS, WEIGHTS, CONTEXTS, HEAD_SUMS, TIMES = 3, 4, 5, 6, 7  # kinds of blobs beside the classes of bigrams


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_NAMES).astype({"kind": "int32", "bucket": "int32", "chunk": "int64"})


def _counts_of(blobs) -> np.ndarray:
    return _joined(blobs, lambda x: _get(x, "<i8"), np.int64)


def _slices(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in order."""
    order = np.argsort(where, kind="stable")
    used, start = np.unique(where[order], return_index=True)
    yield from zip(used.tolist(), np.split(order, start[1:]) if len(used) else [], strict=True)


# ---------------------------------------------------------------- level 2: bigrams


def _asked(rows: DataFrame, shared, buckets: int, most: int) -> DataFrame:
    """Every chunk's different bigrams, with their training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_of, lengths, words, at in _chunks(batches, shared.value, most):
            g = _Bigrams(lengths, words, at, buckets)
            times = np.bincount(g.back, np.repeat([not held for _, _, held in rows_of], lengths), len(g.x)).astype(np.int64)
            out = []
            for place, at in g.parts():
                kind, bucket = divmod(place, buckets)
                other = b"" if kind == 0 else _plain(g.y[at], "<u2") if kind == 1 else _wide(g.x[at])
                out.append((kind, bucket, rows_of[0][0], _pack(g.dealt[at]), other, _plain(times[at], "<u4")))
            yield _batch(out)

    return rows.mapInArrow(send, BLOBS)


def _settle(uni: Unigrams, buckets: int):
    """One bucket of bigrams: answers to the chunks, what they ask of contexts, and sums by context."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        out: list[tuple] = []
        mass = np.zeros(len(uni.p))
        small = np.zeros((K + 2, len(uni.p)), np.int64)  # by times seen; in place 0 those over K
        times_of = np.zeros(K + 2, np.int64)
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for kind in range(3):
            own = rows[rows["kind"] == kind]
            if own.empty:
                continue
            parts = [_unpack(a) for a in own["a"]]
            ends = np.cumsum([len(p) for p in parts])[:-1]
            dealt = np.concatenate(parts)
            if kind == 0:
                x, y = dealt >> np.uint64(16), dealt & np.uint64(0xFFFF)
            elif kind == 1:
                x, y = dealt, _joined(own["b"], lambda b: _get(b, "<u2"), np.uint16).astype(np.uint64)
            else:
                x, y = _joined(own["b"], _narrow, np.uint64), dealt
            _, back = np.unique(dealt if kind == 0 else _pair(x, y), return_inverse=True)
            first = np.zeros(back.max() + 1, np.int64)
            first[back] = np.arange(len(back))  # any of its places
            n = np.bincount(back, _joined(own["c"], lambda c: _get(c, "<u4"), np.uint32), len(first)).astype(np.int64)
            ux, uy = x[first], y[first]
            if kind == 2:
                words, at = np.unique(uy, return_inverse=True)
                counted = np.bincount(at, n, len(words)).astype(np.int64)
                count = counted[at]
            else:
                count = uni.counts[uy.astype(np.int64)]
            answers = np.where(n > 0, n, -count)[back]
            unseen = (n == 0)[back] & (x >= IDS)
            for chunk, a, some, lost in zip(own["chunk"], np.split(answers, ends), parts, np.split(np.where(unseen, x, 0), ends), strict=True):
                own_words = _plain(_at(words, counted, np.unique(some)), "<i8") if kind == 2 else b""
                out.append((kind, bucket, chunk, _plain(a, "<i8"), own_words, b""))
                lost = np.unique(lost[lost > 0])
                out += [(WEIGHTS, b, chunk, _pack(lost[mine]), b"", b"") for b, mine in _slices((_mix(lost) % np.uint64(buckets)).astype(np.int64))]
            seen = n > 0
            ux, uy, n, count = ux[seen], uy[seen], n[seen], count[seen]
            times_of += np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
            inside = ux < IDS
            ctx = ux[inside].astype(np.int64)
            mass += np.bincount(ctx, uni.shares(uy[inside], count[inside]), len(mass))
            for r in range(1, K + 1):
                small[r] += np.bincount(ctx[n[inside] == r], minlength=len(mass))
            small[0] += np.bincount(ctx[n[inside] > K], minlength=len(mass))
            # the second word as its id, or as its count past the ids
            rare.append((ux[~inside], n[~inside], np.where(uy < IDS, uy.astype(np.int64), IDS + count)[~inside]))
        x, n, y = (np.concatenate(v) for v in zip(*rare, strict=True))
        order = np.argsort(x, kind="stable")
        x, n, y = x[order], n[order], y[order]
        out += [(CONTEXTS, b, bucket, _pack(x[mine]), _plain(n[mine], "<i8"), _plain(y[mine], "<i8")) for b, mine in _slices((_mix(x) % np.uint64(buckets)).astype(np.int64))]
        for i, (m, k) in enumerate(zip(np.array_split(mass, SLICES), np.array_split(small, SLICES, 1), strict=True)):
            out.append((HEAD_SUMS, i, bucket, _plain(m, "<f8"), _plain(k, "<i8"), b""))
        out += [(TIMES, r, int(times_of[r]), b"", b"", b"") for r in range(1, K + 2)]
        return _frame(out)

    return settle


class Backoff:
    """Level 2, bounded: discounts, and by head context its training count and its exactly normalising backoff weight."""

    def __init__(self, settled: DataFrame, uni: Unigrams):
        n = {r["bucket"]: r["n"] for r in settled.where(F.col("kind") == TIMES).groupBy("bucket").agg(F.sum("chunk").alias("n")).collect()}
        self.d = discounts([0, *(n.get(r, 0) for r in range(1, K + 2))])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            mass = sum(_get(a, "<f8") for a in rows["a"])
            return _frame([(HEAD_SUMS, int(rows["bucket"].iloc[0]), 0, _plain(mass, "<f8"), _plain(sum(_get(b, "<i8") for b in rows["b"]), "<i8"), b"")])

        sums = settled.where(F.col("kind") == HEAD_SUMS).withColumn("sub", F.pmod("chunk", F.lit(256)))
        sums = sums.groupBy("bucket", "sub").applyInPandas(lambda rows: add(rows.drop(columns="sub")), BLOBS).groupBy("bucket").applyInPandas(add, BLOBS)
        got = sorted(sums.collect(), key=lambda r: r["bucket"])  # SLICES rows, some MB at any input size
        mass = np.concatenate([np.zeros(0), *(_get(r["a"], "<f8") for r in got)])
        small = np.concatenate([np.zeros((K + 2, 0), np.int64), *(_get(r["b"], "<i8").reshape(K + 2, -1) for r in got)], 1)
        if not len(mass):
            mass, small = np.zeros(len(uni.p)), np.zeros((K + 2, len(uni.p)), np.int64)
        self.total = uni.counts.astype(np.float64)
        lost = sum((1 - self.d[r]) * r * small[r] for r in range(1, K + 1)) + DELTA * small[0]
        self.weight = np.where(self.total > 0, lost / np.maximum(self.total, 1) / np.maximum(1e-300, 1 - mass), 1.0)


def _weigh(shared):
    """One bucket of contexts outside the head: logarithms of the weights asked for."""

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        uni, back = shared.value
        own = rows[rows["kind"] == CONTEXTS]
        asks = rows[rows["kind"] == WEIGHTS]
        if asks.empty:
            return _frame([])
        ctx, at = np.unique(_joined(own["a"], _unpack, np.uint64), return_inverse=True)
        n, y = _counts_of(own["b"]), _counts_of(own["c"])
        share = uni.shares(np.minimum(y, IDS).astype(np.uint64), np.maximum(y - IDS, 0))
        total, lost, mass = (np.bincount(at, v, len(ctx)) for v in (n, n - discounted(n, back.d), share))
        log = _log(lost / np.maximum(total, 1)) - _log(1 - mass)  # a context never seen has weight 1
        return _frame([(WEIGHTS, 0, chunk, a, _plain(_at(ctx, log, _unpack(a)), "<f8"), b"") for chunk, a in zip(asks["chunk"], asks["a"], strict=True)])

    return weigh


def _texts(rows: DataFrame, shared, most: int) -> DataFrame:
    """Every chunk's tokens, as places among its different words, and what is known of its rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_of, lengths, words, at in _chunks(batches, shared.value[0], most):
            ids = np.array([[d or 0, (d is None) + 2 * held] for _, d, held in rows_of], np.int64)
            facts = np.concatenate([lengths, ids[:, 0], ids[:, 1]]).astype("<i8")
            yield _batch([(TEXTS, 0, rows_of[0][0], _pack(words), zlib.compress(np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1), zlib.compress(facts.tobytes(), 1))])

    return rows.mapInArrow(send, BLOBS)


OUT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(shared, buckets: int):
    """One chunk: its texts and the answers to its bigrams."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        uni, back = shared.value
        own = rows[rows["kind"] == TEXTS].iloc[0]
        at = np.ascontiguousarray(np.frombuffer(zlib.decompress(own["b"]), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")
        lengths, doc_id, flags = _get(own["c"], "<i8").reshape(3, -1)
        words = _unpack(own["a"])
        g = _Bigrams(lengths, words, at, buckets)
        told = rows[rows["kind"] < TEXTS].sort_values(["kind", "bucket"])
        answer = _counts_of(told["a"])
        # counts of the words outside the head, in the order of their buckets
        rare = words[words >= IDS]
        rare = rare[np.lexsort((rare, (_mix(rare) % np.uint64(buckets)).astype(np.int64)))]
        count = _counts_of(told["b"][told["kind"] == 2])
        if len(answer) != len(g.x) or len(count) != len(rare):
            raise RuntimeError("the documents did not read the same twice; checkpoint them first")
        order = np.argsort(rare)
        rare, count = rare[order], count[order]
        counted = lambda c: np.where(c < IDS, uni.counts[np.where(c < IDS, c, OUT).astype(np.int64)], _at(rare, count, c))
        asked = rows[rows["kind"] == WEIGHTS]
        ctx, log_weight = _joined(asked["a"], _unpack, np.uint64), _joined(asked["b"], lambda b: _get(b, "<f8"), np.float64)
        order = np.argsort(ctx)
        ctx, log_weight = ctx[order], log_weight[order]
        seen, inside = answer > 0, g.x < IDS
        weight = np.where(inside, _log(back.weight[np.where(inside, g.x, OUT).astype(np.int64)]), _at(ctx, log_weight, g.x))
        log = np.where(seen, _log(discounted(np.maximum(answer, 0), back.d)) - np.log10(np.maximum(counted(g.x), 1)), weight + _log(uni.shares(g.y, np.maximum(-answer, 0))))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        c = counted(words)[at]
        small = np.log10(max(1, uni.tokens) + 0.1 * (uni.types + 1))
        none = np.zeros(len(lengths), bool) if uni.tokens else np.ones(len(lengths), bool)
        real = lambda v: pa.array(v, pa.float64(), mask=none).to_pandas(types_mapper=pd.ArrowDtype)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(doc_id.copy(), (flags & 1) == 1),
            "held_out": flags >= 2,
            "n_tokens": lengths,
            "n_known": np.bincount(doc, c > 0, len(lengths)).astype(np.int64),
            "train_tokens": np.full(len(lengths), uni.tokens, np.int64),
            "base_score": real(np.bincount(doc, np.log10(c + 0.1), len(lengths)) - lengths * small),
            "score": real(np.bincount(doc, log[g.back], len(lengths))),
        })

    return finish


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession.sparkContext
    uni = Unigrams(checkpoint(word_counts(rows.where("NOT held_out").select("text"))))
    buckets = max(32, -(-uni.tokens // BUCKET_TOKENS))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = spark.broadcast(uni)
    settled = checkpoint(_asked(rows, first, buckets, chunk_tokens).groupBy("bucket").applyInPandas(lambda r: _settle(first.value, buckets)(r), BLOBS))
    model = spark.broadcast((uni, Backoff(settled, uni)))
    weights = settled.where(F.col("kind").isin(WEIGHTS, CONTEXTS)).groupBy("bucket").applyInPandas(_weigh(model), BLOBS)
    met = _texts(rows, model, chunk_tokens).unionByName(settled.where(F.col("kind") < TEXTS)).unionByName(weights)
    return met.groupBy("chunk").applyInPandas(_finish(model, buckets), OUT_SCHEMA)
