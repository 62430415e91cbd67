"""N-gram Jaccard self-join by a token-group matrix, up to connected components.

A document is its set of distinct word shingles, as 64-bit hashes. Equal sets form one class, and the
join runs over classes. Shingles have a global order: common ones last (commonness from a count sketch
of fixed size), the others by how often their words would meet by chance (from a count sketch of words), so that
shingles of frequent words stay out of prefixes at any input size; the order affects cost, never results. Of the first n - ceil(t * n) + l shingles of each,
with l = 1 + n // 10, two linked sets share at least the smaller l, so only these prefixes are dealt by
shingle.

Round 1 forms groups of similar documents. A shingle's list of at most SHORT classes counts every pair;
a pair is compared when its count reaches l, less what its classes may share of longer lists (what the one
with fewer entries there has). In a longer list, in bands of compatible size, every class
is compared with the band's first one only. Linked classes become a group. Round 2 is for pairs that longer
lists alone may bring to l, so only for classes with l entries there; what a frequent shingle adds
to near copies connects no others. Classes that such lists connect are partitioned into blocks of about BLOCK, by
group where a group is large and by size where the partition is, and the token-group matrix of two
blocks is their token unions: |query & union| bounds the overlap with any member of the other block, and
only what reaches t * |query| is opened. Opened sets meet through postings, and a task keeps the links
that join groups, not all. Pairs of blocks within one group, or of incompatible size, never meet. Every
pair that may link is thus compared or already connected: no link between components is lost, and no
list emits all its pairs. A leader's followers are dealt in blocks too.

Edge cases: null text and texts without words have n_shingles 0, link with nothing and are their own
component; fewer words than the shingle length make one shingle; equal sets always link; rows without
an id join components but do not name them (a component without any id has null); repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import checkpoint, small_or_shuffled
from tidemark.llm.graph import components

WIDTH, PERCENT = 4, 85
SLOT_BITS, WORD_BITS, BLOCK, SHORT, CHUNK_TOKENS, BUCKET_TOKENS = 22, 20, 1024, 32, 600_000, 1_200_000
SLICE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, words: _Words) -> np.ndarray:
    """The text's words as 64-bit hashes; words memoises them."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) > 150_000:
        words.clear()
    return np.fromiter(map(words.__getitem__, w), np.uint64, len(w))


def shingled(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all shingles of word hashes."""
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: str | None, words: _Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingled(word_hashes(text, words), width))


def ranked(h: np.ndarray, ranks: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of word hashes, and the sum of the words' ranks in each."""
    s, first = np.unique(shingled(h, width), return_index=True)
    of = ranks[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.uint64)
    rank = np.zeros(len(s), np.uint64)
    for k in range(min(width, len(h))):
        rank += of[first + k]
    return s, rank


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return int(np.add.reduce(mixed ^ (mixed >> np.uint64(32)))), int(np.add.reduce(mixed * mixed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def least_overlap(n, percent: int = PERCENT):
    """Least intersection of a set of size n with any set it links with."""
    return -(-percent * n // 100)


def common_least(n):
    """How many shingles two linked sets of at least n share among their prefixes."""
    return 1 + n // 10


def linked(n: int, m: int, shared: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _pack(a: np.ndarray, kind: str = "<u8") -> bytes:
    return zlib.compress(a.astype(kind).tobytes(), 1)


def _get(blob: bytes, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


# ---------------------------------------------------------------- classes and the order of shingles

SETS = "kind int, row long, doc_id long, key long, n int, s1 long, s2 long, sketch binary"


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: size and signature of each document's set; kind 1: slices of the task's count sketches, of shingles and then of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slots, often = _Words(), np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(1 << WORD_BITS, np.uint32)

        def add(some, seen):
            at, c = np.unique((np.concatenate(some) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_counts=True)
            slots[at] += c.astype(np.uint32)
            at = (np.concatenate(seen) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
            np.add.at(often, at, np.uint32(1))

        def out(*columns):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SETS.split(", ")])

        for batch in batches:
            n, s1, s2, some, seen, size = [], [], [], [], [], 0
            for text in batch.column(3):
                h = word_hashes(text.as_py(), words)
                s = np.unique(shingled(h, width))
                a, b = signature(s)
                n.append(len(s))
                s1.append(_signed(a))
                s2.append(_signed(b))
                some.append(s)
                seen.append(h)
                size += len(h)
                if size > 400_000:
                    add(some, seen)
                    some, seen, size = [], [], 0
            if some:
                add(some, seen)
            k = len(n)
            yield out([0] * k, batch.column(0), batch.column(1), batch.column(2), n, s1, s2, [None] * k)
        for i, part in enumerate(np.concatenate([slots, often]).reshape(-1, SLICE)):
            if part.any():
                yield out([1], [i], [None], [None], [0], [0], [0], [_pack(part, "<u4")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), _key().alias("key"), "text")
    return rows.mapInArrow(scan, SETS)


def _key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit per slot of shingles: whether they count as common; byte per slot of words: four times the binary logarithm
    of its count. 1.5 MB at any input size."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.uint64)
        for b in rows["sketch"]:
            part = _get(b, "<u8" if "sub" not in rows else "<u4")
            total += part.astype(np.uint64)
        return pd.DataFrame({"row": [rows["row"].iloc[0]], "sketch": [_pack(total)]})

    slices = sets.where("kind = 1").select("row", "sketch", F.pmod(F.xxhash64("sketch"), F.lit(256)).alias("sub"))
    merged = slices.groupBy("row", "sub").applyInPandas(add, "row long, sketch binary").groupBy("row").applyInPandas(add, "row long, sketch binary")
    total = np.zeros((((1 << SLOT_BITS) + (1 << WORD_BITS)) // SLICE, SLICE))
    for r in merged.collect():
        total[r["row"]] = _get(r["sketch"])
    total, often = np.split(total.reshape(-1), [1 << SLOT_BITS])
    return total > total.mean() + 6 * np.sqrt(total.mean()) + 16, np.round(4 * np.log2(1 + often)).astype(np.uint8)


def prefix(s: np.ndarray, rank: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles in the global order (common last, then by rank, then by hash), enough to meet every link."""
    k = len(s) - least_overlap(len(s), percent) + common_least(len(s))
    late = common[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    return s[np.argsort(rank + (late.astype(np.uint64) << np.uint64(32)), kind="stable")[:k]]


# ---------------------------------------------------------------- candidates

LISTS = "bucket int, tokens binary, docs binary, n binary, s1 binary, s2 binary"
PAIRS = "kind int, a1 long, a2 long, b1 long, b2 long, list long, times long, least int"


def _dealt(docs: DataFrame, common: np.ndarray, ranks: np.ndarray, buckets: int, width: int, percent: int) -> DataFrame:
    """Prefix shingles by bucket, in blobs of many documents."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(common), ranks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, late, ranks = _Words(), np.unpackbits(shared.value[0]).astype(bool), shared.value[1]
        held: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        size = 0

        def flush():
            sigs = np.array(list(held), np.uint64).reshape(-1, 2)
            tokens = np.concatenate([p for p, _ in held.values()])
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), [len(p) for p, _ in held.values()])
            n = np.array([m for _, m in held.values()], np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, doc = tokens[order], doc[order]
            where = ((tokens * _MIX) >> np.uint64(33)) % np.uint64(buckets)
            out = []
            for b in range(buckets) if buckets < 4 * len(tokens) else np.unique(where):
                mine = where == np.uint64(b)
                if mine.any():
                    used, back = np.unique(doc[mine], return_inverse=True)
                    out.append((int(b), _pack(tokens[mine]), _pack(back, "<u4"), _pack(n[used], "<u4"), _pack(sigs[used, 0]), _pack(sigs[used, 1])))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[x.split()[0] for x in LISTS.split(", ")])

        for batch in batches:
            for text in batch.column(0):
                s, rank = ranked(word_hashes(text.as_py(), words), ranks, width)
                if len(s):
                    sig = signature(s)
                    if sig not in held:
                        held[sig] = (prefix(s, rank, late, percent), len(s))
                        size += len(held[sig][0])
                if size > CHUNK_TOKENS:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(scan, LISTS)


def candidates_of(tokens: np.ndarray, node: np.ndarray, n: np.ndarray, name: np.ndarray, percent: int, limit: int = SHORT):
    """From distinct (token, node) entries: counted pairs of short lists (a, b, count), pairs of longer
    lists (leader, follower, count), and members of longer lists (list, node, count). n and name are by node; a
    pair's first node is the smaller by (size, name).
    """
    order = np.lexsort((name[node], n[node], tokens))
    tokens, node = tokens[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(tokens)))
    # short lists, all at once: entries k apart in one list
    left = np.repeat(start + size, size) - np.arange(len(tokens))  # entries from here to the list's end
    short = np.repeat(size <= limit, size)
    found = []
    for k in range(1, limit):
        at = np.flatnonzero(short & (left > k))
        if not len(at):
            break
        a, b = node[at], node[at + k]
        fit = 100 * n[a] >= percent * n[b]
        found.append(a[fit].astype(np.uint64) << np.uint64(32) | b[fit].astype(np.uint64))
    pairs = _counted(np.concatenate(found) if found else np.zeros(0, np.uint64))
    # longer lists: bands of compatible size, each with a leader; equal lists are one, with a count
    lists: dict[int, list] = {}
    for a, k in zip(start[size > limit], size[size > limit], strict=True):
        own = node[a : a + k]
        lists.setdefault(xxh64_intdigest(np.sort(name[own]).tobytes()), [own, 0])[1] += 1
    leads, held = [np.zeros(0, np.uint64)], [np.zeros((3, 0), np.int64)]
    for stamp, (own, times) in lists.items():
        sizes, i, k = n[own], 0, len(own)
        while i < k - 1:
            last = int(np.searchsorted(sizes, 100 * int(sizes[i]) // percent, "right"))
            band = np.uint64(own[i]) << np.uint64(32) | own[i + 1 : last].astype(np.uint64)
            leads.append(np.repeat(band, times))
            i = last
        held.append(np.stack([np.full(k, stamp, np.uint64).view(np.int64), own, np.full(k, times)]))
    return pairs, _counted(np.concatenate(leads)), np.concatenate(held, 1)


def _counted(keys: np.ndarray) -> np.ndarray:
    """(a, b, count) of keys a << 32 | b."""
    u, c = np.unique(keys, return_counts=True)
    return np.stack([(u >> np.uint64(32)).astype(np.int64), (u & np.uint64(0xFFFFFFFF)).astype(np.int64), c])


def _candidates(dealt: DataFrame, percent: int, limit: int) -> DataFrame:
    """kind 0: counted pairs; 1: leaders and followers; 2: members of longer lists."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        s1, s2 = np.concatenate([_get(x) for x in rows["s1"]]), np.concatenate([_get(x) for x in rows["s2"]])
        n = np.concatenate([_get(x, "<u4") for x in rows["n"]]).astype(np.int64)
        counts = [len(_get(x, "<u4")) for x in rows["n"]]
        shift = np.cumsum([0, *counts[:-1]])
        doc = np.concatenate([_get(x, "<u4").astype(np.int64) + a for x, a in zip(rows["docs"], shift, strict=True)])
        tokens = np.concatenate([_get(x) for x in rows["tokens"]])
        both = np.stack([s1, s2], 1).copy().view([("a", "<u8"), ("b", "<u8")]).reshape(-1)
        u, first, back = np.unique(both, return_index=True, return_inverse=True)
        node = back[doc]
        # a class that several chunks sent counts once in each list
        order = np.lexsort((node, tokens))
        tokens, node = tokens[order], node[order]
        once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])])
        tokens, node = tokens[once], node[once]
        u1, u2, n = u["a"].view(np.int64), u["b"].view(np.int64), n[first]
        pairs, led, held = candidates_of(tokens, node, n, u["a"], percent, limit)
        kinds = [pairs.shape[1], led.shape[1], held.shape[1]]
        a = np.concatenate([pairs[0], led[0], held[1]])
        b = np.concatenate([pairs[1], led[1], held[1]])
        # what two linked sets share at least; a class may link with one a little smaller than itself
        least = common_least(np.minimum(n[a], np.where(a == b, least_overlap(n[a], percent), n[b])))
        times = np.concatenate([pairs[2], led[2], held[2]])
        stamp = np.concatenate([np.zeros(kinds[0] + kinds[1], np.int64), held[0]])
        return pd.DataFrame({"kind": np.repeat(np.arange(3, dtype=np.int32), kinds), "a1": u1[a], "a2": u2[a], "b1": u1[b], "b2": u2[b], "list": stamp, "times": times, "least": least.astype(np.int32)})

    return dealt.groupBy("bucket").applyInPandas(find, PAIRS)


# ---------------------------------------------------------------- comparing


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "text"])


def _compare_leader(width: int, percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        words = _Words()
        lead = rows[~rows["ask"]]
        out = []
        if len(lead):
            a = shingles(zlib.decompress(lead["text"].iloc[0]).decode("utf-8", "surrogatepass"), words, width)
            for node, text in zip(rows["node"][rows["ask"]], rows["text"][rows["ask"]], strict=True):
                b = shingles(zlib.decompress(text).decode("utf-8", "surrogatepass"), words, width)
                if linked(len(a), len(b), len(np.intersect1d(a, b, True)), percent):
                    out.append((int(lead["node"].iloc[0]), int(node)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return compare


def joining_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels, at most one per join, between the sides (or within, if there is one).

    The other side's token union bounds a set's overlap; sets that it rules out are not opened.
    """
    size = np.array([len(s) for s in sets], np.int64)
    alive = np.ones(len(sets), bool)
    two = bool(side.any())
    if two:
        for a in (0, 1):
            others = [s for s, b in zip(sets, side, strict=True) if b != a]
            union = np.unique(np.concatenate(others)) if others else np.zeros(0, np.uint64)
            for i in np.flatnonzero(side == a):
                alive[i] = len(np.intersect1d(sets[i], union, True)) >= least_overlap(size[i], percent)
    left = np.flatnonzero(alive & (side == 0))
    right = np.flatnonzero(alive & (side == 1)) if two else left
    if not len(left) or not len(right):
        return []
    # postings of the right side
    tokens = np.concatenate([sets[i] for i in right])
    who = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    root = {x: x for x in set(label.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, i in enumerate(left):
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        spans = hi - lo
        total = int(spans.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(total)
        shared = np.bincount(who[at], minlength=len(right))
        fits = np.flatnonzero(100 * shared >= percent * (size[i] + size[right] - shared))
        for m in fits if two else fits[fits > k]:
            a, b = find(int(label[i])), find(int(label[right[m]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(i), int(right[m])))
    return out


def _open_blocks(width: int, percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        words = _Words()
        sets = [shingles(zlib.decompress(t).decode("utf-8", "surrogatepass"), words, width) for t in rows["text"]]
        node = rows["node"].to_numpy()
        found = joining_links(sets, rows["label"].to_numpy(), rows["side"].to_numpy(), percent)
        return pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["a", "b"]).astype("int64")

    return compare


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """placed (node, label, n, part) with blk: its block inside its part.

    A part of up to BLOCK classes is one block. Of a larger one, a label with over BLOCK classes has its own
    blocks; the others are cut by size, in steps of 4 percent, and by hash where still too many.
    """
    many = placed.groupBy("part").agg((F.count(F.lit(1)) > block).alias("many"))
    big = placed.groupBy("label").agg((F.count(F.lit(1)) > block).alias("big"))
    cut = placed.join(many, "part").join(big, "label")
    own = F.when(F.col("big"), F.col("label"))
    band = F.when(F.col("many"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.04))).cast("int")).otherwise(0)
    cut = cut.withColumn("own", F.coalesce(own, F.lit(-1).cast("long"))).withColumn("band", band)
    pieces = cut.groupBy("part", "own", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces"))
    cut = cut.join(pieces, ["part", "own", "band"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    return cut.withColumn("blk", F.xxhash64("part", "own", "band", "piece"))


def _chosen(found: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare at once (a, b), and members of the longer lists of round 2 (list, node).

    Two linked classes share l prefix shingles, some in short lists, all of which count, and some in longer
    ones, of which each class has a known number of entries (times counts shingles that have the same list).
    So with fewer than l such entries in either class, the short lists hold the rest, and the pair is met here.
    """
    named = classes.select("s1", "s2", "node")
    left, right = named.toDF("a1", "a2", "a"), named.toDF("b1", "b2", "b")
    ids = ["a1", "a2", "b1", "b2"]
    entries = checkpoint(found.where("kind = 2").groupBy("a1", "a2").agg(F.sum("times").alias("long"), F.first("least").alias("least")))
    summed = found.where("kind < 2").groupBy("kind", *ids).agg(F.sum("times").alias("times"), F.first("least").alias("least"))
    # leaders only form groups, so weak ones may go; round 2 covers what they would have found
    enough = F.when(F.col("kind") == 0, F.col("times") >= F.col("least")).otherwise(2 * F.col("times") >= F.col("least"))
    weak = summed.where((F.col("kind") == 0) & (F.col("times") < F.col("least")))
    known = small_or_shuffled(entries)
    for side in "ab":
        weak = weak.join(known.select(F.col("a1").alias(f"{side}1"), F.col("a2").alias(f"{side}2"), F.col("long").alias(f"long_{side}")), [f"{side}1", f"{side}2"])
        weak = weak.where(F.col("times") + F.col(f"long_{side}") >= F.col("least"))
    pairs = summed.where(enough).select(*ids).union(weak.select(*ids)).distinct()
    pairs = checkpoint(pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a", "b"))
    lists = found.where("kind = 2").select("list", "a1", "a2").distinct()
    lists = lists.join(entries.where("long >= least").select("a1", "a2"), ["a1", "a2"]).join(left, ["a1", "a2"])
    return pairs, checkpoint(lists.select("list", F.col("a").alias("node")))


def _block(of: DataFrame, key: str) -> DataFrame:
    """of with blks: in how many blocks of about 256 rows its key's rows are dealt."""
    sizes = of.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("blks"))
    return of.join(sizes, key)


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, short: int = SHORT, block: int = BLOCK
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    return _components(docs, id_col, text_col, width, percent, short, block).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the smallest id (any if none has one); texts without words all stay.

    Rows are known by the hash of id and text, so repeated ids are safe.
    """
    rows = checkpoint(_components(docs, id_col, text_col, width, percent).where("label IS NOT NULL").select("doc_id", "key", "label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    groups = rows.groupBy("label").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", F.col("f.key").alias("first"))
    met = rows.join(small_or_shuffled(checkpoint(groups)), "label").groupBy("key").agg(F.first(F.col("key") == F.col("first")).alias("kept"), F.count(F.lit(1)).alias("n"))
    met = checkpoint(met.where("NOT kept OR n > 1").select(F.col("key").alias("__near_key"), "kept"))
    key = F.xxhash64(F.col(id_col).cast("long").cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    marked = docs.withColumn("__near_key", key)
    once = marked.join(small_or_shuffled(met.select("__near_key")), "__near_key", "left_anti")
    again = marked.join(small_or_shuffled(met.where("kept").select("__near_key")), "__near_key", "left_semi").dropDuplicates(["__near_key"])
    return once.unionByName(again).select(docs.columns)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, key, n_shingles, component_id, label (null for texts without words)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = checkpoint(_sets(docs, width))
    own = sets.where("kind = 0")
    live = own.where("n > 0")
    classes = live.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("least_id"),
        F.first("n").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "key")).alias("f"),
    )
    classes = checkpoint(classes.select("s1", "s2", "n", "least_id", F.col("f.row").alias("node"), F.col("f.key").alias("key")))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(32, -(-total * (110 - percent) // (100 * BUCKET_TOKENS)))
    found = checkpoint(_candidates(_dealt(docs, *_common(sets), buckets, width, percent), percent, short))
    pairs, lists = _chosen(found, classes)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(lists.select("node")).distinct()
    wanted = small_or_shuffled(checkpoint(needed.join(classes.select("node", "key"), "node")))
    texts = docs.withColumn("key", _key()).join(wanted, "key").select("node", "text").mapInArrow(_squeezed, "node long, text binary")
    texts = checkpoint(texts.dropDuplicates(["node"]))

    # round 1: followers against their leaders
    dealt = _block(pairs, "a").withColumn("blk", F.pmod(F.xxhash64("b"), F.col("blks")).cast("int"))
    followers = dealt.select(F.col("a").alias("grp"), "blk", F.lit(True).alias("ask"), F.col("b").alias("node"))
    leaders = dealt.select(F.col("a").alias("grp"), "blk", F.lit(False).alias("ask"), F.col("a").alias("node")).distinct()
    sides = followers.union(leaders).join(texts, "node").select("grp", "blk", "ask", "node", "text")
    links = checkpoint(sides.groupBy("grp", "blk").applyInPandas(_compare_leader(width, percent), "a long, b long"))
    label = components(links)

    # round 2: blocks of classes that longer lists connect, each pair of blocks in one task
    def of(df: DataFrame) -> DataFrame:
        return df.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    placed = of(lists.select("list", "node"))
    mixed = placed.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first")).where("lo < hi")
    placed = checkpoint(placed.join(mixed.select("list", "first"), "list"))
    part = components(placed.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("label", "part")
    placed = placed.select("node", "label").distinct().join(part, "node").join(classes.select("node", "n"), "node")
    placed = checkpoint(_blocks(placed, block).select("node", "label", "n", "part", "blk"))
    blocks = placed.groupBy("part", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sized = (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
    one_group = (F.col("x.l0") == F.col("x.l1")) & (F.col("y.l0") == F.col("y.l1")) & (F.col("x.l0") == F.col("y.l0"))
    meet = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.blk") <= F.col("y.blk")) & sized & ~one_group)
    meet = checkpoint(meet.select(F.col("x.blk").alias("p"), F.col("y.blk").alias("q")))
    sides = meet.select("p", "q", F.col("p").alias("blk"), F.lit(0).alias("side")).union(meet.where("p <> q").select("p", "q", F.col("q"), F.lit(1)))
    sides = sides.join(placed.select("blk", "node", "label"), "blk").join(texts, "node").select("p", "q", "side", "node", "label", "text")
    more = checkpoint(sides.groupBy("p", "q").applyInPandas(_open_blocks(width, percent), "a long, b long"))
    label = components(links.union(more))

    classes = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = classes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = classes.join(names, "label").select("s1", "s2", "component_id", "label")
    out = live.join(named, ["s1", "s2"]).select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "component_id", "label")
    return out.union(own.where("n = 0").select("doc_id", "key", F.lit(0).cast("long"), F.col("doc_id"), F.lit(None).cast("long")))
