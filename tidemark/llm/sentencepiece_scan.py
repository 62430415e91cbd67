"""SentencePiece encoding and decoding: merges for BPE models, a max-plus parallel scan for unigram models.

With a BPE model a text is cut into units that no piece, so no merge, can cross. Each unit merges by itself, best
score first and leftmost of equal ones, which gives the library's ids; giant texts are cut between units only.

With a unigram model a text is a chain of code points; the vocabulary's pieces are weighted edges, and encoding is the path
of greatest total score. Giant texts are cut into chunks at any place. The state at a cut is how far the
piece that spans it reaches past it, so a chunk is a transfer matrix over (max, +): best score from an
entry state to an exit state. Matrices combine associatively along the text, which fixes the state at
every cut, and each chunk is then backtraced by itself between its two states. Where no piece can span a
place (before a space mark, around a newline) the matrix of what lies between two such places is one
number, which is memoised; only a chunk's ends need whole matrices. A short text is one chunk with
states 0 and 0.

Either way the ids are the library's own for texts without a literal U+2581. Models of other types, and BPE
models with user-defined or unused pieces, are refused. Conventions are SentencePiece's: a space mark U+2581 before the text and
for each space, byte pieces for characters outside the vocabulary, and of equal paths the one whose
pieces, from the end, reach farthest back (within a chunk). A literal U+2581 is spelled in bytes, so that
decoding always returns the text exactly.

Edge cases: null and empty texts have no ids and decode to ''; one output row for each input row; null
ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK, MEMO = 50_000, 16_384, 500_000
MARK = "\u2581"  # the space mark
STAND_IN = "\ue000"  # holds the place of a literal mark in chunks of giant texts
LOW = -(1 << 60)
UNIGRAM, BPE, USER_DEFINED, UNUSED = 1, 2, 4, 5  # the model file's numbers
SHORT = 60  # units up to here look for the next merge in a list, longer ones in a heap


# Parts of a text that no piece crosses: always before a run of marks and around newlines ...
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
# ... and between signs and other characters, where the vocabulary never joins the two: see _signs.
_FINE = "{m}*[{s}]+|{m}*[^{s}{m}\n]+|{m}+|\n"


def _signs(pieces: list[str]) -> set[str]:
    """The characters that pieces join, over any number of steps, with a full stop but not with an a."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            if MARK not in (a, b):
                root[find(a)] = find(b)
    return set() if find(".") == find("a") else {c for c in list(root) if find(c) == find(".") and c != "\n"}


class Pieces:
    """A vocabulary with integer scores (the file's, in thousandths)."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(sp.serialized_model_proto())
        self.bpe = m.trainer_spec.model_type == BPE
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or self.bpe and any(q.type in (USER_DEFINED, UNUSED) for q in m.pieces):
            raise ValueError(f"{path}: neither a unigram model nor a BPE model of plain pieces")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: round(sp.get_score(i) * 1000) for i in normal}
        self.unknown_id = sp.unk_id()
        self.unknown = min(self.score.values(), default=0) - 10_000
        self.longest = max(map(len, self.id), default=1)
        self.chars = {p for p in self.id if len(p) == 1}
        self.spell_literal = [self.bytes.get(b, self.unknown_id) for b in MARK.encode()]
        # for decoding: what an id adds, except bytes over 127, which only make characters together
        self.adds = [t.replace(MARK, " ") for t in self.text]
        self.high = np.zeros(n, bool)
        for i, b in self.byte_of.items():
            self.adds[i] = chr(b)
            self.high[i] = b > 127
        self._matches = None
        signs = _signs(list(self.id))
        self.units = re.compile(_FINE.format(m=MARK, s="".join(map(re.escape, sorted(signs))))) if signs else _UNITS

    def __getstate__(self):
        return self.__dict__ | {"_matches": None}

    def matches(self, s: str):
        """(last place, (length, score, id)) of every piece in s; by place, longest first."""
        if self._matches is None:
            import ahocorasick

            self._matches = ahocorasick.Automaton()
            for piece, w in self.score.items():
                self._matches.add_word(piece, (len(piece), w, self.id[piece]))
            self._matches.make_automaton()
        return self._matches.iter(s)

    def spell(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character outside the vocabulary."""
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes.get(b, self.unknown_id) for b in piece.encode("utf-8", "surrogatepass")]


def _prepared(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def best_path(p: Pieces, s: str) -> tuple[int, list[int]]:
    """Score and ids of the best path through s; of equal ones the last piece is the longest."""
    n = len(s)
    best, back, ids = [0] + [LOW] * n, [0] * (n + 1), [-1] * (n + 1)
    odd = [i for i, c in enumerate(s) if c not in p.chars] if not p.chars.issuperset(s) else []
    at = 0
    for last, (size, w, i) in p.matches(s):
        while at < len(odd) and odd[at] < last:  # characters outside the vocabulary end no piece
            k = odd[at]
            best[k + 1], back[k + 1] = best[k] + p.unknown, k
            at += 1
        end = last + 1
        total = best[end - size] + w
        if total > best[end]:
            best[end], back[end], ids[end] = total, end - size, i
    for k in odd[at:]:
        best[k + 1], back[k + 1] = best[k] + p.unknown, k
    out, end = [], n
    while end:
        out.extend((ids[end],) if ids[end] >= 0 else p.spell(s[end - 1])[::-1])
        end = back[end]
    return best[n], out[::-1]


def merged(p: Pieces, s: str) -> list[int]:
    """Ids of s by merges: the pair of best score first, the leftmost of equal ones."""
    parts, score = list(s), p.score
    if len(parts) > SHORT:
        parts = _merged_by_heap(parts, score)
    else:
        gain = [score.get(a + b, LOW) for a, b in zip(parts, parts[1:], strict=False)]
        while gain and (best := max(gain)) > LOW:
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score.get(parts[i - 1] + parts[i], LOW)
            if i < len(gain):
                gain[i] = score.get(parts[i] + parts[i + 1], LOW)
    return [i for piece in parts for i in p.spell(piece)]


def _merged_by_heap(parts: list[str], score: dict[str, int]) -> list[str]:
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(-w, i, i + 1, 2) for i in range(n - 1) if (w := score.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
            continue  # one of them has merged since
        parts[i], parts[j] = parts[i] + parts[j], ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (w := score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-w, a, b, len(parts[a]) + len(parts[b])))
    return [x for x in parts if x]


class _Memo(dict):
    """unit -> its ids as 32-bit numbers; emptied at MEMO units, which bounds its memory."""

    def __init__(self, p: Pieces):
        self.p = p

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = np.array(merged(self.p, unit) if self.p.bpe else best_path(self.p, unit)[1], "<i4").tobytes()
        return ids


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p, self.memo = pieces, _Memo(pieces)
        self.literal = np.array(pieces.spell_literal, "<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        first, *rest = text.split(MARK)  # a literal mark is spelled in bytes, by itself
        parts = [self.units(_prepared(first))]
        for part in rest:
            parts += [self.literal, self.units(part.replace(" ", MARK))]
        return np.frombuffer(b"".join(parts), "<i4")

    def chunk(self, s: str, stand_in: str) -> np.ndarray:
        """Ids of whole units, with stand-ins for literal marks."""
        return np.frombuffer(self.literal.join(map(self.units, s.split(stand_in))), "<i4")

    def units(self, s: str) -> bytes:
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.p.units.findall(s)))


load = Pieces


def decode_ids(p: Pieces, ids: np.ndarray) -> str:
    """The text of ids: exact for whatever encode() made."""
    ids = np.asarray(ids, np.int64)
    adds = list(map(p.adds.__getitem__, ids.tolist()))
    high = p.high[ids] if len(ids) else np.zeros(0, bool)
    if high.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            adds[a] = bytes(map(ord, adds[a:b])).decode("utf-8", "surrogatepass")
            adds[a + 1 : b] = [""] * (b - a - 1)
    return "".join(adds)[1:]


# ---------------------------------------------------------------- chunks of giant texts
# In a chunk, s is its own characters and then up to longest - 1 that follow; n is how many are its own.


def _edges(p: Pieces, s: str, start: int, n: int):
    """(end, score) of edges that begin at start; a literal mark is no piece's first character here."""
    c = s[start]
    if c == STAND_IN:  # stands for a literal mark: an edge of its own
        yield start + 1, p.unknown
        return
    for size in range(1, min(p.longest, len(s) - start) + 1):
        w = p.score.get(s[start : start + size])
        if w is not None:
            yield start + size, w
    if c not in p.id:
        yield start + 1, p.unknown


def _cuts(p: Pieces, s: str, n: int) -> list[int]:
    """Places in 1..n that no piece spans, ascending: where units meet."""
    return [m.end() for m in p.units.finditer(s.replace(STAND_IN, "\n")) if m.end() <= n and m.end() < len(s)] + ([n] if n == len(s) else [])


def _spread(p: Pieces, s: str, start: int, n: int) -> np.ndarray:
    """Row i: best scores of being at start, start + 1, ... from overhang i, by edges that begin before n."""
    size = p.longest
    best = np.full((n + size - start, size), LOW, np.int64)
    for i in range(min(size, len(best))):
        best[i, i] = 0
    for at in range(start, n):
        row = best[at - start]
        if row.max() > LOW // 2:
            for end, w in _edges(p, s, at, n):
                np.maximum(best[end - start], row + w, out=best[end - start])
    return best.T


def transfer(p: Pieces, s: str, n: int) -> np.ndarray:
    """longest x longest matrix: best score from entry overhang to exit overhang."""
    size, cuts = p.longest, _cuts(p, s, n)
    if not cuts:
        return _spread(p, s, 0, n)[:, n : n + size].clip(min=LOW)
    head = _spread(p, s, 0, cuts[0])[:, cuts[0]]
    middle = sum(best_path(p, u)[0] if u != STAND_IN else p.unknown for u in _between(s, cuts))
    tail = _spread(p, s, cuts[-1], n)[0][n - cuts[-1] : n - cuts[-1] + size]
    return (head[:, None] + middle + tail[None, :]).clip(min=LOW)


def _between(s: str, cuts: list[int]):
    return (s[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1).clip(min=LOW)


def cut_states(matrices: list[np.ndarray]) -> list[int]:
    """Overhang at each cut, first 0 and last 0, along the best path."""
    forward = [np.where(np.arange(len(matrices[0])) == 0, 0, LOW)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(0).clip(min=LOW))
    states = [0]
    for f, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        total = f + m[:, states[-1]]
        states.append(int(len(total) - 1 - total[::-1].argmax()))
    return states[::-1]


def _trace(p: Pieces, s: str, start: int, n: int, stop: int) -> list[int]:
    """Ids of the best pieces from start to stop that begin before n."""
    size = stop - start
    best, back = [LOW] * (size + 1), [0] * (size + 1)
    best[0] = 0
    for at in range(start, n):
        if best[at - start] > LOW:
            for end, w in _edges(p, s, at, n):
                if end <= stop and best[at - start] + w > best[end - start]:
                    best[end - start], back[end - start] = best[at - start] + w, at - start
    out, end = [], size
    while end > 0:
        out.append(s[start + back[end] : start + end])
        end = back[end]
    return [i for piece in reversed(out) for i in (p.spell_literal if piece == STAND_IN else p.spell(piece))]


def backtrace(encoder: Encoder, s: str, n: int, entry: int, leave: int) -> list[int]:
    """Ids of the pieces that begin in the chunk, between its entry and exit states."""
    p = encoder.p
    cuts = _cuts(p, s, n)
    if not cuts:
        return _trace(p, s, entry, n, n + leave)
    middle = b"".join(encoder.literal if u == STAND_IN else encoder.memo[u] for u in _between(s, cuts))
    return _trace(p, s, entry, cuts[0], cuts[0]) + np.frombuffer(middle, "<i4").tolist() + _trace(p, s, cuts[-1], n, n + leave)


def _giants_by_units(giants: DataFrame, shared, chunk: int) -> DataFrame:
    """doc_id, text, ids of giant texts under a BPE model: runs of units of about chunk characters, each by itself."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row, text in zip(rows["row"], rows["text"], strict=True):
                stand_in = next(c for c in map(chr, itertools.chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text)
                s = _prepared(text.replace(MARK, stand_in))
                ends = [0]
                for m in shared.value.units.finditer(s.replace(stand_in, "\n")):
                    if m.end() - ends[-1] >= chunk or m.end() == len(s):
                        ends.append(m.end())
                yield pd.DataFrame({"row": row, "k": range(len(ends) - 1), "s": [s[a:b] for a, b in zip(ends, ends[1:], strict=False)], "mark": stand_in}).astype({"k": "int32"})

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for rows in batches:
            yield pd.DataFrame({"row": rows["row"], "k": rows["k"], "ids": [encoder.chunk(s, c) for s, c in zip(rows["s"], rows["mark"], strict=True)]})

    parts = giants.select("row", "text").mapInPandas(cut, "row long, k int, s string, mark string").repartition("row", "k")
    made = parts.mapInPandas(ids_of, "row long, k int, ids array<int>")
    ids = made.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return giants.join(ids, "row").select("doc_id", "text", "ids")


def _encode_giants(giants: DataFrame, shared, chunk: int) -> DataFrame:
    """row, doc_id, hash, ids of giant texts, chunk by chunk."""
    ahead = shared.value.longest - 1
    mapped = F.concat(F.lit(MARK), F.translate(F.translate("text", MARK, STAND_IN), " ", MARK))
    whole = giants.where(~F.contains("text", F.lit(STAND_IN))).withColumn("s", mapped)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("s") - 1), F.lit(chunk))
    parts = whole.select("row", "s", F.explode(starts).alias("start")).select(
        "row",
        (F.col("start") / chunk).cast("int").alias("k"),
        F.expr(f"substring(s, start + 1, {chunk + ahead})").alias("s"),
        F.least(F.lit(chunk), F.length("s") - F.col("start")).alias("n"),
    )
    parts = checkpoint(parts.repartition("row", "k"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m = [transfer(shared.value, s, n).tobytes() for s, n in zip(rows["s"], rows["n"], strict=True)]
            yield pd.DataFrame({"row": rows["row"], "k": rows["k"], "m": m})

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        size = shared.value.longest
        at = cut_states([np.frombuffer(m, np.int64).reshape(size, size) for m in rows["m"]])
        return pd.DataFrame({"row": rows["row"], "k": rows["k"], "entry": at[:-1], "leave": at[1:]}).astype({"entry": "int32", "leave": "int32"})

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for rows in batches:
            encoder.memo.clear()
            ids = [backtrace(encoder, *x) for x in zip(rows["s"], rows["n"], rows["entry"], rows["leave"], strict=True)]
            yield pd.DataFrame({"row": rows["row"], "k": rows["k"], "ids": ids})

    cuts = parts.mapInPandas(matrices, "row long, k int, m binary").groupBy("row").applyInPandas(states, "row long, k int, entry int, leave int")
    traced = parts.join(cuts, ["row", "k"]).select("row", "k", "s", "n", "entry", "leave").mapInPandas(traces, "row long, k int, ids array<int>")
    ids = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return giants.join(ids, "row").select("doc_id", "text", "ids")


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, giant: int, chunk: int, make, schema: str) -> DataFrame:
    """make(doc ids, texts, lists of ids) -> Arrow columns of schema, in the worker that encodes."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # under a unigram model, a text that holds the stand-in for a literal mark is encoded in one piece
    is_giant = (F.length("text") > giant) & (F.lit(shared.value.bpe) | ~F.contains("text", F.lit(STAND_IN)))
    names = [x.split()[0] for x in schema.split(", ")]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds the ids held at a time
                part = batch.slice(at, 500)
                ids = [encoder.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(make(shared.value, part.column(0), part.column(1), ids), names=names)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(make(shared.value, batch.column(0), batch.column(1), ids), names=names)

    giants = checkpoint(rows.where(is_giant).withColumn("row", F.monotonically_increasing_id()))
    by = _giants_by_units if shared.value.bpe else _encode_giants
    return rows.where(~is_giant).mapInArrow(short, schema).unionByName(by(giants, shared, chunk).mapInArrow(long, schema))


def _whole(p: Pieces, docs: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
    return [docs, texts, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]


def _digests(p: Pieces, docs: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> list[pa.Array]:
    digest = [hashlib.sha256(np.ascontiguousarray(x, "<i4").tobytes()).hexdigest() for x in ids]
    same = [decode_ids(p, x) == t.as_py() for x, t in zip(ids, texts, strict=True)]
    return [docs, pa.array([len(x) for x in ids], pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, text, ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _encoded(docs, model_path, id_col, text_col, giant, chunk, _whole, f"doc_id {kind}, text string, ids array<int>")


def encoded_summary(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (they decode to the text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _encoded(docs, model_path, id_col, text_col, giant, chunk, _digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """encoded with a column decoded: the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: decode_ids(shared.value, x if x is not None else []))

    return encoded.withColumn("decoded", text_of("ids"))
