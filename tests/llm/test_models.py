"""Language ID, language-model scores, top-k, SentencePiece, packing and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, lm, packing, sentencepiece_scan, topk


# ---------------------------------------------------------------- language ID
def test_languages_of_held_out_documents(docs, rows):
    lang = {r["doc_id"]: r["lang"] for r in rows}
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)


def dictionary_kneser_ney(texts):
    """Interpolated Kneser-Ney over the letters of padded words by plain dictionaries: p(character | what stands before in its word)."""
    words = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
    grams = [defaultdict(float) for _ in range(langid.ORDER)]
    for w, times in words.items():
        padded = "\0" * (langid.ORDER - 1) + w + " "
        for i in range(langid.ORDER - 1, len(padded)):
            grams[-1][padded[i - langid.ORDER + 1 : i + 1]] += times
    for n in range(langid.ORDER - 1, 0, -1):  # how many different characters stand before
        for g in grams[n]:
            grams[n - 1][g[1:]] += 1
    total, kinds, d = [], [], []
    for g in grams:
        n1, n2 = sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())
        d.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
        total.append(Counter()), kinds.append(Counter())
        for x, c in g.items():
            total[-1][x[:-1]] += c
            kinds[-1][x[:-1]] += 1

    def p(c, before):
        out = 1 / 50_000
        for n in range(langid.ORDER):
            ctx = before[len(before) - n :] if n else ""
            if total[n][ctx]:
                out = max(grams[n].get(ctx + c, 0) - d[n], 0) / total[n][ctx] + d[n] * kinds[n][ctx] / total[n][ctx] * out
        return out

    return p, {c for g in grams[0] for c in g}


@pytest.mark.parametrize("slices", [1, 32])
def test_kneser_ney_equals_plain_dictionaries(rows, monkeypatch, slices):
    monkeypatch.setattr(langid, "SLICE", slices)
    texts = {lang: [r["text"] for r in rows if r["lang"] == lang][:3] for lang in ("de", "en", "fr")}
    m = langid.KneserNey.of(texts)
    words = ["banana", "straße", "the", "q", "élève", "日本", *(w for t in texts.values() for w in langid._words(t[0])[:40])]
    got = m.word_bits(words)
    for j, lang in enumerate(m.langs):
        p, alphabet = dictionary_kneser_ney(texts[lang])
        pad = "\0" * (langid.ORDER - 1)
        for w, bits in zip(words, got[:, j]):
            assert bits == pytest.approx(sum(-math.log2(p(c, (pad + w)[: i + langid.ORDER - 1])) for i, c in enumerate(w + " ")), rel=1e-4)
        for before in (pad, pad[:3] + "t", "\0the", "xqzj"):
            assert sum(p(c, before) for c in alphabet) + p("\x01", before) * (50_000 - len(alphabet)) == pytest.approx(1)


def test_every_label_is_learned_and_repeated_rows_take_no_place(spark, docs):
    """Rows without an id, or with one and the same, don't crowd the others out; labels beyond a slice count too."""
    import string

    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("immer derselbe Satz ohne Nummer").alias("text"), F.lit("de").alias("lang"))
    same = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("la même phrase encore une fois").alias("text"), F.lit("fr").alias("lang"))
    odd = [(10_000 + 40 * k + i, " ".join(f"{a}{b}{a}{a}{b}" for b in "xyzw"[: 2 + i % 3]), f"l{k:02}") for k, a in enumerate(string.ascii_lowercase + "àáâãäåæçèéêë") for i in range(8)]
    all_docs = docs.select("doc_id", "text", "lang").union(hot).union(same).union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    m = langid.train(all_docs, docs_per_lang=60)
    assert {"de", "en", "es", "fr"} < set(m.langs) and len(m.langs) == 42
    some = langid.sampled(all_docs, "doc_id", "text", "lang", 60)
    n = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    whole = Counter(r["lang"] for r in {(r["doc_id"], r["text"], r["lang"]): r for r in all_docs.where(~langid.held_out()).collect()}.values())
    assert n == {lang: min(60, k) for lang, k in whole.items()}
    held = docs.where(langid.held_out())
    right = langid.identify(held, model=m).join(held.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count()
    assert right > 0.95 * held.count()


def test_unlabelled_and_letterless_text(awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == 16
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 7, 8, 12))
    assert langid.identify(nothing).count() == 0
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id IN (3, 4, 7)").count() == 0


# ---------------------------------------------------------------- language model
def good_turing(counts):
    """What is left of counts 1 to 5, by Katz's formula, or half a count less where it leaves (0, 1)."""
    n, k = Counter(counts), 5
    out = {}
    for r in range(1, k + 1):
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
        d = (((r + 1) * n[r + 1]) / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = r * d if 0 < d < 1 else r - 0.5
    return out


def reference_scores(items):
    """The base literally, and Katz scores by plain dictionaries."""
    words = lambda t: (t or "").encode().lower().split()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in items}
    END = b""
    c = Counter(w for d, t in items if not held[d] for w in [*words(t), END])
    n, v = sum(c.values()), len(c)
    cls = lambda w: w if w in c else "UNK"
    d1, less = good_turing(c.values()), lambda x, d: d.get(x, x - 0.05)
    p = {w: less(c[w], d1) / n for w in c}
    p["UNK"] = 1 - sum(p.values())
    pairs = Counter((a, b) for d, t in items if not held[d] for a, b in zip(["START", *map(cls, words(t))], [*map(cls, words(t)), END]))
    d2 = good_turing(pairs.values())
    total, kept, mass = Counter(), defaultdict(float), defaultdict(float)
    for (a, b), x in pairs.items():
        total[a] += x
        kept[a] += less(x, d2)
        mass[a] += p[b]
    weight = {a: (1 - kept[a] / total[a]) / max(1e-300, 1 - mass[a]) for a in total}
    out = {}
    for d, t in items:
        w, base, score, before = [*words(t), END], 0.0, 0.0, "START"
        for x in w:
            base += math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
            k = cls(x)
            q = less(pairs[before, k], d2) / total[before] if pairs[before, k] else weight.get(before, 1.0) * p[k]
            score += math.log10(max(q, 1e-300))
            before = k
        out[d] = (held[d], len(w), sum(c[x] > 0 for x in w), n, base, score)
    return out, pairs, weight, p, d2, total


def test_scores_equal_plain_dictionaries(docs, rows):
    want = reference_scores([(r["doc_id"], r["text"]) for r in rows])[0]
    got = lm.score(docs).collect()
    assert len(got) == len(want)
    for r in got:
        h, n, k, t, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, t)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)


@pytest.mark.parametrize(("head", "chunk"), [(0, 1_500_000), (40, 3_000)])
def test_words_outside_the_head_keep_their_own_bigrams(docs, rows, monkeypatch, head, chunk):
    """However few words are broadcast, and whatever the chunks, every word is a word and a context of its own."""
    want = reference_scores([(r["doc_id"], r["text"]) for r in rows])[0]
    monkeypatch.setattr(lm, "HEAD", head)
    for r in lm.score(docs, chunk_tokens=chunk).collect():
        h, n, k, t, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, t)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)


def test_backoff_weights_normalise_exactly(rows):
    _, pairs, weight, p, d2, total = reference_scores([(r["doc_id"], r["text"]) for r in rows[:60]])
    assert sum(p.values()) == pytest.approx(1)
    for a in random.Random(1).sample(sorted(total, key=str), 20):
        q = sum(d2.get(pairs[a, b], pairs[a, b] - 0.05) / total[a] if pairs[a, b] else weight[a] * p[b] for b in p)
        assert q == pytest.approx(1)


def test_lm_awkward(awkward, nothing, spark):
    got = lm.score(awkward).collect()
    assert len(got) == 16 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 8)) and lm.score(nothing).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r["train_tokens"], r["score"]) for r in lm.score(only_held).collect()} == {(0, None)}


# ---------------------------------------------------------------- top-k
@pytest.mark.parametrize("seed", range(6))
def test_threshold_algorithm_is_exact(seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-4, 5, (200, 6)).astype(np.int64)
    m[50:120] = m[50]  # many ties
    ids, q = rng.permutation(200).astype(np.int64), rng.integers(-4, 5, 6).astype(np.int64)
    got = topk.threshold_top_k(m, ids, np.argsort(m, axis=0, kind="stable").T.copy(), q, int(ids[3]), 10)
    want = sorted(((-int(s), int(i)) for s, i in zip(m @ q, ids) if i != ids[3]))[:10]
    assert [(-s, i) for s, i in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_a_known_score_only_leaves_out_rows_below_it(seed):
    rng = np.random.default_rng(seed)
    m, ids = rng.integers(-20, 20, (300, 6)), rng.permutation(300)
    orders = np.argsort(m, axis=0, kind="stable").T
    for own in range(0, 300, 30):
        q = m[np.flatnonzero(ids == own)[0]]
        whole = sorted(((int(s), int(i)) for s, i in zip(m @ q, ids, strict=True) if i != own), key=lambda x: (-x[0], x[1]))
        for least in (whole[3][0], whole[12][0], whole[0][0] + 1):
            assert topk.threshold_top_k(m, ids, orders, q, own, 10, least) == [x for x in whole if x[0] >= least][:10]


@pytest.mark.parametrize("block", [20, 64])
def test_top_k_in_blocks_and_odd_vectors(spark, block):
    nan, inf = float("nan"), float("inf")
    vecs = [(i, [math.sin(i * (d + 1)) for d in range(8)]) for i in range(300)]
    bad = [(1000, None), (1001, [1.0, None]), (1002, [nan] * 8), (1003, [inf] * 8), (1004, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(vecs + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, block=block, query_block=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = {i: [math.floor(1024 * float(np.float32(c))) for c in v] for i, v in vecs}
    for q in (0, 100, 200):
        want = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {0, 100, 200}
    few = topk.top_k(df.where("vec_id IN (0, 5, 7)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [5, 7] and topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_every_row_is_a_query_of_its_own(spark):
    vecs = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (7, [2.0, 0.5]), (7, [2.0, 0.5]), (8, [0.25, 3.0]), (9, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    x = {v: [int(1024 * c) for c in e] for v, e in vecs if v}
    want = []
    for q in ([1024, 0], [0, 1024]):
        scored = sorted((-sum(a * b for a, b in zip(q, x[v])), v) for v, _ in vecs if v)[:3]
        want += [(0, r, v, -s) for r, (s, v) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


# ---------------------------------------------------------------- SentencePiece
@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_scan.load()


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The library's own engine on this vocabulary, read as a unigram model with scores that 32-bit floats hold."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sentencepiece_scan.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for q in m.pieces:
        q.score = max(q.score, -40000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return sentencepiece_scan.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_ids_are_the_librarys(library, rows):
    own, lib = library
    e = sentencepiece_scan.Encoder(own)
    lines = [x for r in rows[:120] for x in r["text"].split("\n") if x and "  " not in x]
    assert len(lines) > 200 and all(e.encode(x).tolist() == lib.encode(x) for x in lines)


def test_ids_of_a_bpe_model_are_the_librarys(pieces, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    assert pieces.bpe and all(len(pieces.units.findall(x)) == 1 for x in pieces.id)
    e = sentencepiece_scan.Encoder(pieces)
    odd = ["", " ", "  a  b ", "\n\n\t x", "日本語 \U0001f600‍", "a" * 300, "é" * 50, "no-spaces" * 40, "-=" * 99, "x" * 61 + " 1,000.00!!!"]
    assert all(e.encode(x).tolist() == lib.encode(x) for x in [*odd, *(r["text"] for r in rows)])
    some = docs.where("doc_id < 40").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\ue000 a\ue000b "), "text", F.lit("\ue001"))).otherwise(F.col("text")))
    want = {r["doc_id"]: lib.encode(r["text"]) for r in some.collect()}
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_scan.encode(some, giant=300, chunk=90).collect()}
    assert got == want


def test_round_trip(pieces, rows):
    e = sentencepiece_scan.Encoder(pieces)
    odd = ["", " ", "  a  b ", "▁", "a▁b ▁", "日本語 \U0001f600‍", "\n\n\t", "a" * 300, " x", "é" * 50]
    for x in [*odd, *(r["text"] for r in rows[:80])]:
        assert sentencepiece_scan.decode_ids(pieces, e.encode(x)) == x


@pytest.mark.parametrize("chunk", [3, 40, 700])
def test_matrices_combine_to_the_whole(pieces, rows, chunk):
    s = sentencepiece_scan
    for text in ["x" * 100 + " yy", "no-spaces" * 20, *(r["text"][:1500] for r in rows[:6])]:
        t = s._prepared(text)
        parts = [(t[i : i + chunk + pieces.longest - 1], min(chunk, len(t) - i)) for i in range(0, len(t), chunk)]
        m = [s.transfer(pieces, *x) for x in parts]
        left = m[0]
        for x in m[1:]:
            left = s.combine(left, x)
        assert left[0, 0] == s.best_path(pieces, t)[0]
        k = len(m) // 2
        if k:
            tree = s.combine(_fold(s, m[:k]), _fold(s, m[k:]))
            assert (tree == left).all()


def _fold(s, m):
    out = m[0]
    for x in m[1:]:
        out = s.combine(out, x)
    return out


def test_giant_texts_encode_like_short_ones(docs, pieces):
    some = docs.where("doc_id < 40").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" ▁ "), "text")).otherwise(F.col("text")))
    short = {r["doc_id"]: r["ids"] for r in sentencepiece_scan.encode(some).collect()}
    score = lambda ids: sum(pieces.score.get(pieces.text[i], pieces.unknown) for i in ids)
    for r in sentencepiece_scan.encode(some, giant=300, chunk=90).collect():
        assert score(r["ids"]) == score(short[r["doc_id"]])  # equal paths may differ across a cut
        assert sentencepiece_scan.decode_ids(pieces, r["ids"]) == r["text"]


def test_sentencepiece_awkward(awkward, nothing):
    got = sentencepiece_scan.encoded_summary(awkward).collect()
    assert len(got) == 16 and all(r["round_trip"] for r in got) and sentencepiece_scan.encoded_summary(nothing).count() == 0
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(awkward.where("doc_id IN (9, 10)")))
    assert back.where("decoded <> text").count() == 0 and back.count() == 2


# ---------------------------------------------------------------- packing
@pytest.mark.parametrize("seed", range(8))
def test_boundaries_minimise_padding(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
    counts = [rng.randint(1, 20) for _ in lengths]
    k = rng.randint(1, 4)

    def padding(bounds):
        return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

    from itertools import combinations

    best = min(padding([*cut, lengths[-1]]) for r in range(min(k, len(lengths))) for cut in combinations(lengths[:-1], r))
    got = packing.optimal_boundaries(np.array(lengths), np.array(counts), k)
    assert len(got) <= k and padding(got) == best


def test_packing_fills_batches_once(docs, rows, awkward, nothing):
    got = packing.pack(docs, token_budget=2000).collect()
    n = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"])) for r in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == n
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch"]].append(r)
    last = {b: max(x for y, x in batches if y == b) for b, _ in batches}
    for (b, k), rs in batches.items():
        cap = max(1, 2000 // max(1, rs[0]["padded_to"]))
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and (len(rs) == cap or k == last[b] and len(rs) <= cap)
        assert len({r["padded_to"] for r in rs}) == 1 and all(r["padding"] == r["padded_to"] - r["n_tokens"] >= 0 for r in rs)
    assert packing.pack(awkward).count() == 16 and packing.pack(nothing).count() == 0


def test_boundaries_come_from_exact_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_LENGTHS", 8, raising=False)  # beyond so many lengths they were once rounded up
    df = spark.createDataFrame([(100 * n + i, "w " * n) for n in range(1, 42) for i in range(n % 5 + 1)], "doc_id long, text string")
    bounds = packing.optimal_boundaries(np.arange(1, 42), np.array([n % 5 + 1 for n in range(1, 42)]), 6)
    assert sorted({r["padded_to"] for r in packing.pack(df, buckets=6).collect()}) == bounds


# ---------------------------------------------------------------- pipeline
def test_near_copies_go_by_row_not_by_id(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    near = lambda stem, k: " ".join([*(stem + w for w in words), f"end{k}"])
    items = [(3, near("a", 1)), (7, near("a", 2)), (7, "a text of its own that no other row is like"), (9, near("b", 1)), (9, near("b", 2)), (None, near("c", 1)), (None, near("c", 2)),
             (5, near("d", 1)), (5, near("d", 1)), (6, None), (6, None), (None, None)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got[3, near("a", 1)] == 1 and got[7, near("a", 2)] == 0 and got[items[2]] == 1
    assert got[9, near("b", 1)] + got[9, near("b", 2)] == 1 and got[None, near("c", 1)] + got[None, near("c", 2)] == 1
    assert got[5, near("d", 1)] == 1 and got[6, None] == 2 and got[None, None] == 1


def test_pipeline_stage_by_stage(spark, sf, docs, rows, tmp_path):
    import corpus_pipeline

    from tests.llm.test_dedup import digest, reference_components
    from tests.llm.test_scans import base_pii

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "pii", "packing"]
    made, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = made[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or now.columns == docs.columns
    kept = {name: {r["doc_id"]: r for r in df.collect()} for name, df in made.items()}
    assert len(kept["language_id"]) >= 0.99 * len(rows)
    first: dict[str, int] = {}
    for d, r in sorted(kept["language_id"].items()):
        first.setdefault(digest(r["text"]), d)
    assert set(kept["exact_dedup"]) == set(first.values())
    want = reference_components([(d, r["text"]) for d, r in kept["exact_dedup"].items()], 5, 80)
    assert set(kept["ngram_jaccard"]) == {d for d, (_, c) in want.items() if c == d}
    assert set(kept["pii"]) == set(kept["ngram_jaccard"]) == set(kept["packing"])
    for d, r in kept["pii"].items():
        assert not base_pii(r["text"]) and r["n_chars"] == len(r["text"])
    assert corpus_pipeline.run(spark, sf).count() == len(kept["packing"])


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    for i, now in enumerate((awkward, nothing)):
        first = now
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, "").write.parquet(str(tmp_path / f"{i}{name}"))
            now = spark.read.parquet(str(tmp_path / f"{i}{name}"))
            assert name == "packing" or now.columns == first.columns
            if name == "exact_dedup" and not i:
                ids = [r["doc_id"] for r in now.collect()]
                assert ids.count(1) == 1 and 2 not in ids and not {3, 4, 7, 8} & set(ids)
        assert i == 0 or now.count() == 0
