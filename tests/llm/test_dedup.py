"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import exact_dedup, line_dedup, ngram_join
from tidemark.llm.graph import components


def digest(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_exact_dedup_equals_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[digest(r["text"])].append(r["doc_id"])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g), len(g), r["doc_id"] == min(g))


@pytest.mark.parametrize("support", [0.001, 0.2, 0.5])
def test_heavy_digests_take_the_same_answer(spark, support):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, support=support).collect()}
    assert got[2] == (1, 200, False) and got[1] == (1, 200, True) and got[3] == (3, 1, True)


def test_exact_dedup_awkward(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == 16
    one = [r for r in got if r["doc_id"] in (1, 2)]
    assert sum(r["kept"] for r in one) == 1 and all(r["group_size"] == 3 and r["keep_id"] == 1 for r in one)
    empty = [r for r in got if r["text_sha256"] == digest("")]
    assert {r["keep_id"] for r in empty} == {3} and len(empty) == 3
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in got)
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def reference_components(items, width, percent):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(items):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(items)}


@pytest.mark.parametrize(("width", "percent", "short", "block"), [(4, 85, 32, 1024), (5, 80, 2, 8)])
def test_ngram_components_equal_brute_force(docs, rows, width, percent, short, block):
    want = reference_components([(r["doc_id"], r["text"]) for r in rows], width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, width=width, percent=percent, short=short, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("short", [2, 32])
def test_chains_of_near_copies(spark, short):
    """A family whose neighbours link while its ends do not, beside strays that share most of its words."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    items = []
    for i in range(60):
        if i % 4 == 0:
            words[rng.integers(60)] = f"x{i}"
        own = list(words)
        if i % 7 == 0:
            for k in rng.integers(0, 60, 6):
                own[k] = f"y{i}-{k}"
        items.append((i, " ".join(own)))
    want = reference_components(items, 4, 85)
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, short=short, block=8).collect()}
    assert got == want and len({c for _, c in got.values()}) > 1


def test_a_frequent_shingle_does_not_bring_near_copies_together(spark, monkeypatch):
    """Near copies whose texts differ but for one phrase, beside longer ones that link by longer lists and short ones together."""
    rng = np.random.default_rng(5)
    phrase, items = "it may well be that", []
    for i in range(30):
        own = [f"w{i}-{k}" for k in range(60)]
        for j in range(2):
            items.append((2 * i + j, " ".join([*own[:30], phrase, *own[30:-1], f"end{j}"])))
    passage = [f"p{k}" for k in range(40)]
    for i in range(24):  # a common passage and a tail that pairs share, with edits in either
        tail = [f"t{i // 2}-{k}" for k in range(40)]
        for _ in range(int(rng.integers(3))):
            tail[rng.integers(40)] = f"x{i}"
        items.append((100 + i, " ".join(passage + tail)))
    want = reference_components(items, 4, 85)
    seen, chosen = [], ngram_join._chosen
    monkeypatch.setattr(ngram_join, "_chosen", lambda *a: seen.append(chosen(*a)) or seen[-1])
    df = spark.createDataFrame(items, "doc_id long, text string")
    for short in (2, 4, 8):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, short=short, block=8).collect()}
        assert got == want
        pairs, lists = seen[-1]
        assert lists.select("node").distinct().count() <= 24  # those with the passage; the others meet by their own shingles
        assert pairs.count() >= 30


def test_prefixes_leave_out_shingles_of_frequent_words():
    """Where no shingle is frequent enough to count as common, those of frequent words still come last."""
    words = ngram_join._Words()
    often = [f"f{k}" for k in range(20)]
    ranks = np.zeros(1 << ngram_join.WORD_BITS, np.uint8)
    ranks[(ngram_join.word_hashes(" ".join(often), words) >> np.uint64(64 - ngram_join.WORD_BITS)).astype(np.int64)] = 80
    common = np.zeros(1 << ngram_join.SLOT_BITS, bool)
    text = " ".join(often + [f"r{k}" for k in range(20)])
    s, rank = ngram_join.ranked(ngram_join.word_hashes(text, words), ranks)
    assert s.tolist() == ngram_join.shingles(text, words).tolist()
    first = ngram_join.prefix(s, rank, common)
    assert len(first) == len(s) - ngram_join.least_overlap(len(s)) + ngram_join.common_least(len(s))
    assert not set(first.tolist()) & set(ngram_join.shingles(" ".join(often), words).tolist())


def test_ngram_awkward(awkward, nothing):
    got = ngram_join.ngram_components(awkward).collect()
    assert len(got) == 16
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[4]["component_id"] == 4 and by[6]["n_shingles"] == 1
    assert by[5]["n_shingles"] == 1  # one word over and over is one shingle
    assert ngram_join.ngram_components(nothing).count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (21, 22), (22, 23), (23, 20), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), **dict.fromkeys((20, 21, 22, 23), 20)}


def test_recurring_lines_go_and_others_stay(spark):
    notice = "Copyright notice number {} of the example project"
    items = [(i, f"{chr(97 + i) * 6} begins a line of its own that stays\n{notice.format(i)}\n{i}") for i in range(8)]
    items.append((8, "User alice logged in from the office\nshort line"))
    items += [(9 + i, f"User {n} logged in from the office") for i, n in enumerate(("bob", "carol", "dave", "erin"))]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(items, "doc_id long, text string"), depth=1).collect()}
    assert all(got[i]["n_dropped"] == 1 and "Copyright" not in got[i]["text"] and got[i]["text"].endswith(f"stays\n{i}") for i in range(8))
    assert all("logged" not in got[i]["text"] for i in range(8, 13)) and got[8]["text"] == "short line"


def reference_line_dedup(items, depth=3):
    """text, lines and dropped lines of each document by plain loops."""

    def masked(line):
        w = re.split("[\x20\x09-\x0d]+", line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
        return tuple("<*>" if re.search("[0-9]", x) else x for x in w)

    holds = defaultdict(set)
    for d, text in items:
        for line in (text or "").split("\n"):
            if any(x not in ("", "<*>") for x in masked(line)):
                holds[masked(line)].add(d)
    long = lambda m: len(m) >= 20 or len(" ".join(m)) >= 120
    drop = {m for m, d in holds.items() if len(d) >= (2 if long(m) else 5)}
    leaves = defaultdict(list)
    for m in holds:
        leaves[len(m), m[:depth]].append(m)
    for lines in leaves.values():
        while len(lines) > 1:
            total = sum(len(holds[m]) for m in lines)
            n = Counter((i, x) for m in lines for i, x in enumerate(m) for _ in holds[m] if x != "<*>")
            fixed = {k for k, c in n.items() if c >= 5 and c >= 0.1 * total}
            groups = defaultdict(list)
            for m in lines:
                own = [(i, x) for i, x in enumerate(m) if (i, x) in fixed]
                if len(own) > depth and len(own) >= 0.7 * sum(x != "<*>" for x in m):
                    groups[tuple(own)].append(m)
            found = {m for g in groups.values() if len(set().union(*(holds[m] for m in g))) >= 5 for m in g}
            drop |= found
            lines = [m for m in lines if m not in found] if found else []
    out = {}
    for d, text in items:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if masked(x) not in drop]
        out[d] = (None if text is None else "\n".join(left), len(lines), len(lines) - len(left))
    return out, drop


def test_line_dedup_equals_brute_force(spark, rows):
    names = [a + b for b in "na bert la ra mil fritz gerd".split() for a in "an el im on ul ar es".split()]
    extra = [f"User session was opened for {names[i % 49]} from the main office" for i in range(30)]
    extra += [f"User session was refused after {names[i % 49]} entered a wrong code" for i in range(20)]
    extra += [f"User session was {x} by {names[i % 49]} at the {x} desk" for x in ("begun", "ended", "moved") for i in range(6)]  # three equally common ones
    extra += [f"User session was closed by {names[i % 49]} {names[-i]} at night" for i in range(7)]  # rarer than a tenth until the others are gone
    extra += ["All rights reserved."] * 6 + ["12 34"] * 9 + ["Seite 4 von 10"] * 3 + [" ".join(f"word{chr(97 + i)}" for i in range(26))] * 2
    items = [(r["doc_id"], r["text"]) for r in rows] + [(100_000 + i, f"{x}\n\na line of number {i} alone {names[i % 49]}{i}") for i, x in enumerate(extra)]
    want, drop = reference_line_dedup(items)
    got = line_dedup.line_dedup(spark.createDataFrame(items, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == want
    assert ("All", "rights", "reserved.") in drop and ("<*>", "<*>") not in drop
    assert all(tuple(x.split()) in drop for x in extra if x.startswith("User") or x.startswith("worda"))


def test_line_dedup_awkward(awkward, nothing):
    got = line_dedup.line_dedup(awkward).collect()
    assert len(got) == 16 and sum(r["n_dropped"] for r in got) == 0
    assert {r["doc_id"]: r["n_lines"] for r in got}[3] == 0 and [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert line_dedup.line_dedup(nothing).count() == 0
