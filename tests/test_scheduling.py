"""Literal fairness cases, and the simulator against the closed forms."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.plans.scheduling import check_expression, fnv64a, lottery, simulate


def queue(n):
    return [(i + 1, 0) for i in range(n)]


def served(queues, weights, turns, **kw):
    return list(simulate({g: queue(n) for g, n in queues.items()}, weights, turns, **kw))


def test_small_tenant_is_not_starved():
    out = served({"A": 500, "B": 20}, {"A": 1.0, "B": 1.0}, 520)
    assert max(t for t, g, *_ in out if g == "B") == 40


def test_weights_share_serves():
    n = Counter(g for _, g, *_ in served({"A": 1000, "B": 1000}, {"A": 1.0, "B": 3.0}, 40))
    assert 2.3 <= n["B"] / n["A"] <= 3.7


def test_equal_weights_share_equally():
    n = Counter(g for _, g, *_ in served({"A": 100, "B": 100}, {"A": 1.0, "B": 1.0}, 20))
    assert abs(n["A"] - n["B"]) <= 2


def test_strict_priority_serves_the_heavy_group_first():
    out = served({"A": 20, "B": 20}, {"A": 1.0, "B": 5.0}, 40, score=lambda g, w, b, i, vt, t, d: w * 1e6 - vt)
    assert [g for _, g, *_ in out[:20]] == ["B"] * 20


def test_shortest_queue_first():
    out = served({"A": 30, "B": 5}, {"A": 1.0, "B": 1.0}, 35, score=lambda g, w, b, i, vt, t, d: -b)
    assert [g for _, g, *_ in out[:5]] == ["B"] * 5


def test_held_leases_cost_their_group():
    n = Counter(g for _, g, *_ in served({"fast": 500, "slow": 500}, {"fast": 1.0, "slow": 1.0}, 150, hold=("slow",)))
    assert n["fast"] >= 3 * n["slow"]


def test_a_score_that_is_not_finite_falls_back():
    out = served({"A": 5, "B": 5}, {"A": 1.0, "B": 1.0}, 10, score=lambda *x: float("nan"))
    assert len(out) == 10 and [f for *_, f in out] == [True] * 5 + [False] * 5  # the fifth fault quarantines the policy


def test_a_faulty_policy_is_quarantined_and_charged_plainly():
    n = []
    out = served({"A": 9, "B": 9}, {"A": 1.0, "B": 1.0}, 12, score=lambda *x: n.append(1) or float("nan"), hold=("A",))
    assert [f for *_, f in out] == [True] * 5 + [False] * 7 and [g for _, g, *_ in out] == ["A", "B"] * 6
    assert len(n) == 10  # both groups in each of five turns
    out = served({"A": 30}, {"A": 1.0}, 20, score=lambda *x: 1 / 0, tick_ms=3000)
    assert all(f for *_, f in out)  # four faults in each window of ten seconds


def test_arrivals_after_an_idle_turn_are_served():
    queues = {"A": [(1, 0), (2, 5)], "B": [(1, 5), (2, 9)]}
    assert [(t, g, m) for t, g, m, _ in simulate(queues, {"A": 1.0, "B": 1.0}, 12)] == [(1, "A", 1), (6, "A", 2), (7, "B", 1), (10, "B", 2)]


def test_weights_and_pauses_change_between_turns():
    out = list(simulate({"A": queue(40), "B": queue(40)}, {"A": 1.0, "B": 1.0}, 40, changes={10: [("B", None, True)], 20: [("B", 4.0, False)]}))
    n = [Counter(g for t, g, *_ in out if a < t <= a + 10) for a in (0, 10, 20, 30)]
    assert n[0] == {"A": 5, "B": 5} and n[1] == {"A": 10} and n[2] == {"B": 10} and n[3]["B"] > 4 * n[3].get("A", 0)


def test_deficit_is_a_variable_of_the_simulator():
    from tidemark.plans.scheduling import compiled

    wfq = [g for _, g, *_ in served({"A": 9, "B": 30}, {"A": 1.0, "B": 3.0}, 30)]
    assert [g for _, g, *_ in served({"A": 9, "B": 30}, {"A": 1.0, "B": 3.0}, 30, score=compiled("deficit + age_ms"))] == wfq


def test_paused_groups_wait():
    out = served({"A": 5, "B": 5}, {"A": 1.0, "B": 1.0}, 10, paused=frozenset("B"), score=lambda g, w, b, i, vt, t, d: -vt)
    assert [g for _, g, *_ in out] == ["A"] * 5


queues = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 12), min_size=1)


@settings(max_examples=150, deadline=None)
@given(queues, st.data())
def test_closed_forms_are_the_greedy_order(sizes, data):
    w = {g: data.draw(st.sampled_from([1.0, 2.0, 4.0, 8.0])) for g in sizes}
    rows = [(g, k, n) for g, n in sizes.items() for k in range(1, n + 1)]
    total = len(rows)
    forms = {
        "wfq": (lambda r: ((r[1] - 1) / w[r[0]], r[0]), {}),
        "strict": (lambda r: (-w[r[0]], (r[1] - 1) / w[r[0]], r[0]), {"score": lambda g, x, b, i, vt, t, d: x * 1e6 - vt}),
        "held": (lambda r: (r[1] * (r[1] - 1) / (2 * w[r[0]]), r[0]), {"hold": tuple(sizes)}),
        "shortest": (lambda r: (r[2], r[0], r[1]), {"score": lambda g, x, b, i, vt, t, d: -b}),
        "longest": (lambda r: (r[1] - r[2] - 1, r[0]), {"score": lambda g, x, b, i, vt, t, d: b}),
    }
    for name, (key, kw) in forms.items():
        want = [(g, k) for g, k, _ in sorted(rows, key=key)]
        got = [(g, m) for _, g, m, _ in served(sizes, w, total, **kw)]
        assert got == want, name


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.lists(st.integers(-5, 5), min_size=1, max_size=8), min_size=1))
def test_running_minimum_is_the_greedy_order(scores):
    rows = [(min(x[: k + 1]), g, k) for g, x in scores.items() for k in range(len(x))]
    want = [(g, k + 1) for _, g, k in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))]
    score = lambda g, w, b, i, vt, t, d: scores[g][len(scores[g]) - b]
    got = [(g, m) for _, g, m, _ in served({g: len(x) for g, x in scores.items()}, dict.fromkeys(scores, 1.0), len(rows), score=score)]
    assert got == want


def test_expressions_name_only_what_they_may():
    assert check_expression("weight / greatest(1, inflight) - 1.5E0 * virtual_time")
    for bad in ("lane", "java_method(1)", "weight; drop", "backlog + 'x'", "w" * 501):
        with pytest.raises(ValueError):
            check_expression(bad)


def test_lottery_is_deterministic_and_weighted():
    assert fnv64a(b"") == 14695981039346656037 and fnv64a(b"a") == 0xAF63DC4C8601EC8C
    assert 2.0 <= lottery("g1", 2.0, 7) < 4.0 and lottery("g1", 2.0, 7) == lottery("g1", 2.0, 7)
