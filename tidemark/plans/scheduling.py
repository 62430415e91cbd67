"""Fair-scheduling plans: served order under a policy.

For policies whose score depends on a group's own state, serving one message at a time is a merge of the
groups' queues, and its order is a sort by a key of (group, k), k being the message's place in its group.
plan() picks that closed form where one is known, a running minimum of an arbitrary expression where
not, and a simulator per lane for the rest. Numbering a lane's order goes by ranges of the key, so a hot
lane is not one task.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import keyed_row_number, ranged_row_number
from tidemark.registry import op
from tidemark.sources.views import ACKED, LEASED, READY, Tables

_K = """SELECT m.lane, m.group_id, m.msg_id, weight, CAST(row_number() OVER (PARTITION BY m.lane, m.group_id ORDER BY msg_id) AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY m.lane, m.group_id) AS BIGINT) AS n
    FROM messages m JOIN groups_t g ON g.lane = m.lane AND g.group_id = m.group_id WHERE fate = 1 AND NOT paused"""


def ready_ranked(t: Tables) -> DataFrame:
    """Ready messages of unpaused groups with weight, place k in their group and its backlog n."""
    g = t.groups.where("NOT paused AND ready > 0").select("lane", "group_id", "weight", F.col("ready").alias("n"))
    rows = t.numbered.where(F.col("fate") == READY).select("lane", "group_id", "msg_id", F.col("ready_no").alias("k"))
    return rows.join(g, ["lane", "group_id"])  # groups are tenants and may be many; a small side is broadcast at run time


def ordered(rows: DataFrame, order: list) -> DataFrame:
    """Numbered by ranges of the whole order, so that neither a hot lane nor many equal keys are one task."""
    key = [f"_o{i}" for i in range(len(order))]
    named = rows.withColumns({k: F.expr(o) if isinstance(o, str) else o for k, o in zip(key, order, strict=True)})
    out = ranged_row_number(named.select("lane", "group_id", "msg_id", *key), ["lane"], key, "turn")
    return out.select("lane", "turn", "group_id", "msg_id")


def _by(order: str) -> str:
    return f"SELECT lane, CAST(row_number() OVER (PARTITION BY lane ORDER BY {order}) AS BIGINT) AS turn, group_id, msg_id FROM ({_K})"


def vt_key() -> Column:
    return (F.col("k") - 1).cast("double") / F.col("weight")


@op("sch_01", _by("CAST(k - 1 AS DOUBLE) / weight, group_id"))
def wfq(t: Tables) -> DataFrame:
    """Weighted fair queueing."""
    return ordered(ready_ranked(t), [vt_key(), "group_id"])


@op("sch_02", _by("weight DESC, CAST(k - 1 AS DOUBLE) / weight, group_id"))
def strict_priority(t: Tables) -> DataFrame:
    return ordered(ready_ranked(t), [-F.col("weight"), vt_key(), "group_id"])


@op("sch_04", _by("CAST(k - 1 AS DOUBLE) / weight, group_id"))
def completion_aware_acked(t: Tables) -> DataFrame:
    """Completion-aware with each message acked at once: nothing in flight, so WFQ."""
    return wfq(t)


@op("sch_05", _by("CAST(k * (k - 1) AS DOUBLE) / (2.0E0 * weight), group_id"))
def completion_aware_held(t: Tables) -> DataFrame:
    """Completion-aware with every lease held: the k-th serve costs k / weight."""
    key = (F.col("k") * (F.col("k") - 1)).cast("double") / (2.0 * F.col("weight"))
    return ordered(ready_ranked(t), [key, "group_id"])


@op("sch_06", _by("n, group_id, k"))
def shortest_queue(t: Tables) -> DataFrame:
    return ordered(ready_ranked(t), ["n", "group_id", "k"])


@op("sch_07", _by("-(n - k + 1), group_id"))
def longest_queue(t: Tables) -> DataFrame:
    left = F.col("k") - F.col("n") - 1
    return ordered(ready_ranked(t), [left, "group_id"])


# ---------------------------------------------------------------- expressions
VARIABLES = {"weight", "backlog", "inflight", "virtual_time", "deficit", "age_ms"}
FAULT_WINDOW_MS, FAULT_LIMIT = 10_000, 5
FUNCTIONS = {"abs", "least", "greatest", "sqrt", "ln", "exp", "pow", "floor", "ceil", "if", "coalesce"}
MAX_EXPRESSION = 500


def check_expression(text: str) -> str:
    """A policy expression names only known variables and functions and is short."""
    if len(text) > MAX_EXPRESSION:
        raise ValueError("policy expression is too long")
    for name in re.findall(r"(?<![\w.])[A-Za-z_]\w*", text):
        if name.lower() not in VARIABLES | FUNCTIONS | {"case", "when", "then", "else", "end", "and", "or", "not", "true", "false", "e"}:
            raise ValueError(f"policy expression may not use {name}")
    if re.search(r"[;'\"`{}\[\]]", text):
        raise ValueError("policy expression has a forbidden character")
    return text


def scored(t: Tables, text: str, cost: str | None = None) -> DataFrame:
    """ready_ranked with the expression's score before each serve; cost is an optional serve-cost expression."""
    rows = ready_ranked(t).withColumn("backlog", F.col("n") - F.col("k") + 1).withColumn("inflight", F.lit(0).cast("long"))
    each = F.lit(1.0) / F.col("weight")
    if cost:
        each = F.greatest(each, F.expr(check_expression(cost)).cast("double"))
    before = Window.partitionBy("lane", "group_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("virtual_time", vt_key() if cost is None else F.coalesce(F.sum(each).over(before), F.lit(0.0)))
    rows = rows.withColumn("age_ms", F.lit(0).cast("long"))  # no group carries an age
    if re.search(r"\bdeficit\b", text + (cost or ""), re.I):
        raise ValueError("deficit looks at other groups: use the simulator")
    return rows.withColumn("score", F.expr(check_expression(text)).cast("double"))


def by_expression(t: Tables, text: str, cost: str | None = None) -> DataFrame:
    """Greedy order under any own-state score: by the running minimum of the score, largest first."""
    w = Window.partitionBy("lane", "group_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = scored(t, text, cost).withColumn("key", F.min("score").over(w))
    return ordered(rows, [-F.col("key"), "group_id", "k"])


_EXPR = f"""SELECT lane, CAST(row_number() OVER (PARTITION BY lane ORDER BY key DESC, group_id, k) AS BIGINT) AS turn, group_id, msg_id FROM
    (SELECT *, min(score) OVER (PARTITION BY lane, group_id ORDER BY k) AS key FROM (SELECT *, CAST(n - k + 1 AS DOUBLE) * weight - (CAST(k - 1 AS DOUBLE) / weight) * 4.0E0 AS score FROM ({_K})))"""


@op("sch_08", _EXPR)
def expression_policy(t: Tables) -> DataFrame:
    return by_expression(t, "backlog * weight - virtual_time * 4.0E0")


op("udf_01", _EXPR)(lambda t: by_expression(t, "backlog * weight - virtual_time * 4.0E0"))


@op("udf_03", _by("CAST(k * (k - 1) AS DOUBLE) / (2.0E0 * weight), group_id"))
def serve_cost_policy(t: Tables) -> DataFrame:
    """A second expression gives the cost of a serve: held leases make the k-th cost k / weight."""
    rows = ready_ranked(t)
    w = Window.partitionBy("lane", "group_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    vt = F.coalesce(F.sum(F.col("k").cast("double") / F.col("weight")).over(w), F.lit(0.0))
    rows = rows.withColumn("vt", vt)
    return ordered(rows, ["vt", "group_id"])


# ---------------------------------------------------------------- simulator
def fnv64a(data: bytes) -> int:
    """FNV-1a; the offset basis and prime are fixed values of that hash."""
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def lottery(group: str, weight: float, turn: int) -> float:
    return weight * (1 + fnv64a(group.encode() + turn.to_bytes(8, "little")) % 1000 / 1000)


def simulate(queues, weights, turns, score=None, hold=(), paused=frozenset(), changes=None, tick_ms: int = 1, cost=None):
    """Serve one message a turn; a pure fold shared by batch and streaming.

    queues: group -> [(msg_id, arrival turn)], by arrival. score(group, weight, backlog, inflight, vt, turn, deficit), or None for
    WFQ; deficit is how far a group's virtual time lags behind the largest. cost(same) is what a serve costs, if that
    is more than 1 / weight; groups in hold keep their leases, which costs them (1 + inflight) / weight. changes:
    turn -> [(group, weight or None, paused or None)], made before that turn. Groups join at the least virtual time of
    the active ones. A score that raises or is not finite is a fault: the turn goes by WFQ at the plain cost, and after
    FAULT_LIMIT faults within FAULT_WINDOW_MS (tick_ms a turn) the policy is quarantined for good. A turn without an
    active group is idle. Yields (turn, group, msg_id, fallback).
    """
    vt: dict[str, float] = {}
    weights, paused = dict(weights), set(paused)
    inflight, heads, here = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    faults, since, quarantined = 0, None, False
    for turn in range(turns):
        for group, weight, pause in (changes or {}).get(turn, ()):
            if weight is not None:
                weights[group] = weight or 1.0
            if pause is not None:
                (paused.add if pause else paused.discard)(group)
        for g, q in queues.items():
            while here[g] < len(q) and q[here[g]][1] <= turn:
                here[g] += 1
        active = [g for g in queues if g not in paused and heads[g] < here[g]]
        if not active:
            continue
        least = min((vt[g] for g in active if g in vt), default=0.0)
        for g in active:
            vt.setdefault(g, least)
        most = max(vt[g] for g in active)
        view = {g: (g, weights[g], here[g] - heads[g], inflight[g], vt[g], turn, most - vt[g]) for g in active}
        fallback, values = False, {g: -vt[g] for g in active}
        if score is not None and not quarantined:
            try:
                scores = {g: score(*v) for g, v in view.items()}
                fallback = any(v != v or abs(v) == float("inf") for v in scores.values())
            except (ArithmeticError, ValueError, TypeError):
                fallback = True
            if fallback:
                now = turn * tick_ms
                if since is None or now - since > FAULT_WINDOW_MS:
                    since, faults = now, 0
                faults += 1
                quarantined = faults >= FAULT_LIMIT
            else:
                values = scores
        pick = min(active, key=lambda g: (-values[g], g))
        w = weights[pick] if weights[pick] > 0 else 1.0
        charge = 1 / w
        if not fallback and not quarantined:
            charge = max(charge, (1 + inflight[pick]) / w if pick in hold else 0.0, cost(*view[pick]) if cost else 0.0)
        vt[pick] += charge
        inflight[pick] += pick in hold
        yield turn + 1, pick, queues[pick][heads[pick]][0], fallback
        heads[pick] += 1


def compiled(text: str):
    """A checked expression as a function of one group's view, for the simulator. CASE has no form here."""
    names = {"abs": abs, "least": min, "greatest": max, "sqrt": math.sqrt, "ln": math.log, "exp": math.exp, "pow": pow, "floor": math.floor, "ceil": math.ceil, "if_": lambda c, a, b: a if c else b}
    code = compile(re.sub(r"\bif\s*\(", "if_(", check_expression(text).replace("<>", "!=")), "policy", "eval")

    def score(group, weight, backlog, inflight, virtual_time, turn, deficit):
        return float(eval(code, {"__builtins__": {}}, names | {"weight": weight, "backlog": backlog, "inflight": inflight, "virtual_time": virtual_time, "deficit": deficit, "age_ms": 0}))

    return score


def simulated(t: Tables, turns: int, score=None, hold=(), paused=frozenset(), changes=None, arrives=None) -> DataFrame:
    """The first turns of each lane under any policy, by the simulator; a lane sends only the heads of its queues.

    arrives(group, k) is the turn at which a group's k-th message comes, 0 where there is none.
    """
    rows = ready_ranked(t).where(F.col("k") <= turns).select("lane", "group_id", "msg_id", "weight", "k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues, weights = {}, {}
        for g, part in pdf.sort_values(["group_id", "k"]).groupby("group_id"):
            queues[g] = [(int(m), arrives(g, int(k)) if arrives else 0) for m, k in zip(part["msg_id"], part["k"], strict=True)]
            weights[g] = float(part["weight"].iloc[0])
        known = {turn: [c for c in some if c[0] in queues] for turn, some in (changes or {}).items()}
        out = list(simulate(queues, weights, turns, score, hold, paused, known))
        return pd.DataFrame({"lane": pdf["lane"].iloc[0], "turn": [x[0] for x in out], "group_id": [x[1] for x in out], "msg_id": [x[2] for x in out]}).astype({"turn": "int64", "msg_id": "int64"})

    return rows.groupBy("lane").applyInPandas(run, "lane string, turn long, group_id string, msg_id long")


@op("sch_03")
def lottery_order(t: Tables, turns: int = 200) -> DataFrame:
    return simulated(t, turns, lambda g, w, backlog, inflight, vt, turn, deficit: lottery(g, w, turn))


_SIM = """WITH RECURSIVE q AS MATERIALIZED (SELECT m.lane, m.group_id, m.msg_id, g.weight, row_number() OVER (PARTITION BY m.lane, m.group_id ORDER BY m.msg_id) AS k FROM messages m
      JOIN groups_t g ON g.lane = m.lane AND g.group_id = m.group_id WHERE fate = 1 AND NOT paused QUALIFY k <= 150),
    w AS MATERIALIZED (SELECT lane, list(group_id ORDER BY group_id) AS names, list(weight ORDER BY group_id) AS weights, list(n ORDER BY group_id) AS sizes FROM (SELECT lane, group_id, any_value(weight) AS weight, count(*) AS n FROM q GROUP BY lane, group_id) GROUP BY lane),
    sim(lane, turn, pick, heads, vts, seen) AS (SELECT lane, 0, 0, list_transform(names, lambda x: 0), list_transform(names, lambda x: CAST(0 AS DOUBLE)), list_transform(names, lambda x: FALSE) FROM w
    UNION ALL SELECT lane, turn, pick, list_transform(heads, lambda h, i: h + CAST(i = pick AS INTEGER)), list_transform(joined, lambda v, i: CASE WHEN i = pick THEN v + 1 / weights[i] ELSE v END), seen FROM
     (SELECT *, coalesce(list_position(joined_or_not, list_min(joined_or_not)), 0) AS pick FROM
      (SELECT *, list_transform(joined, lambda v, i: CASE WHEN active[i] THEN v END) AS joined_or_not, list_transform(seen0, lambda s, i: s OR active[i]) AS seen FROM
       (SELECT *, list_transform(vts, lambda v, i: CASE WHEN active[i] AND NOT seen0[i] THEN coalesce(list_min(list_transform(vts, lambda u, j: CASE WHEN active[j] AND seen0[j] THEN u END)), 0) ELSE v END) AS joined FROM
        (SELECT s.lane, s.turn + 1 AS turn, s.heads, s.vts, s.seen AS seen0, list_transform(w.weights, lambda x, i: CASE WHEN s.turn >= 60 AND w.names[i] = 'g1' THEN CAST(8 AS DOUBLE) ELSE x END) AS weights,
         list_transform(s.heads, lambda h, i: NOT (w.names[i] = 'g3' AND s.turn BETWEEN 20 AND 39) AND h < least(w.sizes[i], CASE WHEN w.names[i] IN ('g2', 'g5') THEN greatest(0, s.turn // 2 - 14) ELSE 150 END)) AS active FROM sim s JOIN w ON w.lane = s.lane WHERE s.turn < 150)))))
    SELECT s.lane, CAST(s.turn AS BIGINT) AS turn, w.names[s.pick] AS group_id, q.msg_id FROM sim s JOIN w ON w.lane = s.lane JOIN q ON q.lane = s.lane AND q.group_id = w.names[s.pick] AND q.k = s.heads[s.pick] WHERE s.pick > 0"""


@op("sch_09", _SIM)
def simulated_changes(t: Tables, turns: int = 150) -> DataFrame:
    """The simulator where no closed form holds: groups g2 and g5 receive a message every other turn from turn 30 on,
    g3 is paused from turn 20 to 39, and g1's weight becomes 8 at turn 60."""
    changes = {20: [("g3", None, True)], 40: [("g3", None, False)], 60: [("g1", 8.0, None)]}
    return simulated(t, turns, changes=changes, arrives=lambda g, k: 2 * (k + 14) if g in ("g2", "g5") else 0)


@op("agg_20", f"SELECT lane, group_id, CAST(count(*) AS BIGINT) AS served_n FROM ({_by("CASE WHEN group_id < 'g4' THEN CAST(k * (k - 1) AS DOUBLE) / (2.0E0 * weight) ELSE CAST(k - 1 AS DOUBLE) / weight END, group_id")}) WHERE turn <= 150 GROUP BY lane, group_id")
def hoarding_counts(t: Tables, turns: int = 150) -> DataFrame:
    """Serves by group after 150 leases when g0 to g3 hold theirs and the rest ack."""
    return simulated(t, turns, None, hold=("g0", "g1", "g2", "g3")).groupBy("lane", "group_id").agg(F.count(F.lit(1)).alias("served_n"))


@op("agg_21", f"SELECT lane, group_id, max(turn) AS completed_at, CAST(count(*) AS BIGINT) AS served_n FROM ({_by('CAST(k - 1 AS DOUBLE) / weight, group_id')}) GROUP BY lane, group_id")
def completion_position(t: Tables) -> DataFrame:
    """The turn at which each group's backlog is done under WFQ: the flagship query."""
    return wfq(t).groupBy("lane", "group_id").agg(F.max("turn").alias("completed_at"), F.count(F.lit(1)).alias("served_n"))


# ---------------------------------------------------------------- policies
POLICIES = [("wfq", "-virtual_time"), ("shortest", "-backlog"), ("broken", "backlog +"), ("unknown", "foo + 1"), ("nan", "sqrt(-1.0E0 - backlog)"), ("fair", "weight / greatest(1, inflight)")]


def validate(t: Tables, text: str) -> str:
    """'' if the expression compiles and gives finite numbers on lanes of 0, 1 and 5 groups, else why not."""
    try:
        check_expression(text)
        lanes = t.values("weight double, backlog long, inflight long, virtual_time double", [(1.0, i + 1, 0, float(i)) for i in range(5)])
        for n in (0, 1, 5):
            for r in lanes.limit(n).select(F.expr(text).cast("double").alias("s")).collect():
                if r["s"] is None or r["s"] != r["s"] or abs(r["s"]) == float("inf"):
                    return "not a finite number"
    except Exception as e:  # noqa: BLE001  a bad expression is an answer here
        return type(e).__name__ if isinstance(e, ValueError) else "does not compile"
    return ""


@op("sch_10", "SELECT * FROM (VALUES ('wfq', TRUE), ('shortest', TRUE), ('broken', FALSE), ('unknown', FALSE), ('nan', FALSE), ('fair', TRUE)) v(policy, valid)")
def validated_policies(t: Tables) -> DataFrame:
    return t.values("policy string, valid boolean", [(n, validate(t, x) == "") for n, x in POLICIES])


_FAULTS = "SELECT event_type AS lane, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 3 = 0"


@op(
    "sch_11",
    f"""SELECT lane, event_id, CAST(count(*) OVER w AS BIGINT) AS faults, count(*) OVER w >= 5 AS over_limit FROM ({_FAULTS})
    WINDOW w AS (PARTITION BY lane ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)""",
)
def quarantine(t: Tables, window_ms: int = 3_600_000, limit: int = FAULT_LIMIT) -> DataFrame:
    """Faults of a lane's policy inside the window (an hour here, events being sparse); at the limit it is quarantined."""
    f = t.events.where("event_id % 3 = 0").select(F.col("event_type").alias("lane"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    n = F.count(F.lit(1)).over(Window.partitionBy("lane").orderBy("ms").rangeBetween(-window_ms, 0))
    return f.select("lane", "event_id", n.alias("faults"), (n >= limit).alias("over_limit"))


_SET = "SELECT event_type AS lane, event_id, concat('score-', CAST(event_id % 9 AS VARCHAR)) AS source FROM events WHERE event_id % 50 = 0"


@op("sch_12", f"SELECT lane, event_id, CAST(row_number() OVER (PARTITION BY lane ORDER BY event_id) AS BIGINT) AS version, sha256(source) AS hash FROM ({_SET})")
def policy_versions(t: Tables) -> DataFrame:
    """Each set-policy command gets its lane's next version and the hash of its source."""
    s = t.events.where("event_id % 50 = 0").select(F.col("event_type").alias("lane"), "event_id", F.concat(F.lit("score-"), (F.col("event_id") % 9).cast("string")).alias("source"))
    return keyed_row_number(s, ["lane"], "event_id", "version", t.event_cuts).select("lane", "event_id", "version", F.sha2("source", 256).alias("hash"))


@op(
    "sch_13",
    f"""SELECT p.lane, 'expression' AS engine, p.version, CAST(coalesce(f.n, 0) AS BIGINT) AS faults, coalesce(f.n, 0) >= 5 AS quarantined FROM
    (SELECT lane, CAST(count(*) AS BIGINT) AS version FROM ({_SET}) GROUP BY lane) p LEFT JOIN
    (SELECT lane, count(*) AS n FROM ({_FAULTS}) WHERE ms > 1706659200000 - 86400000 GROUP BY lane) f ON f.lane = p.lane""",
)
def policy_health(t: Tables, window_ms: int = 86_400_000) -> DataFrame:
    p = policy_versions(t).groupBy("lane").agg(F.max("version").alias("version"))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    f = t.events.where((F.col("event_id") % 3 == 0) & (at > t.asof_ms - window_ms)).groupBy(F.col("event_type").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return p.join(f, "lane", "left").select("lane", F.lit("expression").alias("engine"), "version", n.alias("faults"), (n >= FAULT_LIMIT).alias("quarantined"))


@op(
    "sch_14",
    """SELECT g.lane, g.group_id, h.msg_id, g.vt AS virtual_time FROM (SELECT g.lane, g.group_id, CAST(coalesce(s.n, 0) AS DOUBLE) / weight AS vt,
      row_number() OVER (PARTITION BY g.lane ORDER BY CAST(coalesce(s.n, 0) AS DOUBLE) / weight, g.group_id) AS r FROM groups_t g
      LEFT JOIN (SELECT lane, group_id, count(*) AS n FROM served GROUP BY lane, group_id) s ON s.lane = g.lane AND s.group_id = g.group_id WHERE ready > 0 AND NOT paused AND g.lane <> 'view') g
    JOIN (SELECT lane, group_id, min(msg_id) AS msg_id FROM messages WHERE fate = 1 GROUP BY lane, group_id) h ON h.lane = g.lane AND h.group_id = g.group_id WHERE r = 1""",
)
def next_leases(t: Tables, paused_lanes: tuple[str, ...] = ("view",)) -> DataFrame:
    """The next lease of each open lane: gate, eligible groups, the least virtual time after what has been served,
    and the group's head message. No order is built for one pick."""
    served = t.fates.where(F.col("fate").isin(LEASED, ACKED)).groupBy("lane", "group_id").agg(F.count(F.lit(1)).alias("n"))
    g = t.groups.where((F.col("ready") > 0) & ~F.col("paused") & ~F.col("lane").isin(*paused_lanes)).join(served, ["lane", "group_id"], "left")
    vt = F.coalesce("n", F.lit(0)).cast("double") / F.col("weight")
    pick = g.groupBy("lane").agg(F.min(F.struct(vt.alias("virtual_time"), "group_id")).alias("p")).select("lane", "p.group_id", "p.virtual_time")
    head = t.messages.where(F.col("fate") == READY).groupBy("lane", "group_id").agg(F.min("msg_id").alias("msg_id"))
    return head.join(pick, ["lane", "group_id"]).select("lane", "group_id", "msg_id", "virtual_time")


@op("udf_02", "SELECT lane, group_id, weight * 2.0E0 - CAST(ready AS DOUBLE) AS score FROM groups_t")
def native_score(t: Tables) -> DataFrame:
    """A compiled scoring function: an Arrow batch in, a batch of scores out."""

    @F.pandas_udf("double")
    def score(weight: pd.Series, ready: pd.Series) -> pd.Series:
        return weight * 2.0 - ready

    return t.groups.select("lane", "group_id", score("weight", "ready").alias("score"))


def plan(t: Tables, policy: str, turns: int | None = None) -> DataFrame:
    """Served order under a named policy or an expression, by the cheapest exact form."""
    closed = {"wfq": wfq, "drr": wfq, "strict": strict_priority, "shortest": shortest_queue, "longest": longest_queue, "completion_held": completion_aware_held, "completion_acked": completion_aware_acked}
    if policy in closed:
        out = closed[policy](t)
        return out if turns is None else out.where(F.col("turn") <= turns)
    if policy == "lottery":
        return lottery_order(t, turns or 1000)
    if re.search(r"\bdeficit\b", policy, re.I):
        return simulated(t, turns or 1000, compiled(policy))
    out = by_expression(t, policy)
    return out if turns is None else out.where(F.col("turn") <= turns)
