"""Scalar functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.registry import op
from tidemark.sources.views import Tables

TWO64 = 18446744073709551616
FNV64_BASIS, FNV64_PRIME = 14695981039346656037, 1099511628211
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619


def retry_base(attempt: Column) -> Column:
    """Backoff before jitter: 500 ms doubled per attempt (16 doublings at most), up to 30 s."""
    return F.least(F.lit(500).cast("long") * F.pow(F.lit(2.0), F.least(attempt, F.lit(16))).cast("long"), F.lit(30000).cast("long"))


def fnv64(data: Column) -> Column:
    """FNV-1a 64 of a binary column as decimal(20,0): products stay under 2^104 by splitting the prime."""
    big = lambda x: F.lit(str(x)).cast("decimal(20,0)")

    def step(h, i):
        low = (h % 256).cast("long")
        h = h - low + low.bitwiseXOR(F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long"))
        # h * prime mod 2^64 with prime = 2^40 + 435: the first part keeps h's low 24 bits
        high = (h % 16777216).cast("decimal(20,0)") * F.lit(1099511627776).cast("decimal(18,0)")
        return ((high.cast("decimal(38,0)") + (h * F.lit(435)).cast("decimal(38,0)")) % F.lit(str(TWO64)).cast("decimal(38,0)")).cast("decimal(20,0)")

    n = F.length(data)
    return F.when(n == 0, big(FNV64_BASIS)).otherwise(F.aggregate(F.sequence(F.lit(1), n), big(FNV64_BASIS), step))


def le(value: Column, size: int) -> Column:
    """The low `size` bytes of a long, little-endian."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def retry_delay(msg_id: Column, attempt: Column) -> Column:
    base = retry_base(attempt)
    h = fnv64(F.concat(le(msg_id, 8), le(attempt, 4)))
    return F.least(base + (h % (F.floor(base / 4) + 1).cast("decimal(20,0)")).cast("long"), F.lit(30000).cast("long"))


@op("sc_01", "SELECT CAST(a AS BIGINT) AS attempt, least(500 * CAST(power(2, least(a, 16)) AS BIGINT), 30000) AS base_ms FROM (SELECT unnest(range(1, 25)) AS a)")
def retry_bases(t: Tables) -> DataFrame:
    return t.spark.range(1, 25).select(F.col("id").alias("attempt"), retry_base(F.col("id")).alias("base_ms"))


#: FNV-1a 64 in SQL: a hex string's bytes folded in 128-bit integers.
_FNV64 = """list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(0, length({0}) // 2), lambda i: CAST(CAST(concat('0x', substring({0}, 2 * i + 1, 2)) AS INTEGER) AS HUGEINT))),
    lambda a, c: (CAST(xor(CAST(a AS UBIGINT), CAST(c AS UBIGINT)) AS HUGEINT) * 1099511628211) % 18446744073709551616)"""
_LE8 = "concat(" + ", ".join(f"substring(lpad(hex({{0}}), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + ")"


@op(
    "sc_02",
    f"""SELECT lane, group_id, CAST({_FNV64.format("g")} AS VARCHAR) AS fnv, CAST(least(4000 + {_FNV64.format("m")} % 1001, 30000) AS BIGINT) AS delay_ms FROM
    (SELECT lane, group_id, hex(encode(group_id)) AS g, concat({_LE8.format("next_seq")}, '03000000') AS m FROM groups_t)""",
)
def fnv_hashes(t: Tables) -> DataFrame:
    """FNV-1a of group names and the jittered delay of a third attempt."""
    return t.groups.select("lane", "group_id", fnv64(F.encode("group_id", "utf-8")).cast("string").alias("fnv"), retry_delay(F.col("next_seq"), F.lit(3).cast("long")).alias("delay_ms"))


def hue(name: Column) -> Column:
    """Colour of a name: FNV-1a 32 modulo 360, moved out of the red wedge. ASCII names."""
    codes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.ascii(F.substr(name, i, F.lit(1))).cast("long"))
    h = F.aggregate(codes, F.lit(FNV32_BASIS).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(FNV32_PRIME).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    x = h % 360
    return F.when((x > 345) | (x < 12), (x + 40) % 360).otherwise(x)


_FNV32 = "list_reduce(list_transform(range(1, length(g) + 1), lambda i: CAST(ascii(substring(g, i, 1)) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


@op("sc_03", f"SELECT g AS group_id, CASE WHEN x > 345 OR x < 12 THEN (x + 40) % 360 ELSE x END AS hue FROM (SELECT g, {_FNV32} % 360 AS x FROM (SELECT DISTINCT group_id AS g FROM groups_t))")
def hues(t: Tables) -> DataFrame:
    return t.groups.select("group_id").distinct().select("group_id", hue(F.col("group_id")).alias("hue"))


@op("sc_04", "SELECT lease_id, token_hash, substring(sha256(concat('salt', token_hash)), 1, 16) AS token_id FROM leases WHERE token_hash <> ''")
def token_ids(t: Tables) -> DataFrame:
    """Salted hash and the id that its first eight bytes make."""
    return t.leases.where("token_hash <> ''").select("lease_id", "token_hash", F.substring(F.sha2(F.concat(F.lit("salt"), "token_hash"), 256), 1, 16).alias("token_id"))


_TIMES = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id - 500 END AS delay_ms, CASE WHEN event_id % 3 = 1 THEN 1706659200000 + event_id WHEN event_id % 6 = 2 THEN -5 END AS at_ms FROM events"


def _times(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select("event_id", F.when(e % 3 == 0, e - 500).alias("delay_ms"), F.when(e % 3 == 1, F.lit(t.asof_ms) + e).when(e % 6 == 2, -5).alias("at_ms"))


@op("sc_05", f"SELECT event_id, coalesce(CASE WHEN delay_ms IS NOT NULL THEN 1706659200000 + greatest(delay_ms, 0) END, CASE WHEN at_ms IS NOT NULL THEN greatest(at_ms, 0) END, 0) AS eligible_ms FROM ({_TIMES})")
def eligible_at(t: Tables) -> DataFrame:
    """A delay counts from now, an instant as it is, neither less than 0; without either 0."""
    d, a, zero = F.col("delay_ms"), F.col("at_ms"), F.lit(0).cast("long")
    delay = F.when(d.isNotNull(), F.lit(t.asof_ms) + F.greatest(d, zero))
    return _times(t).select("event_id", F.coalesce(delay, F.when(a.isNotNull(), F.greatest(a, zero)), zero).alias("eligible_ms"))


@op("sc_06", "SELECT event_id, greatest(event_id - 500, 0) AS ms FROM events")
def duration_ms(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.greatest(F.col("event_id") - 500, F.lit(0)).alias("ms"))


@op("sc_07", "SELECT lane, group_id, greatest(inflight - 50, 0) AS after FROM groups_t")
def saturating(t: Tables) -> DataFrame:
    return t.groups.select("lane", "group_id", F.greatest(F.col("inflight") - 50, F.lit(0)).alias("after"))


def be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def history_checksum(h: DataFrame) -> DataFrame:
    """SHA-256 of a run's events in order, event id and type as big-endian numbers and attrs, up to the first gap."""
    part = F.struct("event_id", F.concat(be(F.col("event_id"), 8), be(F.col("event_type"), 4), F.encode(F.col("attrs"), "utf-8")).alias("b"))
    rows = h.groupBy("run_id").agg(F.array_sort(F.collect_list(part)).alias("e"))
    solid = F.filter("e", lambda x, i: x["event_id"] == i + 1)  # ids past a gap never match their place
    return rows.select("run_id", F.sha2(F.aggregate(solid, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["b"])), 256).alias("checksum"), F.size(solid).cast("long").alias("events"))


@op(
    "sc_08",
    """SELECT run_id, sha256(unhex(string_agg(concat(lpad(hex(event_id), 16, '0'), lpad(hex(event_type), 8, '0'), hex(concat('a', CAST(activity_no AS VARCHAR)))), '' ORDER BY event_id))) AS checksum,
    CAST(count(*) AS BIGINT) AS events FROM history WHERE NOT (run_id % 10 = 0 AND event_id >= 4) GROUP BY run_id""",
)
def checksums(t: Tables) -> DataFrame:
    """Every tenth run has a gap at event 4, where its checksum stops."""
    h = t.history.where("NOT (run_id % 10 = 0 AND event_id = 4)").withColumn("attrs", F.concat(F.lit("a"), F.col("activity_no").cast("string")))
    return history_checksum(h)


@op("sc_09", "SELECT lane, group_id, concat(lpad(hex(octet_length(encode(lane))), 4, '0'), hex(encode(lane)), lpad(hex(octet_length(encode(group_id))), 4, '0'), hex(encode(group_id))) AS page_token FROM groups_t")
def key_tokens(t: Tables) -> DataFrame:
    """Length-prefixed keys as hex page tokens."""
    part = lambda c: F.concat(F.lpad(F.hex(F.length(F.encode(c, "utf-8"))), 4, "0"), F.hex(F.encode(c, "utf-8")))
    return t.groups.select("lane", "group_id", F.concat(part(F.col("lane")), part(F.col("group_id"))).alias("page_token"))


@op("sc_10", "SELECT name, CASE WHEN trim(p) IN ('', '*') THEN '.*' ELSE trim(p) END AS pattern FROM (VALUES ('a', ' '), ('b', '*'), ('c', ' view '), ('d', 'g[0-3]'), ('e', ' * ')) v(name, p)")
def patterns(t: Tables) -> DataFrame:
    p = F.trim("p")
    return t.values("name string, p string", [("a", " "), ("b", "*"), ("c", " view "), ("d", "g[0-3]"), ("e", " * ")]).select("name", F.when(p.isin("", "*"), ".*").otherwise(p).alias("pattern"))


@op("sc_11", "SELECT s AS name, lower(replace(regexp_replace(s, '^(WF|HET)_', ''), '_', ' ')) AS label FROM (VALUES ('WF_RUNNING'), ('HET_ACTIVITY_SCHEDULED'), ('WF_CONTINUED_AS_NEW'), ('OTHER_NAME')) v(s)")
def labels(t: Tables) -> DataFrame:
    n = t.values("name string", [("WF_RUNNING",), ("HET_ACTIVITY_SCHEDULED",), ("WF_CONTINUED_AS_NEW",), ("OTHER_NAME",)])
    return n.select("name", F.lower(F.replace(F.regexp_replace("name", "^(WF|HET)_", ""), F.lit("_"), F.lit(" "))).alias("label"))


def humanized(ms: Column) -> Column:
    """ms under a second, then whole seconds, minutes and seconds, hours and minutes, days and hours."""
    s = F.floor(ms / 1000)
    text = lambda *x: F.concat(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x])
    return (
        F.when(ms < 1000, text(ms, "ms"))
        .when(s < 60, text(s, "s"))
        .when(s < 3600, text(F.floor(s / 60), "m ", s % 60, "s"))
        .when(s < 86400, text(F.floor(s / 3600), "h ", F.floor(s % 3600 / 60), "m"))
        .otherwise(text(F.floor(s / 86400), "d ", F.floor(s % 86400 / 3600), "h"))
    )


@op(
    "sc_12",
    """SELECT event_id, CASE WHEN m < 1000 THEN concat(m, 'ms') WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm ', s % 60, 's')
    WHEN s < 86400 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm') ELSE concat(s // 86400, 'd ', s % 86400 // 3600, 'h') END AS text FROM (SELECT event_id, event_id * event_id AS m, event_id * event_id // 1000 AS s FROM events)""",
)
def durations(t: Tables) -> DataFrame:
    return t.events.select("event_id", humanized(F.col("event_id") * F.col("event_id")).alias("text"))


@op("sc_13", "SELECT lease_id, CASE WHEN r < 0 THEN concat('-', -r // 1000, 's') ELSE concat(r // 1000, 's') END AS countdown, r < 0 AS expired, r >= 0 AND r < 5000 AS urgent FROM (SELECT lease_id, deadline_ms - 1706659200000 AS r FROM leases)")
def countdowns(t: Tables) -> DataFrame:
    r = F.col("deadline_ms") - t.asof_ms
    s = F.floor(F.abs(r) / 1000).cast("string")
    return t.leases.select("lease_id", F.when(r < 0, F.concat(F.lit("-"), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s"))).alias("countdown"), (r < 0).alias("expired"), ((r >= 0) & (r < 5000)).alias("urgent"))


def rate_text(tenths: Column) -> Column:
    """A rate in tenths per second, as text: 0/s, one decimal under 100, else whole."""
    whole, part = F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")
    return F.when(tenths == 0, "0/s").when(tenths < 1000, F.concat(whole, F.lit("."), part, F.lit("/s"))).otherwise(F.concat(F.floor((tenths + 5) / 10).cast("string"), F.lit("/s")))


@op("sc_14", "SELECT event_id, CASE WHEN event_id = 0 THEN '0/s' WHEN event_id < 1000 THEN concat(event_id // 10, '.', event_id % 10, '/s') ELSE concat((event_id + 5) // 10, '/s') END AS rate FROM events")
def rates(t: Tables) -> DataFrame:
    return t.events.select("event_id", rate_text(F.col("event_id")).alias("rate"))


@op("sc_15", "SELECT event_id, CASE WHEN length(p) > 40 THEN concat(substring(p, 1, 40), '…') ELSE p END AS preview FROM (SELECT event_id, concat(event_type, '·', coalesce(props, ''), '·', repeat('x', CAST(event_id % 50 AS BIGINT))) AS p FROM events)")
def previews(t: Tables, most: int = 40) -> DataFrame:
    """Payload previews: base64 to text, control characters as dots, cut with an ellipsis."""
    raw = F.concat("event_type", F.lit("\n"), F.coalesce("props", F.lit("")), F.lit("\x07"), F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")))
    text = F.regexp_replace(F.decode(F.unbase64(F.base64(F.encode(raw, "utf-8"))), "utf-8"), "[\\x00-\\x1f\\x7f]", "·")
    return t.events.select("event_id", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text).alias("preview"))


@op("sc_16", "SELECT lease_id, CASE WHEN length(token_hash) > 8 THEN concat(substring(token_hash, 1, 8), '…') ELSE token_hash END AS short FROM leases")
def short_hashes(t: Tables) -> DataFrame:
    h = F.col("token_hash")
    return t.leases.select("lease_id", F.when(F.length(h) > 8, F.concat(F.substring(h, 1, 8), F.lit("…"))).otherwise(h).alias("short"))


@op("sc_17", "SELECT event_id, event_id % 4 = 3 AS finite FROM events")
def finite(t: Tables) -> DataFrame:
    e = F.col("event_id") % 4
    x = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, float("-inf")).otherwise(1.5)
    return t.events.select("event_id", (~(F.isnan(x) | (F.abs(x) == float("inf")))).alias("finite"))


_PATHS = [("/api/lanes/a/b/fairness",), ("/api/lanes/view/dlq",), ("/api/lanes/x/groups/y/fairness",), ("/api/lanes/fairness",), ("/other",)]


@op("sc_18", "SELECT p AS path, regexp_extract(p, '^/api/lanes/(.+)/(fairness|dlq)$', 1) AS lane, regexp_extract(p, '^/api/lanes/(.+)/(fairness|dlq)$', 2) AS action FROM (VALUES " + ", ".join(f"('{p}')" for (p,) in _PATHS) + ") v(p)")
def routes(t: Tables) -> DataFrame:
    """Paths are matched from the right, since a lane may hold slashes."""
    rx = "^/api/lanes/(.+)/(fairness|dlq)$"
    return t.values("path string", _PATHS).select("path", F.regexp_extract("path", rx, 1).alias("lane"), F.regexp_extract("path", rx, 2).alias("action"))


_GRANTS = [("view:g1:read,publish",), ("*:*:all",), ("click::r",), (":g2:admin",)]
ALIASES = {"read": "READ", "r": "READ", "publish": "PUBLISH", "p": "PUBLISH", "consume": "CONSUME", "c": "CONSUME", "admin": "ADMIN", "all": "READ,PUBLISH,CONSUME,ADMIN"}


@op(
    "sc_19",
    "SELECT s AS spec, CASE WHEN split_part(s, ':', 1) IN ('', '*') THEN '.*' ELSE split_part(s, ':', 1) END AS lane, CASE WHEN split_part(s, ':', 2) IN ('', '*') THEN '.*' ELSE split_part(s, ':', 2) END AS grp, array_to_string(list_transform(string_split(split_part(s, ':', 3), ','), lambda a: CASE a "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
    + " END), ',') AS actions FROM (VALUES " + ", ".join(f"('{g}')" for (g,) in _GRANTS) + ") v(s)",
)
def grant_specs(t: Tables) -> DataFrame:
    p = F.split("spec", ":")
    star = lambda c: F.when(c.isin("", "*"), ".*").otherwise(c)
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    actions = F.array_join(F.transform(F.split(p[2], ","), lambda a: names[a]), ",")
    return t.values("spec string", _GRANTS).select("spec", star(p[0]).alias("lane"), star(p[1]).alias("grp"), actions.alias("actions"))


@op("sc_20", "SELECT split_part(x, '=', 1) AS id, split_part(x, '=', 2) AS addr FROM (SELECT unnest(string_split('n1=10.0.0.1:9,n2=10.0.0.2:9,n3=host:7', ',')) AS x)")
def peers(t: Tables, text: str = "n1=10.0.0.1:9,n2=10.0.0.2:9,n3=host:7") -> DataFrame:
    return t.values("x string", [(text,)]).select(F.explode(F.str_to_map("x", F.lit(","), F.lit("="))).alias("id", "addr"))


def cron_field(spec: str, lo: int, hi: int) -> list[int]:
    """Values of one crontab field: *, a, a-b, lists, and /step."""
    out: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        a, _, b = body.partition("-")
        first, last = (lo, hi) if body in ("*", "?") else (int(a), int(b) if b else (hi if step else int(a)))
        if not lo <= first <= last <= hi:
            raise ValueError(f"bad crontab field {spec}")
        out |= set(range(first, last + 1, int(step or 1)))
    return sorted(out)


def cron_fires(t: Tables, spec: str, start_ms: int, days: int) -> DataFrame:
    """Fire times of a five-field crontab after start_ms, UTC: whole minutes of the span, filtered."""
    minute, hour, dom, month, dow = spec.split()
    at = F.timestamp_millis("fire_ms")
    rows = t.spark.range(1, days * 1440 + 1).select((F.lit(start_ms - start_ms % 60000) + F.col("id") * 60000).alias("fire_ms"))
    day = F.dayofmonth(at).isin(*cron_field(dom, 1, 31))
    week = (F.dayofweek(at) - 1).isin(*[d % 7 for d in cron_field(dow, 0, 7)])
    either = (day | week) if dom != "*" and dow != "*" else (day & week)  # two restrictions are alternatives
    return rows.where(F.minute(at).isin(*cron_field(minute, 0, 59)) & F.hour(at).isin(*cron_field(hour, 0, 23)) & F.month(at).isin(*cron_field(month, 1, 12)) & either)


@op("sc_21", "SELECT x AS fire_ms FROM (SELECT 1706659200000 + 60000 * unnest(range(1, 10081)) AS x) WHERE x // 60000 % 60 IN (0, 15, 30, 45) AND x // 3600000 % 24 BETWEEN 9 AND 17 AND (x // 86400000 + 4) % 7 BETWEEN 1 AND 5")
def cron_next(t: Tables) -> DataFrame:
    return cron_fires(t, "*/15 9-17 * * 1-5", t.asof_ms, 7)


@op("sc_22", "SELECT lease_id, deadline_ms - 1706659200000 AS remaining_ms FROM leases")
def remaining(t: Tables) -> DataFrame:
    return t.leases.select("lease_id", (F.col("deadline_ms") - t.asof_ms).alias("remaining_ms"))


def serve_cost(weight: Column, inflight: Column) -> Column:
    w = F.when(weight <= 0, 1.0).otherwise(weight)
    return F.greatest(1 / w, (1 + inflight) / w)


@op("sc_23", "SELECT lane, group_id, greatest(1 / weight, (1 + inflight) / weight) AS cost FROM groups_t")
def serve_costs(t: Tables) -> DataFrame:
    return t.groups.select("lane", "group_id", serve_cost(F.col("weight"), F.col("inflight")).alias("cost"))


@op("sc_24", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'handler_error' END AS reason, CAST(event_id % 5 AS VARCHAR) AS code FROM events")
def failure_meta(t: Tables) -> DataFrame:
    """Failure metadata with a default reason that the handler's own one replaces."""
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("reason"), F.lit("timeout"))).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.map_concat(own, F.create_map(F.lit("code"), (F.col("event_id") % 5).cast("string")))
    default = F.map_filter(F.create_map(F.lit("reason"), F.lit("handler_error")), lambda k, v: ~F.map_contains_key(meta, k))
    return t.events.select("event_id", F.map_concat(default, meta).alias("m")).select("event_id", F.col("m")["reason"].alias("reason"), F.col("m")["code"].alias("code"))


@op("sc_25", "SELECT lane, group_id, weight, paused FROM groups_t")
def specs_round_trip(t: Tables) -> DataFrame:
    """Specs through JSON and back with an explicit schema."""
    j = t.groups.select(F.to_json(F.struct("lane", "group_id", "weight", "paused")).alias("j"))
    return j.select(F.from_json("j", "lane string, group_id string, weight double, paused boolean").alias("s")).select("s.*")


@op("snk_05", """SELECT concat('{"lane":"', lane, '","groupId":"', group_id, '","leaseId":"', CAST(lease_id AS VARCHAR), '","attempt":', CAST(attempt_at_lease AS VARCHAR), ',"state":"LEASED"}') AS json FROM leases""")
def lease_json(t: Tables) -> DataFrame:
    """JSON rows: camel case, zero values kept, 64-bit numbers as strings, enum names."""
    x = F.struct(F.col("lane"), F.col("group_id").alias("groupId"), F.col("lease_id").cast("string").alias("leaseId"), F.col("attempt_at_lease").cast("int").alias("attempt"), F.lit("LEASED").alias("state"))
    return t.leases.select(F.to_json(x, {"ignoreNullFields": "false"}).alias("json"))


@op("snk_07", "SELECT k AS metric, lane, CAST(count(*) AS BIGINT) AS value FROM (SELECT lane, CASE fate WHEN 1 THEN 'published' WHEN 2 THEN 'delayed' WHEN 3 THEN 'leased' WHEN 4 THEN 'dead_lettered' ELSE 'acked' END AS k FROM messages) GROUP BY k, lane")
def metrics(t: Tables) -> DataFrame:
    """Counters over the command log by lane."""
    names = ("published", "delayed", "leased", "dead_lettered", "acked")
    return t.fates.groupBy(F.element_at(F.array(*map(F.lit, names)), F.col("fate").cast("int")).alias("metric"), "lane").agg(F.count(F.lit(1)).alias("value"))


@op("snk_08", "SELECT concat(lane, ': ', ready, ' ready, ', delayed, ' delayed, ', inflight, ' in flight in ', groups_n, ' groups') AS line FROM (SELECT lane, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(delayed_n) AS BIGINT) AS delayed, CAST(sum(inflight) AS BIGINT) AS inflight, count(*) AS groups_n FROM groups_t GROUP BY lane)")
def report_lines(t: Tables) -> DataFrame:
    from tidemark.operators.fairness import lane_stats

    return lane_stats(t).select(F.format_string("%s: %d ready, %d delayed, %d in flight in %d groups", "lane", "ready", "delayed", "inflight", "groups_n").alias("line"))
