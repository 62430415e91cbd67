"""Personal data by patterns and by bootstrapped contextual extraction.

Base kinds are regular expressions with checks. From these seeds the bootstrap learns lexical
patterns: the one or two words left of a seed. Pattern-instance edges (a word that holds a digit or @,
and what stands before it) form a bipartite graph. Each round scores patterns by the share of their
instances that are known, then instances by a noisy-or over the good patterns they occur in; instances
that reach ACCEPT count as known in the next round. What the final patterns discover is added as
kind ctx_<seed kind>; base spans stay. An unseen identifier must hold a digit or @ as all seeds do: names and
handles without either are not found, and words without either do not count against a pattern.

Everything is DataFrame functions. Positions come from split() and regexp_extract_all(), whose pieces
and matches alternate: running sums over one text's matches give the offsets that no regex reports. Quantifiers are possessive and starts are
anchored, so a run of any length costs linear time and no stack. Texts without a digit or @ hold no
span and are passed over. Texts are never shuffled; the graph is, with partial sums.

Edge cases: null text counts as empty; each input row gives one output row, repeated rows and null ids
included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, small_or_shuffled, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, CONFIDENCE, ACCEPT = 2, 3, 0.6, 0.8

# Greedy runs are written possessive: what follows a run can never start inside it. (?:\G|(?<!run)) starts
# a match at the start of a run or where the last match ended, which is where leftmost matching starts it.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


TAIL = 80  # characters of left context that nearly always hold the two words of a lexical pattern; else all of it is kept
_TWO_WORDS = r"[\x20\x09-\x0D][^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$"
WORDS = len(KINDS)  # rank of the words that hold a digit or @, beside the kinds
PARTS = "array<struct<skip:int,left:string,hit:string>>"


def _parts(text: Column, pattern: str) -> Column:
    """Matches in order, each with the length and the end of the text between it and the one before."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    left = lambda gap: F.when(F.right(gap, F.lit(TAIL)).rlike(_TWO_WORDS), F.right(gap, F.lit(TAIL))).otherwise(gap)
    cut = F.transform(both, lambda x: F.struct(F.length(x["gap"]).alias("skip"), left(x["gap"]).alias("left"), x["hit"].alias("hit")))
    return F.filter(cut, lambda x: x["hit"].isNotNull())


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, doc_id, rank, pos, part: the matches of every pattern, and one row without any where there is none."""
    text = text_or_empty(text_col)
    digit = text.rlike("[0-9]")
    tests = [F.contains(text, F.lit("@")), digit & text.rlike(r"[0-9]\.[0-9]"), digit, F.contains(text, F.lit("+")), F.lit(True)]
    patterns = [*(PATTERNS[k] for k in KINDS), _WORD]
    none = F.array().cast(PARTS)
    kinds = [F.struct(F.lit(r).alias("rank"), F.when(t, _parts(text, p)).otherwise(none).alias("parts")) for r, (t, p) in enumerate(zip(tests, patterns, strict=True))]
    some = F.filter(F.array(*kinds), lambda k: F.size(k["parts"]) > 0)
    busy = F.when(text.rlike("[0-9@]"), some).otherwise(F.array().cast(f"array<struct<rank:int,parts:{PARTS}>>"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), busy.alias("k"))
    rows = rows.select("_row", "doc_id", F.explode_outer("k").alias("k"))
    return rows.select("_row", "doc_id", "k.rank", F.posexplode_outer("k.parts").alias("pos", "part"))


def _placed(found: DataFrame) -> DataFrame:
    """found with start and end of each match: running sums over one text's matches of one kind."""
    before = Window.partitionBy("_row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hits = found.where("part IS NOT NULL").select("_row", "rank", "pos", "part.*")
    at = F.coalesce(F.sum(F.col("skip") + F.length("hit")).over(before), F.lit(0)).cast("int") + F.col("skip")
    return hits.withColumn("start", at).withColumn("end", F.col("start") + F.length("hit"))


def _base(placed: DataFrame) -> DataFrame:
    """_row, start, rank, end, kind of the base spans."""
    ok = F.lit(False)
    for r, kind in enumerate(KINDS):
        ok = F.when(F.col("rank") == r, _valid(kind, F.col("hit"))).otherwise(ok)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    return placed.where((F.col("rank") < WORDS) & ok).select("_row", "start", "rank", "end", name.alias("kind"))


def _edges(placed: DataFrame, base: DataFrame) -> DataFrame:
    """_row, start, instance, pattern, kind (of a base span that the word meets, or null).

    A word meets a span if, of the spans that begin before its end, the farthest end lies past its start.
    """
    w = placed.where(F.col("rank") == WORDS)
    left = F.lower(F.concat(F.when(F.col("pos") > 0, "<id>").otherwise(""), F.lit(" "), "left"))
    before = F.filter(F.split(left, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    one = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("^"))
    two = F.concat_ws(" ", F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("^")), one)
    words = w.select("_row", F.col("end").alias("at"), F.lit(0).alias("t"), F.lit(None).cast("struct<end:int,kind:string>").alias("s"), "start", "hit", one.alias("left1"), two.alias("left2"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("hit", "string"), ("left1", "string"), ("left2", "string"))]
    spans = base.select("_row", F.col("start").alias("at"), F.lit(1).alias("t"), F.struct("end", "kind").alias("s"), *nothing)
    so_far = Window.partitionBy("_row").orderBy("at", "t").rowsBetween(Window.unboundedPreceding, 0)
    both = words.union(spans).withColumn("far", F.max("s").over(so_far)).where("t = 0")
    lead = F.length(F.regexp_extract("hit", r"^[^A-Za-z0-9+]*", 0))
    core = F.regexp_extract("hit", r"^[^A-Za-z0-9+]*+([A-Za-z0-9+](?:.*[A-Za-z0-9])?)", 1)
    out = both.select(
        "_row",
        (F.col("start") + lead).alias("start"),
        core.alias("instance"),
        F.when(F.col("far.end") > F.col("start"), F.col("far.kind")).alias("kind"),
        F.explode(F.array(F.concat(F.lit("1:"), "left1"), F.concat(F.lit("2:"), "left2"))).alias("pattern"),
    )
    return out.where(F.length("instance") >= 4)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """instance, kind, score of unseen identifiers, after iterative scoring of the graph."""
    links = checkpoint(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))  # copies count once, and no side of a join is text
    known = links.where("seed IS NOT NULL").groupBy("instance").agg(F.max("seed").alias("kind"), F.lit(1.0).alias("score"))
    sizes = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    out = checkpoint(known)
    for _ in range(rounds):
        patterns = links.join(small_or_shuffled(out), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("k"))
        patterns = patterns.join(sizes, "pattern").where(F.col("k") >= min_seeds).withColumn("trust", F.col("mass") / F.col("n"))
        good = patterns.where(F.col("trust") >= confidence).select("pattern", "kind", "trust")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6))))
        scored = links.where("seed IS NULL").join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = scored.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        fresh = best.where(F.col("score") >= accept).join(known, "instance", "left_anti")
        out = checkpoint(known.unionByName(fresh))
    return out.join(known.select("instance"), "instance", "left_anti")


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _row, doc_id and spans, an array of (start, rank, end, kind), sorted.

    Base kinds have ranks 0 to 3; discovered ones follow as ctx_<kind>.
    """
    found = checkpoint(_found(docs, id_col, text_col))
    placed = checkpoint(_placed(found))
    base = _base(placed)
    edges = checkpoint(_edges(placed, base))
    fresh = bootstrap(edges)
    rank = F.lit(WORDS) + F.array_position(F.array(*map(F.lit, KINDS)), F.col("known")).cast("int") - 1
    at = edges.where("kind IS NULL").select("_row", "start", "instance").distinct()
    more = at.join(small_or_shuffled(checkpoint(fresh.select("instance", F.col("kind").alias("known")))), "instance")
    more = more.select("_row", "start", rank.alias("rank"), (F.col("start") + F.length("instance")).alias("end"), F.concat(F.lit("ctx_"), "known").alias("kind"))
    spans = base.union(more).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))  # bounded by one text
    rows = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"))
    return rows.join(spans, "_row", "left").select("_row", "doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its mask; spans must be sorted and apart."""
    mask = lambda s: F.concat(F.lit("["), F.upper(F.regexp_replace(s["kind"], "^ctx_", "")), F.lit("]"))
    last = lambda i: F.when(i == 0, 0).otherwise(spans[F.greatest(i - 1, F.lit(0))]["end"])
    parts = F.transform(spans, lambda s, i: F.concat(F.substr(text, last(i) + 1, s["start"] - last(i)), mask(s)))
    return F.concat(F.array_join(parts, ""), F.substr(text, spans[F.size(spans) - 1]["end"] + 1, F.length(text)))


def _apart(spans: Column) -> Column:
    """Sorted spans, those that overlap as one, of the first one's kind. An overlap is rare, so the test comes first."""
    begins = lambda s, i: (i == 0) | (s["start"] >= spans[F.greatest(i - 1, F.lit(0))]["end"])
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) == 0) | (s["start"] >= last["end"])
        wider = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(fits, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider)))

    met = F.exists(F.transform(spans, begins), lambda ok: ~ok)
    return F.when(met, F.aggregate(spans, F.array().cast(kind), step)).otherwise(spans)


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data masked in text, and all their columns.

    Spans join on a digest of id and text, so repeated ids are safe.
    """
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col)), 256)
    held = find_pii(docs.withColumn("__pii_key", key), "__pii_key", text_col).where(F.size("spans") > 0)
    held = held.groupBy(F.col("doc_id").alias("__pii_key")).agg(_apart(F.first("spans")).alias("__pii_spans"))
    out = docs.withColumn("__pii_key", key).join(held, "__pii_key", "left")
    return out.withColumn(text_col, F.when(F.col("__pii_spans").isNotNull(), redact(F.col(text_col), F.col("__pii_spans"))).otherwise(F.col(text_col))).drop("__pii_key", "__pii_spans")
