"""Line deduplication by a fixed-depth log-template tree.

Each non-empty line descends the tree: first by its token count, then by its leading DEPTH tokens; tokens that
hold a digit are variable fields and count as <*>. Lines that agree in all masked tokens share a
template, which recurs if it has a constant token and occurs in MIN_DOCS documents, or in LONG_DOCS if it is long
(LONG_TOKENS tokens or LONG_CHARS characters: a passage, not a phrase).

Inside a leaf the tree generalises further, to as many templates as the leaf holds. A token is constant at its
position if lines of at least MIN_DOCS documents, and SHARE of the leaf's lines, have it there; the others become <*>.
Lines whose constants are the same at the same positions share a general template, which recurs if it occurs in
MIN_DOCS documents and its constants are more than the leading DEPTH and SIMILARITY of the tokens without a digit. Lines
of recurring templates leave the leaf, and the rest is looked at again, with its own shares, until a leaf yields none.
So names that vary must stand after the leading DEPTH tokens to be generalised, as in any tree of this kind.

All lines of a recurring template are dropped. Texts are shuffled once, to meet their dropped lines, at every size.

Everything is DataFrame functions and all counts are exact. Counting shuffles line hashes (128 bits) only, combined map-side; token rows exist for leaves that MIN_DOCS documents reach with different lines, and a hot leaf meets only as
per-token counts, of which at most 1 / SHARE a position are constants.

Edge cases: null text stays null, with 0 lines; empty lines, and lines of fields alone, are kept
as they are; a text whose lines all go becomes ''; repeated rows give repeated rows but count as one
document by id; rows without an id count each text as a document; an empty table gives an empty result;
the output has doc_id, text, n_lines, n_dropped and ignores other input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WS, checkpoint, small_or_shuffled, text_or_empty

DEPTH, MIN_DOCS, SIMILARITY, SHARE = 3, 5, 0.7, 0.1
LONG_TOKENS, LONG_CHARS, LONG_DOCS = 20, 120, 2
_FIELD = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"


def _spaced(text: Column) -> Column:
    """The text with each run of white space but newlines as one space. Few texts need the regex."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]++", " ")).otherwise(text)


def _masked(line: Column) -> Column:
    """A single-spaced line, trimmed, with its digit-bearing tokens replaced by <*>."""
    return F.trim(F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line))


def masked_lines(text: Column) -> Column:
    return F.transform(F.split(_spaced(text), "\n", -1), _masked)


def _doc_key() -> Column:
    """Colliding keys do no harm: what is dropped depends on templates alone."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()))


def _hash(*columns: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc, leaf, n (tokens), line (masked) of each line that holds a constant token."""
    lines = docs.select(_doc_key().alias("doc"), F.explode(masked_lines(text_or_empty())).alias("line")).where("line <> ''")
    size = F.octet_length("line")
    lines = lines.withColumn("n", size - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    constant = F.when(size == 4 * F.col("n") - 1, F.translate(F.replace("line", F.lit("<*>"), F.lit("")), " ", "") != "").otherwise(True)
    return lines.where(constant).select("doc", F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf"), "n", "line")


def distinct_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc, leaf, template, long: the different lines of each document, by hash."""
    long = (F.col("n") >= LONG_TOKENS) | (F.length("line") >= LONG_CHARS)
    return checkpoint(_lines(docs, depth).select("doc", "leaf", _hash(F.col("line")).alias("template"), long.alias("long")).distinct())


def _leaf_lines(docs: DataFrame, once: DataFrame, depth: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Of leaves that hold several templates and min_docs lines: the rows of once, and the different lines with
    leaf, template, docs, tokens (hashes, null for fields)."""
    leaves = once.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("template.a").alias("lo"), F.max("template.a").alias("hi"))
    leaves = small_or_shuffled(checkpoint(leaves.where((F.col("n") >= min_docs) & (F.col("lo") < F.col("hi"))).select("leaf")))
    held = checkpoint(once.join(leaves, "leaf", "left_semi").select("doc", "leaf", "template"))
    lines = _lines(docs, depth).where(F.col("n") > depth).join(leaves, "leaf", "left_semi").select("leaf", _hash(F.col("line")).alias("template"), "line")
    lines = lines.groupBy("leaf", "template").agg(F.first("line").alias("line"))
    tokens = F.transform(F.split("line", " "), lambda t: F.when(t != "<*>", F.xxhash64(t)))
    sizes = held.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"))
    return held, checkpoint(lines.join(sizes, ["leaf", "template"]).select("leaf", "template", "docs", tokens.alias("tokens")))


def _general(kinds: DataFrame, held: DataFrame, depth: int, min_docs: int, similarity: float, share: float) -> DataFrame:
    """leaf, template of the lines whose general template recurs, by one look at each leaf."""
    whole = small_or_shuffled(checkpoint(kinds.groupBy("leaf").agg(F.sum("docs").alias("all"))))
    counts = kinds.select("leaf", "docs", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n"))
    often = (F.col("n") >= min_docs) & (F.col("n") >= share * F.col("all"))
    places = counts.join(whole, "leaf").groupBy("leaf", "pos").agg(F.collect_list(F.when(often, F.col("token"))).alias("some"))  # at most 1 / share
    places = places.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "some"))).alias("places"))  # every position of the leaf's lines
    fixed = small_or_shuffled(checkpoint(places.select("leaf", F.transform("places", lambda x: x["some"]).alias("fixed"))), most=10_000)  # some KB a leaf
    mask = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.get("fixed", i), t), t).otherwise(0))
    made = kinds.join(fixed, "leaf").select("leaf", "template", mask.alias("mask"), F.size(F.filter("tokens", lambda t: t.isNotNull())).alias("words"))
    n = F.size(F.filter("mask", lambda t: t != 0))
    members = made.where((n > depth) & (n >= similarity * F.col("words"))).select("leaf", "template", _hash(F.col("mask")).alias("mask"))
    members = checkpoint(members)
    reached = held.join(small_or_shuffled(members), ["leaf", "template"]).groupBy("leaf", "mask").agg(F.count_distinct("doc").alias("n"))
    return members.join(reached.where(F.col("n") >= min_docs), ["leaf", "mask"], "left_semi").select("leaf", "template")


def recurring_templates(
    docs: DataFrame, once: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, share: float = SHARE
) -> DataFrame:
    """template: hashes of the masked lines that recur, directly or through a general template of their leaf."""
    least = F.when(F.max("long"), F.least(F.lit(LONG_DOCS), F.lit(min_docs))).otherwise(F.lit(min_docs))
    out = once.groupBy("template").agg(F.count(F.lit(1)).alias("n"), least.alias("least")).where("n >= least").select("template")
    held, kinds = _leaf_lines(docs, once, depth, min_docs)
    while not kinds.isEmpty():
        found = checkpoint(_general(kinds, held, depth, min_docs, similarity, share))
        out = out.union(found.select("template"))
        # a leaf that yielded nothing will not yield anything later
        kinds = kinds.join(small_or_shuffled(checkpoint(found.select("leaf").distinct())), "leaf", "left_semi")
        kinds = checkpoint(kinds.join(small_or_shuffled(found.select("template")), "template", "left_anti"))
    return out.distinct()


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
    share: float = SHARE,
) -> DataFrame:
    """One row per input row: doc_id, text without recurring lines, n_lines, n_dropped."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    once = distinct_lines(docs, depth)
    drop = checkpoint(recurring_templates(docs, once, depth, min_docs, similarity, share))
    held = once.join(drop, "template", "left_semi").select("doc", "template")
    held = held.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("template").alias("_drop"))  # bounded by one document's lines
    out = docs.withColumn("_doc", _doc_key()).join(held.hint("shuffle_merge"), "_doc", "left")
    lines = F.split(F.col("text"), "\n", -1)
    both = F.arrays_zip(lines.alias("raw"), masked_lines(F.col("text")).alias("mask"))
    kept = F.transform(F.filter(both, lambda x: ~F.array_contains("_drop", _hash(x["mask"]))), lambda x: x["raw"])
    out = out.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept).otherwise(lines))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("_kept")).cast("long")
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    return out.select("doc_id", text.alias("text"), n.alias("n_lines"), (n - n_kept).alias("n_dropped"))
