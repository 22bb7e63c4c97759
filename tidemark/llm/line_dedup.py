"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then the leading tokens, where a
token with a digit counts as a variable field.  Within a leaf a token is fixed at its place
if enough documents hold it there, and a variable field otherwise; "enough" is the least
number of documents that recur, and then four times that, and so on, so that fields of few
values become variable too.  A line's template at a level is its tokens with the variable
ones blanked; it counts if it keeps most of the line.  Templates that recur across
documents are dropped after their first document.

Recurrence means documents of different text, whatever the lines around: copies of one
whole document count once, so their lines are left to duplicate detection.  A long line
recurs in two such documents already.  All counts are sums over a leaf, so nothing depends
on the order of lines or on how a leaf is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialise, mix, released, small, span_hash, text_chunks, word_spans

#: Leading tokens of the tree's path, least share of fixed places (digits included), and least tokens of a line.
DEPTH, SIMILARITY, MIN_TOKENS = 3, 0.7, 3
#: Least share of a line that must be fixed words, not fields.
WORDS = 0.5
#: Documents of different text from which a template recurs, and tokens of a line from which two are enough.
MIN_DOCS, LONG_TOKENS = 3, 10
#: Levels of support, each of four times the documents of the one before.
LEVELS = 6
#: Distinct lines of a leaf up to which they are counted in one task; the counts are the same either way.
LEAF_LINES = 512
#: Rows (of 24 to 100 bytes) of a counted table up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Dropped lines (of about 24 bytes) up to which they are broadcast to the texts; beyond, the texts are shuffled once.
BROADCAST_LINES = 1_000_000
FIELD = np.uint64(1)
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[0x20, 9, 10, 11, 12, 13]] = 0
LETTERS[0] = 0x20


def tokens_of(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token hashes (FIELD if they hold a digit), line bounds in tokens, and document and number of each line."""
    letters = LETTERS[body]
    starts, ends = word_spans(letters, offsets)
    tokens = span_hash(letters, starts, ends)
    digits = np.cumsum(np.r_[0, (body >= 0x30) & (body <= 0x39)])
    tokens[digits[ends] > digits[starts]] = FIELD
    breaks = np.flatnonzero(body == 10)
    begins = np.sort(np.r_[offsets[:-1], breaks + 1], kind="stable")
    # A break at a document's end opens its last, empty line there, before the next document.
    owner = np.searchsorted(offsets[1:], breaks, "right")
    document = np.repeat(np.arange(len(offsets) - 1), np.bincount(owner, minlength=len(offsets) - 1) + 1)
    first = np.searchsorted(document, np.arange(len(offsets) - 1))
    bounds = np.searchsorted(starts, np.r_[begins, len(body)])
    return tokens, bounds, document, np.arange(len(document)) - first[document]


def run_hash(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """An order-dependent hash of each run of tokens."""
    place = np.arange(len(tokens), dtype=np.uint64)
    begin = np.repeat(start, end - start).astype(np.uint64)
    inside = np.repeat(start - np.r_[0, np.cumsum(end - start)[:-1]], end - start) + np.arange((end - start).sum())
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(tokens[inside] + mix(place[inside] - begin + np.uint64(1))), dtype=np.uint64)]
    at = np.r_[0, np.cumsum(end - start)]
    return mix(total[at[1:]] - total[at[:-1]] + (end - start).astype(np.uint64))


def leaf_of(tokens: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """The tree path of each line: its size and its leading tokens."""
    leaf = mix(size.astype(np.uint64))
    for i in range(depth):
        token = tokens[np.minimum(start + i, max(0, len(tokens) - 1))] if len(tokens) else np.zeros(len(start), np.uint64)
        leaf = mix(leaf * np.uint64(31) + np.where(i < size, token, np.uint64(0)))
    return leaf


LINES = "doc_id long, line int, leaf long, hash long, content long, size int"


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """The lines long enough that are not mostly fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, body in text_chunks(batches):
            tokens, bounds, document, number = tokens_of(offsets, body)
            start, end = bounds[:-1], bounds[1:]
            hashes, size = run_hash(tokens, start, end), end - start
            words = np.cumsum(np.r_[0, tokens != FIELD])
            keep = (size >= min_tokens) & (words[end] - words[start] >= WORDS * size)
            leaf = leaf_of(tokens, start, size, depth)
            ids, content = (part.column(i).to_numpy(zero_copy_only=False)[document] for i in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep], pa.int64()), pa.array(number[keep].astype(np.int32)), *[pa.array(x[keep].view(np.int64)) for x in (leaf, hashes)], pa.array(content[keep], pa.int64()), pa.array(size[keep].astype(np.int32))],
                names=["doc_id", "line", "leaf", "hash", "content", "size"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(released(run), LINES)


def _tokens(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line, leaf, hash, docs, size) with their token hashes, from the texts."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "hash", "docs", "size"]
        for part, offsets, body in text_chunks(batches):
            tokens, bounds, document, _ = tokens_of(offsets, body)
            wanted = part.column(2).combine_chunks() if isinstance(part.column(2), pa.ChunkedArray) else part.column(2)
            owner, want = pa.compute.list_parent_indices(wanted).to_numpy(), wanted.flatten()
            line = np.searchsorted(document, np.arange(part.num_rows))[owner] + want.field("line").to_numpy()
            at, n = bounds[line], bounds[line + 1] - bounds[line]
            ends = np.cumsum(n)
            inside = np.repeat(at - (ends - n), n) + np.arange(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(tokens[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[want.field(c) for c in names], lists], names=[*names, "tokens"])

    by_doc = lines.groupBy("doc_id").agg(F.collect_list(F.struct("line", "leaf", "hash", "docs", "size")).alias("lines"))
    by_doc = small(by_doc, lines.count(), BROADCAST_ROWS)
    return docs.join(by_doc, "doc_id").select("doc_id", "text", "lines").mapInArrow(released(fetch), "leaf long, hash long, docs long, size int, tokens array<long>")


def _supported(lines: DataFrame, enough: Column, together: bool) -> DataFrame:
    """leaf, hash, size and tokens (place, token, support) of lines (leaf, hash, docs, size, tokens).

    Lines of small leaves meet ``together``, in one exchange by leaf; those of large leaves
    are counted, and find their counts, by token.
    """
    each = lambda df: df.select("leaf", "hash", "docs", "size", F.posexplode("tokens").alias("place", "token"))
    if together:
        # A repeated row has its lines fetched again.
        marked = each(lines.repartition("leaf").dropDuplicates(["leaf", "hash"])).withColumn("support", F.sum("docs").over(Window.partitionBy("leaf", "place", "token")))
    else:
        rows = each(lines.dropDuplicates(["leaf", "hash"]))
        support = rows.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support"), F.max("size").alias("size"))
        marked = rows.drop("docs").join(support.filter(F.col("support") >= enough).drop("size"), ["leaf", "place", "token"], "left")
    tokens = F.array_sort(F.collect_list(F.struct("place", "token", F.coalesce("support", F.lit(0)).alias("support"))))
    return marked.groupBy("leaf", "hash").agg(F.max("size").alias("size"), tokens.alias("tokens"))


def _templates(lines: DataFrame, enough: Column, similarity: float) -> DataFrame:
    """leaf, hash, level and template of supported lines, of the templates that keep enough of a line."""
    field = F.lit(int(FIELD)).cast("long")

    def level(k: int) -> Column:
        least = enough * 4**k
        # A blank is a value of its own: the hash of an array passes over nulls.
        kept = F.transform("tokens", lambda x: F.when(x["support"] >= least, x["token"]).when(x["token"] == field, field).otherwise(F.lit(0).cast("long")))
        words = F.size(F.filter("tokens", lambda x: (x["support"] >= least) & (x["token"] != field)))
        fields = F.size(F.filter("tokens", lambda x: x["token"] == field))
        counts = (words + fields >= similarity * F.col("size")) & (words >= WORDS * F.col("size"))
        return F.when(counts, F.xxhash64("leaf", kept))

    levels = F.array_distinct(F.array_compact(F.array(*[level(k) for k in range(LEVELS)])))
    return lines.select("leaf", "hash", F.posexplode(levels).alias("level", "template"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """doc_id and line of the lines to drop, from documents (doc_id, text)."""
    work = Scratch(docs.sparkSession)
    lines = work.table(_lines(docs.filter(F.col("doc_id").isNotNull()), depth, min_tokens))
    enough = F.when(F.col("size") >= long_tokens, min(2, min_docs)).otherwise(min_docs)
    # By line and text first, so that the rows of a frequent line are counted in many tasks.
    texts = lines.groupBy("leaf", "hash", "content").agg(F.min(F.struct("doc_id", "line")).alias("rep"), F.max("size").alias("size"))
    distinct = work.table(texts.groupBy("leaf", "hash").agg(F.min("rep").alias("rep"), F.count("*").alias("docs"), F.max("size").alias("size")))
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"), F.max("size").alias("size"))
    # No template of a leaf with fewer lines than it needs documents can recur.
    leaves = work.table(leaves.filter(F.col("docs") >= enough).select("leaf", "n"))
    seen = work.table(distinct.join(small(leaves, leaves.count(), BROADCAST_ROWS), "leaf").select("rep.doc_id", "rep.line", "leaf", "hash", "docs", "size", "n"))
    alone = seen.filter("n = 1").select("leaf", "hash", F.lit(0).alias("level"), F.col("hash").alias("template"))
    named = alone
    for together in (True, False):
        part = work.table(seen.filter(F.col("n").between(2, LEAF_LINES) if together else F.col("n") > LEAF_LINES).drop("n"))
        if together or part.limit(1).count():
            named = named.unionByName(_templates(_supported(_tokens(part, docs), enough, together), enough, similarity))
    named = work.table(named)
    near = small(named, named.count(), BROADCAST_ROWS)
    contents = lines.join(near, ["leaf", "hash"]).groupBy("template", "content").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    recurring = contents.groupBy("template").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"), F.max("size").alias("size"))
    recurring = work.table(recurring.filter(F.col("docs") >= enough).select("template", "first"))
    chosen = named.join(small(recurring, recurring.count(), BROADCAST_ROWS), "template").groupBy("leaf", "hash").agg(F.max(F.struct("level", "first"))["first"].alias("first"))
    chosen = work.table(chosen)
    dropped = materialise(lines.join(small(chosen, chosen.count(), BROADCAST_ROWS), ["leaf", "hash"]).filter("doc_id <> first").select("doc_id", "line"))
    work.drop()
    return dropped


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``df`` without the lines whose template recurs, plus n_lines and n_dropped (replaced if they exist).

    The first document of a template (smallest id) keeps it; a line of several templates
    goes by the one with most fields.  Lines end at "\\n"; those with fewer than
    ``min_tokens`` tokens, or mostly of fields, are never dropped.  Null text stays null with
    no lines; an empty text is one empty line; rows with null ids are left whole; rows that
    share an id count as one document and must hold the same text.  Other columns are left
    alone.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dropped = recurring_lines(docs, **limits)
    gone = dropped.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_gone"))
    gone = small(gone, dropped.count(), BROADCAST_LINES)
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    joined = df.select(*[F.col(f"`{c}`") for c in names]).join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_id"), "left").drop("_id")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("_gone", i))
    return joined.select(
        *[(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(f"`{c}`")) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
    )

