"""Language-model scores by cross-entropy difference.

Two n-gram models, of a target and of a background, share one vocabulary; a document scores
the mean over its words of target loss less background loss, so low scores read like the
target.  A word's loss mixes that of its pair (the word with the one before it, over all
pairs) and of the word alone, over the frequent words and one class for all others.
Something is added to every count.  A document is scored by the counts of all other
documents: its own counts are taken off both models.

So a pair that no other document has counts nothing, and losses are sums over the distinct
pairs of a document.  Each pair of a document is a row, dealt by pair; where rows of several
documents meet, what their counts change goes back to the documents.  Frequent pairs and
words, of which there can only be few, are counted before and looked up where the text is
read; whether a pair is looked up or dealt, its count is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, mix, released, small, text_chunks
from tidemark.llm.decontam import words_of

#: Every gram (pair or word) that makes one HOT-th of all is looked up; those looked up make at least a quarter of that, so 4 * HOT at most.
HOT = 1 << 16
#: Least count that a task tells; a gram that is rarer in each of many small tasks is dealt, with the same result.
LEAST = 8
#: Weight of the pair's loss, what every count is raised by, and the number of pairs that the raises are spread over.
WEIGHT, EXTRA, PAIRS = 0.6, 0.1, 1 << 17
#: Rows (of 8 to 32 bytes) up to which target ids or scores are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Losses are summed as whole multiples of 1 / UNIT nats, whose sums do not depend on their order.
UNIT = 1 << 30
START = np.uint64(1)


def grams_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each word's pair, then that of each word."""
    before = np.r_[np.uint64(0), words[:-1]][: len(words)].astype(np.uint64)
    before[bounds[:-1][bounds[:-1] < bounds[1:]]] = START
    return np.r_[mix(mix(before) + words), mix(words ^ START)]


def distinct(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct grams of each document first stand, and their times."""
    _, at, times = np.unique(mix(gram + mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
    return at, times


def shrunk(grams: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the grams: the next largest count is taken off all, and those with none left go."""
    if len(grams) <= most:
        return grams, counts
    left = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    return grams[left > 0], left[left > 0]


def added(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(of, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)


def frequent(marked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]]:
    """The frequent grams, sorted, their counts in all rows and in the target, which are words, and both totals of words.

    Each task keeps 2 * HOT counters, from which no gram of one HOT-th of its rows can fall
    out; grams whose counters sum to a quarter of that share are then counted exactly.
    """
    most = 2 * HOT

    def notice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(2, np.int64)
        for part, offsets, body in text_chunks(batches):
            words, bounds = words_of(offsets, body)
            held = shrunk(*added(held, shrunk(*np.unique(grams_of(words, bounds), return_counts=True), most)), most)
            sums += [len(words), np.diff(bounds)[part.column(1).to_numpy(zero_copy_only=False).astype(bool)].sum()]
        keep = (held[1] * 4 * HOT >= 2 * sums[0]) & (held[1] >= LEAST)
        gram, count = held[0][keep], held[1][keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[gram, np.arange(2, dtype=np.uint64)].view(np.int64)), pa.array(np.r_[count, sums]), pa.array(np.r_[np.zeros(len(gram), bool), np.ones(2, bool)])], names=["gram", "count", "total"])

    seen = materialise(marked.select("text", "target").mapInArrow(released(notice), "gram long, count long, total boolean").groupBy("total", "gram").agg(F.sum("count").alias("count")))
    found = {r.gram: r["count"] for r in seen.filter("total").collect()}
    sums = tuple(int(found.get(i, 0)) for i in range(2))
    hot = np.sort(seen.filter(~F.col("total") & (F.col("count") * 4 * HOT >= 2 * sums[0])).select("gram").toArrow().column(0).to_numpy().view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_word = np.zeros((2, len(hot)), np.int64), np.zeros(len(hot), bool)
        for part, offsets, body in text_chunks(batches):
            words, bounds = words_of(offsets, body)
            place, known = places(hot, grams_of(words, bounds))
            target = np.tile(np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds)), 2)
            for row, use in zip(counts, (known, known & target), strict=True):
                row += np.bincount(place[use], minlength=len(hot))
            is_word[place[len(words) :][known[len(words) :]]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot), dtype=np.int32)), *[pa.array(row) for row in counts], pa.array(is_word)], names=["place", "n", "t", "word"])

    counts, is_word = np.zeros((2, len(hot)), np.int64), np.zeros(len(hot), bool)
    if len(hot):
        exact = marked.select("text", "target").mapInArrow(released(count), "place int, n long, t long, word boolean").groupBy("place").agg(F.sum("n"), F.sum("t"), F.max("word")).toArrow()
        place = exact.column(0).to_numpy()
        counts[:, place], is_word[place] = [exact.column(i).to_numpy() for i in (1, 2)], exact.column(3).to_numpy(zero_copy_only=False)
    return hot, counts, is_word, sums


def places(hot: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams stand among the frequent ones, and which do."""
    if not len(hot):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    place = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
    return place, hot[place] == grams


def text_losses(marked: DataFrame) -> DataFrame:
    """key, n_tokens and mean losses of each distinct text and kind, from rows (key, text, target)."""
    hot, counts, is_word, sums = frequent(marked)
    vocabulary, unknown = int(is_word.sum()), [total - int(row[is_word].sum()) for row, total in zip(counts, sums, strict=True)]
    rows = marked.select("text", "target", "key")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text: its losses as far as totals, words and frequent pairs go."""
        for part, offsets, body in text_chunks(batches):
            words, bounds = words_of(offsets, body)
            gram, n = grams_of(words, bounds), np.diff(bounds)
            owner = np.tile(np.repeat(np.arange(len(n)), n), 2)
            place, found = places(hot, gram)
            own_unknown = np.bincount(owner[len(words) :][~found[len(words) :]], minlength=len(n))
            at, times = distinct(gram[found], owner[found])
            place, owner = place[found][at], owner[found][at]
            target, losses = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), []
            for model, mine in ((1, target), (0, np.ones(len(n), np.int64))):
                total = sums[model] - n * mine
                base = WEIGHT * n * (np.log(total + EXTRA * PAIRS) - math.log(EXTRA)) + (1 - WEIGHT) * n * np.log(total + EXTRA * (vocabulary + 1))
                base -= (1 - WEIGHT) * own_unknown * np.log(unknown[model] - own_unknown * mine + EXTRA)
                count = counts[model][place] - times * mine[owner]
                change = times * np.where(is_word[place], (1 - WEIGHT) * np.log(count + EXTRA), WEIGHT * np.log1p(count / EXTRA))
                losses.append(np.rint((base - np.bincount(owner, weights=change, minlength=len(n))) * UNIT).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(n, pa.int64()), pa.array(n, pa.int64()), *[pa.array(x) for x in losses]], names=["key", "n_tokens", "words", "target", "background"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each other pair of a text; ``info`` packs its times and whether the text is a target."""
        for part, offsets, body in text_chunks(batches):
            words, bounds = words_of(offsets, body)
            pair = grams_of(words, bounds)[: len(words)]
            rest = ~places(hot, pair)[1]
            pair, owner = pair[rest], np.repeat(np.arange(part.num_rows), np.diff(bounds))[rest]
            at, times = distinct(pair, owner)
            target = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[owner[at]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[at].view(np.int64)), part.column(2).take(pa.array(owner[at])), pa.array((times << 1) | target)], names=["pair", "key", "info"])

    times, target = F.shiftright("info", 1), F.col("info").bitwiseAND(1)
    alike = Window.partitionBy("pair")
    met = rows.mapInArrow(released(others), "pair long, key long, info long").withColumns({"n": F.sum(times).over(alike) - times, "t": F.sum(times * target).over(alike) - times * target}).filter("n > 0")
    change = lambda c: F.round(-WEIGHT * times * F.log1p(F.col(c) / EXTRA) * UNIT).cast("long")
    zero = F.lit(0).cast("long")
    changes = met.select("key", zero.alias("n_tokens"), zero.alias("words"), change("t").alias("target"), change("n").alias("background"))
    changes = changes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "words", "target", "background")])
    both = rows.mapInArrow(released(known), "key long, n_tokens long, words long, target long, background long").unionByName(changes)
    # Copies of a text add to the losses and the words alike, so the means are those of one.
    both = both.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("words", "target", "background")])
    mean = lambda c: F.round(F.col(c) / (F.greatest(F.col("words"), F.lit(1)) * UNIT), 9).alias(f"{c}_loss")
    return both.select("key", "n_tokens", mean("target"), mean("background"))


def cross_entropy_difference(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, target_loss, background_loss (means, nats) and score, their difference.

    The background is all rows, the target those whose ids are in ``targets``; a row's own
    counts are taken off the models that it is in.  Null ids are never targets; a repeated
    row counts as another document.  Without targets the target model is uniform.  Null,
    empty or wordless text has 0 tokens, zero losses and score 0.  Long texts are scored
    whole.  Columns of these names are replaced.
    """
    new = ["n_tokens", "target_loss", "background_loss", "score"]
    names = [c for c in df.columns if c not in new]
    wanted = materialise(targets.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct())
    wanted = small(wanted, wanted.count(), BROADCAST_ROWS)
    text, kept = F.coalesce(F.col(text_col), F.lit("")), [F.col(f"`{c}`") for c in names]
    joined = df.select(*kept).join(wanted, F.col(f"`{id_col}`") == F.col("_id"), "left").withColumn("_target", F.col("_id").isNotNull())
    joined = joined.withColumn("_key", F.xxhash64(text, "_target"))
    scored = materialise(text_losses(joined.select(F.col("_key").alias("key"), text.alias("text"), F.col("_target").alias("target"))))
    joined = joined.select(*kept, "_key").join(small(scored, scored.count(), BROADCAST_ROWS).withColumnRenamed("key", "_key"), "_key", "left")
    return joined.select(*kept, *new[:3], (F.col("target_loss") - F.col("background_loss")).alias(new[3]))
