"""Supervised subword embeddings for document quality.

A document is the average of learned vectors, one per hashed word and character
n-gram; a softmax layer over it gives the classes, and both are trained by stochastic
gradient descent in numpy.  Between average and softmax everything is linear, so for
scoring each hashed feature keeps one number per class difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import code_points, mix, released, span_hash, text_chunks, word_spans

BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
DIMENSION, EPOCHS, RATE = 16, 4, 0.8
#: Labelled rows that one model is fitted on, the first by hash of the id.
MAX_TRAIN = 4000
#: Bytes of text whose features are held at once; one byte has about four of them.
SLICE_BYTES = 1 << 18
#: White space (0) parts words; all other bytes keep their value, 0x20 stands for byte 0.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[0x20, 9, 10, 11, 12, 13]] = 0
LETTERS[0] = 0x20
_SAME = mix(np.array([1 << 50], np.uint64))[0]


def features(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every feature: words and the character n-grams within a word.

    A word that repeats the one before it is the feature "same" instead of itself.  An
    n-gram may begin or end with the space beside its word.
    """
    letters = LETTERS[body]
    starts, ends = word_spans(letters, offsets)
    words = span_hash(letters, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    same = np.r_[False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])][: len(words)]
    words[same] = _SAME
    found, owners = [words % np.uint64(BUCKETS)], [owner]
    points, bounds = code_points(offsets, body)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    value = np.where(points < 128, LETTERS[points & 127], points).astype(np.uint64)
    space = value == 0
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x110001) + value[i : i + size]
        whole = document[:size] == document[n - 1 :]
        for i in range(1, n - 1):
            whole &= ~space[i : i + size]
        if n == 2:
            whole &= ~(space[:-1] & space[1:])
        code = code[whole] * np.uint64(0x9E3779B97F4A7C15)
        found.append(code >> np.uint64(64 - 17))
        owners.append(document[:size][whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and output weights; each document is its distinct buckets and their shares."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output = np.zeros((classes, DIMENSION), np.float32)
    step, steps = 0, EPOCHS * len(documents)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(documents)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            at, share = documents[i]
            if not len(at):
                continue
            rows = vectors[at]
            mean = share @ rows
            score = output @ mean
            odds = np.exp(score - score.max())
            slope = odds / odds.sum()
            slope[labels[i]] -= 1
            back = slope @ output
            output -= rate * np.outer(slope, mean)
            vectors[at] = rows - rate * np.float32(len(at)) ** np.float32(0.5) * share[:, None] * back
    return vectors, output


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of class 1 per bucket, and the bias, from rows (text, label).

    The caller bounds the rows; they are fitted in one task, and only the model comes
    to the driver.  With fewer than two classes the model is the bias alone.
    """

    def run(table: pa.Table) -> pa.Table:
        # The fit depends on the order of its rows, and a shuffle does not keep one.
        table = table.sort_by([("text", "ascending"), ("label", "ascending")]).combine_chunks()
        documents, labels = [], table.column("label").to_numpy().astype(np.int64)
        for batch in table.select(["text"]).to_batches():
            for part, offsets, body in text_chunks([batch], limit=SLICE_BYTES):
                bucket, owner = features(offsets, body)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at, n = np.unique(bucket[order[a:b]], return_counts=True)
                    documents.append((at.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
        share = (labels.sum() + 1) / (len(labels) + 2)
        bias = float(np.log(share / (1 - share)))
        if len(set(labels.tolist())) < 2:
            odds = np.zeros(BUCKETS, np.float32)
        else:
            vectors, output = fit(documents, labels)
            odds = vectors @ (output[1] - output[0])
        return pa.table({"bias": [bias], "odds": pa.array([odds.astype(np.float32).tobytes()], pa.binary())})

    row = labelled.groupBy(F.lit(0).alias("all")).applyInArrow(run, "bias double, odds binary").first()
    return (np.frombuffer(row["odds"], np.float32), row["bias"]) if row else (np.zeros(BUCKETS, np.float32), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """text and label (0 or 1) of at most ``max_train`` labelled rows outside ``held_out``, the first by hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col), F.col(label).cast("int").alias("label")).distinct()
    some = known.orderBy(F.xxhash64(id_col), id_col, "label").limit(max_train)
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(some), id_col).select("text", "label")


def score(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``df`` with a column score, the probability of class 1 (replaced if it exists).

    Null or empty text scores by the bias alone; long texts are scored whole.
    """
    odds, bias = model
    names = [c for c in df.columns if c != "score"]
    schema = df.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, body in text_chunks(batches, text_col, SLICE_BYTES):
            bucket, owner = features(offsets, body)
            n = np.bincount(owner, minlength=part.num_rows)
            mean = np.bincount(owner, weights=odds[bucket], minlength=part.num_rows) / np.maximum(n, 1)
            value = 1 / (1 + np.exp(-np.clip(np.where(n > 0, mean, bias), -50, 50)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*names, "score"])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(released(run), schema)
