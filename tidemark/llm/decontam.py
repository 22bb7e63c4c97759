"""Benchmark decontamination by winnowing.

Of the k-word hashes in each window of n words only the smallest is kept, the
rightmost of ties.  Equal windows keep the same one, so every shared run of n words
shows up in a join of the kept fingerprints; hits are then extended to the whole
window, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import gram_hash, materialise, released, span_hash, text_chunks, utf8, word_spans

#: Lower-cased ASCII letters, digits and all bytes from 0x80; everything else parts words.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x80:] = np.arange(0x80, 0x100)
LETTERS[0x30:0x3A] = np.arange(0x30, 0x3A)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Bytes of benchmark text that one broadcast index may come from; more is read block by block.
BLOCK_BYTES = 16 << 20


def words_of(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the index of each document's first word (with the end)."""
    letters = LETTERS[body]
    starts, ends = word_spans(letters, offsets)
    return span_hash(letters, starts, ends), np.searchsorted(starts, offsets)


def inside(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the ``size`` places start a run of n words within one document."""
    ok = np.ones(max(0, size - n + 1), bool)
    for back in range(1, n):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def winnowed(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """The kept k-gram hash of each run of n words."""
    grams = gram_hash(words, k)
    size = max(0, len(words) - n + 1)
    best = grams[:size].copy()
    for i in range(1, n - k + 1):
        np.minimum(best, grams[i : i + size], out=best)
    return best


class Index:
    """Windows of a block of benchmark items: hash, words, and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], n: int, k: int):
        self.n, self.k = n, k
        self.items = sorted({i for i, _ in items if i is not None})
        number = {item: i for i, item in enumerate(self.items)}
        offsets, body = utf8(pa.array([t for _, t in items], pa.string()))
        words, bounds = words_of(offsets, body)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for (item, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            size = min(n, b - a)
            for at in range(a, b - size + 1) if size else ():
                by_length.setdefault(size, []).append((at, number.get(item, -1)))
        self.windows = {}
        for size, found in sorted(by_length.items()):
            at = np.array([x for x, _ in found])
            runs = words[at[:, None] + np.arange(size)]
            hashes = gram_hash(words, size, at)
            order = np.argsort(hashes, kind="stable")
            unique, first = np.unique(hashes[order], return_index=True)
            holders = np.split(np.array([x for _, x in found])[order], first[1:])
            kept = np.unique(winnowed(words, n, k)[at]) if size == n else None
            self.windows[size] = (unique, runs[order][first], holders, kept)

    def find(self, words: np.ndarray, bounds: np.ndarray):
        """(size, starts of the windows that occur, number of the window) for each window size."""
        for size, (hashes, runs, holders, kept) in self.windows.items():
            ok = inside(bounds, len(words), size)
            if kept is None:
                at = np.flatnonzero(ok)
                grams = gram_hash(words, size, at)
            else:
                best = winnowed(words, size, self.k)
                near = np.minimum(np.searchsorted(kept, best), len(kept) - 1)
                at = np.flatnonzero(ok & (kept[near] == best))
                grams = gram_hash(words, size, at)
            which = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            same = hashes[which] == grams
            at, which = at[same], which[same]
            whole = (words[at[:, None] + np.arange(size)] == runs[which]).all(axis=1) if len(at) else np.zeros(0, bool)
            yield size, at[whole], which[whole], holders


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    parts = -(-size // block_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) if parts > 1 else items for i in range(parts)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (runs of hit words, [start, end)) and hit_items (sorted ids).

    Benchmark ids are taken as strings; a null id counts for hits but not as an item.
    Null or empty text has no words; an empty benchmark hits nothing; repeated rows are
    judged alike; columns of ``docs`` named as the three new ones are replaced.

    The benchmark's index is broadcast only up to ``block_bytes`` of text.  A larger
    benchmark is read in blocks: each is a pass of its own over the rows, which carry their
    hits through a table of the shared folder, so driver and tasks hold one block at a time.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("n_words", "hits", "hit_items")]
    names = [f.name for f in fields]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(schema["hits"].dataType).alias("hits"), F.lit(None).cast(schema["hit_items"].dataType).alias("hit_items"))
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    for number, block in enumerate(blocks):
        rows = [(r["item"], r["text"]) for r in block.collect()]  # at most about block_bytes

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            index = Index(rows, n, k)
            for part, offsets, body in text_chunks(batches, text_col):
                words, bounds = words_of(offsets, body)
                cover = np.zeros(len(words) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for d, (spans, known) in enumerate(zip(part.column(len(names) + 1).to_pylist(), part.column(len(names) + 2).to_pylist(), strict=True)):
                    for s in spans or ():
                        cover[bounds[d] + s["start"]] += 1
                        cover[bounds[d] + s["end"]] -= 1
                    if known:
                        items[d] = set(known)
                for size, at, which, holders in index.find(words, bounds):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    docs_at = np.searchsorted(bounds, at, "right") - 1
                    for d, w in set(zip(docs_at.tolist(), which.tolist(), strict=True)):
                        items.setdefault(d, set()).update(index.items[i] for i in holders[w].tolist() if i >= 0)
                hit = np.cumsum(cover[:-1]) > 0
                cut = np.zeros(len(words) + 1, bool)
                cut[bounds] = True
                before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
                a = np.flatnonzero(hit & (~before | cut[:-1]))
                b = np.flatnonzero(hit & (~after | cut[1:])) + 1
                at = np.searchsorted(bounds, a, "right") - 1
                spans = [[] for _ in range(part.num_rows)]
                for d, x, y in zip(at.tolist(), (a - bounds[at]).tolist(), (b - bounds[at]).tolist(), strict=True):
                    spans[d].append({"start": x, "end": y})
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(names)],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string())),
                    ],
                    names=[*names, "n_words", "hits", "hit_items"],
                )

        out = out.mapInArrow(released(run), schema)
        if number + 1 < len(blocks):
            out = materialise(out)
    return out


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of found rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


