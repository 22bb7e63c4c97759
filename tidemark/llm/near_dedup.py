"""Near duplicates by b-bit MinHash.

Only the low bits of each minimum are kept and packed; bands of minima propose
pairs, bit counts (corrected for chance agreement) estimate their similarity, and
pairs that may reach the threshold are confirmed on the full shingle sets.

Documents with equal sets are one class from the start.

1. *Stars.*  Each class of a band bucket is compared with the bucket's smallest class; the
   confirmed pairs are the first links and make components.
2. *Cells.*  What is left of a bucket with several components: classes outside its most
   frequent component face the classes of that component, and each other, in blocks.  Every
   pair that shares a band is thus compared, but a block tells only the links that join two
   of its components: a spanning forest, at most one link a class.

Sets travel as sorted 64-bit hashes of shingles, fetched from the texts once for the stars
and once for the classes that a block's estimates leave in question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, gram_hash, materialise, mix, released, runs, small, span_hash, text_chunks, word_spans
from tidemark.llm.components import connected_components

BANDS, ROWS, BITS = 32, 5, 2
#: Minima whose low bits are kept; the first BANDS * ROWS also make the bands.
MINIMA = 320
#: Rows of a counted table (24 bytes each) up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Classes of a block, and shingles of its sets.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: A pair whose estimate lies this many standard errors below the threshold is dropped.
ERRORS = 4.5
#: All bytes but white space, with A-Z in lower case; 0x20 stands for the byte 0.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[0x41:0x5B] += 0x20
LETTERS[[0x20, 9, 10, 11, 12, 13]] = 0
LETTERS[0] = 0x20


def shingle_sets(offsets: np.ndarray, body: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a shorter document is one shingle."""
    letters = LETTERS[body]
    starts, ends = word_spans(letters, offsets)
    words = span_hash(letters, starts, ends)
    grams = gram_hash(words, size)
    bounds = np.searchsorted(starts, offsets).tolist()
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        else:
            sets.append(gram_hash(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


class Signer:
    """Band hashes and packed low bits of a set's minima, with fixed coefficients."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, n: int = MINIMA):
        seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
        self.bands, self.rows = bands, rows
        self.factor = (seed[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shift = (seed[n:] >> np.uint64(32)).astype(np.uint32)
        self.band = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 40))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        step = max(1, 1_000_000 // len(short))
        return np.concatenate([(self.factor[i : i + step, None] * short + self.shift[i : i + step, None]).min(axis=1) for i in range(0, len(self.factor), step)])

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.minima(hashes)
        rows = low[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        keys = self.band.copy()
        for i in range(self.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        bits = mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
        packed = np.packbits(np.unpackbits(bits.astype(np.uint8)[:, None], axis=1)[:, 8 - BITS :].T.reshape(-1))
        return keys.view(np.int64), packed


def similarity(a: np.ndarray, b: np.ndarray, minima: int) -> np.ndarray:
    """Estimates from packed bits: the share of agreeing minima, less what chance gives.

    The rows hold BITS planes of ``minima`` bits each, in bytes or in longer words.
    """
    unlike = np.bitwise_xor(a, b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BITS, a.shape[-1] // BITS)
    differ = np.bitwise_count(np.bitwise_or.reduce(unlike, axis=-2)).sum(axis=-1, dtype=np.int32)
    chance = 0.5**BITS
    return (1 - differ / minima - chance) / (1 - chance)


def least_estimate(threshold: float, minima: int) -> float:
    chance = 0.5**BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - ERRORS * (agree * (1 - agree) / minima) ** 0.5 / (1 - chance)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: size and 128-bit hash of its set, band hashes and packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for part, offsets, body in text_chunks(batches):
            sets = shingle_sets(offsets, body, shingle)
            signed = [signer.sign(s) if len(s) else None for s in sets]
            one = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            two = np.array([mix(~s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array([s and s[0] for s in signed], pa.list_(pa.int64())),
                    pa.array([s and s[1].tobytes() for s in signed], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
            )

    return docs.mapInArrow(released(run), SIGNED)


def packed_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The packed bits of each row, as 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _estimated(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = similarity(packed_rows(batch.column(2)), packed_rows(batch.column(3)), MINIMA) >= least
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    return both.select("a", "b", "bits_a", "bits_b").mapInArrow(released(run), "a long, b long")


def shingle_table(docs: DataFrame, nodes: DataFrame, shingle: int, work: Scratch) -> DataFrame:
    """node and set (sorted shingle hashes as bytes) of the documents ``nodes``; few nodes are broadcast to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, body in text_chunks(batches):
            sets = [s.tobytes() for s in shingle_sets(offsets, body, shingle)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    nodes = work.table(nodes.distinct())
    texts = docs.join(small(nodes, nodes.count(), BROADCAST_ROWS), docs["doc_id"] == nodes["node"], "left_semi")
    return work.table(texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(released(run), "node long, set binary"))


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def star_links(pairs: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union.

    The pairs of one ``a`` are dealt in blocks; its set is sent once a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, side, own) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 2)], batch.column(4), strict=True)):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if side == 0:
                    root, mine = a, own
                elif root == a and len(mine) and len(own):
                    both = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                    keep[i] = 100 * both >= percent * (len(mine) + len(own) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 3)], names=["a", "b"])

    counts = work.table(pairs.groupBy("a").agg(_blocks(F.count("*"), F.lit(0)).alias("blocks")))
    wide = work.table(counts.filter("blocks > 1"))
    members = pairs.join(small(wide, wide.count(), BROADCAST_ROWS), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(1).alias("side"), F.col("b").alias("node"))
    roots = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("a").alias("node"))
    dealt = members.unionByName(roots).join(sets, "node").select("a", "block", "side", "node", "set")
    return dealt.repartition("a", "block").sortWithinPartitions("a", "block", "side").mapInArrow(released(run), "a long, b long")


CELL = ["kind", "key", "i", "j"]


def _cells(rows: DataFrame, work: Scratch) -> DataFrame:
    """``rows`` (kind, key, side, node, size, ...) dealt to the blocks (i, j) of their key.

    Rows of side 0 meet those of side 1; rows of side 2 meet each other.
    """
    group = rows.groupBy("kind", "key", "side").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    wide = group.groupBy("kind", "key").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("blocks"))), F.lit(1)).alias(f"b{s}") for s in range(3)])
    wide = work.table(wide.filter("b0 > 1 or b1 > 1 or b2 > 1"))
    rows = rows.join(small(wide, wide.count(), BROADCAST_ROWS), ["kind", "key"], "left").withColumns({f"b{s}": F.coalesce(f"b{s}", F.lit(1)) for s in range(3)})
    side = F.col("side")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(side == 0, F.col("b0")).when(side == 1, F.col("b1")).otherwise(F.col("b2"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(side == 0, F.col("b1")).when(side == 1, F.col("b0")).otherwise(F.col("b2")) - 1)))
    i = F.when(side == 0, F.col("own")).when(side == 1, F.col("other")).otherwise(F.least("own", "other"))
    j = F.when(side == 0, F.col("other")).when(side == 1, F.col("own")).otherwise(F.greatest("own", "other"))
    dealt = rows.withColumns({"i": i, "j": j}).drop("b0", "b1", "b2", "other")
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL)


def _sides(side: np.ndarray, own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a cell that face each other."""
    return np.flatnonzero((side == 0) | ((side == 2) & (own == i))), np.flatnonzero((side == 1) | ((side == 2) & (own == j)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a cell."""
    for table in runs(batches, len(CELL)):
        keys = [table.column(c).to_numpy() for c in range(len(CELL))]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip([0, *cut], [*cut, table.num_rows], strict=True):
            yield table.slice(a, b - a)


def in_question(rows: DataFrame, least: float, percent: int, work: Scratch) -> DataFrame:
    """The rows that some row of another component may be linked with, going by sizes and estimates."""
    columns = ["kind", "key", "side", "node", "component", "size", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches):
            side, own, component, size = (cell.column(c).to_numpy() for c in ("side", "own", "component", "size"))
            bits = packed_rows(cell.column("bits"))
            x, y = _sides(side, own, cell.column("i")[0].as_py(), cell.column("j")[0].as_py())
            live = np.zeros(len(side), bool)
            for at in range(0, len(x), 128):
                p = x[at : at + 128]
                fits = (component[p, None] != component[None, y]) & (100 * np.minimum(size[p, None], size[None, y]) >= percent * np.maximum(size[p, None], size[None, y]))
                u, v = np.nonzero(fits)
                near = similarity(bits[p[u]], bits[y[v]], MINIMA) >= least
                live[p[u[near]]] = live[y[v[near]]] = True
            if live.any():
                yield from cell.select(columns).filter(pa.array(live)).combine_chunks().to_batches()

    schema = "kind int, key long, side int, node long, component long, size long, bits binary"
    found = _cells(rows, work).select(*CELL, "side", "own", "node", "component", "size", "bits").mapInArrow(released(run), schema)
    return found.groupBy("kind", "key", "side", "node").agg(*[F.first(c).alias(c) for c in ("component", "size", "bits")])


def forest(rows: DataFrame, sets: DataFrame, least: float, percent: int, work: Scratch) -> DataFrame:
    """Links (a, b) of components, confirmed on full sets: of each cell only those that join two components."""

    def links(cell: pa.Table) -> list[tuple[int, int]]:
        side, own, component, size = (cell.column(c).to_numpy() for c in ("side", "own", "component", "size"))
        bits, held = packed_rows(cell.column("bits")), [np.frombuffer(s.as_buffer(), np.uint64) for s in cell.column("set")]
        x, y = _sides(side, own, cell.column("i")[0].as_py(), cell.column("j")[0].as_py())
        at = np.r_[0, np.cumsum([len(s) for s in held])]
        names, ids = np.unique(np.concatenate(held), return_inverse=True)
        theirs = np.concatenate([ids[at[v] : at[v + 1]] for v in y]) if len(y) else ids[:0]
        starts = np.r_[0, np.cumsum(np.diff(at)[y])[:-1]].astype(np.int64)
        _, label = np.unique(component, return_inverse=True)
        mark, found = np.zeros(len(names), np.int32), []
        for u in x:
            fits = np.flatnonzero((label[y] != label[u]) & (100 * np.minimum(size[u], size[y]) >= percent * np.maximum(size[u], size[y])))
            fits = fits[similarity(bits[u], bits[y[fits]], MINIMA) >= least]
            if not len(fits):
                continue
            mark[ids[at[u] : at[u + 1]]] = 1
            both = np.add.reduceat(mark[theirs], starts)[fits]
            mark[ids[at[u] : at[u + 1]]] = 0
            for v in y[fits[100 * both >= percent * (size[u] + size[y[fits]] - both)]]:
                if label[v] != label[u]:
                    found.append((int(component[u]), int(component[v])))
                    label[label == label[v]] = label[u]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches):
            if found := links(cell):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    dealt = _cells(rows.join(sets, "node"), work)
    return dealt.select(*CELL, "side", "own", "node", "component", "size", "bits", "set").mapInArrow(released(run), "a long, b long")


def undecided(buckets: DataFrame, labels: DataFrame, bits: DataFrame, work: Scratch) -> DataFrame:
    """kind, key, side, node, component, size and bits of the classes to compare after the stars.

    Kind 0, by the main component of some bucket: classes of other components in it (side 0)
    and its own (side 1).  Kind 1, by bucket: the classes outside its main component (side 2).
    A bucket of two classes was compared whole as a star.
    """
    named = work.table(buckets.filter("n > 2").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")))
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = work.table(mixed)
    rows = work.table(named.join(small(mixed, mixed.count(), BROADCAST_ROWS), "band"))
    out = rows.filter("component <> main")
    left = out.select(F.lit(0).alias("kind"), F.col("main").alias("key"), F.lit(0).alias("side"), "node", "component").distinct()
    right = rows.filter("component = main").select(F.lit(0).alias("kind"), F.col("main").alias("key"), F.lit(1).alias("side"), "node", "component").distinct()
    among = out.filter("parts > 2").select(F.lit(1).alias("kind"), F.col("band").alias("key"), F.lit(2).alias("side"), "node", "component")
    return work.table(left.unionByName(right).unionByName(among).join(bits, "node"))


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the smallest id linked with the row, directly or through others.
    Null or empty text has no shingles and no links.  Rows that share an id count as one
    document and must hold the same text.  A row with a null id has no links: its
    component_id is null and it is kept.  An empty table gives no rows.  Long texts count
    whole.  Other columns are left alone.
    """
    work = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(signatures(docs, shingle))
    key = ["n_shingles", "set_a", "set_b"]
    members = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = work.table(members.groupBy(*key).agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    bits = classes.select("node", F.col("n_shingles").alias("size"), "bits")
    bands = classes.select("node", F.explode("bands").alias("band"))
    roots = work.table(bands.groupBy("band").agg(F.min("node").alias("root"), F.count("*").alias("n")).filter("n > 1"))
    buckets = work.table(bands.join(small(roots, roots.count(), BROADCAST_ROWS), "band"))
    least = least_estimate(percent / 100, MINIMA)
    pairs = buckets.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    pairs = work.table(_estimated(pairs, bits, least))
    sets = shingle_table(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), shingle, work)
    labels = connected_components(star_links(pairs, sets, percent, work), work)
    rows = work.table(in_question(undecided(buckets, labels, bits, work), least, percent, work))
    links = forest(rows, shingle_table(docs, rows.select("node"), shingle, work), least, percent, work)
    joined = connected_components(links, work).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    found = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(joined, "component", "left")
    found = found.select(*key, "node", "last", F.coalesce("whole", "component").alias("component_id"))
    moved = materialise(found.filter("component_id <> node or last <> node").drop("node", "last"))
    work.drop()
    linked = signed.select("doc_id", *key).join(small(moved, moved.count(), BROADCAST_ROWS), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
