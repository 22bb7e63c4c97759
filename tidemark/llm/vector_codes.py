"""Product quantisation in whole numbers, with memoised grid cells.

Vectors become integers (floor of ``scale`` times each component) and are cut into equal parts.
Each part position has a codebook; rounds of assigning every part to its nearest entry and of
moving entries to the floor of their parts' mean follow, all in exact integers.

The nearest entry is found by cell: a part's integers shifted right by ``bits`` name a box of the
grid.  For each box the entries are kept that are not dominated across it, that is, whose least
distance to the box does not exceed the least of all greatest distances.  Tasks remember these
lists by box, so that a box seen again costs a lookup, and evaluate only the listed entries
exactly.  Balls around the box give a first, coarser list by one matrix product; it always holds
the finer one.  The width of the grid follows from the distances between the codebook's entries
and has no effect on results.

Spark scans the vectors once a round; a task sends one row a used entry with sums in limbs of 30
bits, a grouping adds them, and the codebook (``entries`` rows a part) is told to the tasks.  The
codes are written below the checkpoint folder before labels are totalled.

Defined results: vectors that are null or hold null or non-finite components are dropped.  So are
vectors whose length is not the commonest one among lengths divisible by the number of parts
(ties: the shorter), as parts of other lengths cannot be compared.  Repeated ids all count; among
equal ids the codebook takes them by vector, ascending, and null ids last.  Integers beyond the
range in which sums of squares fit 64 bits are compared as Python integers; an error, or a sum of
errors, beyond 64 bits is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import materialise, released, small

#: Labels above which the totals of labels are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Cells a task remembers for each part; then it starts anew.
MEMO_CELLS = 1 << 15
#: Parts handled at once.
BLOCK = 4096
LIMB = 30


class Codebook:
    """The entries of one part position and the memo of grid cells."""

    def __init__(self, entries: list[list[int]]):
        self.exact = entries
        d = max(1, len(entries[0]))
        #: Components below ``near`` are compared in 64 bits with entries below ``far``; entries beyond are
        #: farther from such parts than any entry below ``near``.
        self.near = int(math.isqrt((1 << 61) // d) / (2 + 2 * math.sqrt(d)))
        self.far = int(self.near * (1 + 2 * math.sqrt(d))) + 1
        top = np.array([max((abs(x) for x in e), default=0) for e in entries], object)
        self.listed = np.flatnonzero(top < self.far) if (top < self.near).any() else np.zeros(0, np.int64)
        self.entries = np.array([entries[i] for i in self.listed], np.int64).reshape(len(self.listed), len(entries[0]))
        self.memo: dict[bytes, np.ndarray] = {}
        if len(self.listed):
            self.real = self.entries.astype(np.float64)
            self.norms = (self.real**2).sum(1)
            apart = self._squares(self.real)
            np.fill_diagonal(apart, np.inf)
            gap = math.sqrt(max(0.0, float(np.median(apart.min(1))))) if len(self.listed) > 1 else 0.0
            self.bits = max(0, int(math.log2(max(1.0, gap / (4 * math.sqrt(d))))))

    def _squares(self, points: np.ndarray) -> np.ndarray:
        return np.maximum((points**2).sum(1)[:, None] - 2 * points @ self.real.T + self.norms, 0)

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell, the entries that may be nearest to some part in it, ascending."""
        low, wide = cells << self.bits, (1 << self.bits) - 1
        centre, radius = low + wide / 2, math.sqrt(cells.shape[1]) * wide / 2
        away = self._squares(centre)
        slack = 1e-9 * ((centre**2).sum(1).max() + self.norms.max() + 1)
        distance = np.sqrt(away)
        reach = distance.min(1) + 2 * radius
        # What is left by the balls: centre within reach, with room for rounding.
        row, entry = np.nonzero(away <= (reach**2 + slack + 1e-9 * reach**2)[:, None])
        above, below = self.entries[entry] - low[row], low[row] + wide - self.entries[entry]
        least = (np.maximum(np.maximum(-above, -below), 0) ** 2).sum(1)
        most = (np.maximum(np.abs(above), np.abs(below)) ** 2).sum(1)
        bound = np.minimum.reduceat(most, np.searchsorted(row, np.arange(len(cells))))
        kept = least <= bound[row]
        return np.split(entry[kept], np.searchsorted(row[kept], np.arange(1, len(cells))))

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = np.ascontiguousarray(parts >> self.bits)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first.tolist()]
        lists = [self.memo.get(n) for n in names]
        new = [i for i, x in enumerate(lists) if x is None]
        if new:
            if len(self.memo) + len(new) > MEMO_CELLS:
                self.memo.clear()
            for i, found in zip(new, self._undominated(cells[first[new]]), strict=True):
                lists[i] = self.memo[names[i]] = found
        sizes = np.array([len(x) for x in lists])[which]
        row = np.repeat(np.arange(len(parts)), sizes)
        entry = np.concatenate([lists[i] for i in which.tolist()])
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        return self.listed[entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]]], best

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Index of the nearest entry (ties: the lower) and its squared distance, of each row."""
        codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
        fits = np.zeros(len(parts), bool)
        if len(self.listed):
            fits = (np.abs(parts) < self.near).all(1) if parts.dtype != object else np.array([all(abs(x) < self.near for x in p) for p in parts], bool)
        quick = np.flatnonzero(fits)
        for at in range(0, len(quick), BLOCK):
            rows = quick[at : at + BLOCK]
            codes[rows], errors[rows] = self._block(parts[rows].astype(np.int64))
        for i in np.flatnonzero(~fits).tolist():
            p = [int(x) for x in parts[i]]
            found = [sum((x - y) ** 2 for x, y in zip(p, e, strict=True)) for e in self.exact]
            errors[i] = min(found)
            codes[i] = found.index(errors[i])
        return codes, errors.tolist()


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python integers where a float does not hold them exactly."""
    with np.errstate(over="ignore"):
        scaled = values.astype(np.float64) * scale
    if not scaled.size or np.abs(scaled).max() < 2.0**52:
        return np.floor(scaled).astype(np.int64)
    flat = [math.floor(s) if abs(s) < 2.0**52 else math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x, s in zip(values.ravel().tolist(), scaled.ravel().tolist(), strict=True)]
    return np.array(flat, object).reshape(values.shape)


def _vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    held = batch.column(batch.schema.get_field_index(column))
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), dim)


def _limbs(number: int) -> list[int]:
    """Signed number as limbs of ``LIMB`` bits, the last one signed."""
    out = []
    while not -(1 << LIMB) <= number < 1 << LIMB:
        out.append(number & ((1 << LIMB) - 1))
        number >>= LIMB
    return [*out, number]


class Quantiser:
    """Codebooks by part position, of vectors of one length."""

    def __init__(self, books: list[list[list[int]]], dim: int, scale: int):
        self.books, self.dim, self.scale = books, dim, scale

    def assign(self, values: np.ndarray, made: list[Codebook]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """For each part position the parts, their codes and errors."""
        whole, width = integers(values, self.scale), self.dim // len(made)
        for k, book in enumerate(made):
            parts = whole[:, k * width : (k + 1) * width]
            yield (parts, *book.nearest(parts))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def _moved(vectors: DataFrame, model: Quantiser, column: str) -> Quantiser:
    """The model after one round over all vectors."""

    @released
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(book) for book in model.books]
        width = model.dim // len(made)
        sums = [np.zeros((len(b), width), object) for b in model.books]
        counts = [np.zeros(len(b), np.int64) for b in model.books]
        for batch in batches:
            for k, (parts, codes, _) in enumerate(model.assign(_vectors(batch, column, model.dim), made)):
                counts[k] += np.bincount(codes, minlength=len(counts[k]))
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                if len(used):
                    sums[k][used] += np.add.reduceat(parts[order], starts, axis=0).astype(object)
        rows = []
        for k, count in enumerate(counts):
            for entry in np.flatnonzero(count).tolist():
                split = [_limbs(x) for x in sums[k][entry].tolist()]
                for level in range(max(map(len, split))):
                    rows.append((k, entry, level, int(count[entry]) * (level == 0), [x[level] if level < len(x) else 0 for x in split]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "level", "n", "sums"]
        )

    schema = "part int, entry int, level int, n long, sums array<long>"
    sums = [F.sum(F.col("sums")[i]) for i in range(model.dim // len(model.books))]
    told = vectors.select(column).mapInArrow(partial, schema).groupBy("part", "entry", "level").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect()
    counts, totals = {}, {}
    for r in told:
        at = r["part"], r["entry"]
        counts[at] = counts.get(at, 0) + r["n"]
        totals[at] = [x + (y << LIMB * r["level"]) for x, y in zip(totals.get(at, [0] * len(r["sums"])), r["sums"], strict=True)]
    books = [[[x // counts[k, i] for x in totals[k, i]] if (k, i) in counts else entry for i, entry in enumerate(book)] for k, book in enumerate(model.books)]
    return Quantiser(books, model.dim, model.scale)


def usable(vectors: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector takes part, and the length of these vectors (0: there are none)."""
    finite = F.coalesce(F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.filter(finite & (F.size(column) > 0) & (F.size(column) % parts == 0))
    most = kept.groupBy(F.size(column).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = most[0]["dim"] if most else 0
    return kept.filter(F.size(column) == dim), dim


def train(vectors: DataFrame, dim: int, id_column: str, column: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Quantiser:
    """Codebooks that begin as the parts of the smallest ids' vectors and move ``rounds`` times."""
    first = vectors.select(id_column, column).orderBy(F.col(id_column).asc_nulls_last(), column).limit(entries).collect()
    whole = [integers(np.array(r[column], np.float64), scale).tolist() for r in first]
    width = dim // parts
    model = Quantiser([[v[k * width : (k + 1) * width] for v in whole] for k in range(parts)], dim, scale)
    for _ in range(rounds):
        model = _moved(vectors, model, column)
    return model


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of each usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    kept, dim = usable(vectors.select(id_column, label, column), column, parts)
    if not dim:
        return kept.select(id_column, label, *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    model = train(kept, dim, id_column, column, parts, entries, rounds, scale)
    digits = np.array([f"{i:02x}" for i in range(256)])

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(book) for book in model.books]
        for batch in batches:
            code, error = np.full(batch.num_rows, "", f"<U{2 * parts}"), [0] * batch.num_rows
            for _, codes, errors in model.assign(_vectors(batch, column, dim), made):
                code = np.char.add(code, digits[codes])
                error = [x + y for x, y in zip(error, errors, strict=True)]
            error = [x if x < 1 << 63 else None for x in error]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], [id_column, label, "code", "error"])

    schema = StructType([kept.schema[id_column], kept.schema[label], *StructType.fromDDL("code string, error long").fields])
    coded = materialise(kept.mapInArrow(encode, schema))
    # A label with an error beyond 64 bits has no total in 64 bits either.
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    totals = coded.groupBy(F.col(label).alias("_label")).agg(total.alias("_total"))
    totals = small(totals, coded.select(label).distinct().count(), BROADCAST_ROWS)
    joined = coded.join(totals, F.col(label).eqNullSafe(F.col("_label")), "left")
    return joined.select(id_column, label, "code", "error", F.expr("try_cast(_total as bigint)").alias("label_error"), F.lit(model.sha256()).alias("codebooks_sha256"))
