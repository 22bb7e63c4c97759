"""Exact removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id.

1. *Anchors.*  In each window of ``length`` bytes the K-byte string with the smallest
   polynomial hash is its anchor (the rightmost of ties).  Equal windows have equal
   anchors at equal places, so only suffixes at equal anchors need comparing.  An anchor
   stands for its windows, which together are one fragment of text.
2. *Meeting.*  Hashes of anchor and fragment, dealt by anchor, tell which fragments occur
   whole in a smaller document (all their windows go) and which anchors occur with
   different fragments; only those need their text.
3. *Suffix sort.*  The fragments of such anchors are sorted as suffixes from the anchor, by
   a mergesort whose comparisons find the common extension by binary search over prefix
   hashes.  Runs of suffixes that agree far enough, with equal bytes before the anchor, are
   equal windows.  All equalities found by hash are verified on the bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _ODD, _powers, chunks, materialise, mix, released, text_chunks, utf8

#: Bytes of an anchor: longer ones are met by chance less often, but stand closer together.
K = 24
#: Anchors that a map task gathers before it sends them on; equal fragments among them are sent once.
FLUSH = 1 << 20
#: Anchors that one bucket holds on average.
BUCKET = 400_000
#: Text handled at once by the anchor kernel, so that its arrays stay in the cache.
SLICE_BYTES = 256 << 10


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers; differences of two give the hash of any substring."""
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(len(body))[0], out=total[1:])
    return total


def substring_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * _powers(len(total))[1][start])


def anchors(offsets: np.ndarray, body: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, fragment hash, document, first and last window start, and anchor place."""
    n = len(body)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    total = prefix_hashes(body)
    inverse = _powers(n + 1)[1]
    grams = mix((total[k:] - total[:-k]) * inverse[: n - k + 1])
    places = n.bit_length()
    mask = np.uint64((1 << places) - 1)
    least = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    width, step = length - k + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    whole = np.ones(len(least), bool)
    for end in offsets[1:-1].tolist():
        whole[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(whole)
    if not len(start):
        return anchors(offsets[:1], body[:0], length, k)
    place = (mask - (least[start] & mask)).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]]
    place = place[np.r_[0, cut]]
    shape = ((last - first) * 1024 + (place - first)).astype(np.uint64)
    fragment = mix(substring_hash(total, first, last + length) + shape * _ODD)
    return grams[place], fragment, np.searchsorted(offsets, first, "right") - 1, first, last, place


def _narrow(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _widen(data: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(n, size)
    return out.view("<u8").reshape(n)


#: Bytes kept of anchor hash, fragment hash, document, first start, last - first, place - first.
_SIZES = (5, 7, 8, 4, 2, 2)


def encode(columns: tuple[np.ndarray, ...]) -> bytes:
    return struct.pack("<I", len(columns[0])) + b"".join(_narrow(c, s) for c, s in zip(columns, _SIZES, strict=True))


def decode(blobs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        (n,), at, columns = struct.unpack_from("<I", blob), 4, []
        for size in _SIZES:
            columns.append(_widen(blob[at : at + n * size], n, size))
            at += n * size
        parts.append(columns)
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * len(_SIZES)


def _by_bucket(buckets: np.ndarray, columns: tuple[np.ndarray, ...], kind: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[order], [c[order] for c in columns]
    cut = [*np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]).tolist(), len(buckets)]
    blobs = [encode([c[a:b] for c in columns]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(buckets[cut[:-1]], pa.int64()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _send(rows: list[tuple[np.ndarray, ...]], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket, equal fragments once for the smallest document; spans already known."""
    gram, fragment, doc, first, last, place = (np.concatenate(c) for c in zip(*rows, strict=True))
    gram, fragment = gram & np.uint64((1 << 40) - 1), fragment & np.uint64((1 << 56) - 1)
    order = np.lexsort((doc, fragment, gram))
    gram, fragment, doc, first, last, place = (c[order] for c in (gram, fragment, doc, first, last, place))
    group = np.cumsum(np.r_[True, (gram[1:] != gram[:-1]) | (fragment[1:] != fragment[:-1])]) - 1
    smallest = doc[np.r_[0, np.flatnonzero(np.diff(group)) + 1]][group]
    known = doc > smallest
    columns = (gram, fragment, doc, first, last - first, place - first)
    yield from _by_bucket((gram[~known] % np.uint64(buckets)).astype(np.int64), tuple(c[~known] for c in columns), 0)
    if known.any():
        spans = merged(doc[known], first[known], last[known] + length)
        zero = np.zeros(len(spans[0]), np.int64)
        yield from _by_bucket((mix(spans[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), (zero, spans[2] - spans[1], spans[0], spans[1], zero, zero), 1)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans joined where they touch or overlap within a document; overlaps of windows suffice."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new = np.r_[True, doc[1:] != doc[:-1]]
    base = np.cumsum(new) * (1 << 40)
    reach = np.maximum.accumulate(base + end)
    cut = np.flatnonzero(np.r_[True, (base + start)[1:] > reach[:-1]])
    return doc[cut], start[cut], (reach - base)[np.r_[cut[1:] - 1, len(doc) - 1]]


FOUND = "doc long, edge boolean, start long, last long, place long"


def _found(doc, edge, start, last, place) -> pa.Table:
    return pa.table({"doc": pa.array(doc.astype(np.int64)), "edge": pa.array(edge), "start": pa.array(start.astype(np.int64)), "last": pa.array(last.astype(np.int64)), "place": pa.array(place.astype(np.int64))})


def _meet(table: pa.Table, length: int) -> pa.Table:
    """Of one bucket: spans that a smaller document holds, and anchors whose fragments differ."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
    spans = decode([b for k, b in zip(kind, blobs, strict=True) if k == 1])
    gram, fragment, doc, first, more, place = decode([b for k, b in zip(kind, blobs, strict=True) if k == 0])
    doc = doc.view(np.int64)
    order = np.lexsort((doc, fragment, gram))
    gram, fragment, doc, first, more, place = (c[order] for c in (gram, fragment, doc, first, more, place))
    parts = [_found(spans[2], np.zeros(len(spans[0]), bool), spans[3], spans[3] + spans[1] - np.uint64(length), spans[3])]
    if len(gram):
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (fragment[1:] != fragment[:-1])]
        group, of = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        smallest = doc[new][group]
        heads = of[new]
        low, high = np.minimum.reduceat(doc, np.flatnonzero(new_gram)), np.full(of[-1] + 1, np.iinfo(np.int64).min)
        np.maximum.at(high, heads, doc[new])
        whole = doc > smallest
        edge = ~whole & (np.bincount(heads)[of] > 1) & (high > low)[of]
        keep = whole | edge
        parts.append(_found(doc[keep], edge[keep], first[keep], first[keep] + more[keep], first[keep] + place[keep]))
    return pa.concat_tables(parts)


class Suffixes:
    """Suffixes of a buffer of fragments, sorted on at most ``length`` bytes from each start."""

    def __init__(self, body: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.body = np.r_[body, np.zeros(1, np.uint8)]
        self.start, self.size = start, size
        self.total = prefix_hashes(body)
        self.inverse = _powers(len(body) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search on hashes."""
        x, y = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        u, v, p, q = self.total[x], self.total[y], self.inverse[x], self.inverse[y]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.total[x + mid] - u) * p == (self.total[y + mid] - v) * q
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; of equal ones neither does."""
        n = self.common(a, b)
        ends_a, ends_b = n >= self.size[a], n >= self.size[b]
        return ~ends_b & (ends_a | (self.body[self.start[a] + n] < self.body[self.start[b] + n]))

    def sort(self, order: np.ndarray) -> np.ndarray:
        """Mergesort: all pairs of runs of a level merge at once, each suffix finding its rank in the other run."""
        n, run = len(order), 1
        while run < n:
            at = np.arange(n)
            left = at // run % 2 == 0
            other = np.minimum(np.where(left, (at // run + 1) * run, (at // run - 1) * run), n)
            low, high = other.copy(), np.minimum(other + run, n)
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                mine, theirs = order[live], order[mid]
                # Stable: of equals, the left run comes first.
                goes = np.where(left[live], self.before(theirs, mine), ~self.before(mine, theirs))
                low[live], high[live] = np.where(goes, mid + 1, low[live]), np.where(goes, high[live], mid)
            into = np.where(left, at, at - run) + (low - other)
            merged_order = np.empty_like(order)
            merged_order[into] = order
            order, run = merged_order, run * 2
        return order

    def verified(self, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The order, and common lengths of neighbours from the bytes; sorted by bytes if a hash misled."""
        rows = self.body[np.minimum(self.start[order, None] + np.arange(width), len(self.body) - 1)].astype(np.int16)
        rows[np.arange(width) >= self.size[order, None]] = -1
        unlike = rows[1:] != rows[:-1]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        at = np.flatnonzero(common < width)
        if (rows[at, common[at]] > rows[at + 1, common[at]]).any():
            again = np.lexsort(rows.T[::-1])
            return self.verified(order[again], width)
        return order, common


def _resolve(table: pa.Table, length: int, k: int) -> pa.Table:
    """Of one bucket of fragments: windows that occur in a smaller document."""
    doc, start, last, place = (table.column(c).to_numpy() for c in ("doc", "start", "last", "place"))
    offsets, body = utf8(table.column("fragment"))
    offsets = offsets[:-1]
    anchor = offsets + place - start
    ends = offsets + last - start + length
    suffixes = Suffixes(body, anchor, np.minimum(ends - anchor, length))
    order, common = suffixes.verified(suffixes.sort(np.argsort(substring_hash(suffixes.total, anchor, anchor + k), kind="stable")), length)
    docs, spans = doc[order], []
    for back in range(length - k + 1):
        at = place[order] - back
        takes = np.flatnonzero((at >= start[order]) & (at <= last[order]))
        if len(takes) < 2:
            continue
        run = np.cumsum(np.r_[True, common < length - back])[takes]
        mine = order[takes]
        left = substring_hash(suffixes.total, anchor[mine] - back, anchor[mine])
        by = np.lexsort((docs[takes], left, run))
        run, left, d, mine = run[by], left[by], docs[takes][by], mine[by]
        new = np.r_[True, (run[1:] != run[:-1]) | (left[1:] != left[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.flatnonzero(d > d[head])
        if not len(again):
            continue
        window = (anchor[mine[again]] - back)[:, None] + np.arange(length)
        origin = (anchor[mine[head[again]]] - back)[:, None] + np.arange(length)
        again = again[(body[window] == body[origin]).all(axis=1)]
        spans.append((d[again], place[mine[again]] - back))
    if spans:
        d, s = (np.concatenate(c) for c in zip(*spans, strict=True))
    else:
        d = s = np.zeros(0, np.int64)
    d, s, e = merged(d, s, s + length)
    return pa.table({"doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64())})


REMOVED = "n_bytes long, spans array<struct<start: long, end: long>>"


def repeated_spans(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text and spans: the maximal runs of bytes of each row to remove, as [start, end).

    Null text is empty; rows with null ids are left whole and are no source of others;
    rows that share an id count as one document and must hold the same text.  An empty
    table gives no rows.  Offsets are in UTF-8 bytes.
    """
    if length < k + 8:
        k = max(1, length // 2)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(2 * size / (length - k + 2) / BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part, offsets, body in text_chunks(batches, limit=SLICE_BYTES):
            ids = part.column(0).to_numpy()
            gram, fragment, doc, first, last, place = anchors(offsets, body, length, k)
            if len(gram):
                base = offsets[doc]
                rows.append((gram, fragment, ids[doc], first - base, last - base, place - base))
                held += len(gram)
            if held >= FLUSH:
                yield from _send(rows, buckets, length)
                rows, held = [], 0
        if rows:
            yield from _send(rows, buckets, length)

    sent = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).mapInArrow(released(send), "bucket long, kind int, blob binary")
    found = materialise(sent.groupBy("bucket").applyInArrow(lambda t: _meet(t, length), FOUND))

    edges = found.filter("edge").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "last", "place")).alias("edges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_offsets, body = utf8(batch.column(1))
            for a, b in chunks(text_offsets):
                part = batch.slice(a, b - a).column(2)
                places = part.flatten()
                base = np.repeat(text_offsets[a:b], np.diff(part.offsets.to_numpy()))
                ids = np.repeat(batch.column(0).to_numpy()[a:b], np.diff(part.offsets.to_numpy()))
                start, last, place = (places.field(i).to_numpy() for i in range(3))
                n = last - start + length
                at = np.cumsum(np.r_[0, n])
                copied = body[np.repeat(base + start - at[:-1], n) + np.arange(at[-1])]
                gram = substring_hash(prefix_hashes(copied), at[:-1] + place - start, at[:-1] + place - start + k) & np.uint64((1 << 40) - 1)
                fragments = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(copied)])
                yield pa.RecordBatch.from_arrays([pa.array((gram % np.uint64(buckets)).astype(np.int64)), pa.array(ids), pa.array(start), pa.array(last), pa.array(place), fragments], names=["bucket", "doc", "start", "last", "place", "fragment"])

    fragments = docs.join(edges, "doc_id").select("doc_id", "text", "edges").mapInArrow(released(cut), "bucket long, doc long, start long, last long, place long, fragment binary")
    resolved = fragments.groupBy("bucket").applyInArrow(lambda t: _resolve(t, length, k), "doc long, start long, end long")
    whole = found.filter("not edge").select("doc", "start", (F.col("last") + length).alias("end"))
    spans = whole.unionByName(resolved).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(spans, "doc_id", "left")


def removal_report(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the rows of :func:`repeated_spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = utf8(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2)):
                text = body[offsets[i] : offsets[i + 1]]
                keep = kept(text, spans)
                rows.append((len(text), len(text) - len(keep[0]), keep[1], hashlib.sha256(keep[0]).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept(text: np.ndarray, spans: pa.ListScalar) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs of removed bytes."""
    if not spans.is_valid:
        return text.tobytes(), 0
    start, end = (np.minimum(spans.values.field(i).to_numpy(), len(text)) for i in (0, 1))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return text[~gone].tobytes(), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
