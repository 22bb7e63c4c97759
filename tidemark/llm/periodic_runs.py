"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` words and
``EXPONENT`` periods, that no neighbouring word extends.  All work is on one document, so the
job is one pass over the texts without a shuffle, and a lost task is only run again.

For each scale t = 1, 2, 4, ... the periods from t to 2 t - 1 are sought:

1. Every stretch of t words has a name: names of length 2 t are hashed from two of length t.
2. A position is *highly periodic* if the t words from it have a period of at most t / 4; these
   are the runs that smaller scales have found, so they supply the periods omitted here.
3. Position i is *synchronising* if the least name of the other positions from i to i + t stands
   at i or at i + t.  That depends on the 2 t words from i only, hence equal contexts are chosen
   alike, and t positions in a row have a chosen one unless they are highly periodic.
4. A synchronising position and the next one with equal 2 t words, at most 2 t - 1 apart,
   propose their distance as a period.  Inside a run of period q and at least four periods some
   position i and i + q are both chosen, and none between has the same context.
5. Proposals that overlap are one run, which is extended word by word in growing blocks.

Words are numbered by a dictionary and each run is compared word by word; hashes only propose.

Defined results: null and empty texts have no words and no run; a null id is not unrolled by
``planted``; repeated rows give repeated rows; other columns are kept as they are, and columns
named like those added are replaced.  A task holds the words of one chunk of texts, or of one
longer text, and arrays of a few numbers a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mix, released, text_chunks

#: A run has at least this many periods; the scales above rest on four.
EXPONENT = 4
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    out, have = names, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _stretch(ids: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The whole stretch around [start, end) whose words q apart are identical."""
    size = 16
    while start > 0:
        low = max(0, start - size)
        other = np.flatnonzero(ids[low:start] != ids[low + q : start + q])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, size = low, 2 * size
    size = 16
    while end < len(ids):
        high = min(len(ids), end + size)
        other = np.flatnonzero(ids[end:high] != ids[end - q : high - q])
        if len(other):
            end += int(other[0])
            break
        end, size = high, 2 * size
    return start, end


def _scale(ids: np.ndarray, names: np.ndarray, t: int, periodic: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) with t <= period < 2 t; names are those of t words from each position."""
    n = len(ids) - 2 * t + 1
    if n <= t:
        return []
    named = np.where(periodic[: len(names)], _LAST, names)
    least = _least(named, t + 1)[:n]
    chosen = np.flatnonzero((least != _LAST) & ((least == named[:n]) | (least == named[t : t + n])))
    context = mix(names[chosen] * _ODD + mix(names[chosen + t] + _ODD))
    order = np.lexsort((chosen, context))
    a, b = chosen[order[:-1]], chosen[order[1:]]
    apart = b - a
    near = np.flatnonzero((context[order[:-1]] == context[order[1:]]) & (apart >= t) & (apart < 2 * t))
    if not len(near):
        return []
    at, q = a[near], apart[near]
    order = np.lexsort((at, q))
    found, reached = [], {}
    for start, period in zip(at[order].tolist(), q[order].tolist(), strict=True):
        if start + period + 2 * t <= reached.get(period, 0):
            continue
        end = start + period + 2 * t
        if not np.array_equal(ids[start : end - period], ids[start + period : end]):
            continue
        start, end = _stretch(ids, start, end, period)
        reached[period] = end
        if end - start >= EXPONENT * period:
            found.append((start, end - start, period))
    return found


def find_runs(numbers: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Of each array of numbers, all runs (start, length, period) of at least ``EXPONENT`` periods, by start and period.

    A scale takes all arrays that are long enough for it, end to end, with a mark after each.
    """
    lengths = np.array([len(x) for x in numbers], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
    t = 1
    while True:
        live = np.flatnonzero(lengths >= EXPONENT * t)
        if not len(live):
            return [sorted(set(x)) for x in out]
        if t == 1:
            begins = np.r_[0, np.cumsum(lengths[live] + 1)]
            ids = np.full(begins[-1], -1, np.int64)
            for k, i in enumerate(live.tolist()):
                ids[begins[k] : begins[k] + lengths[i]] = numbers[i]
            ids[begins[1:] - 1] = -1 - np.arange(len(live))
            names, held = mix(ids.astype(np.uint64) * _ODD + np.uint64(1)), live
        elif len(live) < len(held):
            keep = np.repeat(np.isin(held, live), lengths[held] + 1)
            ids, names, held = ids[keep], names[keep[: len(names)]], live
            begins = np.r_[0, np.cumsum(lengths[live] + 1)]
            names = names[: max(0, len(ids) - t + 1)]
        edge = np.zeros(len(ids) + 1, np.int64)
        for k, i in enumerate(held.tolist()):
            for start, length, period in out[i]:
                if 4 * period <= t <= length:
                    edge[begins[k] + start] += 1
                    edge[begins[k] + start + length - t + 1] -= 1
        for start, length, period in _scale(ids, names, t, np.cumsum(edge[:-1]) > 0):
            k = int(np.searchsorted(begins, start, "right")) - 1
            out[held[k]].append((start - int(begins[k]), length, period))
        names = mix(names[:-t] * _ODD + mix(names[t:] + _ODD))
        t *= 2


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by the CRC of the id's digits, made periodic from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _keep(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def collapse_runs(docs: DataFrame, least: int = 6, unroll: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with the number of words, the runs, and the words left once each run keeps one period.

    Words are those between the white space of ASCII.  ``unroll`` (doc_id, words) may give other
    words in place of the text's.
    """
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    kept = docs.select(*names)
    added = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, body in text_chunks(batches):
            raw, known, words, numbers = body.tobytes(), {}, [], []
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            for k, doc_id in enumerate(ids):
                mine = raw[offsets[k] : offsets[k + 1]].split()
                mine = unroll(doc_id, mine) if unroll else mine
                words.append(mine)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in mine), np.int64, len(mine)))
            found = [[r for r in runs if r[1] >= max(least, EXPONENT * r[2])] for runs in find_runs(numbers)]
            texts = []
            for mine, runs in zip(words, found, strict=True):
                left = [mine[i] for i in np.flatnonzero(_keep(len(mine), runs)).tolist()] if runs else mine
                texts.append(b" ".join(left).decode("utf-8"))
            extra = [
                pa.array([len(mine) for mine in words], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], added.field("runs").type),
                pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], schema=pa.schema([*rows.schema, *added]))

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(ADDED).fields]))


def run_report(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest one, and digests of the runs and of the words left."""
    best = F.element_at(F.expr("array_sort(runs, (a, b) -> case when a.length <> b.length then int(sign(b.length - a.length)) when a.start <> b.start then int(sign(a.start - b.start)) else int(sign(a.period - b.period)) end)"), 1)
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    first = F.when(F.size("runs") > 0, best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), first["start"].alias("start"), first["length"].alias("length"), first["period"].alias("period"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))
