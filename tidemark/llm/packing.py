"""Best-fit packing of token pieces by minimum bin slack.

Each sequence starts with the longest piece left; a subset-sum dynamic program
over the lengths still in stock finds the fullest combination beside it, which is
removed.  The program sees counts by length, so its size is set by ``max_tokens``
and not by the corpus, and one combination is taken as often as the stock allows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, partitions, released

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Entries of a cache, which only saves time; a full one becomes the old one, from which what is used again comes back.
CACHED = 120_000


#: Below it, every code point has a name and none is a combining mark.
FIRST_MARK = 0x300


def _unsure_points() -> np.ndarray:
    """Of each code point: 1 if it is a combining mark, 2 if this Python does not name it."""
    kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
    return np.fromiter((1 if k[0] == "M" else 2 if k == "Cn" else 0 for k in kinds), np.uint8, 0x110000)


class WordTokens(dict):
    """Ids of white-space chunks as little-endian bytes, by the tokenizer's own model.

    A tokenizer whose normalizer and pre-split are those below drops white space and never
    merges across it, so a text's ids are those of its chunks, once it is in lower case.  A
    text that holds an added token, a code point that Python does not name, or two combining
    marks in a row goes to the tokenizer whole, and so does any text if the file says otherwise.
    """

    #: The normalizer and pre-split (fixed values of the tokenizer's file) that chunks stand for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        self.by_chunk = parts["normalizer"] == self.NORMALIZER and parts["pre_tokenizer"] == self.SPLIT and parts["model"]["type"] == "BPE"
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(added)) if added else None
        self.split = regex.compile(self.PATTERN).findall
        # Code points without a name here may have one in the tokenizer's tables, and marks in a row another order.
        self.points = _unsure_points()
        self.split_ascii = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.spelled(chunk)
        if len(chunk) <= 40:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def spelled(self, chunk: str) -> bytes:
        if chunk.isascii():
            words = [chunk] if chunk.isalpha() else self.split_ascii(chunk)
        else:
            words = self.split(chunk)
        # A chunk of one word is kept as the chunk alone.
        return b"".join([self.words.get(w) or self.word(w) for w in words]) if len(words) != 1 else self.word(words[0], False)

    def word(self, word: str, keep: bool = True) -> bytes:
        found = self.words.get(word) or self.old_words.get(word)
        if not found:
            spelled = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.model.tokenize(spelled)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if keep:
            if len(self.words) >= CACHED:
                self.old_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def forget(self) -> None:
        self.old, self.old_words = {}, {}

    def unsure(self, text: str) -> bool:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max() < FIRST_MARK:
            return False
        kind = self.points[points]
        return bool((kind == 2).any() or (kind[1:] & kind[:-1] & 1).any())

    def ids(self, text: str) -> bytes:
        # Only the lower case of a sigma depends on what stands beside it.
        if not self.by_chunk or "Σ" in text or (self.added and self.added.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not text.isascii():
            if self.unsure(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(ids)}I", *ids)
            text = unicodedata.normalize("NFC", text)
        return b"".join([self[c] for c in text.lower().replace("\n", " ").split(" ")])


_tokenizers: dict[str, WordTokens] = {}


def _cut(text: str, words: WordTokens, seen: dict[bytes, list[tuple[int, int]]], max_tokens: int) -> list[tuple[int, int]]:
    """(length, CRC) of each piece."""
    key = hashlib.blake2b(text.encode(), digest_size=16).digest()
    if key not in seen:
        ids = words.ids(text) + struct.pack("<I", END_ID)
        if len(seen) >= CACHED:
            seen.clear()
        seen[key] = [(len(p) // 4, zlib.crc32(p)) for i in range(0, len(ids), 4 * max_tokens) if (p := ids[i : i + 4 * max_tokens])]
    return seen[key]


def token_pieces(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokens(tokenizer_path)
        words, seen = _tokenizers[tokenizer_path], {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = 0
                for piece, (length, crc) in enumerate(_cut(text.as_py() or "", words, seen, max_tokens)):
                    rows.append((doc_id, piece, start, length, crc))
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        words.forget()  # the worker process lives on

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), PIECES)


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest piece in stock with the fullest feasible combination beside it."""
    largest = int(np.flatnonzero(counts)[-1])
    stock = counts.copy()
    stock[largest] -= 1
    room = capacity - largest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(stock[: room + 1])[::-1].tolist():
        left, size = int(min(stock[length], room // length)), 1
        while left and not reach >> room & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    chosen, at = {largest: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_sequences(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: length, first rank, how many, first sequence, offset.

    The i-th piece of a segment lies in the i-th sequence after the first.  There are
    at most a few segments per length and combination, however large the counts are.
    """
    stock = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        stock[length] += count
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    while stock.any():
        chosen = fullest(stock, capacity)
        times = min(int(stock[length]) // n for length, n in chosen.items())
        offset = 0
        for length, n in chosen.items():
            for _ in range(n):
                rows.append((length, int(used[length]), times, sequence, offset))
                used[length] += times
                offset += length
            stock[length] -= n * times
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "times", "sequence", "offset"]).astype("int64").sort_values(["length", "rank"])


def pack(pieces: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """Give every piece a sequence and an offset.

    ``pieces`` has the columns of :func:`token_pieces`.  Equal rows are packed one by
    one; an empty table gives no rows.  Ranks within a length are numbered in two
    levels (hash bucket, then place), so one frequent length never meets in one task.
    """
    buckets = 4 * partitions(pieces.sparkSession)
    kept = materialise(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    held = kept.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    #: At most max_tokens rows.
    plan = plan_sequences({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("held").alias("n")).collect()}, max_tokens)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = kept.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("rank"))
    keys = plan["length"].to_numpy() << 44 | plan["rank"].to_numpy()
    base, first, offset = (plan[c].to_numpy() for c in ("rank", "sequence", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank - base[at]), pa.array(offset[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(released(run), PACKED)


def pack_documents(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    Null text is empty: its piece is the end id alone.  Documents of more than
    ``max_tokens`` ids are cut; repeated rows and null ids are packed row by row.  An empty
    table gives no rows.  Other columns are left alone.
    """
    return pack(token_pieces(df, tokenizer_path, max_tokens, id_col, text_col), max_tokens)
