"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match at any
place of a document.  Parsing a document greedily into such matches takes few phrases
in its own language and many in others.  A longer model has longer matches by chance alone,
in proportion to the logarithm of its length, so phrases are normalised by it (and by the
document's letters, which are the same for all): the language with the least entropy,
phrases times log2 of model letters over letters, wins.

The automata are kept as sparse tables whose rows are laid over each other, and stepped
over many blocks of letters at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import code_points, released, text_chunks

#: Labelled documents and letters of text that a language's model is built from at most, and the sizes that come first.
MODEL_DOCS, MODEL_LETTERS, MODEL_BYTES = 60, 16_000, (200, 4000)
#: A phrase ends at each multiple of so many letters of a document: this is part of its definition.
BLOCK = 2048
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for anything else."""
    lower = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            small = chr(point).lower()
            lower[point] = ord(small) if len(small) == 1 else point
    return lower


def normalised(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space (code 32) for each run of others, and offsets.

    A document does not begin with a space.
    """
    points, at = code_points(offsets, body)
    small = _letters()[points]
    keep = small > 0
    before = np.r_[False, keep[:-1]]
    before[at[:-1][at[:-1] < len(before)]] = False
    keep |= before
    return np.where(small > 0, small, 32)[keep], np.cumsum(np.r_[0, keep])[at]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text`` by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for code in text:
        state = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if size[to] == size[at] + 1:
                link[state] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
    return moves


def displaced(moves: list[dict[int, int]], width: int, spare: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a sparse table laid over each other: place by state, and slots.

    The move of the state placed at p by code c stands at slot p + c, if p is in the slot's
    upper half; its lower half is the place of the next state.  No two states share a place.
    The number of slots follows from the number of moves (at most three a letter of the
    model) and the alphabet, not from their product.  Rows of many moves are placed first.
    """
    spread = 1 << (spare * sum(map(len, moves))).bit_length()
    place, used, taken = [0] * len(moves), bytearray(spread + width), bytearray(spread)
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        tries = (at % spread for at in range(state * 2654435761, state * 2654435761 + 40503 * spread, 40503))
        at = next((at for at in tries if not taken[at] and not any(used[at + code] for code in moves[state])), -1)
        if at < 0:  # no gaps fit this row
            return displaced(moves, width, spare * 2)
        place[state] = at
        taken[at] = 1
        for code in moves[state]:
            used[at + code] = 1
    slots = np.full(spread + width, -1, np.int64)
    for state, out in enumerate(moves):
        for code, to in out.items():
            slots[place[state] + code] = place[state] << 32 | place[to]
    return np.array(place, np.int64), slots


class Parser:
    """Counts the phrases of documents under each language's model; memory grows with the models' letters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        #: What one phrase costs by each model.
        self.bits = np.log2([len(samples[name]) + 1 for name in self.languages])
        alphabet = sorted({ord(c) for text in samples.values() for c in text})
        #: Code of each point; the last code is for letters that no model has seen.
        self.code = np.full(0x110000, len(alphabet), np.int32)
        self.code[alphabet] = np.arange(len(alphabet))
        width = len(alphabet) + 1
        #: By language: the root's place, and the place after a phrase's first letter (the root: the model lacks it).
        self.roots = np.zeros((len(self.languages), 1), np.int64)
        self.begins = np.zeros((len(self.languages), width), np.int64)
        slots, size = [], 0
        for k, name in enumerate(self.languages):
            moves = suffix_automaton(self.code[[ord(c) for c in samples[name]]].tolist())
            place, own = displaced(moves, width)
            self.roots[k] = self.begins[k] = place[0] + size
            self.begins[k, list(moves[0])] = place[list(moves[0].values())] + size
            slots.append(np.where(own < 0, -1, own + (size << 32 | size)))
            size += len(own)
        self.slots = np.concatenate(slots) if slots else np.zeros(0, np.int64)

    def phrases(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases by document and language."""
        n_docs = len(offsets) - 1
        blocks = -(-np.diff(offsets) // BLOCK)
        owner = np.repeat(np.arange(n_docs), blocks)
        first = offsets[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(offsets[owner + 1] - first, BLOCK)
        order = np.argsort(-size, kind="stable")
        first, size, owner = first[order], size[order], owner[order]
        codes = self.code[points]
        state = np.repeat(self.roots, len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        # Blocks that have a letter at each step.
        for step, live in enumerate(np.cumsum(np.bincount(size)[::-1])[::-1][1:] if len(size) else []):
            code, at = codes[first[:live] + step], state[:, :live]
            slot = self.slots[at + code]
            begin = self.begins[:, code]
            # A letter that does not extend the phrase ends it; one the model lacks is a phrase of its own.
            over = slot >> 32 != at
            count[:, :live] += over & (at != self.roots)
            count[:, :live] += over & (begin == self.roots)
            state[:, :live] = np.where(over, begin, slot & 0xFFFFFFFF)
        count += state != self.roots
        return np.stack([np.bincount(owner, weights=c, minlength=n_docs) for c in count], axis=1).astype(np.int64) if len(count) else np.zeros((n_docs, 0), np.int64)


def learn(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text of each language: the first MODEL_LETTERS letters of at most MODEL_DOCS documents.

    Documents outside ``held_out`` come by hash of the id, those of usual size
    (MODEL_BYTES) first, then longer and then shorter ones, so that a language of long or
    of short documents alone is learned too.  No more than MODEL_LETTERS characters of
    any document are of use, and only those are fetched.
    """
    text, size = F.col(text_col), F.octet_length(text_col)
    known = df.filter(F.col(lang_col).isNotNull() & (size > 0) & F.col(id_col).isNotNull() & ~held_out)
    kind = F.when(size < MODEL_BYTES[0], 2).when(size <= MODEL_BYTES[1], 0).otherwise(1)
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.substring(text, 1, MODEL_LETTERS).alias("text"), kind.alias("kind"), F.xxhash64(F.col(id_col), text).alias("draw"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("kind", "draw", "text"))).filter(F.col("place") <= MODEL_DOCS)
    samples: dict[str, list[np.ndarray]] = {}
    for row in first.orderBy("lang", "place").collect():  # MODEL_DOCS a language
        body = np.frombuffer(row["text"].encode(), np.uint8)
        samples.setdefault(row["lang"], []).append(normalised(np.array([0, len(body)]), body)[0])
    joined = {lang: np.concatenate([np.r_[p, 32] for p in parts])[:MODEL_LETTERS] for lang, parts in samples.items()}
    return {lang: "".join(map(chr, points)) for lang, points in joined.items() if (points != 32).any()}


_parsers: dict[int, Parser] = {}


def identify(df: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (replaced if they exist).

    Null text, text without letters, and any text if nothing was learned: ``und`` and 0.
    The score is the share of the winner among the inverse entropies; ties go to the
    smallest name.  Long texts are parsed whole, in blocks of BLOCK letters.
    """
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = df.select(*[F.col(f"`{c}`") for c in names], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(samples)
        parser = _parsers[key]
        for part, offsets, body in text_chunks(batches, text_col, 4 << 20):
            points, bounds = normalised(offsets, body)
            if parser.languages:
                cost = np.maximum(parser.phrases(points, bounds), 1) * parser.bits
                best = cost.argmin(axis=1)
                share = (1 / cost).max(axis=1) / (1 / cost).sum(axis=1)
                some = np.diff(bounds) > 0
                lang = np.where(some, np.array(parser.languages, object)[best], UNKNOWN)
                value = np.where(some, share, 0.0)
            else:
                lang, value = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(value)], names=[*names, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(released(run), schema)
