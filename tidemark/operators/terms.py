"""Which lists of terms a text holds: one automaton over all terms, one pass over each text.

A term counts wherever it stands, also inside a longer word.  Lists are parameters: name to
terms; a term may stand in several.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lists = Mapping[str, Sequence[str]]


@lru_cache(8)
def _automaton(lists: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """The automaton, whose hits are numbers of terms, and the lists that each term stands in."""
    terms = sorted({t.lower() for _, own in lists for t in own if t})
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, k)
    found.make_automaton()
    member = np.array([[term in {t.lower() for t in own} for _, own in lists] for term in terms], bool).reshape(len(terms), len(lists))
    return found, member


def flagged(df: DataFrame, lists: Lists, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with one boolean column per list, and ``count``, how many different terms the text holds.

    Columns of these names are replaced.  Texts are read whole and in lower case, as are the
    terms.  A null or empty text, an empty list and empty terms make no hit.  No shuffle; a task
    holds one Arrow batch of texts.
    """
    key = tuple((name, tuple(terms)) for name, terms in lists.items())
    new = [*lists, *([count] if count else [])]
    kept = [c for c in df.columns if c not in new or c == text]
    if text in new:
        raise ValueError(f"{text} cannot be both the text and a result")
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(True).alias(c) for c in lists], *([F.lit(0).alias(count)] if count else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, member = _automaton(key)
        for batch in batches:
            hits, sizes = np.zeros((batch.num_rows, len(key)), bool), np.zeros(batch.num_rows, np.int32)
            if len(member):
                for row, value in enumerate(batch.column(kept.index(text))):
                    held = {k for _, k in automaton.iter((value.as_py() or "").lower())}
                    sizes[row] = len(held)
                    hits[row] = member[list(held)].any(axis=0)
            columns = [*batch.columns, *(pa.array(hits[:, k]) for k in range(len(key))), *([pa.array(sizes)] if count else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def first_of(cases: Sequence[tuple[str, object]], default) -> Column:
    """The value of the first flag that is set."""
    out = F.lit(default)
    for flag, value in reversed(cases):
        out = F.when(F.col(flag), F.lit(value)).otherwise(out)
    return out
