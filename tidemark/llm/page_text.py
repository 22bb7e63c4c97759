"""Main text of web pages by differencing pages with neighbouring URLs.

Pages of a host that stand side by side in the order of their URL paths mostly come from one
template.  Each page is aligned, by a longest common subsequence of its text lines, with the page
before and the page after it; lines shared with either are the template's and are deleted.

Markup tells what alignment can't: menus, adverts and the like that differ from page to page are
left out by element and by class (``markup``).  Where an element says which lines are the article,
the page's text is these lines; a paragraph that recurs there (a licence, a quotation, a copied
text) stays, and only boxes within the article (share bars, subscription notices) go, if *all*
their lines are shared.  Without such markup every shared line goes.

Two pages that are copies of each other tell nothing about the template: those whose article
lines are shared for more than half of the shorter, or, without article markup, for more than
19 of 20 characters of either.

Texts stay where they are: a first pass tells, of each page, 64-bit hashes of its lines with their
sizes and places.  These are dealt in ranges of (host, path, page_id), so that a large host is
spread over as many tasks as its share asks for, and each task holds two neighbouring pages at a
time.  The first and the last page of each task meet their neighbours of the next task in a second,
small step; results do not depend on how pages are dealt.  Only pages that lose lines are told to
the last pass, which makes the texts: by broadcast up to ``BROADCAST_ROWS``, by a shuffle beyond.

Defined results: null or empty html gives an empty text; a null url, or one without a host, has no
neighbours; rows repeated whole are copies of each other, each gives a row, and they lose the lines
that any of them loses; page_id null sorts first; other columns are left out unless asked for by
``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import markup
from tidemark.llm.common import Scratch, materialise, released, small

#: Bits of alignment rows held at once; longer alignments are halved until they fit.
HELD_BITS = 1 << 27

Aligned = tuple[list[int], list[int]]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """For each prefix of b, the bits of a: 0 where one more line of a makes the common subsequence longer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, out = full, []
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
        out.append(row)
    return out


def _steps(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of b with each prefix of a."""
    row = (1 << len(a)) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(a) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(bits == 0)]


def common_lines(a: list[int], b: list[int]) -> Aligned:
    """Places in a and in b of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    p, q = _aligned([a[i] for i in x], [b[j] for j in y])
    ends = range(tail, 0, -1)
    return [*range(head), *(x[i] for i in p), *(len(a) - k for k in ends)], [*range(head), *(y[j] for j in q), *(len(b) - k for k in ends)]


def _aligned(a: list[int], b: list[int]) -> Aligned:
    if not a or not b:
        return [], []
    if len(a) * len(b) > HELD_BITS and len(b) > 1:
        half = len(b) // 2
        whole = _steps(a, b[:half]) + _steps(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(whole))
        p, q = _aligned(a[:cut], b[:half])
        r, s = _aligned(a[cut:], b[half:])
        return [*p, *(cut + i for i in r)], [*q, *(half + j for j in s)]
    rows = _rows(a, b)
    i, j, p, q = len(a), len(b), [], []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            p.append(i)
            q.append(j)
    return p[::-1], q[::-1]


@dataclass
class Outline:
    """A page's lines: hash of each, number of characters, rank, and boxes (``markup.Line``)."""

    hashes: list[int]
    sizes: list[int]
    ranks: list[int]
    inside: list[list[int]]

    def best(self) -> int:
        return max(self.ranks, default=0)

    def is_copy(self, shared: set[int]) -> bool:
        """Whether the lines shared with another page make the two copies."""
        best = self.best()
        sizes = {i: n for i, (n, rank) in enumerate(zip(self.sizes, self.ranks, strict=True)) if rank == best}
        both, whole = sum(n for i, n in sizes.items() if i in shared), sum(sizes.values())
        return 2 * both > whole if best else 20 * (whole - both) < whole

    def dropped(self, shared: set[int]) -> list[int]:
        """The article's lines that go if these lines are shared."""
        best = self.best()
        if not best:
            return sorted(shared)
        own = {box for i, boxes in enumerate(self.inside) if i not in shared for box in boxes}
        return sorted(i for i in shared if self.ranks[i] == best and set(self.inside[i]) - own)


def outline(page: list[markup.Line]) -> Outline:
    hashes = [int.from_bytes(hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for x in page]
    return Outline(hashes, [len(x.text) for x in page], [x.rank for x in page], [list(x.inside) for x in page])


def shared_lines(a: Outline, b: Outline) -> tuple[set[int], set[int]]:
    """Numbers of the lines that two neighbouring pages share as template; none if they are copies."""
    p, q = map(set, common_lines(a.hashes, b.hashes))
    if not p or a.is_copy(p) or b.is_copy(q):
        return set(), set()
    return p, q


def main_text(page: list[markup.Line], dropped: set[int]) -> str:
    """The article's lines without those that go."""
    best = max((x.rank for x in page), default=0)
    return "\n".join(x.text for i, x in enumerate(page) if x.rank == best and i not in dropped)


#: Pages that lose lines, above which they are joined by a shuffle.
BROADCAST_ROWS = 300_000
OUTLINE = "hashes array<long>, sizes array<int>, ranks array<int>, inside array<array<int>>"
TOLD = pa.schema([
    ("_task", pa.int32()), ("_place", pa.int32()), ("_host", pa.string()), ("_dropped", pa.list_(pa.int32())), ("_shared", pa.list_(pa.int32())),
    ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("inside", pa.list_(pa.list_(pa.int32()))),
])
FIELDS = ("hashes", "sizes", "ranks", "inside")


def _outlines(pages: DataFrame) -> DataFrame:
    """Key, host, path and outline of each page that has a host."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outline(markup.lines(x.as_py())) for x in batch.column(batch.schema.get_field_index("_html"))]
            extra = [pa.array([getattr(x, name) for x in found], TOLD.field(name).type) for name in FIELDS]
            kept = batch.select(["page_id", "_digest", "_host", "_path"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *extra], schema=pa.schema([*kept.schema, *(TOLD.field(n) for n in FIELDS)]))

    schema = StructType([*(pages.schema[c] for c in ("page_id", "_digest", "_host", "_path")), *StructType.fromDDL(OUTLINE).fields])
    return pages.filter("_host <> ''").mapInArrow(run, schema)


def _difference(dealt: DataFrame) -> DataFrame:
    """Lines dropped by the neighbours within the task, where there are any.

    The first page of a task (place 1) and the last (2; 3 if it is both) come with their outlines
    instead, as they have a neighbour elsewhere.
    """
    schema = StructType([dealt.schema["page_id"], dealt.schema["_digest"], *StructType.fromDDL(f"_task int, _place int, _host string, _dropped array<int>, _shared array<int>, {OUTLINE}").fields])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list | None = None  # key, host, outline, lines shared so far, place
        keys = None

        def told(key: dict, host: str, page: Outline, shared: set[int], place: int) -> dict | None:
            if place:
                return {**key, "_task": task, "_place": place, "_host": host, "_dropped": None, "_shared": sorted(shared), **vars(page)}
            gone = page.dropped(shared) if shared else []
            return {**key, "_task": task, "_place": 0, "_host": None, "_dropped": gone, "_shared": None, **dict.fromkeys(FIELDS)} if gone else None

        for batch in batches:
            keys = batch.select(["page_id", "_digest"])
            done = []
            for key, r in zip(keys.to_pylist(), batch.select(["_host", *FIELDS]).to_pylist(), strict=True):
                host, page, mine = r.pop("_host"), Outline(**r), set()
                if held and held[1] == host:
                    theirs, mine = shared_lines(held[2], page)
                    held[3].update(theirs)
                if held:
                    done.append(told(*held))
                held = [key, host, page, mine, 0 if held else 1]
            rows = [x for x in done if x]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*keys.schema, *TOLD]))
        if held:
            yield pa.RecordBatch.from_pylist([told(*held[:4], held[4] | 2)], schema=pa.schema([*keys.schema, *TOLD]))

    return dealt.mapInArrow(run, schema)


def _meet(ends: DataFrame) -> DataFrame:
    """Lines dropped from the first and last pages of tasks, differenced with their neighbours of the task before and after."""
    # One number a task.
    tasks = ends.select("_task").distinct()
    order = tasks.withColumn("_before", F.lag("_task").over(Window.orderBy("_task"))).withColumn("_next", F.lead("_task").over(Window.orderBy("_task")))
    # Both sides of a seam get the number of the task before it; a page that is all of its task has two seams.
    left, right = F.when(F.col("_place") != 2, F.col("_before")), F.when((F.col("_place") != 1) & F.col("_next").isNotNull(), F.col("_task"))
    seams = ends.join(order, "_task").withColumn("_seam", F.explode(F.array_compact(F.array(left, right))))
    own = pa.schema([("_task", pa.int32()), ("_place", pa.int32()), ("_more", pa.list_(pa.int32()))])

    def pair(rows: pa.Table) -> pa.Table:
        sides = sorted(rows.to_pylist(), key=lambda r: r["_task"])
        met = len(sides) == 2 and sides[0]["_host"] == sides[1]["_host"]
        found = shared_lines(*(Outline(*(r[f] for f in FIELDS)) for r in sides)) if met else [()] * len(sides)
        return pa.Table.from_pylist([{"_task": r["_task"], "_place": r["_place"], "_more": sorted(x)} for r, x in zip(sides, found, strict=True)], schema=own)

    found = seams.select("_seam", "_task", "_place", "_host", *FIELDS).groupBy("_seam").applyInArrow(pair, "_task int, _place int, _more array<int>")
    known = ends.join(found.groupBy("_task", "_place").agg(F.flatten(F.collect_list("_more")).alias("_more")), ["_task", "_place"], "left")
    schema = StructType([ends.schema["page_id"], ends.schema["_digest"], ends.schema["_dropped"]])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["page_id", "_digest"])
            gone = [Outline(*(r[f] for f in FIELDS)).dropped({*r["_shared"], *(r["_more"] or ())}) for r in batch.select([*FIELDS, "_shared", "_more"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(gone, pa.list_(pa.int32()))], schema=pa.schema([*keys.schema, TOLD.field("_dropped")]))

    return known.select("page_id", "_digest", *FIELDS, "_shared", "_more").mapInArrow(final, schema).filter(F.size("_dropped") > 0)


def template_lines(pages: DataFrame) -> DataFrame:
    """Of the pages (page_id, _digest, _host, _path, _html) that lose lines, the numbers of these."""
    scratch = Scratch(pages.sparkSession)
    outlines = scratch.table(_outlines(pages)).withColumn("_tie", F.monotonically_increasing_id())
    dealt = outlines.repartitionByRange("_host", "_path", "page_id", "_digest", "_tie").sortWithinPartitions("_host", "_path", "page_id", "_digest", "_tie")
    told = scratch.table(_difference(dealt))
    waits = F.col("hashes").isNotNull()
    gone = told.filter(~waits).select("page_id", "_digest", "_dropped").union(_meet(told.filter(waits)))
    out = materialise(gone.groupBy("page_id", "_digest").agg(F.array_distinct(F.flatten(F.collect_list("_dropped"))).alias("_dropped")))
    scratch.drop()
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, the columns of ``keep``, the main text and its number of characters."""
    names = ["page_id", "url", *keep]
    address = r"^\s*[A-Za-z][A-Za-z0-9+.-]*:/{2}(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
    known = pages.select(*names, F.col("html").alias("_html"), F.xxhash64("url", "html").alias("_digest"))
    gone = template_lines(known.withColumn("_host", F.lower(F.regexp_extract("url", address, 1))).withColumn("_path", F.regexp_extract("url", address, 2)))
    gone = small(gone.withColumnRenamed("page_id", "_page").withColumnRenamed("_digest", "_key"), gone.count(), BROADCAST_ROWS)
    told = known.join(gone, known["page_id"].eqNullSafe(gone["_page"]) & (known["_digest"] == gone["_key"]), "left")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(markup.lines(r["_html"]), set(r["_dropped"] or ())) for r in batch.select(["_html", "_dropped"]).to_pylist()]
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], schema=pa.schema([*kept.schema, ("_text", pa.string())]))

    schema = StructType([*(known.schema[c] for c in names), *StructType.fromDDL("_text string").fields])
    text = told.select(*names, "_html", "_dropped").mapInArrow(run, schema)
    return text.withColumn("n_chars", F.length("_text").cast("long")).withColumnRenamed("_text", "text")
