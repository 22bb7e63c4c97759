"""Vector codes, page texts and periodic runs against plain versions, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import ann, markup, packing, page_text, periodic_runs, vector_codes


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= 4 * q and not any(words[i : i + length - d] == words[i + d : i + length] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def repetitive(draw: random.Random, size: int) -> list[int]:
    out: list[int] = []
    while len(out) < size:
        kind = draw.random()
        if kind < 0.5:
            out += ([draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randint(1, 14))] * draw.randint(1, 8))[: draw.randint(1, 80)]
        elif kind < 0.6 and out:
            out += out[-draw.randint(1, len(out)) :] * draw.randint(1, 4)
        else:
            out += [draw.randrange(draw.choice([2, 3, 50])) for _ in range(draw.randint(1, 9))]
    return out


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        many = [repetitive(draw, draw.randrange(150)) if draw.random() < 0.9 else [] for _ in range(draw.randint(1, 6))]
        assert periodic_runs.find_runs([np.array(x, np.int64) for x in many]) == [plain_runs(x) for x in many]


def test_runs_of_long_arrays():
    draw = np.random.default_rng(1)
    for q in (1, 2, 3, 5, 64, 127, 128, 129, 3000):
        x = np.r_[draw.integers(10**6, 10**7, 501), np.tile(np.arange(q), 5)[: 4 * q + q // 2], draw.integers(10**8, 10**9, 77)]
        assert periodic_runs.find_runs([x]) == [[(501, 4 * q + q // 2, q)]]


def report(doc_id, text, unroll) -> tuple:
    words = (text or "").encode().split()
    words = periodic_runs.planted(doc_id, words) if unroll else words
    runs = [r for r in plain_runs(words) if r[1] >= max(6, 4 * r[2])]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    left = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], digest, left)


@pytest.mark.parametrize("unroll", [False, True])
def test_run_report(spark, unroll):
    draw = random.Random(8)
    rows = brute.awkward() + [(100 + i, " \t".join(f"w{x}" for x in repetitive(draw, draw.randrange(90))) + " x \x0b", "en", "s", None) for i in range(120)]
    docs = spark.createDataFrame(rows, brute.COLUMNS).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)).withColumn("start", F.lit(2)).repartition(3)
    got = periodic_runs.run_report(periodic_runs.collapse_runs(docs, unroll=periodic_runs.planted if unroll else None))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(got.dtypes) == dict.fromkeys(names[:6], "bigint") | dict.fromkeys(names[6:], "string")
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(str(report(r[0], r[1], unroll)) for r in rows)
    assert periodic_runs.run_report(periodic_runs.collapse_runs(docs.limit(0))).count() == 0


def test_planted_words_follow_the_rule():
    words = [b"%d" % i for i in range(57)]
    changed = 0
    for i in range(300):
        h = zlib.crc32(str(i).encode())
        a, g = h // 10 % 57, h // 10
        p = 1 + (57 - a) // (3 + g % 8)
        want = [words[a + (k - a) % p] if h % 10 == 0 and k >= a else words[k] for k in range(57)]
        assert periodic_runs.planted(i, words) == want
        changed += want != words
    assert changed > 10


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> dict[int, tuple]:
    """vec_id -> (code, error); and the codebooks, in Python integers."""
    kept = sorted((r[0], [floor(1024 * Fraction(x)) for x in r[1]], r[2]) for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]))
    width = len(kept[0][1]) // parts
    books = [[v[k * width : (k + 1) * width] for _, v, _ in kept[:entries]] for k in range(parts)]

    def assign():
        for _, v, _ in kept:
            yield [min((sum((x - y) ** 2 for x, y in zip(v[k * width : (k + 1) * width], e, strict=True)), i) for i, e in enumerate(books[k])) for k in range(parts)]

    for _ in range(rounds):
        near = list(assign())
        for k in range(parts):
            for i in range(len(books[k])):
                mine = [v[k * width : (k + 1) * width] for (_, v, _), c in zip(kept, near, strict=True) if c[k][1] == i]
                if mine:
                    books[k][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    near, label = list(assign()), {}
    errors = [sum(d for d, _ in n) for n in near]
    for (_, _, name), error in zip(kept, errors, strict=True):
        label[name] = label.get(name, 0) + error
    fit = lambda x: x if x < 2**63 else None
    return {(i, "".join(f"{c:02x}" for _, c in n), fit(e), None if any(fit(x) is None for (_, _, m), x in zip(kept, errors, strict=True) if m == name) else fit(label[name]), sha) for (i, _, name), n, e in zip(kept, near, errors, strict=True)}


@pytest.mark.parametrize("extreme", [False, True])
def test_vector_codes_equal_brute_force(spark, extreme):
    draw = random.Random(4 + extreme)
    rows = [(i, [float(np.float32(draw.gauss(i % 3, 0.4))) for _ in range(8)], draw.choice([None, 1, 2, 3])) for i in range(120)]
    rows += [(200 + i, rows[5][1], 7) for i in range(30)]
    rows += [(300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [1.0] * 7 + [float("nan")], None), (303, [float("inf")] * 8, 1)]
    if extreme:
        rows += [(-1, [3e38, -3e38] * 4, 4), (400, [2e30] * 8, 4), (401, [1e5] * 8, 5), (402, [3e38, -2e38] * 4, 6), (403, [1e-40] * 8, 5)]
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(0)).withColumn("error", F.lit("x")).repartition(3)
    got = vector_codes.compress(table, parts=4, entries=16, rounds=3)
    assert {tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()} == plain_codes(rows, 4, 16, 3)


def test_vector_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<double>, label string"
    none = vector_codes.compress(spark.createDataFrame([], kinds))
    assert none.count() == 0 and dict(none.dtypes)["label_error"] == "bigint"
    odd = spark.createDataFrame([(1, [], "a"), (2, [1.0], "a"), (3, [1e300, 1.0, -1e300, 2.0], "a"), (4, [0.5] * 4, None), (None, [0.5] * 4, None), (5, [1.0] * 8, "b"), (4, [0.5] * 4, None)], kinds)
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(odd).collect()}
    assert got == {(3, "00000000", 0, 0), (4, "01010101", 0, 0), (None, "01010101", 0, 0)}
    one = vector_codes.compress(spark.createDataFrame([(i, [0.1] * 8, "x") for i in range(40)], kinds), entries=4).collect()
    assert {(r.code, r.error) for r in one} == {("00000000", 0)}


def test_cells_keep_the_nearest_entry():
    draw = np.random.default_rng(3)
    for spread, d, n, k in ((128, 16, 3000, 256), (3, 4, 2000, 200), (10**3, 1, 2000, 50), (2**28, 3, 300, 40), (40, 16, 500, 1)):
        parts = np.floor(draw.normal(0, spread, (n, d))).astype(np.int64)
        parts[::3] = parts[0] + draw.integers(-2, 3, parts[::3].shape)
        book = vector_codes.Codebook(parts[draw.integers(0, n, k)].tolist())
        far = ((parts[:, None, :] - np.array(book.exact)[None]).astype(object) ** 2).sum(2).astype(np.int64)
        codes, errors = book.nearest(parts)
        assert codes.tolist() == far.argmin(1).tolist() and list(errors) == far.min(1).tolist()


ARTICLE = "<article><h1>Caf&eacute; &amp; tea</h1><p><b>One  two\n<br>three<p>four &lt;five&gt;</p><p>All rights reserved.</p>{box}</article>"
BOX = "<div><p>Follow us</p><ul><li>here</li><li>there</li></ul></div>"


def test_lines_of_a_page():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body class='has-sidebar'><header class='site-header'><h1>Site</h1></header>"
        "<div class='cookie-notice'>We use cookies</div><nav><ul><li>a</ul></nav><div class='wrap with-sidebar'>" + ARTICLE.format(box="<form>mail<input></form><section id=comments><p>hi</p></section><div class=ad>buy<span>now</span></div>") + "</div><aside>side</aside><!-- c --><footer>&copy; x"
    )
    assert [x.text for x in markup.lines(page) if x.rank == 2] == ["Café & tea", "One two three", "four <five>", "All rights reserved."]
    assert [x.text for x in markup.lines("<div class=ad>buy<article><p>kept <span class='ad'>no</span> text")] == ["kept text"]
    assert [x.text for x in markup.lines("a<p>1 < 2 & 3<table><tr><td>x<td>y</table><pre>p\n q</pre>&#x41;&nbsp;b<!-- open <p>c")] == ["a", "1 < 2 & 3", "x", "y", "p q", "A b"]
    assert markup.lines(None) == markup.lines("") == markup.lines("<p> &nbsp; </p>") == []
    assert [x.text for x in markup.lines("<b>" * 3000 + "<p>deep" * 3000)][-1] == "deep"


def plain_lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 27, 40, 5])
def test_alignment_is_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(page_text, "HELD_BITS", bits)
    draw = random.Random(bits)
    for _ in range(300):
        kinds = draw.choice([2, 4, 30])
        a, b = ([draw.randrange(kinds) for _ in range(draw.randrange(40))] for _ in range(2))
        b = a[:10] + b + a[-5:] if draw.random() < 0.3 else b
        p, q = page_text.common_lines(a, b)
        assert [a[i] for i in p] == [b[j] for j in q] and sorted(set(p)) == p and sorted(set(q)) == q and len(p) == plain_lcs(a, b)


def site(draw: random.Random, host: str, n: int, marked: bool) -> list[tuple]:
    rows = []
    for i in range(n):
        own = [f"{host} {i} " + f"{draw.random()} " * 9 + "." for _ in range(draw.randint(1, 4))]
        text = "".join(f"<p>{x}</p>" for x in own)
        body = ARTICLE.format(box=BOX + text) if marked else "<div><p>Top</p></div>" + text + "<div><p>Bottom</p><p>End</p></div>"
        rows.append((i, f"http://{host}/{draw.choice('ab')}/{draw.randrange(60)}{draw.choice(['', '/', '?x=1', '#y', '.html'])}", body))
    return rows


def plain_texts(rows: list[tuple]) -> list[tuple]:
    def key(r):
        host = (r[1] or "").split("//")[-1].split("/")[0]
        path = "/" + (r[1] or "").split("//")[-1].partition("/")[2].split("?")[0].split("#")[0] if host else ""
        return host, path, (r[0] is not None, r[0] or 0)

    rows = sorted(rows, key=key)
    pages, shared = [markup.lines(r[2]) for r in rows], [set() for _ in rows]
    outlines = [page_text.outline(x) for x in pages]
    for k in range(1, len(rows)):
        if key(rows[k])[0] and key(rows[k])[0] == key(rows[k - 1])[0]:
            for side, more in zip((k - 1, k), page_text.shared_lines(*outlines[k - 1 : k + 1]), strict=True):
                shared[side] |= more
    return sorted((r[0], r[1], t, len(t)) for r, t in ((r, page_text.main_text(p, set(o.dropped(s)))) for r, p, o, s in zip(rows, pages, outlines, shared, strict=True)))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pages_are_differenced_with_their_neighbours(spark, parts):
    draw = random.Random(2)
    rows = site(draw, "a.org", 30, True) + [(100 + r[0], *r[1:]) for r in site(draw, "b.org", 25, False)] + [(200, None, "<p>x"), (201, "http://c.org/", None), (202, "http://c.org/q", ""), (203, "", "<p>y</p>"), (204, "http://d.org", "<p>alone")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("z")).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts < 40)
    try:
        got = page_text.extract(table)
        assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
        found = sorted(map(tuple, got.collect()), key=str)
        none = page_text.extract(table.limit(0)).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert none == 0 and found == sorted(plain_texts(rows), key=str)
    texts = {r[0]: r[2] for r in found}
    assert all(t.startswith("Café & tea\nOne two three\nfour <five>\nAll rights reserved.\na.org") for i, t in texts.items() if i < 100)
    assert all(x.startswith("b.org") for i, t in texts.items() if 100 <= i < 200 for x in t.split("\n"))
    assert [texts[i] for i in (200, 201, 202, 203, 204)] == ["x", "", "", "y", "alone"]


def test_copies_tell_nothing_about_the_template(spark):
    page = ARTICLE.format(box=BOX)
    rows = [(i, "http://a.org/x", page) for i in range(6)] + [(7, "http://a.org/x/2", page)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and {r.text for r in got} == {"Café & tea\nOne two three\nfour <five>\nAll rights reserved.\nFollow us\nhere\nthere"}


CONTRACT = {
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_page_text": "page_id bigint, url string, text string, n_chars bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    from tidemark.llm import queries

    small = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, small)
    assert {tuple(c.split()) for c in CONTRACT[name].split(", ")} <= set(got.dtypes)
    source = {"op11": "embeddings", "op12": "pages", "op13": "documents"}[name.split("_")[0]]
    assert got.count() == spark.read.parquet(f"{small}/{source}.parquet").count()


def test_nearest_of_very_large_and_very_small_vectors(spark):
    """Cosines do not depend on the size of vectors, as long as they are finite."""
    plain = [[1.0, 0.1], [0.3, 1.0], [-1.0, 0.2], [1.0, 0.9], [0.5, -1.0], [1.0, 0.0]]
    sizes = [1.0, 1e200, 1e-200, 1e308, 5e-320, 1e-300]
    rows = [(i, [x * size for x in v]) for i, (v, size) in enumerate(zip(plain, sizes, strict=True))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") >= 0, 5).collect()
    want = {(i, j): np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for i, a in enumerate(plain) for j, b in enumerate(plain) if i != j}
    assert len(got) == 30
    for r in got:
        assert abs(r.score - want[r.query_id, r.vec_id]) < (1e-3 if 4 in (r.query_id, r.vec_id) else 1e-12)


def test_tokens_of_rare_code_points_equal_the_tokenizer():
    """Code points alone, in a word and after a letter, unnamed ones too, and texts full of combining marks."""
    from tokenizers import Tokenizer

    from tidemark.llm.queries import tokenizer_path

    tokenizer, ours = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path())
    draw = random.Random(6)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [form.format(chr(c)) for c in points[::61] for form in ("{}", "ab{}cd", "e{} x")]
    marks = [c for c in points if unicodedata.category(chr(c))[0] == "M"]
    texts += ["".join(chr(draw.choice(marks if draw.random() < 0.3 else points[:9000])) for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == want.ids, ascii(text)
