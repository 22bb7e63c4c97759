"""Each operator against brute force on awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import ann, decontam, langid, line_dedup, lm_score, near_dedup, packing, quality, sharding, substring_dedup
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.COLUMNS)


def test_jump_hash_moves_keys_only_into_new_shards():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *range(10, 3000)], np.uint64)
    now, grown = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert [brute.jump(int(k), 40) for k in keys[:300]] == now[:300].tolist()
    assert set(grown[grown != now].tolist()) == {40}
    assert sharding.jump_hash(keys, 1).max() == 0


def test_sharding(docs, none):
    got = sharding.assign_shards(docs, 3).toPandas()
    rows = brute.awkward()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    want = sorted((zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows)
    assert sorted(zip(got["text_crc32"], got["size"], strict=True)) == want
    for row in got.itertuples():
        key = (-1 if pd.isna(row.doc_id) else int(row.doc_id)) % 2**64
        assert (row.shard, row.grown_shard, row.law) == (brute.jump(key, 3), brute.jump(key, 4), "key")
    assert sharding.assign_shards(none, 3).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), 256).toPandas()
    want = []
    for row in brute.awkward():
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want += [(row[0], k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    found = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(found, key=str) == sorted(want, key=str)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == np.r_[0, part["length"].cumsum()[:-1]].tolist() and part["length"].sum() <= 256
    assert packing.pack_documents(none, tokenizer_path(), 256).count() == 0


def test_chunk_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, ours = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path())
    draw = random.Random(3)
    alphabet = "aZ' s9\n\t.é漢́ß<|endoftext|>\x1c İ_" + "JK\u030c\u0307Σσς\u0391\u212a"
    for _ in range(900):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_is_tight_and_places_everything():
    draw = random.Random(5)
    counts = {n: draw.randrange(1, 9) for n in draw.sample(range(1, 400), 150)}
    plan = packing.plan_sequences(counts, 400)
    assert plan.groupby("length")["times"].sum().to_dict() == counts
    total = sum(n * c for n, c in counts.items())
    assert plan["sequence"].max() < 1.02 * total / 400 + 2
    assert packing.plan_sequences({}, 400).empty


def test_decontamination(spark, docs, none):
    passage = brute.prose(99, 30)
    items = [("a", passage), ("b", passage), ("c", "one"), ("d", None), ("e", ""), (None, brute.prose(2)), ("f", "no such words in any of these texts at all indeed")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontam.BLOCK_BYTES, 200):
        found = decontam.find_contamination(docs.withColumn("hits", F.lit(1)), bench, block_bytes=block)
        got = decontam.contamination_report(found).join(docs.select("doc_id", "text"), "doc_id").distinct().toPandas()
        for row in got.itertuples():
            n, hit, its = brute.contaminated(row.text, items)
            its.discard("None")
            assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, len(hit), len(its), bool(hit))
            assert row.items_sha256 == hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()
        assert got["contaminated"].sum() >= 5
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).filter(F.size("hits") > 0).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, docs, none, shingle):
    draw = random.Random(8)
    rows = brute.awkward()
    for group in range(4):
        words = brute.prose(200 + group, 100).split(" ")
        for copy in range(12):
            mine = list(words)
            for at in draw.sample(range(100), draw.randrange(0, 9)):
                mine[at] = f"x{draw.randrange(10**6)}"
            rows.append((1000 + 20 * group + copy, " ".join(mine), None, None, None))
    table = spark.createDataFrame(rows, brute.COLUMNS)
    got = near_dedup.near_duplicates(table, shingle, 80).filter("doc_id is not null").distinct().toPandas()
    want = brute.components(rows, shingle, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()
    assert near_dedup.near_duplicates(none, shingle).count() == 0


def test_signature_estimates():
    signer = near_dedup.Signer()
    draw = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        both = draw.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        a, b = both, np.r_[both[:n], draw.integers(0, 2**63, 2000 - n).astype(np.uint64)]
        (_, x), (_, y) = signer.sign(np.unique(a)), signer.sign(np.unique(b))
        assert abs(near_dedup.similarity(x, y, near_dedup.MINIMA) - share) < 0.12


def test_repeated_spans(docs, none):
    got = substring_dedup.removal_report(substring_dedup.repeated_spans(docs, 50)).filter("doc_id is not null").distinct().toPandas()
    left = brute.repeated(brute.awkward(), 50)
    for row in got.itertuples():
        assert (row.n_bytes - row.n_removed, row.kept_sha256) == (len(left[row.doc_id]), hashlib.sha256(left[row.doc_id]).hexdigest())
    assert got["n_removed"].sum() > 500 and len(got) == len(left)
    assert substring_dedup.repeated_spans(none, 50).count() == 0


def test_suffix_sort_is_lexicographic():
    draw = np.random.default_rng(4)
    body = draw.integers(97, 99, 600).astype(np.uint8)
    start = np.arange(550)
    order = substring_dedup.Suffixes(body, start, np.full(550, 50)).sort(start)
    assert [body[s : s + 50].tobytes() for s in order] == sorted(body[s : s + 50].tobytes() for s in start)


def test_quality(spark, none):
    rows = [(i, brute.prose(i) if i % 3 else brute.prose(i).replace(" ", "$$$ "), None, None, None) for i in range(240)]
    table = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None)], brute.COLUMNS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 5 == 0
    model = quality.train(quality.training_rows(table, labels, "quality", held))
    got = quality.score(table.withColumn("score", F.lit("clash")), model).toPandas().set_index("doc_id")
    test = [i for i in range(240) if i % 5 == 0]
    assert np.mean([(got["score"][i] >= 0.5) == (i % 3 > 0) for i in test]) > 0.95
    assert got["score"].between(0, 1).all() and got["score"][900] == got["score"][901]
    # Characters, not bytes, make the n-grams: "é" and "è" share no n-gram of their own, "éa" is one of two.
    count = lambda t: len(quality.features(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))[0])
    assert count("éa é") == count("xa x")
    empty = quality.train(quality.training_rows(table, labels.limit(0), "quality", held))
    assert quality.score(table, empty).filter("score = 0.5").count() == 242
    assert quality.score(none, model).count() == 0


def test_language(spark, none):
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "ein"]}
    draw = random.Random(1)
    text = lambda lang: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(50))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", None, None) for i in range(60)]
    table = spark.createDataFrame([*rows, (90, None, "aa", None, None), (91, "12 !!", "bb", None, None), (92, text("aa").upper() * 60, None, None, None)], brute.COLUMNS)
    samples = langid.learn(table, F.col("doc_id") % 3 == 1)
    got = langid.identify(table, samples).toPandas().set_index("doc_id")
    assert all(got["lang_pred"][r[0]] == r[2] for r in rows) and got["lang_pred"][92] == "aa"
    assert (got["lang_pred"][90], got["lang_pred"][91], got["score"][91]) == ("und", "und", 0.0)
    assert langid.identify(none, samples).count() == 0 and langid.learn(none, F.lit(False)) == {}
    assert set(langid.identify(table, {}).toPandas()["lang_pred"]) == {"und"}


def test_language_of_one_short_or_of_long_documents(spark):
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ox", "yl", "uz", "ep"]}
    draw = random.Random(2)
    text = lambda lang, n: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text("aa", 60), "aa") for i in range(40)] + [(50, text("bb", 12), "bb"), (51, text("cc", 3000), "cc"), (52, text("cc", 2500), "cc")]
    tests = [(100 + i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    schema = "doc_id long, text string, lang string"
    samples = langid.learn(spark.createDataFrame(rows, schema), F.lit(False))
    assert set(samples) == {"aa", "bb", "cc"} and len(samples["bb"]) < 200 and len(samples["cc"]) == langid.MODEL_LETTERS
    got = langid.identify(spark.createDataFrame(tests, schema), samples).toPandas()
    assert (got["lang_pred"] == got["lang"]).all()


def test_language_by_brute_force(spark, monkeypatch):
    """Greedy longest matches, cut at blocks, times the bits of each model; ties to the smallest name."""
    monkeypatch.setattr(langid, "BLOCK", 7)
    samples = {"x": "abracadabra banana", "y": "the cat and the dog", "z": "na"}
    parser = langid.Parser(samples)
    texts = ["Banana, cadabra!", "the catdog", "na na na na", "q", "an"]
    for text in texts:
        body = np.frombuffer(text.encode(), np.uint8)
        points, offsets = langid.normalised(np.array([0, len(body)]), body)
        letters, want = "".join(map(chr, points)), []
        for model in samples.values():
            count = 0
            for start in range(0, len(letters), 7):
                block, at = letters[start : start + 7], 0
                while at < len(block):
                    n = next((k for k in range(len(block) - at, 0, -1) if block[at : at + k] in model), 1)
                    at, count = at + n, count + 1
            want.append(count)
        assert parser.phrases(points, offsets).tolist() == [want], text
        assert parser.bits.tolist() == pytest.approx([math.log2(len(m) + 1) for m in samples.values()])


def test_models_of_wide_alphabets_stay_small():
    """Slots follow the letters of a model, not letters times alphabet; phrases as by substring search."""
    draw = np.random.default_rng(4)
    samples = {f"w{k}": "".join(map(chr, draw.integers(0x4E00 + 900 * k, 0x4E00 + 900 * k + 3000, 6000))) for k in range(6)}
    samples["few"] = "".join(draw.choice(list("ab "), 6000))
    parser = langid.Parser(samples)
    assert parser.slots.nbytes + parser.begins.nbytes < 12_000_000
    text = samples["w2"][100:160] + samples["w3"][7:19] + "abba" + samples["w0"][:5]
    body = np.frombuffer(text.encode(), np.uint8)
    points, offsets = langid.normalised(np.array([0, len(body)]), body)
    letters, want = "".join(map(chr, points)), []
    for name in parser.languages:
        at = count = 0
        while at < len(letters):
            n = next((k for k in range(len(letters) - at, 0, -1) if letters[at : at + k] in samples[name]), 1)
            at, count = at + n, count + 1
        want.append(count)
    assert parser.phrases(points, offsets).tolist() == [want]


def test_phrases_by_brute_force():
    model, text = "abracadabra", "abraxcadabrab"
    parser = langid.Parser({"x": model})
    body = np.frombuffer(text.encode(), np.uint8)
    points, offsets = langid.normalised(np.array([0, len(body)]), body)
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in model:
            n += 1
        at, count = at + max(n, 1), count + 1
    assert parser.phrases(points, offsets).tolist() == [[count]]


@pytest.mark.parametrize("block_rows", [8192, 20])
def test_nearest(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(12, 16))
    vectors = [(centres[i % 12] + 0.3 * draw.normal(size=16)).astype(np.float32).tolist() for i in range(1500)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[7], 1) for i in range(40)]
    odd = [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [float("nan")] * 16, 0), (3150, [None] * 16, 0), (3200, [1.0], 0), (None, vectors[3], 0), rows[50]]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    got = ann.nearest(table, F.col("id") % 50 == 0, 5).toPandas()
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = matrix @ matrix[q]
        score[q] = -9
        want = ids[np.lexsort((ids, -score.round(12)))[:5]]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(want) & set(mine["vec_id"])), total + 5
        place = {int(v): i for i, v in enumerate(ids)}
        exact = [float(matrix[place[v]] @ matrix[q]) for v in mine["vec_id"]]
        assert mine["score"].tolist() == pytest.approx(exact, abs=1e-12) and list(zip(-mine["score"], mine["vec_id"])) == sorted(zip(-mine["score"], mine["vec_id"]))
    assert hit / total >= 0.9 and set(got["query_id"]) == set(ids[ids % 50 == 0])
    assert ann.nearest(table.limit(0), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(table.filter("vec_id in (0, 1)"), F.col("id") % 50 == 0).toPandas()["vec_id"].tolist() == [1]


def test_nearest_fills_every_query_from_small_leaves(spark, monkeypatch):
    """Leaves of up to three vectors and a calibration of one leaf: each query still gets k rows, or all there are."""
    monkeypatch.setattr(ann, "LEAF", 3)
    monkeypatch.setattr(ann, "BRANCHES", 3)
    monkeypatch.setattr(ann, "_calibrated", lambda *_: 1)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(0, v.tolist()) for v in rng.normal(size=(3, 8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(table, (F.col("id") % 10 == 0) & (F.col("id") > 0)).toPandas()
    assert got.groupby("query_id").size().to_dict() == {i: 5 for i in range(10, 300, 10)}
    assert ann.nearest(table, F.col("id") == 0).count() == 5
    assert ann.nearest(table.filter("vec_id in (1, 2, 3)"), F.col("id") == 1).count() == 2


def test_line_templates(spark, none):
    rows = [(i, f"{brute.prose(i)}\nPage {i} of the printed report ends here\n{brute.prose(500 + i)}", None, None, None) for i in range(8)]
    copies = [(20 + i, f"{brute.prose(50)}\n{brute.prose(51)}\n{brute.prose(52)}", None, None, None) for i in range(6)]
    table = spark.createDataFrame([*rows, *copies, (40, None, None, None, None), (41, "", None, None, None), (None, rows[2][1], None, None, None), rows[5]], brute.COLUMNS)
    got = line_dedup.drop_recurring_lines(table.withColumn("n_lines", F.lit("clash"))).toPandas()
    by_id = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")
    assert "printed report" in by_id["text"][0] and by_id["n_dropped"][0] == 0
    for i in range(1, 8):
        assert by_id["text"][i] == f"{brute.prose(i)}\n{brute.prose(500 + i)}"
    assert all(by_id["n_dropped"][20 + i] == 0 for i in range(6))
    assert by_id["text"][40] is None and by_id["n_lines"][41] == 1 and len(got) == table.count()
    assert line_dedup.drop_recurring_lines(none).count() == 0


def test_line_templates_with_constant_neighbours(spark):
    """A passage, a fixed header and lines between blank lines recur; lines of two documents do if they are long."""
    passage = "\n".join(f"the {w} line of the shared passage" for w in ("opening", "middle", "closing"))
    rows = [(i, f"subscribe to our weekly letter\n\n{brute.prose(i)}\n{passage}\n\nall rights are reserved\n\n{brute.prose(500 + i)}") for i in range(6)]
    long = "this sentence of more than ten tokens stands in two documents and not in more of them"
    rows += [(30 + i, f"{brute.prose(30 + i)}\n{long}\nonly two of these\n{brute.prose(530 + i)}") for i in range(2)]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got["n_dropped"][0] == got["n_dropped"][30] == 0
    for i in range(1, 6):
        assert got["text"][i] == f"\n{brute.prose(i)}\n\n\n{brute.prose(500 + i)}"
    assert got["text"][31] == f"{brute.prose(31)}\nonly two of these\n{brute.prose(531)}"


@pytest.mark.parametrize("leaf_lines", [4, 4096])
def test_line_templates_by_brute_force(spark, monkeypatch, leaf_lines):
    """Fields of many and of few values, two at once, digits, notices of five lines, copies, long and short lines."""
    monkeypatch.setattr(line_dedup, "LEAF_LINES", leaf_lines)
    draw = random.Random(12)
    names, days = [f"name{chr(97 + i)}" for i in range(20)], ["Monday", "Friday", "Sunday"]
    notice = "\n".join(f"line {w} of the notice" for w in ("one", "two", "three", "four", "five"))
    rows = []
    for i in range(90):
        mine = [brute.prose(i, 12), f"the morning news was posted by {draw.choice(names)} on {draw.choice(days)}", f"Page {i} of the printed report"]
        mine += [f"entry {i} 17 {i + 4}", notice] if i < 50 else [" ".join(draw.choice("the of a to".split()) for _ in range(4))]
        rows.append((i, "\n".join(mine)))
    rows += [(200 + i, rows[3][1]) for i in range(4)] + [rows[7], (None, rows[8][1]), (300, None), (301, "")]
    limits = (line_dedup.DEPTH, line_dedup.SIMILARITY, line_dedup.WORDS, line_dedup.MIN_TOKENS, line_dedup.MIN_DOCS, line_dedup.LONG_TOKENS, line_dedup.LEVELS)
    want = brute.recurring(rows, *limits)
    for parts in (1, 5):
        got = line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("text", F.coalesce("text", F.lit("")))).distinct().toPandas()
        assert {i: set(part["line"]) for i, part in got.groupby("doc_id")} == want
    assert all(want[i] >= {4, 5, 6, 7, 8} for i in range(1, 50)) and not want.get(0)
    # Of 60 pairs of name and day few recur by themselves, yet the line stays in its first document alone.
    assert [i for i in range(90) if 1 not in want.get(i, ())] == [0]


def test_cross_entropy_difference(spark, docs, none):
    good = spark.createDataFrame([(3,), (5,), (None,)], "doc_id long")
    got = lm_score.cross_entropy_difference(docs.withColumn("score", F.lit("clash")), good).toPandas()
    counts, target = {}, {}
    for row in brute.awkward():
        n = brute.contaminated(row[1], [])[0]
        counts[row[0]] = n
        target[row[0]] = row[0] in (3, 5)
    for row in got.itertuples():
        key = None if pd.isna(row.doc_id) else int(row.doc_id)
        assert row.n_tokens == counts[key]
        assert row.score == pytest.approx(row.target_loss - row.background_loss)
    by_id = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")["score"]
    # Rows 3 are two rows of the target, so each is read by the other's counts; row 5 has no other of its kind.
    assert by_id[3] < by_id[0] and by_id[6] == by_id[7] == 0
    assert lm_score.cross_entropy_difference(none, good).count() == 0


@pytest.mark.parametrize("hot", [1, 40, 1 << 16])
def test_cross_entropy_difference_by_brute_force(spark, monkeypatch, hot):
    """Counts of all other documents, whichever grams are looked up and whichever are dealt."""
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "LEAST", 1)
    texts = [brute.prose(i % 9) + " the same pair" * (i % 4) for i in range(14)] + ["word", "word", "alone"]
    good = {2, 5, 11, 14}

    everything = [w for text in texts for w in text.split()]

    def loss(i, others, frequent):
        single, pair = Counter(), Counter()
        for k in others:
            words = texts[k].split()
            single.update(w if w in frequent else None for w in words)
            pair.update(zip(["^", *words[:-1]], words, strict=True))
        words, out = texts[i].split(), 0.0
        for last, word in zip(["^", *words[:-1]], words, strict=True):
            out -= 0.6 * math.log((pair[last, word] + 0.1) / (pair.total() + 0.1 * lm_score.PAIRS))
            out -= 0.4 * math.log((single[word if word in frequent else None] + 0.1) / (single.total() + 0.1 * (len(frequent) + 1)))
        return out / len(words)

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = table.select(F.col("doc_id").alias("key"), "text", F.col("doc_id").isin(*good).alias("target"))
    known = set(lm_score.frequent(marked)[0].tolist())
    names = {w: int(lm_score.grams_of(*lm_score.words_of(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8)))[1]) for w in set(everything)}
    frequent = {w for w, gram in names.items() if gram in known}
    assert hot == 1 or frequent >= {w for w, n in Counter(everything).items() if n * hot >= 2 * len(everything)}
    assert hot < 1 << 16 or frequent == set(everything)
    got = lm_score.cross_entropy_difference(table, spark.createDataFrame([(i,) for i in good], "doc_id long")).toPandas()
    assert len(got) == len(texts)
    for row in got.itertuples():
        assert row.n_tokens == len(texts[row.doc_id].split())
        assert row.background_loss == pytest.approx(loss(row.doc_id, set(range(len(texts))) - {row.doc_id}, frequent), abs=1e-7)
        assert row.target_loss == pytest.approx(loss(row.doc_id, good - {row.doc_id}, frequent), abs=1e-7)


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    """What each stage keeps of awkward rows, and that it takes an empty table."""
    import corpus_pipeline

    rows, kept = brute.awkward(), {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name
        out = stage(spark, docs.withColumn("hits", F.lit("clash")), "/root/testdata/sf0.001")
        kept[name] = out.toPandas()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= len(rows)
    assert {i for i in kept["near_dedup"]["doc_id"].dropna()} == {i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c}
    gone = brute.recurring(rows, line_dedup.DEPTH, line_dedup.SIMILARITY, line_dedup.WORDS, line_dedup.MIN_TOKENS, line_dedup.MIN_DOCS, line_dedup.LONG_TOKENS, line_dedup.LEVELS)
    left = {int(r.doc_id): r.text for r in kept["line_dedup"].dropna(subset="doc_id").itertuples()}
    for i, text in {(r[0], r[1]) for r in rows if r[0] is not None}:
        lines = [line for n, line in enumerate((text or "").split("\n")) if n not in gone.get(i, ())]
        assert (i not in left) if gone.get(i) and not "".join(lines).strip(" ") else (left[i] == (text if text is None else "\n".join(lines)))
    assert kept["packing"]["doc_id"].nunique() == len({r[0] for r in rows if r[0] is not None})


def test_quality_stage_drops_what_is_labelled_bad(spark, monkeypatch):
    import corpus_pipeline

    rows = [(i, brute.prose(i) if i % 3 else brute.prose(i).replace(" ", "$$$ "), "en", "s", None) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, spark.createDataFrame(rows, brute.COLUMNS), "").collect()}
    good = {i for i in range(240) if i % 3}
    assert len(kept & good) >= 0.95 * len(good) and len(kept - good) <= 4


CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    from tidemark.llm import queries

    small = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, small)
    kinds = dict(got.dtypes)
    assert {c.split()[0]: c.split()[1] for c in CONTRACT[name].split(", ")}.items() <= kinds.items()
    assert got.count() >= spark.read.parquet(f"{small}/documents.parquet").count() if name != "op4_ann" else got.count() == 5 * got.select("query_id").distinct().count()


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Chains of near copies without a common root, in blocks of four classes: the links found join the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    draw, rows = random.Random(21), []
    for group in range(6):
        words = brute.prose(300 + group, 90).split(" ")
        for copy in range(40):
            words = list(words)
            for at in draw.sample(range(90), 2):
                words[at] = f"y{draw.randrange(10**6)}"
            rows.append((1000 * group + draw.randrange(900), " ".join(words)))
    rows = list({r[0]: r for r in rows}.values())
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute.components(rows, 2, 80)
