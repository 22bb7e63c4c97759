"""Plain-Python versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

LETTERS = str.maketrans("0123456789", "abcdefghij")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())


def prose(i: int, n: int = 60) -> str:
    return " ".join(f"w{zlib.crc32(f'{i}/{j}'.encode()) % 997}".translate(LETTERS) for j in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeats, copies, near copies, shared passages."""
    base, shared = prose(1, 120), prose(99, 30)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [base, base, near, prose(2), prose(3) + " " + shared, "lead " + shared + " " + prose(4), "", None, "one", "one", "!!!", prose(5, 3000), "é" * 70 + " x", "tail é" * 30, shared, "a b", "\n\n", prose(6) + "\n" + prose(7)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, "en", "src1", 5), (-4, base, "en", "src1", 5)]


def components(rows: list[tuple], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {}
    for row in rows:
        if row[0] is not None:
            words = re.findall(rb"[^\x20\x09-\x0D]+", lower(row[1] or ""))
            sets[row[0]] = frozenset(zip(*[words[k:] for k in range(size)], strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else [])
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def repeated(rows: list[tuple], length: int) -> dict[int, bytes]:
    """doc_id -> bytes left."""
    texts = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    seen: dict[bytes, int] = {}
    left = {}
    for i in sorted(texts):
        body, gone = texts[i], set()
        for at in range(len(body) - length + 1):
            if seen.setdefault(body[at : at + length], i) < i:
                gone.update(range(at, at + length))
        left[i] = bytes(c for at, c in enumerate(body) if at not in gone)
    return left


def contaminated(text: str | None, items: list[tuple], n: int = 10) -> tuple[int, set, set]:
    """Number of words, hit words, and items."""
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for item, body in items:
        words = pattern.findall(lower(body or ""))
        size = min(n, len(words))
        for at in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[at : at + size]), set()).add(str(item))
    words, hit, found = pattern.findall(lower(text or "")), set(), set()
    for size in {len(w) for w in windows}:
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in windows:
                hit.update(range(at, at + size))
                found |= windows[tuple(words[at : at + size])]
    return len(words), hit, found


def jump(key: int, shards: int) -> int:
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def recurring(rows: list[tuple], depth: int, similarity: float, words: float, min_tokens: int, min_docs: int, long_tokens: int, levels: int) -> dict[int, set[int]]:
    """doc_id -> numbers of the lines to drop, by the definition of the template tree."""
    lines = []
    for i, text in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        for number, line in enumerate(text.split("\n")):
            tokens = tuple("#" if re.search("[0-9]", t) else t for t in re.split("[\x20\x09-\x0d]+", line) if t)
            if len(tokens) >= min_tokens and sum(t != "#" for t in tokens) >= words * len(tokens):
                lines.append((i, number, text, tokens))
    support: dict[tuple, set] = {}
    for _, _, text, tokens in lines:
        for place, token in enumerate(tokens):
            support.setdefault((len(tokens), tokens[:depth], place, token), set()).add((tokens, text))
    holders: dict[tuple, set] = {}
    first: dict[tuple, int] = {}
    names: dict[tuple, list] = {}
    for i, _, text, tokens in lines:
        enough = min(2, min_docs) if len(tokens) >= long_tokens else min_docs
        found = []
        for level in range(levels):
            kept = tuple(t if t == "#" or len(support[len(tokens), tokens[:depth], p, t]) >= enough * 4**level else None for p, t in enumerate(tokens))
            fixed = sum(t not in ("#", None) for t in kept)
            if fixed + kept.count("#") >= similarity * len(tokens) and fixed >= words * len(tokens):
                found.append((tokens[:depth], kept))
        names[tokens] = found
        for name in set(found):
            holders.setdefault(name, set()).add(text)
            first[name] = min(first.get(name, i), i)
    gone: dict[int, set[int]] = {}
    for i, number, _, tokens in lines:
        enough = min(2, min_docs) if len(tokens) >= long_tokens else min_docs
        name = next((n for n in reversed(names[tokens]) if len(holders[n]) >= enough), None)
        if name is not None and first[name] != i:
            gone.setdefault(i, set()).add(number)
    return gone
