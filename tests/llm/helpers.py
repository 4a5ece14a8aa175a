"""Small documents that hold every awkward case, and brute-force versions of operators."""

from __future__ import annotations

import hashlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, `Score` int, shard string"

LINE = "the quick brown fox jumps over the lazy dog while nine other animals look on and say nothing at all about it"


def awkward(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = [
        None, "", "   \n\t ", "one", "one two", LINE, LINE, LINE + " today", LINE.upper(), long, long, "a" * 3000, "é" * 200 + " " + LINE, "\n\n\n", LINE + "\n" + LINE + "\n\nend",
        "# # * $ % | < > #$%& " * 30, "1234 5678 !!! ??", "don't stop — it's “odd” <|endoftext|> ok", "x\x1cy\x85z\xa0w   v",
    ]
    rows = [(i * 10, t, ["en", None, "de"][i % 3], ["s1", "s2", None][i % 3], None if t is None else len(t), "clash", i, "clash") for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, LINE + " nobody", "en", "s1", 5, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text: str | None, words: int) -> frozenset:
    w = (text or "").encode()
    w = bytes(w).lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))


def groups_by_brute_force(texts: dict[int, str | None], words: int, num: int, den: int) -> dict[int, int]:
    sets = {i: shingles(t, words) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def repeats_by_brute_force(texts: dict[int, bytes], length: int = 50) -> dict[int, tuple[bytes, list[tuple[int, int]]]]:
    owner: dict[bytes, int] = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            owner.setdefault(texts[i][s : s + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if owner[t[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        spans, at = [], 0
        while at < len(t):
            if gone[at]:
                end = at
                while end < len(t) and gone[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out[i] = (bytes(x for x, g in zip(t, gone) if not g), spans)
    return out
