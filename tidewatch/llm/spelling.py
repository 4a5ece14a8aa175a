"""Words that differ by one letter, grouped under the spelling that is used far more often.

Words are found by a search of a frequency-vector trie. A word's letters fall into 16 groups; level k of the
trie branches by how many letters of the k-th group a word has (counts modulo 16, which keeps differences of
one). One edit adds at most one to one count and takes at most one from another, so a search may spend a
surplus of one and a deficit of one on its way down, and every leaf it reaches holds words worth comparing.

1. One pass counts the words; their combining sum is the vocabulary.
2. The trie is spread over tasks by its topmost levels. A word is stored below its own prefix, and searches go
   to each prefix its budget can reach. As nearness is mutual only one side searches: the first count in which
   two words differ must be the greater one in the word found. Where a prefix holds more than PAGE words four
   more levels are added to it; where words or searches are still many they are cut into blocks that meet
   pairwise, so no task holds an unbounded part and no pair is lost.
3. In a task the trie is the sorted array of its words' counts: a node is a range. A stack of blocks of
   (search, node, budget) is walked depth first, each block going down one level at a time.
4. Words at a leaf are compared letter by letter. Both directions of a near pair are counted and the most
   frequent near word of each is found by combining aggregates.
5. A word's root is found by doubling steps along the forms, which grow tenfold each.

Defined cases: texts that are null hold no words; a row without an id has the empty id; repeated rows count as
often as they occur; ties go to the smaller word in code-point order; a word longer than any limit is compared
whole; an empty table, or one without words, gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import documents, given_up, small_or_salted, written
from tidewatch.llm.registry import query

LETTERS, LEAST_N, RATIO, DROP_EVERY = 7, 2, 10, 31
PAGE = 20_000  # words of one part of the trie
SEARCHES = 8  # searches of one task, as a multiple of PAGE
GROUPS, STEP = 16, 4
# Letters whose code points agree modulo 16 form a group. The levels begin with groups of frequent letters.
LEVELS = np.array([5, 4, 9, 14, 15, 1, 2, 3, 8, 12, 13, 7, 6, 0, 10, 11])
_SHIFT = np.array([4 * (GROUPS - 1 - k) for k in range(GROUPS)], np.uint64)
_HELD = 200_000  # words a task counts before it hands them on
_FRONT = 1 << 16  # items of a block of the search
_CELLS = 1 << 23  # letters compared at once


def vocabulary(docs: DataFrame, key: str, text: str, letters: int = LETTERS, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): runs of letters of at least ``letters`` code points, A-Z lower-cased.

    Every ``drop_every``-th one, by a hash of id and run, has lost one letter.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                lowered = (t.as_py() or b"").lower().decode("utf-8", "replace")  # bytes: A-Z only
                seed = zlib.crc32((i.as_py() or "").encode() + b":")
                for word, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    held[word] += n
                if len(held) > _HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    plain = docs.select(F.col(f"`{key}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Words as one buffer of single-byte letters."""

    def __init__(self, words: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def keys(self) -> np.ndarray:
        """Counts of the letter groups, four bits a level, the first level topmost."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        counts = np.bincount(owner * GROUPS + (self.data[:-1] & 15), minlength=len(self.sizes) * GROUPS).reshape(-1, GROUPS) & 15
        return (counts[:, LEVELS].astype(np.uint64) << _SHIFT).sum(axis=1, dtype=np.uint64)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] differ by one replaced letter, or by one that b has more."""
        out = np.zeros(len(a), bool)
        size = self.sizes[a]
        more = self.sizes[b] - size
        for longer in (0, 1):
            fit = np.flatnonzero(more == longer)
            for n in np.unique(size[fit]).tolist():
                which = fit[size[fit] == n]
                step = max(1, _CELLS // (n + 1))
                for lo in range(0, len(which), step):
                    part = which[lo : lo + step]
                    cell = np.arange(n)
                    x = self.data[self.starts[a[part]][:, None] + cell]
                    at = self.starts[b[part]][:, None] + cell
                    same = x == self.data[at]
                    if not longer:
                        out[part] = (~same).sum(axis=1) == 1
                        continue
                    late = x == self.data[at + 1]
                    lead = np.where(same.all(axis=1), n, np.argmin(same, axis=1))
                    tail = np.where(late.all(axis=1), n, np.argmin(late[:, ::-1], axis=1))
                    out[part] = lead + tail >= n
        return out


def search(keys: np.ndarray, asked: np.ndarray, spent: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(search, low, high) of the leaves that searches reach, in blocks; a leaf is a range of the sorted ``keys``.

    ``spent`` is 0 (nothing), 1 (the surplus) or 2 (both) and ``asked`` what is looked for so far: the searching
    word's counts, with what it has spent in the levels above ``depth``. The deficit comes after the surplus.
    """
    one = np.uint64(1)

    def at(level: int, who: np.ndarray, target: np.ndarray, state: np.ndarray) -> tuple | None:
        """Those of the block that find a node below the level."""
        shift = _SHIFT[level - 1] if level else np.uint64(0)
        low = target >> shift << shift if level else np.zeros(len(target), np.uint64)
        high = low + ((one << shift) - one) if level else np.full(len(target), np.iinfo(np.uint64).max)
        first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        found = first < last
        return (level, who[found], target[found], state[found], first[found], last[found]) if found.any() else None

    stack = []
    for lo in range(0, len(asked), _FRONT):
        part = np.arange(lo, min(lo + _FRONT, len(asked)))
        stack.append(at(depth, part, asked[part], spent[part]))
    while stack:
        item = stack.pop()
        if item is None:
            continue
        level, who, target, state, first, last = item
        if level == GROUPS:
            yield who, first, last
            continue
        if len(who) > _FRONT:
            half = len(who) // 2
            stack += [(level, *[x[half:] for x in item[1:]]), (level, *[x[:half] for x in item[1:]])]
            continue
        shift = _SHIFT[level]
        nibble = target >> shift & np.uint64(15)
        cleared = target & ~(np.uint64(15) << shift)
        up, down = np.flatnonzero(state == 0), np.flatnonzero(state == 1)
        plus = cleared[up] | ((nibble[up] + one & np.uint64(15)) << shift)
        minus = cleared[down] | ((nibble[down] - one & np.uint64(15)) << shift)
        stack.append(at(level + 1, np.concatenate([who, who[up], who[down]]), np.concatenate([target, plus, minus]),
                        np.concatenate([state, np.ones(len(up), np.int8), np.full(len(down), 2, np.int8)])))


def _prefixes(keys: np.ndarray, spent: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, what is looked for, spent) of all ways to spend the budget in levels ``lo`` to ``hi``."""
    every, one, low = np.arange(len(keys)), np.uint64(1), np.uint64(15)

    def moved(target: np.ndarray, level: int, by: np.uint64) -> np.ndarray:
        shift = _SHIFT[level]
        return target & ~(low << shift) | ((target >> shift) + by & low) << shift

    yield every, keys, spent
    fresh, half = np.flatnonzero(spent == 0), np.flatnonzero(spent == 1)
    less = np.uint64(15)  # minus one, modulo 16
    for i in range(lo, hi):
        yield half, moved(keys[half], i, less), np.full(len(half), 2, np.int8)
        up = moved(keys[fresh], i, one)
        yield fresh, up, np.ones(len(fresh), np.int8)
        for j in range(i + 1, hi):
            yield fresh, moved(up, j, less), np.full(len(fresh), 2, np.int8)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _expanded(searches: DataFrame, lo: int, hi: int) -> DataFrame:
    """Searches (word, n, asked, spent) with every way to spend what is left of the budget in levels lo to hi, and the page they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = _SHIFT[hi - 1]
        for batch in batches:
            asked = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            spent = batch.column(3).to_numpy(zero_copy_only=False)
            for place, target, state in _prefixes(asked, spent, lo, hi):
                if len(place):
                    rows = batch.select([0, 1]).take(pa.array(place))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(_signed(target)), pa.array(state, pa.int8()), pa.array(_signed(target >> shift << shift))], names=["word", "n", "asked", "spent", "page"]
                    )

    return searches.select("word", "n", "asked", "spent").mapInArrow(run, "word binary, n bigint, asked bigint, spent tinyint, page bigint")


def _keyed(words: DataFrame) -> DataFrame:
    """(word, n, asked) with words as single-byte letters and the key of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            keys = Letters(held).keys() if held else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column(1), pa.array(_signed(keys))], names=["word", "n", "asked"])

    return words.select("word", "n").mapInArrow(run, "word binary, n bigint, asked bigint")


def _page_pairs(depth: int):
    """(word, near, near_n), both ways, of the stored and searching words of one part of the trie."""

    def run(table: pa.Table) -> pa.Table:
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        asked, spent = np.ascontiguousarray(table.column("asked").to_numpy()).view(np.uint64), table.column("spent").to_numpy()
        letters = Letters(words)
        stored, asking = np.flatnonzero(spent < 0), np.flatnonzero(spent >= 0)
        stored = stored[np.argsort(asked[stored], kind="stable")]
        keys = asked[stored]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for who, first, last in search(keys, asked[asking], spent[asking], depth):
            many = last - first
            a = np.repeat(asking[who], many)
            b = stored[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            near = letters.near(a, b)
            a, b = a[near], b[near]
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        own = letters.keys()
        twice = np.flatnonzero(own[a] == own[b])  # equal counts: either word finds the other, one of them is enough
        one = np.ones(len(a), bool)
        one[twice] = [words[x] < words[y] for x, y in zip(a[twice].tolist(), b[twice].tolist())]
        a, b = a[one], b[one]
        names = pa.array([w.decode("latin-1") for w in words], pa.string())
        of = np.concatenate([b, a])
        return pa.table({"word": names.take(pa.array(np.concatenate([a, b]))), "near": names.take(pa.array(of)), "near_n": pa.array(n[of], pa.int64())})

    return run


def near_pairs(words: DataFrame, page: int = PAGE) -> DataFrame:
    """(word, near, near_n): both directions of every two words that differ by one inserted, deleted or replaced letter."""
    keyed = written(_keyed(words), "word-keys")
    home = keyed.withColumn("spent", F.lit(0).cast("tinyint"))
    searches, found, old = home, [], []
    for depth in range(STEP, GROUPS + 1, STEP):
        reached = _expanded(searches, depth - STEP, depth)
        own = F.shiftleft(F.shiftright(F.col("asked"), 4 * (GROUPS - depth)), 4 * (GROUPS - depth))
        sizes = written(keyed.groupBy(own.alias("page")).agg(F.count(F.lit(1)).alias("words")), "page-sizes")
        aimed = written(small_or_salted(reached, sizes, ["page"], sizes.count(), how="inner"), "searches")
        if old:
            given_up(*old)
        old = [aimed]
        settled = F.col("words") <= page if depth < GROUPS else F.lit(True)
        found.append((depth, aimed.where(settled), own, sizes))
        if depth == GROUPS:
            break
        searches = aimed.where(~settled).select("word", "n", "asked", "spent")
        if searches.isEmpty():
            break
        found[-1] = (depth, written(aimed.where(settled), "settled-searches"), own, sizes)
    pairs = None
    for depth, asking, own, sizes in found:
        loads = asking.groupBy("page").agg(F.count(F.lit(1)).alias("asking"), F.first("words").alias("words"))
        blocks = loads.select("page", F.ceil(F.col("asking") / (SEARCHES * page)).cast("int").alias("q"), F.ceil(F.col("words") / page).cast("int").alias("s"))
        blocks = written(blocks, "page-blocks")
        count = blocks.count()
        place = lambda many: F.pmod(F.xxhash64("word"), many).cast("int")
        to = small_or_salted(asking.select("word", "n", "asked", "spent", "page"), blocks, ["page"], count, how="inner")
        to = to.withColumn("a", place(F.col("q"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        kept = keyed.select("word", "n", "asked", F.lit(-1).cast("tinyint").alias("spent"), own.alias("page"))
        kept = small_or_salted(kept, blocks, ["page"], count, how="inner").withColumn("b", place(F.col("s"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        names = ["word", "n", "asked", "spent", "page", "a", "b"]
        rooms = to.select(*names).unionByName(kept.select(*names)).groupBy("page", "a", "b")
        part = rooms.applyInArrow(_page_pairs(depth), "word string, near string, near_n bigint")
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs


def group_spellings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST_N, ratio: int = RATIO, drop_every: int = DROP_EVERY, page: int = PAGE
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``least`` occurrences or more."""
    words = written(vocabulary(docs, key, text, letters, drop_every).where(F.col("n") >= least), "vocabulary")
    best = near_pairs(words, page).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    tied = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.m") >= F.lit(ratio) * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"),
    )
    tied = written(tied.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    steps = written(tied.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "form-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "form-steps")
        given_up(steps)
        steps = doubled
        if steps.where("moved").isEmpty():
            break
    return tied.join(steps.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(documents(spark, sf_dir))
