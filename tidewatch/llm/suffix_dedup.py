"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Texts are parsed into phrases. A rolling hash of GRAM bytes is taken at every place; the trigger of
a LENGTH-byte string is its gram of least hash (the first of equals), so equal strings have their
trigger at the same place. Consecutive strings with one trigger make a phrase: the bytes they cover.
Neighbouring phrases overlap by LENGTH - 1 bytes, so every LENGTH-byte string starts in one phrase
and lies wholly in it, and what it shares with other documents is settled in the dictionary of
distinct phrases; the parse (which documents hold a phrase) carries the answer to all occurrences.

1. Each task parses its texts and keeps a phrase's least document; the others' phrases are covered.
   Phrases go to buckets by trigger gram.
2. A bucket sorts its phrases: a phrase of a smaller document covers all later ones. The first ones
   are the dictionary. Of those, only phrases that share a gram and SIDE bytes before or after it
   with another document's phrase can share a string with it: they are contested.
3. Contested phrases' bytes meet in buckets, where all their suffixes are sorted by the first LENGTH
   bytes (a suffix array of the bucket's dictionary); equal neighbours are equal strings, and the
   least document of each run covers the others. Grams with more than HOT_GRAM contested phrases
   are counted string by string instead, with combining aggregates, so none fills a task.
4. Texts with covered phrases are parsed once more and the covered bytes cut.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; documents with equal
ids do not cover each other; rows with a null id are left as they are and cover nothing; other
columns are kept, those named like an output replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import documents, marked, marks_of, with_fields, without, written
from tidewatch.llm.registry import query
from tidewatch.llm.textbytes import _VALUES, Texts, chunked, mixed, powers

LENGTH, GRAM, SIDE = 50, 12, 19
STRINGS = LENGTH - GRAM + 1
CHUNK = 1 << 18
PHRASES_HELD = 250_000
BYTES_PER_BUCKET = 2 << 20
ENTRIES_PER_BUCKET = 10_000
HOT_GRAM = 20_000
ALL = 32767
_PLACE = np.uint64((1 << 31) - 1)


class Parse:
    """Phrases of several texts: first and last string start, text number, phrase and gram hashes, side hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        t = self.texts = Texts(texts)
        data = t.data
        n = len(data) - LENGTH + 1
        if n <= 0:
            data = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
            n = len(data) - LENGTH + 1
        wide = data.astype(np.uint64)
        two = wide[:-1] | (wide[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        eight = four[:-4] | (four[4:] << np.uint64(32))
        grams = len(data) - GRAM + 1
        gram = mixed(mixed(eight[:grams]) + four[8 : 8 + grams] * np.uint64(0xD6E8FEB86659FD93))
        least = (gram & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span * 2 <= STRINGS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = STRINGS - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
        trigger = (least & _PLACE).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        long = t.lengths >= LENGTH
        np.add.at(inside, t.starts[long], 1)
        np.add.at(inside, t.ends[long] - LENGTH + 1, -1)
        valid = np.cumsum(inside)[:n] > 0
        change = trigger[1:] != trigger[:-1]
        begins, finishes = valid.copy(), valid.copy()
        begins[1:] &= ~valid[:-1] | change
        finishes[:-1] &= ~valid[1:] | change
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(finishes)
        self.text = np.searchsorted(t.ends, self.first, side="right")
        at = trigger[self.first]
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:-1])])
        ends = self.last + LENGTH

        def hashed(lo: np.ndarray, hi: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
            return mixed((sums[hi] - sums[lo]) * down[lo] + mixed(np.atleast_1d(np.asarray(salt, np.uint64))))

        self.gram = gram[at].view(np.int64)
        self.phrase = hashed(self.first, ends, ((ends - self.first) << 8) | (at - self.first)).view(np.int64)
        left, right = self.first <= at - SIDE, self.last >= at - SIDE
        self.left = np.where(left, (hashed(np.maximum(at - SIDE, 0), at + GRAM, 1) | np.uint64(1)).astype(np.uint32), 0).astype(np.int64)
        self.right = np.where(right, (hashed(at, np.minimum(at + GRAM + SIDE, len(data)), 2) | np.uint64(1)).astype(np.uint32), 0).astype(np.int64)

    def of(self, text: int) -> slice:
        return slice(*np.searchsorted(self.text, [text, text + 1]).tolist())


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


_PHRASE_COLUMNS = ("gram", "phrase", "doc", "side_left", "side_right")


def phrases(docs: DataFrame, buckets: int) -> DataFrame:
    """Per task and bucket: arrays of leading phrases, and of those known to be covered (known_phrase, known_doc)."""

    def flushed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, phrase, doc, left, right = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, phrase))
        gram, phrase, doc, left, right = (c[order] for c in (gram, phrase, doc, left, right))
        new = np.ones(len(phrase), bool)
        new[1:] = phrase[1:] != phrase[:-1]
        leader = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
        again = np.zeros(len(phrase), bool)
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1])
        lead, known = np.flatnonzero(new), np.flatnonzero(~new & ~again & (doc > leader))
        room = (mixed(gram.view(np.uint64), 9) % np.uint64(buckets)).astype(np.int64)
        lead, known = (x[np.argsort(room[x], kind="stable")] for x in (lead, known))
        used = np.unique(np.concatenate([room[lead], room[known]]))
        cut = lambda x: np.concatenate([np.searchsorted(room[x], used), [len(x)]])
        lead_at, known_at = cut(lead), cut(known)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = {"bucket": pa.array(used, pa.int64())}
        columns |= {name: _lists(c[lead], lead_at, k) for name, c, k in zip(_PHRASE_COLUMNS, (gram, phrase, doc, left, right), kinds)}
        columns |= {"known_phrase": _lists(phrase[known], known_at, pa.int64()), "known_doc": _lists(doc[known], known_at, pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, part in chunked(batch.column(1), CHUNK):
                p = Parse(part)
                parts.append((p.gram, p.phrase, ids[first + p.text], p.left, p.right))
                held += len(p.phrase)
                if held >= PHRASES_HELD:
                    yield flushed(parts)
                    parts, held = [], 0
        if held:
            yield flushed(parts)

    schema = "bucket bigint, " + ", ".join(f"{c} array<bigint>" for c in (*_PHRASE_COLUMNS, "known_phrase", "known_doc"))
    return docs.mapInArrow(run, schema)


_VERDICT = "doc bigint, phrase bigint, first smallint, last smallint, gram bigint, entries int"


def _flat(table: pa.Table, name: str) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]
    return np.concatenate(chunks) if chunks else np.zeros(0, np.int64)


def _verdicts(doc, phrase, first, last, gram=None, entries=None) -> pa.Table:
    n = len(doc)
    blank = lambda kind: pa.nulls(n, kind)
    return pa.table({
        "doc": pa.array(doc, pa.int64()), "phrase": pa.array(phrase, pa.int64()), "first": pa.array(np.broadcast_to(first, n), pa.int16()), "last": pa.array(np.broadcast_to(last, n), pa.int16()),
        "gram": blank(pa.int64()) if gram is None else pa.array(gram, pa.int64()), "entries": blank(pa.int32()) if entries is None else pa.array(entries, pa.int32()),
    })


def _contested(gram: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which phrases share gram and side with a phrase of another document."""
    out = np.zeros(len(gram), bool)
    some = np.flatnonzero(side)
    order = some[np.lexsort((doc[some], side[some], gram[some]))]
    if not len(order):
        return out
    new = np.ones(len(order), bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (side[order][1:] != side[order][:-1])
    starts = np.flatnonzero(new)
    least, most = doc[order][starts], doc[order][np.append(starts[1:], len(order)) - 1]
    out[order] = (least != most)[np.cumsum(new) - 1]
    return out


def settle_phrases(table: pa.Table) -> pa.Table:
    """One bucket's covered phrases (gram null) and contested ones (with the gram and its number of them)."""
    gram, phrase, doc, left, right = (_flat(table, c) for c in _PHRASE_COLUMNS)
    order = np.lexsort((doc, phrase, gram))
    gram, phrase, doc, left, right = (c[order] for c in (gram, phrase, doc, left, right))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])
    starts = np.flatnonzero(new)
    covered = np.flatnonzero(doc > doc[starts][np.cumsum(new) - 1]) if len(doc) else starts
    known_doc, known_phrase = _flat(table, "known_doc"), _flat(table, "known_phrase")
    g, p, d = gram[starts], phrase[starts], doc[starts]
    contested = np.flatnonzero(_contested(g, left[starts], d) | _contested(g, right[starts], d))
    g = g[contested]
    _, which, number = np.unique(g, return_inverse=True, return_counts=True)
    return pa.concat_tables([
        _verdicts(np.concatenate([doc[covered], known_doc]), np.concatenate([phrase[covered], known_phrase]), 0, ALL),
        _verdicts(d[contested], p[contested], 0, 0, g, number[which] if len(g) else g),
    ])


def phrase_bytes(rows: DataFrame) -> DataFrame:
    """(room, doc, phrase, content, hot) of the wanted phrases of each text; rows are (doc, t, wanted: [(phrase, gram, entries)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = np.asarray(batch.column(0)), batch.column(2)
            for start, part in chunked(batch.column(1), CHUNK):
                p = Parse(part)
                out: list[tuple] = []
                for k in range(len(part)):
                    own = p.of(k)
                    flat = wanted.slice(start + k, 1).flatten().flatten()
                    ask, gram, entries = (np.asarray(c) for c in flat)
                    place = np.searchsorted(ask_sorted := np.sort(ask), p.phrase[own])
                    hit = np.flatnonzero(ask_sorted[np.minimum(place, len(ask) - 1)] == p.phrase[own])
                    hit = hit[np.unique(p.phrase[own][hit], return_index=True)[1]] + own.start
                    back = np.argsort(ask)[np.searchsorted(ask_sorted, p.phrase[hit])]
                    for i, j in zip(hit.tolist(), back.tolist()):
                        out.append((int(gram[j]), int(ids[start + k]), int(ask[j]), p.texts.data[p.first[i] : p.last[i] + LENGTH].tobytes(), bool(entries[j] > HOT_GRAM)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                columns = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc", "phrase", "content", "hot"])

    return rows.mapInArrow(run, "gram bigint, doc bigint, phrase bigint, content binary, hot boolean")


def suffix_verdicts(table: pa.Table) -> pa.Table:
    """Covered string starts of one bucket's phrases, from the sorted suffixes of their bytes."""
    content = table.column("content").to_pylist()
    doc, phrase = (table.column(c).to_numpy() for c in ("doc", "phrase"))
    data = np.frombuffer(b"".join(content) + bytes(6), np.uint8)
    sizes = np.fromiter(map(len, content), np.int64, len(content))
    begins = np.cumsum(sizes) - sizes
    strings = sizes - LENGTH + 1
    entry = np.repeat(np.arange(len(content)), strings)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begins[entry] + offset
    rows = np.lib.stride_tricks.sliding_window_view(data, 56)[at].copy()
    rows[:, LENGTH:] = 0
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((doc[entry], *keys.T[::-1]))  # the suffix array, up to LENGTH bytes, then by document
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    owner = doc[entry][order]
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else owner
    covered = np.sort(order[owner > least])
    if not len(covered):
        return _verdicts(doc[:0], phrase[:0], 0, 0)
    run = np.ones(len(covered), bool)
    run[1:] = (covered[1:] != covered[:-1] + 1) | (entry[covered][1:] != entry[covered][:-1])
    a = covered[np.flatnonzero(run)]
    b = covered[np.append(np.flatnonzero(run)[1:], len(covered)) - 1]
    return _verdicts(doc[entry[a]], phrase[entry[a]], offset[a], offset[b])


def _hot_verdicts(entries: DataFrame) -> DataFrame:
    """As ``suffix_verdicts``, for phrases of grams too frequent for one task: string by string, in DataFrame terms."""
    strings = F.expr(f"transform(sequence(0, length(content) - {LENGTH}), o -> struct(cast(o as smallint) as o, substring(content, o + 1, {LENGTH}) as s))")
    rows = entries.select("doc", "phrase", F.inline(strings))
    least = rows.groupBy("s").agg(F.min("doc").alias("least"))
    return rows.join(least, "s").where("doc > least").select("doc", "phrase", F.col("o").alias("first"), F.col("o").alias("last"))


def cut_texts(rows: DataFrame, as_text: bool) -> DataFrame:
    """The rows (other columns, t, covered: [(phrase, first, last)]) with ``kept`` and ``spans`` for t and covered."""
    fields = rows.schema.fields[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = batch.column(batch.num_columns - 1)
            kept, spans = [], []
            for start, part in chunked(batch.column(batch.num_columns - 2), CHUNK):
                p = Parse(part)
                for k, text in enumerate(part):
                    flat = covered.slice(start + k, 1).flatten().flatten()
                    phrase, first, last = (np.asarray(c).astype(np.int64) for c in flat)
                    own = p.of(k)
                    order = np.argsort(p.phrase[own], kind="stable") + own.start
                    lo, hi = (np.searchsorted(p.phrase[order], phrase, side=s) for s in ("left", "right"))
                    which = np.repeat(np.arange(len(phrase)), hi - lo)
                    place = order[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
                    a = p.first[place] + first[which] - p.texts.starts[k]
                    b = np.minimum(p.first[place] + last[which], p.last[place]) + LENGTH - p.texts.starts[k]
                    depth = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
                    gone = np.cumsum(depth)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                    spans.append([{"start": x, "end": y} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())])
            body = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, body, pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))], names=[*[f.name for f in fields], "kept", "spans"])

    kind = "string" if as_text else "binary"
    return rows.mapInArrow(run, with_fields(fields, f"kept {kind}, spans array<struct<start:bigint,end:bigint>>"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """The documents' other columns with n_bytes, ``kept`` (bytes, or text without broken characters) and ``spans`` removed."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    whole = without(docs, ["n_bytes", "kept", "spans", "t", "covered"]).withColumn("t", body).drop(text)
    plain = whole.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), "t")
    total = plain.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(8, total // BYTES_PER_BUCKET)
    settled = phrases(plain.where(F.length("t") >= LENGTH), buckets).groupBy("bucket").applyInArrow(settle_phrases, _VERDICT)
    settled = written(settled, "phrase-verdicts")
    covered, contested = settled.where("gram is null").select("doc", "phrase", "first", "last"), settled.where("gram is not null")

    wanted = contested.groupBy("doc").agg(F.collect_list(F.struct("phrase", "gram", "entries")).alias("wanted"))  # at most a text's phrases
    some = marked(plain, "doc", marks_of(contested, "doc"))
    entries = written(phrase_bytes(some.join(wanted, "doc").select("doc", "t", "wanted")), "contested-phrases")
    rooms = max(1, entries.count() // ENTRIES_PER_BUCKET)
    normal = entries.where("not hot").withColumn("room", F.pmod(F.xxhash64("gram"), F.lit(rooms))).select("room", "doc", "phrase", "content")
    by_suffix = normal.groupBy("room").applyInArrow(suffix_verdicts, _VERDICT).select("doc", "phrase", "first", "last")
    covered = written(covered.unionByName(by_suffix).unionByName(_hot_verdicts(entries.where("hot"))), "covered-phrases")

    marks = marks_of(covered, "doc")
    per_doc = covered.groupBy("doc").agg(F.collect_list(F.struct("phrase", "first", "last")).alias("covered"))
    keyed = whole.withColumn("n_bytes", F.length("t").cast("bigint"))
    names = [c for c in keyed.columns if c != "t"]
    hit = marked(keyed, key, marks).join(per_doc, F.col(key) == per_doc["doc"], "left").drop("doc")
    none = F.array().cast("array<struct<phrase:bigint,first:smallint,last:smallint>>")
    cut = cut_texts(hit.select(*[F.col(f"`{c}`") for c in names], "t", F.coalesce("covered", none).alias("covered")), as_text)
    rest = marked(keyed, key, marks, hit=False)
    kept = F.col("t").cast("string") if as_text else F.col("t")
    untouched = rest.select(*[F.col(f"`{c}`") for c in names], kept.alias("kept"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return cut.unionByName(untouched)


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", gone.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
