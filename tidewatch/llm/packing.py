"""Packing token pieces into windows by best-fit decreasing.

A document's ids, with an end id, are cut into full windows and one remainder. Remainders go, by
a hash, to groups of bounded size; each group places its pieces in order of falling length, every
one into the open window with the least room that still fits. A segment tree indexed by remaining
room finds that window in log(window) steps. Groups are independent, so any number of tasks share
the work, and a group leaves only its last few windows partly filled.

Defined cases: a null text is empty and still has its end id; repeated documents give repeated
pieces; ties in length are ordered by document and start; an empty table gives an empty result.
Other columns of the documents are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import documents, written
from tidewatch.llm.registry import query

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 4096
KEPT_RUNS = 500_000
END_OF_WORD = "</w>"
RUNS = re.compile(rb"[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff\s]+")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class WordEncoder:
    """Little-endian 32-bit ids of texts; each distinct word is encoded once and kept.

    The tokenizer drops white space and takes runs of letters apart from all else, so a text's ids
    are those of its letter runs and of the runs between. All new letter runs are encoded in one call
    and told apart by their end-of-word tokens. A text with a run that the tokenizer might join to its
    neighbour (an apostrophe, a non-ASCII mark, an added token) is encoded block by block instead.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = word.endswith(END_OF_WORD)
        self.runs: dict[bytes, bytes] = {}
        self.odd: set[bytes] = set()

    def _each(self, blocks: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([b.decode() for b in blocks], add_special_tokens=False)
        return {b: array("I", x.ids).tobytes() for b, x in zip(blocks, found)}

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs of letters."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(cuts) != len(words):  # a letter that the tokenizer's Unicode tables lack
            return self._each(words)
        flat = ids.tobytes()
        return {word: flat[lo:hi] for word, lo, hi in zip(words, [0, *cuts], cuts)}

    def _learn(self, fresh: set[bytes]) -> None:
        words, marks = [], []
        for run in fresh:
            if run[0] < 0x80 and not run[:1].isalpha():
                (self.odd.add if b"'" in run else marks.append)(run)
            elif run.isalpha() or run.decode().lower().isalpha():
                words.append(run)
            else:
                self.odd.add(run)
        if words:
            self.runs.update(self._words(words))
        if marks:
            self.runs.update(self._each(marks))

    def buffers(self, texts: list[str | None], kept_runs: int = KEPT_RUNS) -> list[bytes]:
        encoded = [(t or "").encode() for t in texts]
        if len(self.runs) + len(self.odd) > kept_runs:
            self.runs.clear()
            self.odd.clear()
        rows = [RUNS.findall(b) for b in encoded]
        known, odd = self.runs, self.odd
        fresh = set(filterfalse(known.__contains__, chain.from_iterable(rows))) - odd
        if fresh:
            self._learn(fresh)
        out = []
        for text, row in zip(encoded, rows):
            if (odd and not odd.isdisjoint(row)) or any(a in text for a in self.added):
                blocks = text.split()
                ids = self._each(list(set(blocks)))
                out.append(b"".join(map(ids.__getitem__, blocks)))
            else:
                out.append(b"".join(map(known.__getitem__, row)))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_buffers(texts: list[str | None], path: str, kept_runs: int = KEPT_RUNS) -> list[bytes]:
    """Little-endian 32-bit ids of each text, as the tokenizer file gives them."""
    return _encoder(path).buffers(texts, kept_runs)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, kept_runs: int = KEPT_RUNS) -> DataFrame:
    """Full windows and the remainder of each document; ``with_ids`` adds the ids themselves.

    ``kept_runs`` bounds the words a Python worker keeps: more of them save time, fewer save memory.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), token_buffers(part.column(1).to_pylist(), path, kept_runs)):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[start * 4 : (start + window) * 4]
                        row = (doc, start, len(own) // 4, zlib.crc32(own), total)
                        rows.append((*row, np.frombuffer(own, "<u4").astype("int32")) if with_ids else row)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                if with_ids:
                    names, columns = [*names, "ids"], [*columns, pa.array([r[5] for r in rows], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining room: a segment tree of counts over the rooms 0 to ``window``."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.at[room].append(which)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of pieces given in falling order of length."""
    where, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    open_windows, made = OpenWindows(window), 0
    for k, need in enumerate(lengths.tolist()):
        found = open_windows.take_tightest(need)
        if found is None:
            found, made = (window, made), made + 1
        room, which = found
        where[k], offset[k] = which, window - room
        if room > need:
            open_windows.add(room - need, which)
    return where, offset


def pack(found: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``found`` is counted and read again: pass a written table."""
    groups = max(1, -(-found.count() // group_pieces))
    keyed = found.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit(rows["length"].to_numpy(), window)
        base = int(rows["__group"].iloc[0]) << 32
        return rows.drop(columns="__group").assign(sequence_id=base + where, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id bigint, offset bigint"
    return keyed.groupBy("__group").applyInPandas(place, schema)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(found, "pieces"))
