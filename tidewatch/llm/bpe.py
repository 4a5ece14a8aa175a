"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut at added tokens, then by the tokenizer's word pattern. Each word is an array of
parts (their start offsets and ids) beside an array of the ranks of adjacent pairs. The smallest
rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed, until no
pair can merge. New words of one length take their steps together, as the rows of one matrix of ids and
one of ranks: each step takes one column from every word that still merges. Words beyond SHORT bytes,
where scans would be quadratic, take the same merges in the same order from a heap. Words repeat, so
each task keeps the results of recent ones.

Defined cases: null encodes as the empty text (no ids); any string has ids, as all 256 bytes are
in the vocabulary; repeated rows are encoded one by one; other input columns are kept, those named
like an output replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, types as T

from tidewatch.llm.common import documents, without
from tidewatch.llm.registry import query

SHORT = 96
CACHED_WORDS = 200_000
TOGETHER = 1 << 21  # characters of the texts that are encoded together
FEW = 12  # so few words of one length are merged one by one
NONE = 1 << 60
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_characters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in word) for word, i in vocab.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), len(self.merged))
            self.merged.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: word.encode() for word, i in self.added.items()})
        longest = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.words = regex.compile(WORDS)
        self.recent: dict[str, list[int]] = {}
        pairs = np.array([(a << 32 | b, rank) for (a, b), rank in self.pairs.items()], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0].argsort()]
        # The last key is of no pair, so that each search ends at a key.
        self.keys, self.ranks = np.append(pairs[:, 0], NONE), np.append(pairs[:, 1], NONE)
        self.merged_ids, self.bytes_as_ids = np.array(self.merged, np.int64), np.array(self.byte_ids, np.int64)
        self.names = {i: str(i) for i in self.bytes_of}

    # --- one word ---------------------------------------------------------------------------
    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """(start offsets, ids) of the word's parts."""
        ids = [self.byte_ids[b] for b in word]
        return self._by_heap(ids) if len(ids) > SHORT else self._by_scan(ids)

    def _by_scan(self, ids: list[int]) -> tuple[list[int], list[int]]:
        rank_of, starts = self.pairs.get, list(range(len(ids)))
        ranks = [rank_of(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            ids[i] = self.merged[low]
            del ids[i + 1], starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NONE)
        return starts, ids

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = self.keys.searchsorted(wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def _by_scans(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of one length, by the steps of ``_by_scan`` taken together."""
        found: list[list[int]] = [[]] * len(words)
        ids = self.bytes_as_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
        ranks, place = self._ranks_of(ids[:, :-1], ids[:, 1:]), np.arange(len(words))
        while ids.shape[1] > 1:
            i = ranks.argmin(axis=1)
            low = ranks[np.arange(len(i)), i]
            merges = low != NONE
            if not merges.all():
                for k, row in zip(place[~merges].tolist(), ids[~merges].tolist()):
                    found[k] = row
                ids, ranks, place, i, low = ids[merges], ranks[merges], place[merges], i[merges], low[merges]
                if not len(place):
                    return found
            n, width = ids.shape
            rows = np.arange(n)
            ids[rows, i] = self.merged_ids[low]
            stays = np.ones((n, width), bool)
            stays[rows, i + 1] = False
            ids = ids[stays].reshape(n, width - 1)
            ranks = ranks[stays[:, 1:]].reshape(n, width - 2)
            r = np.flatnonzero(i < width - 2)
            ranks[r, i[r]] = self._ranks_of(ids[r, i[r]], ids[r, i[r] + 1])
            r = np.flatnonzero(i)
            ranks[r, i[r] - 1] = self._ranks_of(ids[r, i[r] - 1], ids[r, i[r]])
        for k, row in zip(place.tolist(), ids.tolist()):
            found[k] = row
        return found

    def _by_heap(self, ids: list[int]) -> tuple[list[int], list[int]]:
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or self.pairs.get((ids[i], ids[j]), NONE) != rank:
                continue
            ids[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.pairs.get((ids[a], ids[b]), NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        starts = [i for i in range(n) if alive[i]]
        return starts, [ids[i] for i in starts]

    # --- whole texts ------------------------------------------------------------------------
    def _pieces(self, text: str) -> list[str]:
        """The words and added tokens of a text; no word is an added token, as those are cut out first."""
        if not self.split_added:
            return self.words.findall(text)
        out: list[str] = []
        at = 0
        for found in self.split_added.finditer(text):
            out += self.words.findall(text[at : found.start()])
            out.append(found[0])
            at = found.end()
        out += self.words.findall(text[at:])
        return out

    def _ids_of(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of new words."""
        by_length: dict[int, list[str]] = {}
        encoded = {word: word.encode() for word in words}
        for word, b in encoded.items():
            by_length.setdefault(len(b), []).append(word)
        out: dict[str, list[int]] = {}
        for length, alike in by_length.items():
            if length > SHORT or len(alike) < FEW:
                out.update((word, self.parts(encoded[word])[1]) for word in alike)
            else:
                out.update(zip(alike, self._by_scans([encoded[word] for word in alike])))
        return out

    def _encode_together(self, texts: list[str]) -> Iterator[list[int]]:
        pieces = [self._pieces(text) for text in texts]
        if len(self.recent) >= CACHED_WORDS:
            self.recent.clear()
        recent = self.recent
        new = self._ids_of({word for word in set(chain.from_iterable(pieces)) if word not in recent and word not in self.added})
        long = {word: new.pop(word) for word in [word for word in new if len(word) > SHORT]}
        recent.update(new)
        recent.update((token, [i]) for token, i in self.added.items())
        known = recent | long if long else recent
        for words in pieces:
            yield list(chain.from_iterable(map(known.__getitem__, words)))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order; texts of up to TOGETHER characters, or a longer one, at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text or "") > TOGETHER:
                yield from self._encode_together(held)
                held, size = [], 0
            held.append(text or "")
            size += len(text or "")
        yield from self._encode_together(held)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a file, read once per Python worker; the file is installed on every executor."""
    return Codec(path)


def _mapped(df: DataFrame, needs: list[str], outputs: list[tuple[str, T.DataType]], rows) -> DataFrame:
    """Adds columns computed from ``needs`` batch by batch; other columns pass through."""
    kept = without(df, [n for n, _ in outputs if n not in needs])
    schema = T.StructType([*(f for f in kept.schema.fields if f.name not in dict(outputs)), *(T.StructField(n, t) for n, t in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(*[batch.column(n).to_pylist() for n in needs])
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name not in made}
            yield pa.RecordBatch.from_pydict(columns | made)

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with the ids of their whole texts."""

    def rows(texts):
        return {ids: pa.array(list(codec(path).encode_all(texts)), pa.list_(pa.int32()))}

    return _mapped(docs, [text], [(ids, T.ArrayType(T.IntegerType()))], rows)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give a null text."""

    def rows(lists):
        return {text: pa.array([None if x is None else codec(path).decode(x) for x in lists], pa.string())}

    return _mapped(encoded, [ids], [(text, T.StringType())], rows)


def round_trip_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens, the digest of the ids and that of the text decoded from them, without sending ids to the JVM."""

    def rows(texts):
        c = codec(path)
        n, of_ids, of_text = [], [], []
        for ids in c.encode_all(texts):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)}

    outputs = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, [text], outputs, rows).drop(text)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
