"""A regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. For each class Spark sums count, vector and
outer products of the labelled rows; from these the driver, which holds only 2 x (1 + D + D*D)
numbers, makes class means and covariances. A covariance is shrunk towards the pooled one and that
towards its diagonal, and kept as the inverse of its Cholesky factor. A score is the logistic of the
difference of the classes' log densities (Mahalanobis distances and log determinants) and log priors.

Defined cases: a null text counts as empty and is scored as any other; labels that are null are left
out; repeated labels count as often as they occur; with a class missing, the score is the share of
label 1 (0.5 without labels); statistics are always finite; an empty table gives an empty result.
Input columns are kept, those named like an output replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import documents, with_fields, without, written
from tidewatch.llm.language import held_out
from tidewatch.llm.registry import query
from tidewatch.llm.textbytes import Texts, chunked

CUT = 0.7
SHRINK_TO_POOLED, SHRINK_TO_DIAGONAL = 0.1, 0.1
LEAST_VARIANCE = 1e-3
TEMPERATURE = 1.0
CHUNK = 1 << 18
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "letters", "capitals", "digits", "beyond_ascii", "stops", "loud", "symbols", "other_marks",
    "words_ending_in_symbols", "words_all_capitals", "repeated_next", "distinct_words", "commonest_word", "line_words", "repeated_lines", "letter_entropy",
)
D = len(STATISTICS)


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


_UPPER, _LOWER, _DIGIT = (_kind(bytes(range(a, b + 1))) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
_HIGH, _STOP, _LOUD, _SYMBOL = _kind(bytes(range(128, 256))), _kind(b".,;:"), _kind(b"!?"), _kind(b"#*$%&|<>")
_MARK = _kind(b"'\"()[]{}-_=+/\\@^~`")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; shares enter as the root of their value, counts as logarithms."""
    t = Texts(texts)
    w = t.words()
    n = len(texts)
    size, words = np.maximum(t.lengths, 1), np.maximum(w.count, 1)

    def share_of(table: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(table[t.data])])
        return np.sqrt((run[t.ends] - run[t.starts]) / size)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.text, weights=values, minlength=n) / words

    length = (w.ends - w.starts).astype(float)
    mean = per_word(length)
    spread = np.sqrt(np.maximum(0, per_word(length**2) - mean**2))
    marked = per_word(_SYMBOL[w.data[w.ends - 1]])
    ups, lows = (np.concatenate([[0], np.cumsum(k[w.data])]) for k in (_UPPER, _LOWER))
    shouted = per_word((ups[w.ends] - ups[w.starts] > 0) & (lows[w.ends] - lows[w.starts] == 0))
    hashes = w.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((hashes, w.text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.concatenate([starts, [len(order)]]))
    owner = w.text[order][starts] if len(order) else np.zeros(0, int)
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    lines, repeated = np.ones(n), np.zeros(n)
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x]
        lines[i], repeated[i] = max(1, len(own)), len(own) - len(set(own))
    entropy = np.zeros(n)
    for i, (a, b) in enumerate(zip(t.starts, t.ends)):
        c = np.bincount(t.data[a:b], minlength=256)
        p = c[c > 0] / max(1, b - a)
        entropy[i] = -(p * np.log(p)).sum()
    columns = [
        np.log1p(t.lengths), np.log1p(w.count), np.log1p(mean), np.log1p(spread), share_of(_LOWER), share_of(_UPPER), share_of(_DIGIT), share_of(_HIGH), share_of(_STOP),
        share_of(_LOUD), share_of(_SYMBOL), share_of(_MARK), np.sqrt(marked), np.sqrt(shouted), np.sqrt(per_word(same)), np.bincount(owner, minlength=n) / words,
        np.sqrt(most / words), np.log1p(w.count / lines), np.sqrt(repeated / lines), entropy,
    ]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False, out: str = "statistics") -> DataFrame:
    """The documents with their vector of statistics."""
    kept = [f for f in without(docs, [out]).schema.fields if keep_text or f.name != text]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").cast("binary").alias("__bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(part) for _, part in chunked(batch.column(batch.num_columns - 1), CHUNK)]
            flat = np.concatenate(found) if found else np.zeros((0, D))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, D), pa.int32()), pa.array(flat.ravel()))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, vectors], names=[*[f.name for f in kept], out])

    return rows.mapInArrow(run, with_fields(kept, f"{out} array<double>"))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior and log determinant term, mean, and inverse Cholesky factor; or a constant score."""

    constants: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constant_score: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant_score is not None:
            return np.full(len(x), self.constant_score)
        logs = [c - 0.5 * ((x - m) @ f.T).__pow__(2).sum(axis=1) for c, m, f in zip(self.constants, self.means, self.factors)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPERATURE, -500, 500)))


def train(labelled: DataFrame, label: str = "quality", vector: str = "statistics") -> Discriminant:
    """Fits the discriminant to rows of (vector, label 0 or 1); sums are made in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, D)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        width = total.shape[1]
        yield pa.RecordBatch.from_pydict({"k": np.repeat([0, 1], width), "i": np.tile(np.arange(width), 2), "v": total.ravel()})

    rows = labelled.where(F.col(label).isin(0, 1)).select(vector, F.col(label).cast("int").alias("label"))
    found = rows.mapInArrow(sums, "k bigint, i bigint, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + D + D * D))
    total[found["k"].to_numpy(int), found["i"].to_numpy(int)] = found["v"].to_numpy()
    n = total[:, 0]
    if not n.all():
        return Discriminant(np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D)), float(n[1] / n.sum()) if n.any() else 0.5)
    means = total[:, 1 : 1 + D] / n[:, None]
    scatter = total[:, 1 + D :].reshape(2, D, D) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    constants, factors = [], []
    for k in (0, 1):
        own = (1 - SHRINK_TO_POOLED) * scatter[k] / n[k] + SHRINK_TO_POOLED * pooled
        own = (1 - SHRINK_TO_DIAGONAL) * own + (SHRINK_TO_DIAGONAL * np.diag(own) + LEAST_VARIANCE) * np.eye(D)
        factor = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(factor))
        constants.append(math.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(constants), means, np.array(factors))


def classify(vectors: DataFrame, model: Discriminant, vector: str = "statistics", cut: float = CUT) -> DataFrame:
    """The rows with score and predicted instead of their vector."""
    taken = without(vectors, ["score", "predicted"])
    kept = [f for f in taken.schema.fields if f.name != vector]
    ordered = taken.select(*[F.col(f"`{f.name}`") for f in kept], vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, D))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= cut).astype("int32"))], names=[*[f.name for f in kept], "score", "predicted"])

    return ordered.mapInArrow(run, with_fields(kept, "score double, predicted int"))


def classify_texts(docs: DataFrame, model: Discriminant, text: str = "text", cut: float = CUT) -> DataFrame:
    """The documents with score and predicted, from their texts in one step."""
    kept = without(docs, ["score", "predicted"]).schema.fields
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").cast("binary").alias("__bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(statistics(part)) for _, part in chunked(batch.column(batch.num_columns - 1), CHUNK)]
            score = np.concatenate(found) if found else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= cut).astype("int32"))], names=[*[f.name for f in kept], "score", "predicted"])

    return rows.mapInArrow(run, with_fields(kept, "score double, predicted int"))


def taught_rows(vectors: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Vectors of the documents that labels may be learned from, with their label."""
    return vectors.where(~held_out(4, 2)).select("doc_id", "statistics").join(labels.select("doc_id", label).where(F.col(label).isNotNull()), "doc_id")


@query("op5_quality_discriminant")
def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(4, 2).alias("held_out"))
    vectors = written(with_statistics(docs), "statistics")
    model = train(taught_rows(vectors, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return classify(vectors, model)
