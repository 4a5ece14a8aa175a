"""Language identification as inference in a mixture of languages.

A model holds, for each language, the likelihoods of hashed byte trigrams. A document's trigrams are
taken as draws from a mixture of languages; expectation-maximisation estimates the proportions.
Starting from all languages, those of negligible share are dropped, then the least one as long as
the penalised likelihood (half of PENALTY times the logarithm of the trigrams, for every further
language) does not fall. What is left is the document's language set; its largest share is
the prediction. Many documents are iterated at once on sparse arrays.

Training sums trigram counts per language in Spark; BUCKETS times the number of languages (at most
MOST_LANGUAGES) is the size of the model, whatever the size of the corpus.

Defined cases: a null text or one without a letter is ``und`` with score 0, so is every text if
nothing could be learned; rows with a null language teach nothing; equal shares go to the language
first in order; repeated rows count and are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import documents, with_fields
from tidewatch.llm.registry import query
from tidewatch.llm.textbytes import Texts, chunked

BUCKETS = 1 << 15
MOST_LANGUAGES = 256
ROUNDS, MORE_ROUNDS = 12, 6
PENALTY = 4.0
NEGLIGIBLE = 0.03
UNKNOWN = "und"
CHUNK = 1 << 18


def _letters() -> np.ndarray:
    """Each byte's stand-in: lower-case letters and bytes beyond ASCII as they are, anything else a blank."""
    table = np.full(256, 0x20, np.uint8)
    table[128:] = np.arange(128, 256)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_TABLE = _letters()


def trigram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, buckets, counts): each text's distinct trigram buckets, ascending."""
    t = Texts(texts)
    data = _TABLE[t.data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % BUCKETS
    blank = data == 0x20
    useful = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    firsts, buckets, counts, at = [0], [], [], 0
    for lo, n in zip((t.starts - 1).tolist(), t.lengths.tolist()):
        own = bucket[lo : lo + n][useful[lo : lo + n]]
        if len(own) > 2000:
            all_counts = np.bincount(own, minlength=BUCKETS)
            b = np.flatnonzero(all_counts)
            c = all_counts[b]
        else:
            b, c = np.unique(own, return_counts=True)
        buckets.append(b)
        counts.append(c)
        at += len(b)
        firsts.append(at)
    return np.array(firsts), np.concatenate(buckets), np.concatenate(counts)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # BUCKETS x languages


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.2) -> Model:
    """Trigram likelihoods of each language of the rows that name one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, run in chunked(batch.column(0), CHUNK):
                firsts, buckets, counts = trigram_counts(run)
                for k in range(len(run)):
                    own = held.setdefault(langs[first + k], np.zeros(BUCKETS, np.int64))
                    own[buckets[firsts[k] : firsts[k + 1]]] += counts[firsts[k] : firsts[k + 1]]
        for name, own in held.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(own[used], pa.int64())})

    taught = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").cast("binary").alias("t"), F.col(lang).cast("string").alias("l"))
    sums = taught.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(BUCKETS * MOST_LANGUAGES + 1).toPandas()  # the model: one number per bucket and language
    names = tuple(sorted(found["lang"].unique()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MOST_LANGUAGES} are meant to be told apart")
    table = np.zeros((BUCKETS, len(names)))
    column = {name: i for i, name in enumerate(names)}
    table[found["bucket"].to_numpy(int), found["lang"].map(column).to_numpy(int)] = found["n"].to_numpy(float)
    return Model(names, (table + smoothing) / (table + smoothing).sum(axis=0, keepdims=True) if names else table)


def _iterate(likelihood: np.ndarray, weight: np.ndarray, size: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of all texts at once: (shares, log-likelihoods). A share of 0 stays 0."""
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = np.add.reduceat(weight, starts)[:, None]
    for _ in range(rounds):
        joint = likelihood * np.repeat(share, size, axis=0)
        joint *= (weight / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    inside = np.log((likelihood * np.repeat(share, size, axis=0)).sum(axis=1)) * weight
    return share, np.add.reduceat(inside, starts)


def mixtures(model: Model, texts: list[bytes]) -> np.ndarray:
    """Each text's language shares after selection of its language set; rows of zeros where there is no trigram."""
    firsts, buckets, counts = trigram_counts(texts)
    out = np.zeros((len(texts), len(model.languages)))
    size = np.diff(firsts)
    some = np.flatnonzero(size)
    if not len(some) or not model.languages:
        return out
    likelihood, weight, n = model.likelihood[buckets], counts.astype(float), size[some]
    share, _ = _iterate(likelihood, weight, n, np.full((len(some), out.shape[1]), 1 / out.shape[1]), ROUNDS)
    share = np.where(share >= np.minimum(NEGLIGIBLE, share.max(axis=1, keepdims=True)), share, 0)
    share, fit = _iterate(likelihood, weight, n, share / share.sum(axis=1, keepdims=True), MORE_ROUNDS)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    per_language = 0.5 * PENALTY * np.log(np.add.reduceat(weight, starts) + 1)
    live = np.flatnonzero((share > 0).sum(axis=1) > 1)
    while len(live):
        rows = np.repeat(starts[live] - np.concatenate([[0], np.cumsum(n[live])[:-1]]), n[live]) + np.arange(n[live].sum())
        trial = share[live].copy()
        least = np.where(trial > 0, trial, 2).argmin(axis=1)
        trial[np.arange(len(live)), least] = 0
        trial, without = _iterate(likelihood[rows], weight[rows], n[live], trial / trial.sum(axis=1, keepdims=True), MORE_ROUNDS)
        better = without + per_language[live] >= fit[live]
        share[live[better]], fit[live[better]] = trial[better], without[better]
        live = live[better]
        live = live[(share[live] > 0).sum(axis=1) > 1]
    out[some] = share
    return out


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents' other columns with lang_pred, score (its share), languages and proportions of the set."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages doubles
    outputs = "lang_pred string, score double, languages array<string>, proportions array<double>"
    taken = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score", "languages", "proportions")]
    rows = docs.select(*[F.col(f"`{c}`") for c in taken], F.col(text).cast("string").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            named, score, sets, parts = [], [], [], []
            for _, part in chunked(batch.column(batch.num_columns - 1), CHUNK):
                shares = mixtures(m, part)
                for t, own in zip(part, shares):
                    if not own.any() or not _has_letter(t):
                        row = (UNKNOWN, 0.0, [], [])
                    else:
                        order = np.argsort(-own, kind="stable")[: int((own > 0).sum())]
                        row = (m.languages[order[0]], float(min(1.0, own[order[0]])), [m.languages[i] for i in order], own[order].tolist())
                    for to, value in zip((named, score, sets, parts), row):
                        to.append(value)
            columns = {c: batch.column(i) for i, c in enumerate(taken)}
            columns |= {"lang_pred": pa.array(named, pa.string()), "score": pa.array(score, pa.float64()), "languages": pa.array(sets, pa.list_(pa.string())), "proportions": pa.array(parts, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:-1], outputs))


def held_out(modulus: int, remainder: int) -> Column:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return crc % modulus == remainder


@query("op3_language_mixture")
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(3, 1)))
    found = predict(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")
