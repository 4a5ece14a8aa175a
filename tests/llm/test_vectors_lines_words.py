"""Whitening, line dedup and spelling groups against plain versions of the same."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from compare import connect, differences
from helpers import awkward, empty, rows_of, sha
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, spelling, whitening
from tidewatch.llm.queries import load

VECTORS = "vec_id bigint, embedding array<float>, label int, n string, whitened string, Component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, i, "clash", "clash", 7) for i, v in rows], VECTORS)


def whole(v):
    return [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]


def checked(spark, rows, components=32, atol=1e-8):
    """The operator's result beside eigenvectors of the plain covariance; returns the rows by id."""
    out = whitening.whiten(vectors(spark, rows), components=components).toPandas()
    sound = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in sound)
    x = np.array([whole(v) for _, v in sound if len(v) == d], dtype=object)
    n = len(x)
    total = x.sum(axis=0)
    exact = [[Fraction(int(sum((n * a - s) * (n * b - t) for a, b in zip(x[:, i], x[:, j]))), n**3) for j, t in enumerate(total)] for i, s in enumerate(total)]
    v = np.array([[float(e) for e in row] for row in exact])
    values, components_ = np.linalg.eigh(v)
    k = min(components, int((values > values.max() * d * 1e-15).sum()))
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, total)] for row in x])
    z = np.abs(centred @ components_[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]))
    got = out.sort_values(["vec_id", "component"], kind="stable")
    assert len(got) == n * k and set(got.n) == {n}
    order = np.argsort([-1 if i is None else i for i, v in sound if len(v) == d], kind="stable")
    got["vec_id"] = got.vec_id.fillna(-1)
    got = got.sort_values(["vec_id", "component"], kind="stable")
    np.testing.assert_allclose(np.abs(got.whitened.to_numpy().reshape(n, k)), z[order], atol=atol)
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total)) for i in order]
    assert [int(e) for e in got.deviation_exact[::k]] == want
    assert [None if np.isnan(e) else int(e) for e in got.deviation[::k]] == [w if w < 1 << 53 else (None if w >= 1 << 63 else int(float(w))) for w in want]
    np.testing.assert_allclose(got.explained.to_numpy()[:k], values[::-1][:k] / np.trace(v), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-6
    return got


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 9)) * np.linspace(0.3, 4, 9) + 100
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    checked(spark, rows)
    checked(spark, rows, components=4)


def test_whitening_defined_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 2, 4).astype(np.float32).tolist()) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    got = checked(spark, rows + odd + [(None, [0.5, 0.25, -1.0, 9.0])])
    assert not set(got.vec_id) & {100, 101, 102, 103, 104, 105}
    repeated = rows + [(i + 50, v) for i, v in rows[:7]]
    checked(spark, repeated)
    for nothing in ([], odd[:1], rows[:1], [rows[0], rows[0]]):
        assert whitening.whiten(vectors(spark, nothing)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 3.0, -1.0 * i]) for i in range(9)]  # rank one
    assert set(checked(spark, flat).component) == {1}


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [float(i % 3), float((-1) ** i) * 1e9 * (i + 1), 3e38 if i == 4 else float(i * i)]) for i in range(8)]
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    x = [[min(w - 1_000_000, 1 << 46) for w in whole(v)] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((8 * a - s) ** 2 for a, s in zip(v, total)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation_exact) for r in out.itertuples()} == want
    assert out.deviation.isna().sum() == sum(w >= 1 << 63 for w in want.values()) * out.component.nunique()


def test_factors_of_a_covariance():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 11)) * 10.0 ** rng.integers(-3, 3, 11)
    v = np.cov(a.T)
    order, low = whitening.pivoted_cholesky(v)
    assert np.allclose(low @ low.T, v[np.ix_(order, order)]) and np.allclose(low, np.tril(low))
    assert (np.diff(np.diag(low)) <= 0).all()
    g = whitening.orthogonal_columns(low)
    cross = g.T @ g
    norms = np.sqrt(np.diag(cross))
    assert np.abs(cross / np.outer(norms, norms) - np.eye(11)).max() < 1e-14
    np.testing.assert_allclose(np.sort(norms**2), np.linalg.eigvalsh(v), rtol=1e-9)


def test_whitening_query(spark, sf_dir):
    import pyarrow.parquet as pq

    held = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    out = load()[0]["op11_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    x = np.array([whole(v) for v in held["embedding"]], float)
    c = x - x.mean(axis=0)
    values, found = np.linalg.eigh(c.T @ c / len(x))
    z = c @ found[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    np.testing.assert_allclose(np.abs(out.whitened.to_numpy().reshape(-1, 32)), np.abs(z[np.argsort(held["vec_id"])]), atol=1e-6)


# --- lines ------------------------------------------------------------------------------------
def plain_lines(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    out = []
    for lines in split:
        kept = [x for x in lines if held[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


LINES = ["Same line\nown {i}\n same LINE\t", "\n\n", "  \x0bSAME line \r\nother", "É line\né line", "é line", "two\n{i}", "two", None, "", "x\x1c\nx", "a\n" * 500 + "same line"]


@pytest.mark.parametrize("least, batches, fanout", [(2, 1, 4), (3, 5, 2), (5, 7, 3), (10, 8, 4)])
def test_lines_equal_a_plain_count(spark, least, batches, fanout):
    texts = [t and t.format(i=i % 9) for i, t in enumerate(LINES * 4)]
    df = spark.createDataFrame([(i if i % 7 else None, t, "clash", "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, h string, kept string, `Lines` int")
    out = line_dedup.dedup_lines(df, least=least, batches=batches, fanout=fanout)
    assert rows_of(out.select("n_lines", "n_dropped", F.sha2("kept", 256).alias("s")), "n_lines", "n_dropped", "s") == sorted(plain_lines(texts, least), key=repr)


def test_lines_of_awkward_rows(spark):
    df = awkward(spark)
    out = line_dedup.dedup_lines(df, least=2)
    texts = [r.text for r in df.collect()]
    assert rows_of(out.select("n_lines", "n_dropped", F.sha2("kept", 256).alias("s")), "n_lines", "n_dropped", "s") == sorted(plain_lines(texts, 2), key=repr)
    assert out.select("__row.*").columns == df.columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_places_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", 0)
    monkeypatch.setattr("tidewatch.llm.common.BROADCAST_ROWS", 0)
    texts = ["same\n%d" % (i % 4) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = line_dedup.dedup_lines(df, least=6)
    assert rows_of(out.select("n_lines", "n_dropped", F.sha2("kept", 256).alias("s")), "n_lines", "n_dropped", "s") == sorted(plain_lines(texts, 6), key=repr)


def test_runs_stay_few_and_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark, least=3, fanout=3, buckets=4)
    batches = [spark.createDataFrame([(h, h, 1) for h in range(b, b + 40)], "h bigint, g bigint, docs bigint") for b in range(11)]
    for n, batch in enumerate(batches, 1):
        runs.add(batch)
        assert sum(runs.runs) <= 2 * (1 + int(np.log(n) / np.log(3)))
    name = next(held[0] for held in runs.levels if held)
    plan = spark.table(name).groupBy("h", "g").agg(F.sum("docs"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    held = Counter(h for b in range(11) for h in range(b, b + 40))
    assert sorted(r.h for r in runs.frequent().collect()) == sorted(h for h, n in held.items() if n >= 3)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_line_query_equals_its_sql(spark, sf_dir):
    runs, sql = load()
    assert not differences(runs["op12_line_dedup"](spark, sf_dir), connect(sf_dir), sql["op12_line_dedup"])


# --- words ------------------------------------------------------------------------------------
def plain_groups(texts, letters=7, least=2, ratio=10, every=31):
    held = Counter()
    for i, t in texts:
        lowered = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                held[run] += 1
    n = {w: k for w, k in held.items() if k >= least}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n), key=repr)


WORD_COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def word_table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id bigint, text string, word string, `N` int")


@pytest.mark.parametrize("page", [1, 3, 40, 20_000])
def test_spellings_equal_a_plain_search(spark, page):
    rng = np.random.default_rng(8)
    alphabet = "abcdeimnorstéüÿ×"
    words = ["".join(rng.choice(list(alphabet), rng.integers(6, 11))) for _ in range(25)]
    said = []
    for w in words:
        said += [w] * int(rng.integers(1, 40))
        for _ in range(int(rng.integers(0, 14))):  # edits, some of them edited again
            v = w
            for _ in range(int(rng.integers(1, 3))):
                k, c = int(rng.integers(0, len(v))), str(rng.choice(list(alphabet)))
                v = [v[:k] + v[k + 1 :], v[:k] + c + v[k:], v[:k] + c + v[k + 1 :]][int(rng.integers(0, 3))]
            said += [v] * int(rng.integers(1, 4))
    said += ["aaaaaaa", "aaaaaaaa", "baaaaaaa", "abaaaaaa"] * 3 + ["abcdefg", "bacdefg", "abcdegf"] * 2 + ["x" * 40, "x" * 41, "x" * 24 + "y" + "x" * 16] * 2
    rng.shuffle(said)
    texts = [(i, " ".join(said[i::12]).replace("m", "M")) for i in range(12)] + [(None, "Strasse1strasse strassen"), (50, None), (51, ""), (52, "STRASSE;Strasse;ÀÉtrange ÀÉtrange")]
    texts += texts[:2]
    got = rows_of(spelling.group_spellings(word_table(spark, texts), page=page), *WORD_COLUMNS)
    assert got == plain_groups(texts)
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got) is any(r[5] not in (r[0], r[3]) for r in plain_groups(texts))


def test_forms_lead_to_their_root(spark):
    chain = ["letters" * 2] * 400 + ["letters" * 2 + "a"] * 30 + ["letters" * 2 + "ab"] * 2 + ["another" * 2] * 5
    texts = [(1, " ".join(chain))]
    got = {r.word: (r.form, r.root) for r in spelling.group_spellings(word_table(spark, texts), drop_every=1 << 40).collect()}
    assert got["letters" * 2 + "ab"] == ("letters" * 2 + "a", "letters" * 2) and got["another" * 2] == (None, "another" * 2)


def test_words_of_awkward_rows(spark):
    long = "q" * 70_000
    texts = [(r.doc_id, r.text) for r in awkward(spark).collect()] + [(900, f"{long} {long}a {long} {long}a {long[:-1]}b {long[:-1]}b")]
    assert rows_of(spelling.group_spellings(word_table(spark, texts), page=50), *WORD_COLUMNS) == plain_groups(texts)
    assert spelling.group_spellings(empty(spark)).count() == 0
    assert spelling.group_spellings(word_table(spark, [(1, "no long word")])).count() == 0


def test_spelling_query_equals_a_plain_search(spark, sf_dir):
    import pyarrow.parquet as pq

    held = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert rows_of(load()[0]["op13_spelling"](spark, sf_dir), *WORD_COLUMNS) == plain_groups(list(zip(held["doc_id"], held["text"])))
