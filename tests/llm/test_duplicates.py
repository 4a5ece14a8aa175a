"""Near-duplicate groups and repeated byte strings against brute force."""

import random

import pytest
from helpers import LINE, awkward, empty, groups_by_brute_force, repeats_by_brute_force
from pyspark.sql import functions as F

from tidewatch.llm import graph, jaccard_join, suffix_dedup
from tidewatch.llm.queries import load

RUNS, _ = load()


def _edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def _corpus(seed, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [_edited(base, rng.randrange(8), rng) for _ in range(copies)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [LINE + " " + " ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        chain[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    texts += texts[:15] + ["", "   ", "one", "one", "ONE", "one two", None]
    rng.shuffle(texts)
    return {i * 3: t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("words", "num", "seed", "block"), [(3, 90, 1, 20_000), (5, 80, 2, 20_000), (3, 70, 3, 7)])
def test_groups_equal_brute_force(spark, words, num, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = _corpus(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, words, num, 100).collect()}
    assert got == groups_by_brute_force(texts, words, num, 100)


def test_groups_of_awkward_documents(spark):
    got = {(r["doc_id"], r["component_id"]): r["n_shingles"] for r in jaccard_join.near_duplicates(awkward(spark)).collect()}
    assert got[60, 50] == got[50, 50] == 18 and got[80, 50] == 18 and (100, 90) in got and got[0, 0] == got[10, 10] == got[20, 20] == 0
    assert (None, None) in got
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_registered_groups_equal_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["component_id"] for r in RUNS["op8_jaccard_join"](spark, sf_dir).collect()}
    assert got == groups_by_brute_force(texts, 3, 90, 100)


@pytest.mark.parametrize("block", [4_000, 5])
def test_buckets_that_joined_too_early_are_looked_at_again(spark, block, monkeypatch):
    """With empty bitmaps every pair looks alike, so exactness rests on the second look alone."""
    monkeypatch.setattr(jaccard_join, "_bitmap", lambda tokens: bytes(8))
    monkeypatch.setattr(jaccard_join, "EXACT_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT_TOKEN", block)
    texts = _corpus(4, copies=12)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, 3, 90, 100).collect()}
    assert got == groups_by_brute_force(texts, 3, 90, 100)


@pytest.mark.parametrize("num", [70, 80, 90])
def test_sets_on_the_boundary_are_linked(spark, num):
    """Every two sizes up to 60 at the least overlap that links them, and at one token less.

    One word a shingle, so sizes and overlaps are what is asked for; each pair has words of its own.
    """
    texts, want, k = {}, {}, 0
    for n in range(1, 61):
        for m in range(-(-n * num // 100), n + 1):
            least = -(-(n + m) * num // (100 + num))
            for common in (least, least - 1):
                if not 0 < common <= m or (n == m == common):
                    continue
                word = lambda side, i: f"{side}{k}x{i}"  # noqa: B023, E731
                shared = [word("c", i) for i in range(common)]
                texts[2 * k] = " ".join(shared + [word("a", i) for i in range(n - common)])
                texts[2 * k + 1] = " ".join(shared + [word("b", i) for i in range(m - common)])
                linked = common * 100 >= num * (n + m - common)
                want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if linked else 2 * k + 1}
                k += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, 1, num, 100).collect()}
    assert got == want and any(i != c for i, c in want.items())
    assert any(len(texts[i].split()) == 10 and len(texts[i + 1].split()) == 9 and want[i + 1] == i for i in range(0, 2 * k, 2)) is (num <= 90)


def test_a_text_and_its_beginning(spark):
    """Sets of ten and nine shingles at 90 %."""
    texts = {}
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(12)]
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join(words[:11])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, 3, 90, 100).collect()} == {i: i - i % 2 for i in texts}


def test_lists_never_shorten_as_sets_grow():
    for num in range(50, 100):
        k = [jaccard_join.shared_least(n, num, 100) for n in range(1, 400)]
        assert k == sorted(k) and all(jaccard_join.listed(n, num, 100) <= n for n in range(400))


def test_of_each_group_one_row_stays(spark):
    rng = random.Random(9)
    text = [rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(99)) for _ in range(60)]
    near, far, other = " ".join(text[:-1]), " ".join(text[::-1]), " ".join(sorted(text))
    base = " ".join(text)
    rows = [(1, base), (2, near), (2, far), (3, base), (3, base), (4, far), (5, other), (5, other), (6, ""), (6, ""), (None, base), (None, base), (7, None), (8, near + " x"), (9, far), (9, other + " y"), (10, ""), (10, near)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, component_id string, rows int")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, base), (2, far), (5, other), (6, ""), (6, ""), (None, base), (None, base), (7, None), (10, "")], key=repr)
    assert jaccard_join.keep_one(docs).columns == docs.columns
    assert jaccard_join.keep_one(docs.where("doc_id < 0")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def _strings(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    out = {}
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(40, len(p))], word()]
        out[i * 2] = " ".join(parts).encode()
    out |= {500: b"z" * 200, 502: b"z" * 130, 504: b"ab" * 90, 506: b"ba" * 80, 508: b"", 510: b"short", 512: out[0], 514: out[0] + out[2], 516: bytes(60), 518: bytes(70), 520: "é".encode() * 60, 522: b"x" + "é".encode() * 40}
    return out


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 20_000, 1 << 18), (2, 0, 700), (3, 20_000, 300)])
def test_repeats_equal_brute_force(spark, seed, hot, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_GRAM", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "PHRASES_HELD", 50 if chunk < 1000 else 250_000)
    texts = _strings(seed)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == repeats_by_brute_force(texts)


def test_repeats_of_awkward_documents(spark):
    docs = awkward(spark)
    got = suffix_dedup.remove_repeats(docs, as_text=True).collect()
    kept = {}
    for r in got:
        kept.setdefault(r["doc_id"], []).append(r["kept"])
    assert len(got) == 21 and kept[0] == [""] and kept[50] == [LINE, LINE] and kept[60] == [""] and kept[70] == [" today"] and kept[100] == [""]
    assert kept[None] == [LINE + " nobody"]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    assert not [r for r in got if any("�" in k for k in kept[r["doc_id"]])]


def test_registered_repeats_equal_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") < 10**9).collect()}
    got = {r["doc_id"]: r for r in RUNS["op7_suffix_dedup"](spark, sf_dir).collect()}
    for i, (kept, spans) in repeats_by_brute_force(texts).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(texts[i]), len(texts[i]) - len(kept), len(spans))
