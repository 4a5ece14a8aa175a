"""Operators made of column expressions: WARC derivatives, shards, Merkle trees, quality rules."""

import duckdb
import pytest
from compare import connect, differences
from helpers import LINE, awkward, empty, rows_of
from pyspark.sql import functions as F

from tidewatch.llm import merkle, quality_rules, sharding, warc
from tidewatch.llm.common import written
from tidewatch.llm.queries import load

RUNS, SQL = load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(RUNS[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


# --- WARC -----------------------------------------------------------------------------------
def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<html lang="de"><title>T &amp; U</title><p>x<b>y</b></p><a href="/q">z</a></html>'), (2, None, None)], "page_id int, url string, html string")
    responses = warc.page_responses(pages)
    found = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(responses).collect()}
    source = {r["target_uri"]: r for r in responses.collect()}
    assert len(found) == 4
    for response in source.values():
        meta, plain = found[response["record_id"], "metadata"], found[response["record_id"], "conversion"]
        assert meta["concurrent_to"] == plain["record_id"] and meta["refers_to_uri"] == response["target_uri"] == plain["refers_to_uri"]
        assert plain["content_length"] == len(plain["content"].encode()) and f"Content-Length: {plain['content_length']}" in plain["header"]
        assert all(line in meta["content"] for line in ("source-header: HTTP/1.1 200 OK", "source-payload-digest: " + plain["source_digest"]))
    a = found[source["http://a/"]["record_id"], "conversion"]
    assert a["content"] == "T & U\nxy\nz"
    b = found[source[None]["record_id"], "conversion"]
    assert b["content"] == "" and b["block_digest"] == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and "Target-URI" not in b["header"]
    meta = found[source["http://a/"]["record_id"], "metadata"]["content"]
    assert "title: T & U\r\n" in meta and "language: de\r\n" in meta and "outlink: /q\r\n" in meta


def test_unclosed_markup_ends_with_the_page(spark):
    rows = spark.createDataFrame([("<p>a<!-- b",), ("x <script>y",), ("a < b &lt;i&gt;<p",), (" \n ",)], "h string")
    assert [r[0] for r in rows.select(warc.plain_text(F.col("h"))).collect()] == ["a", "x", "a < b <i>", ""]


def test_rendered_record_has_header_blank_line_and_content(spark):
    pages = spark.createDataFrame([(1, "u", "<p>hi</p>")], "page_id int, url string, html string")
    text = [r[0] for r in warc.rendered(warc.derive(warc.page_responses(pages))).collect() if "conversion" in r[0]][0]
    head, body = text.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\nWARC-Type: conversion") and body == "hi\r\n\r\n"
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


# --- shards ---------------------------------------------------------------------------------
def test_shards_of_a_graph_with_a_hot_group(spark):
    nodes = spark.range(3000).select(F.col("id").alias("node"), (F.col("id") % 37 + 50).cast("bigint").alias("size"), F.when(F.col("id") < 1000, F.lit("hot")).when(F.col("id") < 1600, (F.col("id") % 200).cast("string")).alias("v"))
    nodes = written(nodes, "t")
    edges = written(sharding.equal_value_edges(nodes, "v"), "t")
    assert edges.groupBy("a").count().agg(F.max("count")).first()[0] < 200
    placed = sharding.balanced_shards(nodes.select("node", "size"), edges, shards=8).cache()
    loads = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert placed.count() == 3000 and len(loads) == 8 and max(loads) - min(loads) < 200
    assert placed.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("a"), (F.countDistinct("slot") == F.count("*")).alias("b")).where("not a or not b").isEmpty()
    together = placed.join(nodes.where("v <> 'hot'"), "node").groupBy("v").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert together < 10
    cut = sharding.cut_edges(edges, placed).first()
    assert cut["cut"] < cut["edges"] / 2


def test_groups_that_fit_stay_together(spark):
    """Group k has as many copies as SIZES[k]; the last is larger than a shard."""
    sizes = [2] * 40 + [20, 50, 100, 200, 700, 2400]
    values = [f"g{k}" for k, n in enumerate(sizes) for _ in range(n)] + [None] * 5000
    nodes = written(spark.createDataFrame([(i, 40 + i % 7 if v is None else 43, v) for i, v in enumerate(values)], "node bigint, size bigint, v string").repartition(5), "t")
    placed = sharding.grouped_shards(nodes, "v", shards=8).cache()
    loads = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert placed.count() == len(values) == placed.select("node").distinct().count() and max(loads) < 1.01 * min(loads)
    assert placed.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("a"), (F.countDistinct("slot") == F.count("*")).alias("b")).where("not a or not b").isEmpty()
    spread = {r["v"]: r["n"] for r in placed.join(nodes, "node").where("v is not null").groupBy("v").agg(F.countDistinct("shard").alias("n")).collect()}
    assert {v: n for v, n in spread.items() if n > 1} == {f"g{len(sizes) - 1}": 3}
    found = sharding.kept_together(nodes, "v", placed).first()
    assert (found["groups"], found["whole"]) == (len(sizes), len(sizes) - 1)


PAGE = """<html lang='de'><title>A &#38;lt; B &#x2019;</title><a href='/q'>x</a><a class=k href = /p?x=1&amp;y=2>y</a><!-- <a href="/no">n</a> --><script>'<a href="/no2">'</script>
<a data-href="/n2" href="/z&#38;k">z</a><p>it&#8217;s &#0; &#xD800; &#99999999; &amp;#65; &#; &#8; done</p>"""


def test_quoting_entities_and_hidden_links(spark):
    """Both quotes and none, blanks round the sign, numeric entities, nothing out of comments and scripts; equal to the SQL."""
    pages = spark.createDataFrame([(1, "http://a", PAGE)], "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1::BIGINT AS page_id, 'http://a' AS url, ? AS html", [PAGE])
    records = warc.derive(warc.page_responses(pages))
    assert not differences(records, con, warc.OP1_SQL)
    facts, text = [r["content"] for r in records.orderBy(F.desc("warc_type")).collect()]
    lines = facts.split("\r\n")
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: /q", "outlink: /p?x=1&y=2", "outlink: /z&k"]
    assert "language: de" in lines and "title: A &lt; B \u2019" in lines
    assert text.split("\n")[-1] == "it\u2019s \ufffd \ufffd &#99999999; &#65; &#; \x08 done"


def test_votes_through_shared_pieces(spark):
    """Against a plain count over all pairs: each node hears the others of a piece, divided by their number."""
    import random

    draw = random.Random(5)
    held = {(draw.randrange(60), piece) for piece in range(40) for _ in range(draw.choice([1, 2, 3, 30]))}
    held |= {(node, piece + 100) for node, piece in held if piece < 10}  # bundles of two pieces
    shard = {node: draw.randrange(4) for node in range(60)}
    sharding.HOT, old = 8, sharding.HOT
    links = sharding.bundled(written(spark.createDataFrame(sorted(held), "node bigint, piece bigint"), "t"))
    voters = spark.createDataFrame(sorted(shard.items()), "node bigint, shard int")
    got = {r["node"]: (r["all"], r["own"]) for r in sharding.heard(links, voters, 4).join(sharding.own_votes(links), "node").collect()}
    sharding.HOT = old
    members = {}
    for node, piece in held:
        members.setdefault(piece, set()).add(node)
    want = {}
    for them in members.values():
        for a in them if len(them) > 1 else ():
            for b in them - {a}:
                want.setdefault(a, {}).setdefault(shard[b], []).append(1 / (len(them) - 1))
    assert set(got) == set(want)
    for node, (votes, own) in got.items():
        heard = {s: (v - (own if s == shard[node] else 0)) / sharding.VOTE for s, v in enumerate(votes)}
        assert all(abs(heard.get(s, 0) - sum(want[node].get(s, []))) < 1e-6 for s in range(4))


def test_propagation_cuts_fewer_links(spark):
    """400 families of five that share pieces, one piece in every third node, units of equal values among them."""
    rows = [(i, 40 + i % 9, f"v{i if i % 7 else i // 70}", [i // 5 * 3, i // 5 * 3 + 1, 10**6 + i] + ([-1] if i % 3 == 0 else [])) for i in range(2000)]
    alike = {}
    rows = [(i, size if i % 7 else 40, v, alike.setdefault(v, links)) for i, size, v, links in rows] + [(5000 + i, 30 + i % 5, None, None) for i in range(500)]
    nodes = written(spark.createDataFrame(rows, "node bigint, size bigint, v string, links array<bigint>").repartition(4), "t")
    heads = nodes.where("v is not null").groupBy("v").agg(F.min("node").alias("node")).select("node")
    links = sharding.bundled(written(nodes.join(heads, "node").select("node", F.explode("links").alias("piece")), "t"))
    found = {}
    for rounds in (0, sharding.ROUNDS):
        placed = sharding.grouped_shards(nodes, "v", shards=8, rounds=rounds, links="links").cache()
        loads = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert placed.count() == 2500 and len(loads) == 8 and max(loads) < 1.01 * min(loads)
        assert placed.join(nodes, "node").where("v is not null").groupBy("v").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
        found[rounds] = sharding.cut_links(links, placed).first()
    assert found[0]["cut_votes"] > 0.8 * found[0]["votes"]
    assert found[sharding.ROUNDS]["cut_votes"] < 0.5 * found[sharding.ROUNDS]["votes"]


def test_shards_of_awkward_documents(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = RUNS["op2_label_shards"](spark, f"{tmp_path}/a")
    assert got.count() == 21 and got.where("shard is null or slot is null or size < 1 or text_crc32 < 0").isEmpty()
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert RUNS["op2_label_shards"](spark, f"{tmp_path}/e").count() == 0


# --- Merkle trees ---------------------------------------------------------------------------
def test_next_document_in_any_number_of_ranges(spark):
    for per_bucket in (2000, 3):
        merkle.ROWS_PER_BUCKET, old = per_bucket, merkle.ROWS_PER_BUCKET
        docs = spark.createDataFrame([(i * i, f"t{i}") for i in range(25)], "k bigint, t string")
        got = {r["k"]: r["n"] for r in merkle.with_next(docs, "k", "t", "n").collect()}
        merkle.ROWS_PER_BUCKET = old
        assert got == {i * i: f"t{(i - 1) % 25}" for i in range(25)}


def test_fingerprints_of_awkward_documents(spark):
    got = merkle.fingerprints(awkward(spark)).collect()
    assert len(got) == 21 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (50, 60)]
    assert len(set(same)) == 1 and len(same) == 3
    assert merkle.fingerprints(empty(spark)).count() == 0
    alone = merkle.fingerprints(awkward(spark).where("doc_id = 30")).first()
    assert alone["near_next"] == 1.0


def test_edits_are_located(spark):
    pair = spark.createDataFrame([(1, "a\nb\n\nc\nd", "a\nb\n\nc\nX"), (2, "same", "same"), (3, "", "new"), (4, "a\n\nb", "a")], "id int, x string, y string")
    assert rows_of(merkle.edits(pair, "x", "y", ["id"]), "id", "section", "paragraph") == [(1, 1, 1), (3, 0, 0), (4, 1, 0)]


# --- quality rules --------------------------------------------------------------------------
def _counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_of_awkward_documents(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(900, " ".join("a b c d e f g h".split() * 3), "en", "s1", 1, "", 0, ""), (901, "x " * 9, "en", "s1", 1, "", 0, ""), (902, LINE + " " + LINE, "en", "s", 1, "", 0, "")], awkward(spark).schema))
    got = quality_rules.judge(docs).collect()
    assert len(got) == 24
    for r in got:
        n, chars, symbols, lines, repeats = _counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_sketches_merge_by_adding(spark, sf_dir):
    counted = quality_rules.with_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    halves = [quality_rules.sketches(counted.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    keys = ["lang", "source", "metric", "bin"]
    merged = halves[0].unionByName(halves[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert merged.exceptAll(quality_rules.sketches(counted)).isEmpty()


def test_outliers_of_a_group_are_dropped_and_clean_documents_kept(spark):
    clean = [(i, f"{LINE} number {i} and some more words {i * 7}", "en", "s") for i in range(300)]
    loud = [(1000 + i, " ".join(w + "***" for w in LINE.split()) + f" {i}", "en", "s") for i in range(5)]
    got = quality_rules.judge(spark.createDataFrame(clean + loud, "doc_id int, text string, lang string, source string"))
    assert rows_of(got.where("not kept"), "doc_id") == [(1000 + i,) for i in range(5)]
    assert got.select("cut_level").distinct().first()[0] == "source"


def _long_words(i, plus):
    return " ".join(f"{'w' * (4 + (k + i) % 3 + plus)}{k:02}{i:04}" for k in range(40))


def test_a_groups_own_spread_decides_its_cuts(spark):
    rows = [(i, _long_words(i, 0), "en", "calm") for i in range(300)] + [(1000 + i, _long_words(i, 2), "en", "calm") for i in range(3)]
    spam = " ".join(f"{w}{k}***" for k, w in enumerate(LINE.split()))
    rows += [(2000 + i, _long_words(i, 0) if i % 3 else f"{spam} {i}", "en", "spammed") for i in range(300)]
    repeated = [f"{' '.join(f'a{k}b{i}' for k in range(60))} {' '.join(f'a{k}b{i}' for k in range(9))}" for i in range(2)]
    rows += [(3000 + i, t, "en", "calm") for i, t in enumerate(repeated)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(3))
    assert not any(got[3000 + i]["kept"] or got[3000 + i]["base_failed"] for i in range(2))
    assert all(got[2000 + i]["kept"] == (i % 3 > 0) and got[2000 + i]["cut_level"] == "source" for i in range(300))


def test_salted_joins_give_the_same_verdicts(spark, monkeypatch):
    from tidewatch.llm import common

    want = rows_of(quality_rules.judge(awkward(spark)), "doc_id", "kept", "cut_level", "length_cut")
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert rows_of(quality_rules.judge(awkward(spark)), "doc_id", "kept", "cut_level", "length_cut") == want
