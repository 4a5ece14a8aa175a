"""Merkle trees over the sections and paragraphs of a text, with DataFrame functions only.

A text is cut into sections at blank lines, a section into paragraphs at line ends, a paragraph
into blocks of at most BLOCK code points. Blocks are the leaves; each node is the SHA-256 of its
kind and its children's digests. Equal roots mean equal texts, as the cuts lose nothing. Two trees
that differ are walked from the root: equal branches are skipped, differing ones name the edit.
Likeness of two fingerprints is the share of leaves they have in common, twice the common leaves
over the sum of both, each digest once.

Defined cases: a null text is the empty text, whose tree has one empty section; the likeness of two
trees is 1 if their roots are equal. Rows with the same doc_id are ordered by their text's hash, null
ids come last; an empty table gives an empty result; other input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import documents
from tidewatch.llm.registry import query
from tidewatch.operators.ordering import assign_buckets, cut_points

BLOCK = 64
ROWS_PER_BUCKET = 2000
MOST_BUCKETS = 16384
_PARAGRAPHS = "array<struct<digest:string,blocks:array<string>>>"


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """struct(root, sections: [struct(digest, paragraphs: [struct(digest, blocks: [digest])])])."""

    def paragraph(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), lambda b: F.sha2(b, 256))
        return _bind(blocks, lambda b: F.struct(_node("p", b).alias("digest"), b.alias("blocks")))

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, "\n"), paragraph)
        return _bind(paragraphs, lambda p: F.struct(_node("s", F.transform(p, lambda x: x["digest"])).alias("digest"), p.alias("paragraphs")))

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)
    return _bind(sections, lambda s: F.struct(_node("r", F.transform(s, lambda x: x["digest"])).alias("root"), s.alias("sections")))


def leaves(of: Column) -> Column:
    """The distinct leaf digests of a tree."""
    return F.array_distinct(F.flatten(F.transform(of["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["blocks"])))))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    both = F.size(leaves_a) + F.size(leaves_b)
    shared = F.size(F.array_intersect(leaves_a, leaves_b)) * 2 / both
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(shared.cast("double"))


def edits(pairs: DataFrame, before: str, after: str, keys: list[str]) -> DataFrame:
    """(keys, section, paragraph) of each paragraph place that differs between two texts of a row.

    Sections and paragraphs are compared place by place, from equal roots down: only differing
    branches are opened. A place that one side lacks differs.
    """
    trees = pairs.select(*keys, tree(F.col(before)).alias("a"), tree(F.col(after)).alias("b")).where(F.col("a.root") != F.col("b.root"))

    def opened(frame: DataFrame, a: str, b: str, name: str) -> DataFrame:
        places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
        at = frame.withColumn(name, F.explode(places))
        at = at.withColumns({"x": F.get(F.col(a), F.col(name)), "y": F.get(F.col(b), F.col(name))})
        return at.where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))

    sections = opened(trees.select(*keys, F.col("a.sections").alias("a"), F.col("b.sections").alias("b")), "a", "b", "section")
    sections = sections.select(*keys, "section", *[F.coalesce(F.col(f"{s}.paragraphs"), F.array().cast(_PARAGRAPHS)).alias(t) for s, t in (("x", "a"), ("y", "b"))])
    return opened(sections, "a", "b", "paragraph").select(*keys, "section", "paragraph")


def with_next(docs: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Each document with the text of the next one in descending key order; the last one's is the first.

    Documents are cut into key ranges, and a window runs inside each. The first document of a range
    is also sent to the range before it, so one shuffle of the texts suffices and no task sees all.
    """
    rows = docs.count()
    buckets = max(1, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))
    ranged = docs.withColumn("__key", F.col(key).cast("double"))
    points = cut_points(ranged, ["__key"], buckets)["__key"] if buckets > 1 else []
    ranged = assign_buckets(ranged, {"__key": ("__range", points)}).drop("__key").withColumn("__range", F.coalesce("__range", F.lit(-1)))
    tops = sorted((tuple(r) for r in ranged.groupBy("__range").agg(F.max(key)).collect()), reverse=True)
    if not tops:
        return docs.withColumn(out, F.lit(None).cast("string"))
    top_of = {own: top for own, top in tops}
    before = {own: earlier for (earlier, _), (own, _) in zip(tops, tops[1:])}
    spark = docs.sparkSession
    routes = [(own, top_of[own], to, 1) for own, to in before.items()] + [(tops[0][0], tops[0][1], tops[-1][0], 2)]
    route = spark.createDataFrame(routes, f"__own int, __top {dict(docs.dtypes)[key]}, __to int, __guest int")
    # At most MOST_BUCKETS + 1 rows, whatever the number of documents.
    sent = ranged.join(F.broadcast(route), (F.col("__range") == F.col("__own")) & F.col(key).eqNullSafe(F.col("__top")))
    guests = sent.select(*docs.columns, F.col("__to").alias("__range"), "__guest")
    own = ranged.select(*docs.columns, "__range", F.lit(0).alias("__guest"))
    order = Window.partitionBy("__range").orderBy(F.col("__guest") == 2, F.col(key).desc_nulls_last(), F.xxhash64(text), "__guest")
    return own.unionByName(guests).withColumn(out, F.lead(text).over(order)).where("__guest = 0").drop("__range", "__guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of whole texts."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = F.expr("length(text) div 2")
    pairs = with_next(plain, "doc_id", "text", "next")
    kept = F.substr(F.col("text"), F.lit(1), F.length("text") - half)
    pairs = pairs.withColumn("edited", F.concat(kept, F.substr(F.col("next"), F.lit(1), half)))
    trees = pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         *[tree(F.col(c)).alias(c) for c in ("text", "edited", "next")])
    flat = trees.select("doc_id", "n_chars", "edited_sha256", *[x for c in ("text", "edited", "next") for x in (F.col(f"{c}.root").alias(f"{c}_root"), leaves(F.col(c)).alias(f"{c}_leaves"))])
    near = lambda other: likeness(F.col("text_root"), F.col("text_leaves"), F.col(f"{other}_root"), F.col(f"{other}_leaves"))
    return flat.select("doc_id", "n_chars", "edited_sha256", F.col("text_root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
                       near("edited").alias("near_edited"), near("next").alias("near_next"))


def _tree_sql(text: str) -> str:
    blocks = f"list_transform(regexp_extract_all(p, '(?s).{{1,{BLOCK}}}'), lambda b: sha256(b))"
    paragraph = f"sha256('p' || array_to_string({blocks}, ''))"
    section = f"sha256('s' || array_to_string(list_transform(string_split(s, chr(10)), lambda p: {paragraph}), ''))"
    return f"sha256('r' || array_to_string(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {section}), ''))"


def _leaves_sql(text: str) -> str:
    return f"list_distinct(flatten(list_transform(string_split({text}, chr(10)), lambda p: regexp_extract_all(p, '(?s).{{1,{BLOCK}}}'))))"


def _near_sql(root: str, leaf: str) -> str:
    both = f"(len(text_leaves) + len({leaf}))"
    return f"CASE WHEN text_root = {root} THEN 1.0 WHEN {both} = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(text_leaves, {leaf})) / {both} END::DOUBLE"


OP4_SQL = f"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
paired AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS n FROM plain),
edited AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(n, 1, length(t) // 2) AS e FROM paired),
trees AS (SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, {_tree_sql('t')} AS text_root, {_tree_sql('e')} AS edited_root,
  {_tree_sql('n')} AS next_root, {_leaves_sql('t')} AS text_leaves, {_leaves_sql('e')} AS edited_leaves, {_leaves_sql('n')} AS next_leaves FROM edited)
SELECT doc_id, n_chars, edited_sha256, text_root AS fingerprint, edited_root AS edited_fingerprint,
  {_near_sql('edited_root', 'edited_leaves')} AS near_edited, {_near_sql('next_root', 'next_leaves')} AS near_next FROM trees
"""


@query("op4_merkle", OP4_SQL)
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
