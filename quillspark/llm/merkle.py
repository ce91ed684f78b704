"""Merkle manifest of a dataset, over nested intervals of leaf ranks.

Every row is a leaf: the digest of chosen columns in a form that tells nulls and
values apart.  Leaves of a group (a tree) are ranked; every ``FAN`` nodes in a row
become one above them, until one is left.  The trees' roots, ordered by group, are
the leaves of a last tree, whose root stands for the dataset.

A node is ``(tree, level, lo, hi, digest)``: it covers the leaf ranks ``lo`` to
``hi``, so intervals nest.  Levels are joined downwards by containment, bucketed by
the parent's place (``lo`` divided by the parent's width): a node's siblings are the
nodes of its level inside the parent's interval but outside its own, told apart as
before and after it.  The path from a node to the root is one array, built once for
every parent and passed on to its children, so leaves meet one table an eighth of
their number, whatever the height of the tree.

Ranks come from a range partitioning that cuts inside trees, with the rows of each
part counted, so no tree gathers in one task.  A level is an aggregate of at most
``FAN`` rows a key.  Levels are written to the shared folder; the driver sees one
number, the size of the largest tree.

Nulls in any column have their own leaf form, a null group is a tree of its own and
the first; empty and very long texts are values like others.  Rows of equal order
key are ranked by their digest, and repeated rows are leaves each, so the result does
not depend on the order of the input.  An empty table gives no rows.  Columns to keep
are passed on packed in ``row``, so their names clash with none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

#: Nodes that become one node of the next level.
FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field_form(value: Column) -> Column:
    """``-`` for null, otherwise the UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_form, values)), 256)


def _tree_key(group: Column) -> Column:
    """A string that sorts bytewise as the group does, null first and apart from the empty string."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0 within ``tree``) and ``size``, the tree's number of rows.

    Rows lie in parts by range, each part sorted; a row's rank is its place in the
    part after the rows of its tree in earlier parts.
    """
    place = F.monotonically_increasing_id()
    parts = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("place", place)
    parts = materialize(parts.withColumn("part", F.shiftright("place", 33)), "merkle-parts")
    held = parts.groupBy(tree, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = f"coalesce(sum(n) OVER (PARTITION BY {tree} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    starts = held.selectExpr(tree, "part", f"{before} - first AS shift", f"sum(n) OVER (PARTITION BY {tree}) AS size")
    return parts.join(starts, [tree, "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def build_levels(leaves: DataFrame) -> list[DataFrame]:
    """Nodes ``(tree, size, lo, hi, digest)`` of every level; the first is ``leaves``, with what else they carry."""
    levels = [leaves]
    largest, width = leaves.agg(F.max("size")).first()[0] or 0, 1
    while width < largest:
        wider = width * FAN
        runs = levels[-1].where(F.col("size") > width).groupBy("tree", "size", F.expr(f"lo div {wider}").alias("bucket"))
        merged = runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "digest"))).alias("run"))
        levels.append(materialize(merged.select("tree", "size", "lo", "hi", F.sha2(F.array_join("run.digest", ""), 256).alias("digest")), "merkle-level"))
        width = wider
    return levels


def _whole() -> Column:
    """Whether a node covers its tree; smaller trees end at lower levels, so each has one such node."""
    return (F.col("lo") == 0) & (F.col("hi") == F.col("size") - 1)


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``(tree, digest)``: the root of every tree."""
    found = [level.where(_whole()).select("tree", "digest") for level in levels]
    return reduce(DataFrame.unionByName, found)


def _by_place(left: Column, right: Column) -> Column:
    return F.signum(left["lo"] - right["lo"]).cast("int")


def _attach(children: DataFrame, above: DataFrame, width: int) -> DataFrame:
    """Every child with ``path``: its siblings, then the path of the node that contains it; and with that node's ``ends``.

    ``above(tree, lo, hi, path, ends)`` are nodes that cover ``width`` leaves each; the
    join is by their bucket and keeps what lies inside their interval.
    """
    bucket = F.expr(f"lo div {width}")
    extra = [c for c in children.columns if c not in ("tree", "size", "lo", "hi", "digest")]
    packed = F.struct("lo", "hi", "digest", F.struct("size", *extra).alias("rest"))
    runs = children.groupBy(F.col("tree").alias("its"), bucket.alias("run")).agg(F.array_sort(F.collect_list(packed), _by_place).alias("inside"))
    parents = above.select("tree", bucket.alias("bucket"), F.col("lo").alias("first"), F.col("hi").alias("last"), "path", "ends")
    met = parents.join(runs, (F.col("tree") == F.col("its")) & (F.col("bucket") == F.col("run")))
    contained = F.filter("inside", lambda x: (x["lo"] >= F.col("first")) & (x["hi"] <= F.col("last")))
    held = met.select("tree", "path", "ends", contained.alias("inside"))
    each = held.select("*", F.explode("inside").alias("own"))
    side = lambda where: F.array_join(F.transform(F.filter("inside", where), lambda x: x["digest"]), "")
    step = F.struct(side(lambda x: x["hi"] < F.col("own.lo")).alias("before"), side(lambda x: x["lo"] > F.col("own.hi")).alias("after"))
    return each.select("tree", "own.lo", "own.hi", "own.digest", "own.rest.*", F.concat(F.array(step), "path").alias("path"), "ends")


def attach_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path`` and ``ends``, from ``tops(tree, path, ends)`` of the trees' roots."""
    found, width = None, FAN ** (len(levels) - 1)
    for k in reversed(range(len(levels))):
        start = levels[k].where(_whole()).join(tops, "tree")
        if found is not None:
            start = start.unionByName(_attach(levels[k].where(F.col("size") > width), found, width * FAN))
        found = materialize(start.select("tree", "lo", "hi", "path", "ends"), "merkle-paths") if k else start
        width //= FAN
    return found


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: list[str], seen: Column | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, packed) with ``leaf``, ``subroot``, ``root``, ``path`` and ``seen``.

    Leaves digest ``fields``, form a tree for each value of ``group`` and ascend by
    ``order``.  ``seen`` is the leaf that a verifier computes where it isn't null,
    otherwise the leaf itself.
    """
    name = lambda c: F.col(f"`{c}`")
    digest = leaf_digest([name(c) for c in fields])
    other = F.lit(None).cast("string") if seen is None else seen
    packed = rows.select(_tree_key(name(group)).alias("tree"), name(order).alias("by"), digest.alias("digest"), other.alias("seen"), F.struct(*map(name, keep)).alias("row"))
    placed = ranked(materialize(packed, "merkle-leaves"), "tree", ["by", "digest"])
    leaves = materialize(placed.select("tree", "size", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", "seen", "row"), "merkle-ranked")
    levels = build_levels(leaves)

    roots = materialize(roots_of(levels).select(F.lit("").alias("forest"), "tree", "digest"), "merkle-subroots")
    top = ranked(roots, "forest", ["tree"]).select(F.col("forest").alias("tree"), "size", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", F.col("tree").alias("its_tree"), F.col("digest").alias("subroot"))
    top_levels = build_levels(materialize(top, "merkle-forest"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    summit = roots_of(top_levels).select("tree", none.alias("path"), F.col("digest").alias("ends"))
    tops = attach_paths(top_levels, summit).select(F.col("its_tree").alias("tree"), "path", F.struct("subroot", F.col("ends").alias("root")).alias("ends"))

    proven = attach_paths(levels, materialize(tops, "merkle-tops"))
    return proven.select("row", F.col("digest").alias("leaf"), "ends.subroot", "ends.root", "path", F.coalesce("seen", "digest").alias("seen"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by language, its proofs, and what tampered texts fold to."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = F.when(hit, leaf_digest([lowered if c == "text" else F.col(c) for c in FIELDS]))
    folded = manifest(docs, FIELDS, "lang", "doc_id", ["doc_id"], seen).withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return folded.select("row.doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = """
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
marked AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit
  FROM documents, crc),
forms AS (
  SELECT doc_id, lang, hit,
         concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM marked),
leaves AS (SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || CASE WHEN hit THEN lowered ELSE body END) AS seen FROM forms),
d AS MATERIALIZED (
  SELECT doc_id, lang, leaf, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (
  SELECT lang AS tree, 0 AS level, r AS idx, leaf AS digest, n AS many FROM d
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(many) + 7) // 8 FROM up WHERE many > 1 GROUP BY tree, level, idx // 8),
forest AS MATERIALIZED (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM up WHERE many = 1),
top AS (
  SELECT 0 AS level, r AS idx, subroot AS digest, n AS many FROM forest
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(many) + 7) // 8 FROM top WHERE many > 1 GROUP BY level, idx // 8),
steps AS MATERIALIZED (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM up a JOIN up b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.many > 1 GROUP BY a.tree, a.level, a.idx),
top_steps AS MATERIALIZED (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.many > 1 GROUP BY a.level, a.idx),
climb AS (
  SELECT lang AS tree, r, 0 AS level, r AS idx, '' AS proof, seen AS node FROM d
  UNION ALL
  SELECT c.tree, c.r, c.level + 1, c.idx // 8, c.proof || s.before || s.after, sha256(s.before || c.node || s.after)
  FROM climb c JOIN steps s ON c.tree IS NOT DISTINCT FROM s.tree AND c.level = s.level AND c.idx = s.idx),
grown AS MATERIALIZED (SELECT tree, r, max_by(proof, level) AS proof, max_by(node, level) AS node FROM climb GROUP BY tree, r),
last AS (
  SELECT g.tree, g.r, 0 AS level, f.r AS idx, g.proof, g.node FROM grown g JOIN forest f ON g.tree IS NOT DISTINCT FROM f.tree
  UNION ALL
  SELECT c.tree, c.r, c.level + 1, c.idx // 8, c.proof || s.before || s.after, sha256(s.before || c.node || s.after)
  FROM last c JOIN top_steps s ON c.level = s.level AND c.idx = s.idx),
ends AS MATERIALIZED (SELECT tree, r, max_by(proof, level) AS proof, max_by(node, level) AS node FROM last GROUP BY tree, r)
SELECT d.doc_id, d.leaf, f.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = t.digest AS verified
FROM d JOIN ends e ON d.lang IS NOT DISTINCT FROM e.tree AND d.r = e.r JOIN forest f ON d.lang IS NOT DISTINCT FROM f.tree JOIN top t ON t.many = 1
"""
