"""Merkle manifest of a dataset: leaf hashes, a tree for each group, a tree over the groups, and inclusion proofs.

1. Every row becomes a leaf, the hash of its fields; leaves are numbered within their group in the order of their key. The
   numbers come from ranges: rows are dealt by ranges of (group, key), sorted there, and the sizes of the ranges before
   are added, so a group that holds most rows is numbered by many tasks.
2. Runs of FAN ** LEVELS consecutive nodes of a group, aligned to their positions, are one window partition. Within it,
   level after level, lag and lead columns with the fixed offsets j * FAN ** level, masked by the node's slot in its run
   and by the run's length, hold the siblings; the row of the first child hashes the parent. All windows of a run share one
   partitioning and one order, so there is one shuffle for LEVELS levels.
3. What the runs end in is the next, FAN ** LEVELS times smaller set of nodes; stages go on until each group has one node,
   its subroot. The subroots, numbered by group, go through the same stages to the root.
4. Proofs come down the same stages: a row's steps within its run, then those of its run, which join by (group, run).

A proof is an array of steps (left, right): the digests left and right of the node at each level, joined in order.

Defined results: a null field is `-`; a null group is a group of its own, before all others; null keys come first. Rows
with the same key are ordered by their leaf; rows that are the same in all fields have the same leaf, each one its own
place. A group of one row has its leaf as subroot, one group alone has its subroot as root; the proof of a single row has
no steps. Rows with a null doc_id are never tampered with. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.shared import materialize, read_table

#: Children of a node, and levels of a window partition (so FAN ** LEVELS nodes).
FAN, LEVELS = 2, 10

#: The bits of monotonically_increasing_id that count the rows of a partition.
ROW_BITS = 33

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A field as its byte count, a colon and its text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def numbered(rows: DataFrame, group: str, *keys: str) -> DataFrame:
    """Add ``pos``, from 0 within each group in the order of the keys, and ``n``, the group's size.

    rows must be a written table: rows that agree in all keys are told apart by their file and row in it, so that they,
    too, fall to several ranges.
    """
    ties = rows.select("*", F.col("_metadata.file_path").alias("tie_file"), F.col("_metadata.row_index").alias("tie_row"))
    order = [group, *keys, "tie_file", "tie_row"]
    dealt = ties.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie_file", "tie_row")
    placed = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", ROW_BITS)
    spans = placed.groupBy(F.col(group).alias("span_group"), part.alias("span_part")).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    # One row for each range that a group reaches into.
    earlier = Window.partitionBy("span_group").orderBy("span_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "n": F.sum("held").over(Window.partitionBy("span_group"))})
    met = placed.join(spans, (F.col(group) == F.col("span_group")) & (part == F.col("span_part")))
    return met.withColumn("pos", F.col("place") - F.col("first") + F.col("before")).drop("span_group", "span_part", "first", "held", "before", "place")


def climbed(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Nodes (grp, pos, n, node) with ``run``, ``top`` on the first row of each run, and ``own_steps``, each row's steps in its run."""
    size = fan**levels
    run = nodes.withColumn("run", F.floor(F.col("pos") / size).cast("long"))
    window = Window.partitionBy("grp", "run").orderBy("pos")
    until_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = run.withColumn("node_0", F.col("node"))
    for level in range(levels):
        width, node = fan**level, f"node_{level}"
        slot = F.pmod(F.floor(F.col("pos") / width), F.lit(fan))
        count = F.ceil(F.col("n") / width)
        # The run of siblings is shorter at the end of a level.
        length = F.least(F.lit(fan), count - (F.floor(F.col("pos") / width) - slot))
        near = {f"{way}_{j}": move(node, j * width).over(window) for j in range(1, fan) for way, move in (("lag", F.lag), ("lead", F.lead))}
        rows = rows.withColumns(near)
        left = F.concat(F.lit(""), *[F.when(slot >= j, F.col(f"lag_{j}")).otherwise("") for j in range(fan - 1, 0, -1)])
        right = F.concat(F.lit(""), *[F.when(slot + j < length, F.col(f"lead_{j}")).otherwise("") for j in range(1, fan)])
        holds, grows = F.pmod(F.col("pos"), F.lit(width)) == 0, count > 1
        step = F.when(holds, F.struct(grows.alias("real"), F.when(grows, left).otherwise("").alias("left"), F.when(grows, right).otherwise("").alias("right")))
        parent = F.when(holds & (slot == 0), F.when(grows, digest(F.col(node), right)).otherwise(F.col(node)))
        rows = rows.withColumns({f"step_{level}": step, f"node_{level + 1}": parent}).drop(*near)
    # A node's step stands on its first row; the rows below it take it from there.
    held = [F.last(f"step_{level}", ignorenulls=True).over(until_here).alias(f"own_{level}") for level in range(levels)]
    kept = [c for c in run.columns if c != "node_0"]
    rows = rows.select(*kept, F.col(f"node_{levels}").alias("top"), *held)
    real = F.filter(F.array(*[f"own_{level}" for level in range(levels)]), lambda s: s["real"])
    return rows.select(*kept, "top", F.transform(real, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))).alias("own_steps"))


def tree(nodes: DataFrame, fan: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """For nodes (grp, pos, n, node, ...): the same rows with ``peak`` and ``steps``, and the groups' peaks (grp, peak).

    nodes are read twice, once to climb and once to come down with the proofs.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    stages = []
    while True:
        # Small groups need fewer levels than a run may have.
        deep = next((level for level in range(1, levels) if fan**level >= largest), levels)
        stages.append((nodes, deep))
        above = climbed(nodes.select("grp", "pos", "n", "node"), fan, deep).filter(F.col("pos") == F.col("run") * fan**deep)
        nodes = materialize(above.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / fan**deep).cast("long").alias("n"), F.col("top").alias("node")), "runs")
        largest = -(-largest // fan**deep)
        if largest <= 1:
            break
    peaks = nodes.select("grp", F.col("node").alias("peak"))
    found = nodes.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_run"), F.col("node").alias("peak"), F.expr("array()").cast("array<struct<left: string, right: string>>").alias("up_steps"))
    for number, (stage, deep) in reversed(list(enumerate(stages))):
        down = climbed(stage, fan, deep).join(found, (F.col("grp") == F.col("up_grp")) & (F.col("run") == F.col("up_run")))
        down = down.withColumn("steps", F.concat("own_steps", "up_steps")).drop("up_grp", "up_run", "up_steps", "own_steps", "run", "top")
        if number:
            found = materialize(down.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_run"), "peak", F.col("steps").alias("up_steps")), "proofs")
    return down, peaks


def manifest(leaves: DataFrame, group: Column, key: Column, leaf: Column, *carried: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Leaves with key, leaf, the carried columns, subroot, root and steps (the proof, from the leaf to the root).

    The group is a string column; null is the first group.
    """
    # One letter before each group puts null first and lets groups be joined.
    grp = F.when(group.isNull(), "n").otherwise(F.concat(F.lit("v"), group))
    own = materialize(leaves.select(grp.alias("grp"), key.alias("key"), leaf.alias("node"), F.struct(F.lit(0).alias("none"), *carried).alias("carried")), "leaves")
    placed, peaks = tree(numbered(own, "grp", "key", "node"), fan, levels)
    branches = materialize(peaks.select(F.lit("").alias("grp"), F.col("grp").alias("branch"), F.col("peak").alias("node")), "subroots")
    roots, _ = tree(numbered(branches, "grp", "branch"), fan, levels)
    roots = materialize(roots.select(F.col("branch"), F.col("peak").alias("root"), F.col("steps").alias("root_steps")), "roots")
    whole = placed.join(roots, F.col("grp") == F.col("branch"))
    return whole.select("key", F.col("node").alias("leaf"), *[F.col(f"carried.{c}").alias(c) for c in carried], F.col("peak").alias("subroot"), "root", F.concat("steps", "root_steps").alias("steps"))


def document_leaf(changes: dict[str, Column] | None = None) -> Column:
    """The leaf hash of a document's fields, some of them changed."""
    return digest(*[framed((changes or {}).get(name, F.col(name))) for name in FIELDS])


def op11_merkle_manifest(spark, sf_dir):
    """Manifest of documents with a tree for each language; some rows are tampered with, and every row is verified."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    # Counts may be as large as a long: one more is a decimal.
    more = document_leaf({"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    leaves = docs.select("doc_id", "lang", document_leaf().alias("leaf_hash"), F.when(tampered, more).alias("changed"))
    rows = manifest(leaves, F.col("lang"), F.col("doc_id"), F.col("leaf_hash"), "changed")
    rows = rows.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    siblings = F.aggregate("steps", F.lit(""), lambda all_, step: F.concat(all_, step["left"], step["right"]))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT doc_id, doc_id::VARCHAR AS digits, 0 AS done, 4294967295::UBIGINT AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, digits, done + 1, list_reduce(
    list_prepend(xor(crc, ascii(digits[done + 1])::UBIGINT), range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)
  FROM bits WHERE done < length(digits)),
tampered AS (SELECT doc_id FROM bits WHERE done = length(digits) AND xor(crc, 4294967295::UBIGINT) % 7 = 0),
fields AS (
  SELECT d.doc_id, lang, t.doc_id IS NOT NULL AS changed, n_chars,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents d LEFT JOIN tampered t ON d.doc_id = t.doc_id),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM fields),
leaves AS (
  SELECT *, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS grp,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER () AS row_id
  FROM hashed),
up AS (
  SELECT grp, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY grp, level, pos // 2, n),
subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp::BLOB) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
nodes AS (SELECT 0 AS tree, grp, level, pos, n, h FROM up UNION ALL SELECT 1, '', level, pos, n, h FROM top),
walk AS (
  SELECT row_id, grp, 0 AS tree, 0 AS level, pos, n, '' AS siblings, coalesce(other, leaf) AS x FROM leaves
  UNION ALL
  SELECT w.row_id, w.grp,
    CASE WHEN w.n = 1 THEN 1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 1) // 2 END,
    w.siblings || coalesce(o.h, ''),
    CASE WHEN w.n = 1 THEN w.x WHEN w.pos % 2 = 0 THEN sha256(w.x || coalesce(o.h, '')) ELSE sha256(o.h || w.x) END
  FROM walk w JOIN subroots s ON s.grp = w.grp
  LEFT JOIN nodes o ON o.tree = w.tree AND o.grp = CASE w.tree WHEN 0 THEN w.grp ELSE '' END AND o.level = w.level AND o.pos = xor(w.pos, 1) AND w.n > 1
  WHERE NOT (w.tree = 1 AND w.n = 1))
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.siblings) AS proof_sha256, w.x AS folded_root, w.x = r.h AS verified
FROM leaves l JOIN walk w ON w.row_id = l.row_id AND w.tree = 1 AND w.n = 1 JOIN subroots s ON s.grp = l.grp JOIN top r ON r.n = 1
"""
