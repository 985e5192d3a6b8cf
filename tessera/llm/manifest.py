"""Merkle dataset manifest: one root for a table, and for each row the proof that it belongs to it.

Rows are leaves. Each source has a tree over its leaves in order of ids, three nodes to
a parent; the sources' roots have a tree of their own. A row's authentication path is
the siblings of its ancestors, level by level up to the root.

Leaves are cut into aligned blocks of FAN ** HEIGHT. Going up, a block becomes the one
node it has at that height, and those nodes are cut into blocks again, until a tree is
one node. Coming down, a traversal schedule writes the paths of a block leaf by leaf: each
level keeps the nodes of the run that the path is in, and a treehash stack
prepares those of the next run from leaves ahead. A leaf's step is as many stack moves
as the block has levels, given to the stack with the lowest node, so all stacks together
hold a few nodes a level. The path of the block itself, shared by its leaves, is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jump_shards import CRC_TABLE, crc_sql
from .ordered import POSITION, in_order
from .runtime import small_or_shuffled, stored

FAN = 3
#: Levels of a block: 729 leaves of a few numbers and hashes are all that a task holds at a time.
HEIGHT = 6
#: Above every level.
DONE = 1 << 30
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = ["none", "source"]
#: before and after: the siblings left and right of a node in its run, as hex text, one after another.
PROOF = "array<struct<before: string, after: string>>"


def joined(nodes: list[str]) -> str:
    """The parent of a run of nodes."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


class Treehash:
    """Builds the nodes of one run at a level from their leaves, taken one by one; holds at most FAN - 1 nodes of each level below."""

    def __init__(self, leaves: list[str], level: int, run: int):
        self.leaves, self.level = leaves, level
        width = FAN ** (level + 1)
        self.next, self.end = run * width, min((run + 1) * width, len(leaves))
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def lowest(self) -> int:
        """Level of the lowest node held; that of the run if none is, beyond all levels when there is nothing left to do."""
        if self.next >= self.end:
            return DONE
        return next((k for k, nodes in enumerate(self.open) if nodes), self.level)

    def move(self) -> None:
        """Takes the next leaf and closes the runs that it fills, or that end with the tree."""
        self.open[0].append(self.leaves[self.next])
        self.next += 1
        last = self.next == len(self.leaves)
        for k in range(self.level):
            if len(self.open[k]) == FAN or last and self.open[k]:
                self.open[k + 1].append(joined(self.open[k]))
                self.open[k] = []

    def nodes(self) -> list[str]:
        """The run's nodes; by the schedule nothing is left to do when they are asked for."""
        while self.next < self.end:
            self.move()
        return self.open[self.level]


def authentication_paths(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order: (siblings before, siblings after) of its ancestor at each of height levels."""
    now = [Treehash(leaves, k, 0).nodes() for k in range(height)]
    ahead = [Treehash(leaves, k, 1) for k in range(height)]
    for i in range(len(leaves)):
        if i:
            for k in range(height):
                width = FAN ** (k + 1)
                if i % width:
                    break
                now[k] = ahead[k].nodes()
                ahead[k] = Treehash(leaves, k, i // width + 1)
        path, place = [], i
        for nodes in now:
            place, at = divmod(place, FAN)
            path.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
        yield path
        for _ in range(height):
            stack = min(ahead, key=Treehash.lowest)
            if stack.next < stack.end:
                stack.move()


def block_root(leaves: list[str], height: int) -> str:
    """The node of these leaves so many levels up."""
    return Treehash(leaves, height, 0).nodes()[0]


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("index")


def _levels(size: int, height: int) -> int:
    return min(height, height_of(size))


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """The blocks of nodes (none, source, index, node, size) as nodes of the same columns."""

    def run(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        size = group["size"][0].as_py()
        return pa.table({
            "none": group["none"][:1], "source": group["source"][:1], "index": [group["index"][0].as_py() // FAN**height],
            "node": [block_root(group["node"].to_pylist(), _levels(size, height))], "size": [-(-size // FAN**height)],
        })

    blocks = nodes.withColumn("block", F.expr(f"index div {FAN**height}")).groupBy(*TREE, "block")
    return blocks.applyInArrow(run, "none boolean, source string, index long, node string, size long")


def _descend(nodes: DataFrame, upper: DataFrame, carried: list[str], height: int) -> DataFrame:
    """nodes with proof, and carried from upper: nodes of the level of blocks, with their proofs."""
    own = [c for c in nodes.columns if c not in ("size", "block")]
    kinds = dict(nodes.dtypes) | dict(upper.dtypes)

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = _sorted(group)
        shared = above["proof"][0].as_py()
        paths = authentication_paths(group["node"].to_pylist(), _levels(group["size"][0].as_py(), height))
        proofs = [[*({"before": a, "after": b} for a, b in path), *shared] for path in paths]
        columns = {c: group[c] for c in own} | {c: pa.array([above[c][0].as_py()] * len(group), above.schema.field(c).type) for c in carried}
        return pa.table(columns | {"proof": pa.array(proofs, above.schema.field("proof").type)})

    blocks = nodes.withColumn("block", F.expr(f"index div {FAN**height}")).groupBy(*TREE, "block")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*own, *carried]) + f", proof {PROOF}"
    return blocks.cogroup(upper.withColumnRenamed("index", "block").groupBy(*TREE, "block")).applyInArrow(run, schema)


def _tower(nodes: DataFrame, name: str, height: int) -> list[DataFrame]:
    """nodes, their blocks, the blocks of those and so on, until each tree is one node; the sizes fall FAN ** height times a step."""
    tower, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1 or len(tower) == 1 and most:
        tower.append(stored(_climb(tower[-1], height), name))
        most = -(-most // FAN**height)
    return tower


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """leaves (doc_id, source, leaf, ...) with index, subroot, root and proof.

    Leaves of a source ascend by doc_id, null first, and by leaf where ids repeat; equal rows
    are equal leaves, each with a place of its own. A null source is a tree of its own, the
    first; a lone leaf is its source's root, and a lone source's root is the root. Three
    nodes have a parent, the last run of a level fewer, even one. An empty table has
    no rows. Further columns pass, if their names are none of index, node, size, none,
    proof, subroot and root. No source is sorted or hashed in one task, whatever its share.
    """
    rows = leaves.withColumns({"none": F.col("source").isNull(), "source": F.coalesce(F.col("source").cast("string"), F.lit(""))}).withColumnRenamed("leaf", "node")
    rows = in_order(rows, [F.col("none").desc(), F.col("source").asc(), F.col("doc_id").asc_nulls_first(), F.col("node").asc()], "leaves")
    trees = stored(rows.groupBy(*TREE).agg(F.min(POSITION).alias("first"), F.count("*").alias("size")), "trees")
    rows = rows.join(small_or_shuffled(trees, trees.count()), TREE).withColumn("index", F.col(POSITION) - F.col("first")).drop(POSITION, "first")
    tower = _tower(rows, "blocks", height)
    if len(tower) == 1:  # no rows
        return rows.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PROOF).alias("proof")).drop("size").transform(_named)
    subroots = in_order(tower[-1].select(*TREE, F.col("node")), [F.col("none").desc(), F.col("source").asc()], "subroots")
    top = subroots.select(F.lit(False).alias("none"), F.lit("").alias("source"), F.col(POSITION).alias("index"), "node", F.lit(trees.count()).cast("long").alias("size"),
                          F.struct("none", "source").alias("tree"))
    above = _tower(top, "sources", height)
    upper = above[-1].select(*TREE, "index", F.col("node").alias("root"), F.array().cast(PROOF).alias("proof"))
    for level in reversed(above[:-1]):
        upper = stored(_descend(level, upper, ["root"], height), "proofs")
    upper = upper.select("tree.none", "tree.source", F.lit(0).cast("long").alias("index"), F.col("node").alias("subroot"), "root", "proof")
    for level in reversed(tower[1:-1]):
        upper = stored(_descend(level, upper, ["subroot", "root"], height).drop("node"), "proofs")
    return _descend(tower[0], upper, ["subroot", "root"], height).transform(_named)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source", F.when(~F.col("none"), F.col("source"))).withColumnRenamed("node", "leaf").drop("none")


def leaf(row: dict[str, Column]) -> Column:
    """The hash of a row's fields: of each the UTF-8 byte count, a colon and the value, or a dash for null."""
    shown = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(shown(row[f].cast("string")) for f in FIELDS)), 256)


def fields() -> dict[str, Column]:
    return {f: F.col(f) for f in FIELDS}


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give; equal to the manifest's root just for an unchanged row."""
    return F.aggregate(proof, node, lambda at, level: F.sha2(F.concat(level["before"], at, level["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what folding finds where line breaks were deleted from every text whose id has an even CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    stripped = F.when(tampered, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(fields()).alias("leaf"), leaf(fields() | {"text": stripped}).alias("found"))
    rows = manifest(stored(leaves, "hashed"))
    rows = rows.withColumn("folded_root", folded(F.col("found"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str, group: str) -> str:
    """Nodes of every level of trees in DuckDB: name(lvl, group, i, h, n)."""
    return f"""{name} AS (
  SELECT 0 AS lvl, {group}, i, h, n FROM {leaves}
  UNION ALL
  SELECT any_value(lvl) + 1, {group}, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), any_value(n + {FAN - 1}) // {FAN} FROM {name} WHERE n > 1 GROUP BY {group}, i // {FAN}
)"""


def _oracle() -> str:
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    hashed = lambda text: "sha256(" + " || ".join([*(shown(f) for f in FIELDS[:-1]), shown(text)]) + ")"
    side = lambda name, sign: f"coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i {sign} p.i), '') AS {name}"
    return f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
read AS (SELECT doc_id, source, {hashed("text")} AS h,
  CASE WHEN CAST({crc_sql("CAST(doc_id AS VARCHAR)")} AS BIGINT) % 2 = 0 THEN {hashed("replace(text, chr(10), '')")} ELSE {hashed("text")} END AS found,
  coalesce('1' || source, '0') AS g FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM read),
{_tree_sql("nodes", "leaves", "g")},
subroots AS (SELECT g AS s, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, true AS g FROM nodes WHERE n = 1),
{_tree_sql("tops", "subroots", "g")},
steps AS (
  SELECT l.doc_id, 0 AS part, x.lvl, x.i, x.g, x.n FROM leaves l JOIN nodes x ON x.g = l.g AND x.n > 1 AND x.i = l.i // CAST({FAN} ** x.lvl AS BIGINT)
  UNION ALL
  SELECT l.doc_id, 1, x.lvl, x.i, NULL, x.n FROM leaves l JOIN subroots u ON u.s = l.g JOIN tops x ON x.n > 1 AND x.i = u.i // CAST({FAN} ** x.lvl AS BIGINT)
),
sides AS (
  SELECT doc_id, part, p.lvl, {side("a", "<")}, {side("b", ">")} FROM steps p JOIN nodes s ON part = 0 AND s.g = p.g AND s.lvl = p.lvl AND s.i // {FAN} = p.i // {FAN} GROUP BY ALL
  UNION ALL
  SELECT doc_id, part, p.lvl, {side("a", "<")}, {side("b", ">")} FROM steps p JOIN tops s ON part = 1 AND s.lvl = p.lvl AND s.i // {FAN} = p.i // {FAN} GROUP BY ALL
),
proofs AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY part, lvl) AS proof FROM sides GROUP BY doc_id),
climb AS (
  SELECT doc_id, 1 AS k, found AS h, proof FROM leaves LEFT JOIN proofs USING (doc_id)
  UNION ALL
  SELECT doc_id, k + 1, sha256(proof[k].a || h || proof[k].b), proof FROM climb WHERE k <= coalesce(len(proof), 0)
),
ends AS (SELECT doc_id, arg_max(h, k) AS folded_root, sha256(array_to_string(list_transform(coalesce(any_value(proof), []), lambda x: x.a || x.b), '')) AS proof_sha256 FROM climb GROUP BY doc_id)
SELECT doc_id, l.h AS leaf, u.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaves l JOIN subroots u ON u.s = l.g JOIN (SELECT h FROM tops WHERE n = 1) r ON true JOIN ends USING (doc_id)
"""


OP11_SQL = _oracle()
