"""A Merkle manifest of a dataset: large blocks are reduced where they lie, a small upper tree on the driver.

Leaves are grouped by source and packed into blocks of 4,096 (16 to the third) consecutive ones. Executors reduce each
block to one node; further tiers of blocks follow while more than TOP nodes remain. The driver builds the tree above and
broadcasts it: it holds every block's path to the root at 64 bytes a node, so 4 MB for TOP nodes. Executors then finish
each leaf's proof and fold it.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, numbered, stream_arrow, written

#: Nodes that make one; leaves of a block; nodes that the driver takes at most.
RUN = 16
BLOCK = RUN**3
TOP = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = "array<struct<l: string, r: string>>"


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each with its length, so that no two rows give the same bytes."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(m: int) -> int:
    """Levels above m nodes."""
    k = 0
    while m > 1:
        m, k = -(-m // RUN), k + 1
    return k


def _levels(nodes: list[str], levels: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[k : k + RUN])) for k in range(0, len(below), RUN)])
    return out


def _paths(levels: list[list[str]], suffix: tuple) -> list[tuple]:
    """The path of each lowest node: its siblings left and right, level by level, then the top node's."""
    above = [suffix]
    for nodes in reversed(levels[:-1]):
        here = []
        for k in range(len(nodes)):
            lo = k - k % RUN
            here.append((("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + RUN])), *above[k // RUN]))
        above = here
    return above


def _fold(node: str, path) -> str:
    for left, right in path:
        node = _h(left + node + right)
    return node


def _local_levels(m: int, block: int) -> int:
    return min(height(m), height(block))


class UpperTree:
    """The tree above the nodes (group, index) that are left: groups' trees, and one over their roots."""

    def __init__(self, nodes: list[tuple[int, int, str]], grouped: bool):
        self.groups: dict[int, list[list[str]]] = {}
        for g, _, d in sorted(nodes):
            self.groups.setdefault(g, [[]])[0].append(d)
        for g, levels in self.groups.items():
            self.groups[g] = _levels(levels[0], height(len(levels[0])))
        order = sorted(self.groups)
        roots = [self.groups[g][-1][0] for g in order]
        tops = _paths(_levels(roots, height(len(roots))), ()) if grouped else [()] * len(roots)
        self.above = dict(zip(order, tops))

    def path(self, g: int, i: int) -> tuple:
        out = []
        for nodes in self.groups[g][:-1]:
            lo = i - i % RUN
            out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + RUN])))
            i //= RUN
        return (*out, *self.above[g])


def _packed(nodes: DataFrame, block: int, *more: str) -> DataFrame:
    """One row a block: its nodes in order. A block's size is bounded, and so is the row."""
    key = F.floor(F.col("i") / block).cast("long")
    entries = F.array_sort(F.collect_list(F.struct("i", *more, "d")))
    return nodes.groupBy("g", key.alias("b")).agg(F.first("m").alias("m"), entries.alias("nodes"))


def _rows(batches):
    """(row of the block, its entries as one Arrow struct array) of packed blocks."""
    for batch in batches:
        nodes = batch.column("nodes")
        for k in range(batch.num_rows):
            yield batch.slice(k, 1), nodes[k].values


def _hex(column: pa.Array) -> list[str]:
    return [d.hex() for d in column.to_pylist()]


def _reduced(packs: DataFrame, block: int) -> DataFrame:
    """Each block's one node, as (g, i, m, d) of the next tier."""

    def run(batches):
        for row, nodes in _rows(batches):
            m = row.column("m")[0].as_py()
            top = _levels(_hex(nodes.field("d")), _local_levels(m, block))[-1]
            yield pa.RecordBatch.from_pydict(
                {"g": row.column("g"), "i": row.column("b"), "m": pa.array([-(-m // block)], pa.int64()), "d": pa.array([bytes.fromhex(top[0])], pa.binary())}
            )

    return stream_arrow(packs, run, "g long, i long, m long, d binary")


def _suffix(row: pa.RecordBatch, tree) -> tuple:
    if tree is not None:
        return tree.value.path(row.column("g")[0].as_py(), row.column("b")[0].as_py())
    return tuple((s["l"], s["r"]) for s in row.column("path")[0].as_py())


def _node_paths(packs: DataFrame, block: int, tree) -> DataFrame:
    """The path of every node of a tier of blocks."""

    def run(batches):
        for row, nodes in _rows(batches):
            levels = _levels(_hex(nodes.field("d")), _local_levels(row.column("m")[0].as_py(), block))
            paths = [[{"l": x, "r": y} for x, y in p] for p in _paths(levels, _suffix(row, tree))]
            g = pa.array([row.column("g")[0].as_py()] * len(paths), pa.int64())
            yield pa.RecordBatch.from_arrays([g, nodes.field("i"), pa.array(paths, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))], ["g", "i", "path"])

    return stream_arrow(packs, run, f"g long, i long, path {_PATH}")


def _proofs(packs: DataFrame, block: int, tree, id_type: str) -> DataFrame:
    """The rows of the manifest: every leaf's proof, and its fold from the leaf that is there now."""

    def run(batches):
        for row, nodes in _rows(batches):
            m = row.column("m")[0].as_py()
            leaves, now = _hex(nodes.field("d")), nodes.field("t").to_pylist()
            levels = _levels(leaves, _local_levels(m, block))
            suffix = _suffix(row, tree)
            rest = height(m) - (len(levels) - 1)
            subroot = _fold(levels[-1][0], suffix[:rest])
            root = _fold(subroot, suffix[rest:])
            proofs, folded = [], []
            for leaf, t, path in zip(leaves, now, _paths(levels, suffix)):
                proofs.append(_h("".join([x + y for x, y in path])))
                folded.append(_fold(leaf if t is None else t.hex(), path))
            n = len(leaves)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": nodes.field("id"), "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
            )

    return stream_arrow(packs, run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_text(text: str = "text", id_col: str = "doc_id") -> Column:
    """The text as a check of the manifest finds it: A-Z in lower case where 5 divides the CRC-32 of the id."""
    struck = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return F.when(struck, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))


def merkle_manifest(docs: DataFrame, now: Column | None = None, *, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs(doc_id, source, lang, n_chars, text).

    now is the text as found at the check (a column over docs; default: the text itself): folded_root is recomputed
    from it and the proof, verified tells whether it is the root. Rows ascend by id within their source, null ids
    first, equal ids by leaf; sources ascend, null first. Equal rows are leaves of their own, next to each other.
    Empty tables give no rows; other columns are ignored.

    Rows are numbered by a range-partitioned sort, so a source of any size is in many tasks; the driver sees the row
    counts of partitions, and of the tree at most `top` nodes.
    """
    if block != RUN ** height(block) or block < RUN:
        raise ValueError("block must be a power of the run")
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = F.lit(None).cast("binary") if now is None else F.when(~now.eqNullSafe(F.col("text")), F.unhex(leaf_digest(*fields, now)))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", F.unhex(leaf_digest(*fields, F.col("text"))).alias("d"), found.alias("t"))
    placed, held = numbered(leaves, "source", "id", "d", name="leaves", into="pos")
    sources = placed.groupBy("source").agg(F.min("pos").alias("first"), F.count("*").alias("m"))
    ordered, held2 = numbered(sources, "first", name="sources", into="g")
    ordered = ordered.withColumnRenamed("source", "__source")
    nodes = placed.join(ordered, F.col("source").eqNullSafe(F.col("__source"))).select("g", (F.col("pos") - F.col("first")).alias("i"), "m", "id", "t", "d")
    n_groups = held2.count()

    packs = [written(_packed(nodes, block, "id", "t"), "blocks")]
    dropped(held)
    grouped, turned, used = True, -1, []
    while True:
        nodes = written(_reduced(packs[-1], block), "nodes")
        used.append(nodes)
        n = nodes.count()
        if n <= top:
            break
        if grouped and n == n_groups:  # every source has come to one node: on with the tree over the sources
            grouped, turned = False, len(packs)
            nodes = nodes.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n).cast("long").alias("m"), "d")
        packs.append(written(_packed(nodes, block), "blocks"))
    rows = [(r.g, r.i, r.d.hex()) for r in nodes.select("g", "i", "d").toLocalIterator()]
    tree = spark.sparkContext.broadcast(UpperTree(rows, grouped))
    for k in range(len(packs) - 1, 0, -1):
        paths = _node_paths(packs[k], block, tree)
        if k == turned:
            paths = paths.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("b"), "path")
        else:
            paths = paths.withColumnRenamed("i", "b")
        packs[k - 1] = packs[k - 1].join(written(paths, "paths"), ["g", "b"])
        tree = None
    dropped(held2, *used)
    return _proofs(packs[0], block, tree, id_type)
