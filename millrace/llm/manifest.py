"""A Merkle manifest of a table of documents: a root over all sources, and for each document the proof that it is in it.

The leaves, in order of source and document, are dealt to chunks of consecutive rows. A fragment is what a chunk, or any run
of neighbouring chunks, knows of the trees and can't resolve alone: nodes keyed by tree, level and index. Fragments merge
associatively: their nodes are put together, and wherever all siblings of a run are there (how many that are follows from
the number of the tree's leaves) they become their parent. Neighbouring fragments merge by eights until one is left, the
root; only nodes at the borders of a fragment stay unresolved, so a fragment has some dozens of nodes at any size. The way
back hands every unresolved node its path to the root, and each chunk completes the proofs of its own leaves.

Cases: null columns are leaves' ``-``; a null source is a source of its own, before all others; documents of null or equal
doc_id are in the order of their leaves, and repeated rows are leaves of their own. A document with a null doc_id is never
tampered with. Texts are hashed whole, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

ARITY = 3
#: Leaves of a chunk, which is what a task holds at once, and fragments that merge together.
CHUNK, FAN = 16_384, 8
#: Key of the tree over the subroots; the trees of sources have the source's place, from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "chunk long, tree long, width long, sources long, level int, index long, digest string"
PATH = NODE.replace("digest", "path")
PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

Key = tuple[int, int, int]


def leaf(*values: Column) -> Column:
    """Digest of columns, each its length in bytes, a colon and itself, or ``-``."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def parent(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _run_size(width: int, level: int, run: int) -> int:
    """Nodes under the given node of the next level, in a tree of so many leaves."""
    return min(ARITY, _width(width, level) - ARITY * run)


def _width(leaves: int, level: int) -> int:
    return -(-leaves // ARITY**level)


def merged(nodes: dict[Key, str], widths: dict[int, int]) -> tuple[dict[Key, str], dict[Key, list[str]]]:
    """(unresolved nodes, the digests of each run that was complete, by its parent). nodes: (tree, level, index) -> digest;
    widths: leaves of each tree. The root of a source is a leaf of the tree TOP."""
    left, runs, by_level = {}, {}, defaultdict(dict)

    def climb(pending: dict[int, dict[Key, str]]) -> dict[int, str]:
        """Resolves upwards; what can't be is left, but for the roots of trees, by tree."""
        roots, level = {}, 0
        while any(pending.values()):
            here = pending.pop(level, {})
            for (tree, run), same in groupby(sorted(here), key=lambda k: (k[0], k[2] // ARITY)):
                same = list(same)
                if _width(widths[tree], level) == 1:
                    roots[tree] = here[same[0]]
                elif len(same) < _run_size(widths[tree], level, run):
                    left.update((k, here[k]) for k in same)
                else:
                    up = tree, level + 1, run
                    runs[up] = [here[k] for k in same]
                    pending[level + 1][up] = parent(runs[up])
            level += 1
        return roots

    for key, digest in nodes.items():
        if key[0] != TOP:
            by_level[key[1]][key] = digest
    tops = defaultdict(dict, {0: {(TOP, 0, tree): digest for tree, digest in climb(by_level).items()}})
    for key, digest in nodes.items():
        if key[0] == TOP:
            tops[key[1]][key] = digest
    left |= {(TOP, next(n for n in range(99) if _width(widths[TOP], n) == 1), 0): digest for digest in climb(tops).values()}
    return left, runs


def paths(nodes: dict[Key, str], widths: dict[int, int], above: dict[Key, str]) -> dict[Key, str]:
    """The path of each node to the root: steps ``left|right`` with the siblings' digests, each ended by a semicolon. above:
    those of the nodes that these nodes can't resolve alone."""
    left, runs = merged(nodes, widths)
    steps = {k: above[k] for k in left}
    for (tree, level, run), digests in sorted(runs.items(), key=lambda x: (x[0][0] != TOP, -x[0][1])):
        up = _key(tree, level, run, widths)
        for i in range(len(digests)):
            steps[tree, level - 1, ARITY * run + i] = f"{''.join(digests[:i])}|{''.join(digests[i + 1 :])};{steps[up]}"
    return {k: steps[_key(*k, widths)] for k in nodes}


def _key(tree: int, level: int, index: int, widths: dict[int, int]) -> Key:
    """Where a node's path is kept: a subroot is a leaf of TOP."""
    return (TOP, 0, tree) if tree != TOP and _width(widths[tree], level) == 1 else (tree, level, index)


def placed(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves (source, doc_id, leaf, ...) with chunk, tree, width, sources and index.

    Rows are dealt by ranges of their order; a number of the row makes equal rows apart, so that no range is larger than
    others. Only counts of rows by range and source are summed up.
    """
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("number")]
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.save(leaves.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counted = ranged.groupBy("part", "source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    spans = counted.select(
        "part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("source")).alias("width"),
        F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("earlier"), "n",
    )
    first = F.when(F.col("offset") == 0, 1).otherwise(0)
    spans = scratch.save(spans.withColumn("begun", F.sum(first).over(in_part.rowsBetween(Window.unboundedPreceding, 0))), "spans")
    parts = spans.groupBy("part").agg(F.sum("n").alias("rows"), F.max("begun").alias("begin"))
    # one row for each range, whose number the session sets
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("rows").over(all_before), F.lit(0)).alias("start"), F.coalesce(F.sum("begin").over(all_before), F.lit(0)).alias("sources_before"), F.sum("begin").over(Window.partitionBy()).alias("sources"))
    spans = spans.join(parts, "part").select("part", F.col("source").alias("of"), "offset", "width", "earlier", "start", "sources", (F.col("sources_before") + F.col("begun") - 1).alias("tree"))
    numbered = ranged.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    joined = numbered.join(spans.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.select(((F.col("start") + F.col("row")) / F.lit(CHUNK)).cast("long").alias("chunk"), "tree", "width", "sources", (F.col("offset") + F.col("row") - F.col("earlier")).alias("index"), "doc_id", "leaf", "changed")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by chunk -> (chunk, its rows)."""
    chunk, held = None, []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for of, same in groupby(rows, key=lambda r: r[0]):
            if of != chunk:
                if held:
                    yield chunk, held
                chunk, held = of, []
            held += same
    if held:
        yield chunk, held


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, rows in _chunks(batches):
        widths = {tree: width for _, tree, width, *_ in rows} | {TOP: rows[0][3]}
        left, _ = merged({(tree, 0, index): leaf.hex() for _, tree, _, _, index, leaf in rows}, widths)
        yield _table(chunk, left, widths)


def _table(chunk: int, nodes: dict[Key, str], widths: dict[int, int], last: str = "digest") -> pa.RecordBatch:
    keys = sorted(nodes)
    columns = [[chunk] * len(keys), [k[0] for k in keys], [widths[k[0]] for k in keys], [widths[TOP]] * len(keys), [k[1] for k in keys], [k[2] for k in keys], [nodes[k] for k in keys]]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "tree", "width", "sources", "level", "index", last])


def _nodes(frame: pd.DataFrame, value: str = "digest") -> tuple[dict[Key, str], dict[int, int]]:
    keys = zip(frame["tree"].tolist(), frame["level"].tolist(), frame["index"].tolist(), strict=True)
    widths = dict(zip(frame["tree"].tolist(), frame["width"].tolist(), strict=True))
    if len(frame):
        widths[TOP] = int(frame["sources"].iloc[0])
    return dict(zip(keys, frame[value].tolist(), strict=True)), widths


def _merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    nodes, widths = _nodes(frame)
    return _table(int(key[0]), merged(nodes, widths)[0], widths).to_pandas()


def _descend(key: tuple, below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Fragments of one merge, and the paths of what it left -> paths of all their nodes, by chunk."""
    below = below.drop(columns="group")
    nodes, widths = _nodes(below)
    found = paths(nodes, widths, _nodes(above, "path")[0])
    keys = zip(below["tree"].tolist(), below["level"].tolist(), below["index"].tolist(), strict=True)
    return below.drop(columns="digest").assign(path=[found[k] for k in keys])


def tree_reduce(fragments: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The fragments, then those after each round in which FAN neighbours merge; the last has the root alone."""
    rounds = [fragments]
    while (rounds[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        group = F.floor(F.col("chunk") / FAN).cast("long").alias("group")
        rounds.append(scratch.save(rounds[-1].groupBy(group).applyInPandas(_merge, NODE), f"round{len(rounds)}"))
    return rounds


def descended(rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(chunk, tree, width, sources, level, index, path) of the nodes in the first of the rounds."""
    known = rounds[-1].select("chunk", "tree", "width", "sources", "level", "index", F.lit("").alias("path"))
    for i, below in reversed(list(enumerate(rounds[:-1]))):
        group = F.floor(F.col("chunk") / FAN).cast("long")
        known = scratch.save(below.withColumn("group", group).groupBy("group").cogroup(known.withColumnRenamed("chunk", "group").groupBy("group")).applyInPandas(_descend, PATH), f"paths{i}")
    return known


def folded(leaf: str, steps: list[str], depth: int) -> tuple[str, str]:
    """(digest after the first depth steps, after all)."""
    digest = after = leaf
    for i, step in enumerate(steps):
        left, _, right = step.partition("|")
        digest = parent((left, digest, right))
        if i + 1 == depth:
            after = digest
    return after, digest


def _proved(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The leaves of a chunk and the paths of the nodes that it can't resolve alone -> the proofs of its leaves."""
    kind = None

    def noted():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            yield batch

    for _, rows in _chunks(noted()):
        widths, above, leaves = {TOP: rows[0][3]}, {}, []
        for _, tree, width, _, level, index, path, doc, leaf, changed in rows:
            widths[tree] = width
            if path is not None:
                above[tree, level, index] = path
            else:
                leaves.append((tree, index, doc, leaf.hex(), changed and changed.hex()))
        known = paths({(tree, 0, index): leaf for tree, index, _, leaf, _ in leaves}, widths, above)
        depths = {tree: next(n for n in range(99) if _width(width, n) == 1) for tree, width in widths.items()}
        out = []
        for tree, index, doc, leaf, changed in leaves:
            steps = known[tree, 0, index].split(";")[:-1]
            siblings = "".join(steps).replace("|", "")
            fold = folded(changed or leaf, steps, 0)[1]
            out.append((doc, leaf, folded(leaf, steps, depths[tree])[0], root, parent((siblings,)), fold, fold == root))
        columns = zip(zip(*out, strict=True), (kind, *[pa.string()] * 5, pa.bool_()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], PROOF)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, changed, number): the digest of each document and of what tampering leaves of it, where it does:
    it deletes the newlines of the text of every document whose doc_id has an even crc32."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in fields]
    return docs.select("doc_id", "source", F.unhex(leaf(*map(F.col, fields))).alias("leaf"), F.when(changed, F.unhex(leaf(*other))).alias("changed"), F.monotonically_increasing_id().alias("number"))


def proofs(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of leaves(): the root of all, the digest of the
    siblings on the way there, and the root that the leaf, or what tampering made of it, gives with them."""
    spread = scratch.save(placed(scratch.save(found, "leaves"), scratch), "placed")
    scratch.drop_others("placed")
    order = ["chunk", "tree", "index"]
    dealt = spread.select("chunk", "tree", "width", "sources", "index", "leaf").repartition("chunk").sortWithinPartitions(*order)
    rounds = tree_reduce(scratch.save(dealt.mapInArrow(_fragments, NODE), "round0"), scratch)
    top = rounds[-1].first()
    root = top["digest"] if top else ""
    above = descended(rounds, scratch)
    none = lambda kind: F.lit(None).cast(kind)
    doc = spread.schema["doc_id"].dataType
    rows = spread.select("chunk", "tree", "width", "sources", F.lit(0).alias("level"), "index", none("string").alias("path"), "doc_id", "leaf", "changed")
    both = rows.unionByName(above.select(*above.columns, none(doc).alias("doc_id"), none("binary").alias("leaf"), none("binary").alias("changed")))
    schema = f"doc_id {doc.simpleString()}, " + ", ".join(f"{n} string" for n in PROOF[1:-1]) + ", verified boolean"
    return both.repartition("chunk").sortWithinPartitions(*order).mapInArrow(lambda batches: _proved(batches, root), schema)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document against the root of the whole table."""
    return proofs(leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark, "op11"))
