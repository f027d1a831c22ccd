"""SimHash near-duplicates: exact Hamming neighbours through a vantage-point tree.

A node holds a vantage point and the median of the distances to it; fingerprints up to the median go to one child, the others to the other. The
depth follows the number of fingerprints, so that a leaf holds some ``LEAF`` of them. Each level measures on its own block of bits, and distances on
disjoint blocks add up: by the triangle inequality a neighbour on the other side of a node differs there by at least the
distance to the median, and within the radius these differences can only add up to the radius. So a fingerprint
visits, besides its own leaf, the leaves that it reaches with that budget; their number grows with a power of the depth, not of the
table. Every pair within the radius meets in the later of its two leaves.

Scale: equal fingerprints meet once, whatever their number of documents. The tree is built from a sample of at most ``SAMPLE`` fingerprints and
travels to the tasks (some bytes a node). Leaves with many fingerprints are cut into blocks on both sides of the comparison. A block
reports a spanning star per group of linked fingerprints instead of all pairs of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import row_key, staged, whole_text
from sitewarden.llm.components import components

SEED = 42
RADIUS = 3
#: Fingerprints of a leaf, of the sample the tree is built from (and of it per leaf), deepest tree (three bits a level).
LEAF, SAMPLE, SAMPLE_PER_LEAF, DEEPEST = 32_768, 1 << 20, 32, 21
#: Fingerprints of one side of a block, cells of one comparison matrix, and rows of one group of blocks, which one task holds.
BLOCK, CELLS, GROUP_ROWS = 262_144, 4_000_000, 500_000


def simhash(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint, signed as Spark keeps it."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A to Z change, only ASCII white space parts
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(begins, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``key`` (of id and text) and ``fp`` per row; null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("key"), of(text).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Tree:
    """Vantage points and medians by node (the children of ``i`` are ``2 i`` and ``2 i + 1``, the root is 1), and the bits of each level."""

    def __init__(self, sample: np.ndarray, depth: int):
        bounds = [round(64 * i / depth) for i in range(depth + 1)] if depth else []
        self.masks = [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(bounds, bounds[1:])]
        self.point, self.median = np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int64)
        node = np.ones(len(sample), np.int64)
        for level, mask in enumerate(self.masks):
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            for i in range(1 << level):
                here = sample[order[cuts[i] : cuts[i + 1]]] & mask
                if not len(here):
                    continue
                # The point, of a few, from which the distances spread most.
                some = here[:: max(1, len(here) // 16)][:16]
                spread = np.bitwise_count(some[:, None] ^ here[None, :512]).astype(float).std(axis=1)
                at = (1 << level) + i
                self.point[at] = some[int(spread.argmax())]
                distance = np.bitwise_count(here ^ self.point[at]).astype(np.int64)
                # The bound that halves the node best; all may lie on one side.
                upto = np.cumsum(np.bincount(distance, minlength=66))
                self.median[at] = int(np.abs(2 * upto - len(here)).argmin())
            node = 2 * node + (np.bitwise_count(sample & mask ^ self.point[node]) > self.median[node])

    def descend(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, row and whether it is the row's own, for every leaf that a row visits: its own and later ones within the radius."""
        row, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        spent, own = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for mask in self.masks:
            distance = np.bitwise_count(fps[row] & mask ^ self.point[node]).astype(np.int64)
            over = distance - self.median[node]
            right = over > 0
            cost = spent + np.where(right, over, 1 - over)
            cross = cost <= radius
            node = np.concatenate([2 * node + right, (2 * node + ~right)[cross]])
            row, spent = np.concatenate([row, row[cross]]), np.concatenate([spent, cost[cross]])
            own = np.concatenate([own, np.zeros(int(cross.sum()), bool)])
        home = np.empty(len(fps), np.int64)
        home[row[own]] = node[own]
        kept = own | (node > home[row])
        return node[kept], row[kept], own[kept]


def build_tree(distinct: DataFrame, n: int, leaf: int = LEAF) -> Tree:
    """A tree for ``n`` fingerprints, from a sample of them by hash."""
    depth = min(DEEPEST, max(0, (max(1, -(-n // leaf)) - 1).bit_length()), (SAMPLE // SAMPLE_PER_LEAF).bit_length() - 1)
    wanted = min(SAMPLE, max(1024, SAMPLE_PER_LEAF << depth))
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(max(1, n // wanted))) == 0)
    sample = np.array(sorted(r.fp for r in some.select("fp").collect()), np.int64).view(np.uint64)
    return Tree(np.random.default_rng(SEED).permutation(sample), depth)


def _visits(distinct: DataFrame, tree: Tree, radius: int) -> DataFrame:
    """``cell, home, fp``: every fingerprint in its own leaf and in the later ones that it visits."""
    shared = distinct.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            leaf, row, own = shared.value.descend(fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own), pa.array(fps[row])], names=["cell", "home", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell long, home boolean, fp long")


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node it is linked with, for the components of the given edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars over the pairs of the two sides within the radius; ``same``: the right side begins with the left one."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = left.view(np.uint64), right.view(np.uint64)
    side = 2048
    for i in range(0, len(left), side):
        rows = left[i : i + side]
        wide = max(1, CELLS // len(rows))
        for j in range(i if same else 0, len(right), wide):
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ right[None, j : j + wide]) <= radius)
            a, b = rows[a].view(np.int64), right[j : j + wide][b].view(np.int64)
            apart = a != b
            if apart.any():
                u, v = _stars(np.concatenate([u, a[apart]]), np.concatenate([v, b[apart]]))
    if len(u):
        yield u, v


def _block_links(rows: pd.DataFrame, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one pair of blocks of a leaf; two visitors meet in a leaf of their own."""
    fps, home, first = rows["fp"].to_numpy(), rows["home"].to_numpy(), (rows["own"] == rows["i"]).to_numpy()
    if rows["i"].iloc[0] == rows["j"].iloc[0]:
        yield from _links(fps[home], np.concatenate([fps[home], fps[~home]]), radius, True)
    else:
        yield from _links(fps[first & home], fps[~first], radius, False)
        yield from _links(fps[first & ~home], fps[~first & home], radius, False)


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of fingerprints within ``radius`` bits of each other."""
    spark = distinct.sparkSession
    n = distinct.count()
    visits = staged(_visits(distinct, build_tree(distinct, n, leaf), radius))
    # A row per leaf, as many as the tree has (at most 2 ** DEEPEST, in fact SAMPLE / SAMPLE_PER_LEAF).
    sizes = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-visits.count() // GROUP_ROWS))
    own = visits.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A block meets itself and every other one once.
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", "home", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = met.withColumn("shard", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(groups)).cast("int"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, part in rows.groupby(["cell", "i", "j"], sort=False) for x in _block_links(part, radius)]
        if not found:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        return pd.DataFrame({"u": np.concatenate([x[0] for x in found]), "v": np.concatenate([x[1] for x in found])})

    return dealt.groupBy("shard").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 3,
                    leaf: int = LEAF) -> DataFrame:
    """Per row of ``docs``: id, ``key`` (of id and text), ``fp`` (signed), ``component_id``.

    Rows link where their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest id reachable, the
    row's own included, and null where no row of the component has an id. Null text is empty; texts without a word have
    fingerprint 0, which links like any other. Repeated rows share a fingerprint. An empty table gives no rows.
    """
    rows = staged(fingerprints(docs, id_col, text_col, width))
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least")))
    members = components(links(distinct, radius, leaf))
    linked = members.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = linked.join(least, "root").select(F.col("node").alias("_fp"), "component_id")
    known = distinct.join(of_node, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(known, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), "key", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns.

    Rows that repeat a kept id and text all stay; a component without any id stays whole.
    """
    kept = near_duplicates(docs, id_col, text_col, radius, width).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keys = kept.select(F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key(id_col, whole_text(text_col)).alias("_own"))
    return rows.join(keys, F.col("_own") == F.col("_key"), "left_semi").select("_row.*")
