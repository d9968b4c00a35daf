"""N-gram Jaccard join with signature trees.

Two documents link when their sets of word shingles overlap by at least `percent` of the union. The join is exact up to
64-bit hashing and has four steps, each of which reads a stored table and none of which pairs up a whole group:

1. `describe`: every text becomes a set; equal sets are one node, whatever the number of copies. The same pass gathers the
   shingles that very many documents share (heavy hitters of each chunk, summed over all), at most 2 / HEAVY of them.
2. `prefixes`: linked sets share a shingle among the first n - ceil(percent * n) + 1 of any common order. The order puts
   heavy shingles last, so a passage that half the corpus quotes is hardly ever a key. Shingles under one node go.
3. `stars`: each node is compared with one centre among the groups of its keys, by exact overlap. This joins groups of
   near copies with a linear number of comparisons.
4. `signature trees`: keys that still hold several components become trees. A leaf is a node's bitmap; an inner node holds
   the OR of its leaves' bitmaps and their range of sizes. Two tree nodes are traversed together and a pair is dropped
   when no set below one can overlap a set below the other enough: by sizes, or by the bits of the one missing in the
   other. Pairs of leaves of different components that remain may link; only a forest of them leaves a task, which names
   the clusters of nodes that may be linked to each other.
5. `verified_cells`: the sets of a cluster meet in one place, each once. Trees over them give the pairs, the pairs that a
   union-find has not joined yet are compared exactly, and at most nodes - 1 links leave a cell.

A node of a large key is compared with nodes of near size only: keys are cut into bands of sizes. Cells that are still too
large are dealt out as pairs of blocks. Components come from the verified links.

Defined cases: a null or blank text has no shingles, links with nothing and is its own component; a null id may be linked,
but is no smallest id; repeated rows are one node; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import free_name, stored, tidied, without_keys
from bomlens.llm.components import components
from bomlens.llm.shingles import WordHashes, set_id, shingle_set

WIDTH, PERCENT = 5, 80
#: A shingle is heavy from this share of all shingles on.
HEAVY = 1 / 500_000
#: Shingles looked at together for heavy hitters.
CHUNK = 2_000_000
BLOCK = 1024
STAR_MEMBERS = 512
FANOUT = 8
SALTS = 8
DESCRIBED = ["id", "n", "node", "bits", "token", "seen"]
#: A list of ids is broadcast up to this length (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: A node is compared with a centre that has this share of its keys at least.
STAR_SHARE = 0.25
#: Keys with more nodes become trees; the nodes of the others are compared by sorted sizes.
TREE_FROM = 48
#: Shingles of the sets that are compared in one place, and sets compared with one at a time.
CELL_TOKENS, COMPARED = 2_000_000, 512


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _texts(batch: pa.RecordBatch, at: int):
    column = batch.column(at).cast(pa.binary())
    return (value.as_py() for value in column)


def least_overlap(n: np.ndarray | int, percent: int):
    """The fewest common shingles of a set of n and any linked set."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - int(least_overlap(n, percent)) + 1


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap by the percentage of their union."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= percent * (len(left) + len(right) - common)


def describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (id, n, node, bits) of documents, and rows (token, seen) of chunks' frequent shingles with a null n.

    bits is the bitmap of a set, given once for each node and batch.
    """

    def run(batches):
        known, chunk, size = WordHashes(), [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(chunk), return_counts=True)
            keep = counts >= max(2, size * HEAVY / 2)
            k = int(keep.sum())
            nulls = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([nulls, nulls, nulls, pa.nulls(k, pa.binary()), pa.array(_signed(values[keep])), pa.array(counts[keep])], names=DESCRIBED)

        for batch in batches:
            sizes, nodes, maps, own = [], [], [], set()
            for text in _texts(batch, 1):
                found = shingle_set(text, known, width)
                sizes.append(len(found))
                nodes.append(set_id(found) if len(found) else None)
                new = len(found) > 0 and nodes[-1] not in own
                maps.append(bitmap(found, signature_bits(len(found))).tobytes() if new else None)
                if new:
                    own.add(nodes[-1])
                    chunk.append(found)
                    size += len(found)
                    if size >= CHUNK:
                        yield frequent()
                        chunk, size = [], 0
            nulls = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), nulls, nulls], names=DESCRIBED)
        if chunk:
            yield frequent()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "id bigint, n bigint, node bigint, bits binary, token bigint, seen bigint")


def heavy_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted heavy shingles and their counts; no more than 2 / HEAVY, whatever the corpus."""
    total = described.filter("n is not null").agg(F.sum("n")).first()[0] or 0
    found = described.filter("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= max(2.0, total * HEAVY / 2)).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["seen"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, text_col: str, heavy, width: int, percent: int) -> DataFrame:
    """(token, node, k): the k first shingles of every set, rarest first, once for each node and task."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        known, done = WordHashes(), set()
        tokens, counts = shared.value
        for batch in batches:
            out_tokens, out_nodes, out_sizes = [], [], []
            for text in _texts(batch, 0):
                found = shingle_set(text, known, width)
                if not len(found) or (node := set_id(found)) in done:
                    continue
                if len(done) >= 500_000:
                    done.clear()
                done.add(node)
                k = prefix_length(len(found), percent)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    weight = np.where(tokens[at] == found, counts[at], 0)
                    found = found[np.lexsort((found, weight))]
                out_tokens.append(found[:k])
                out_nodes.append(np.full(k, node, dtype=np.int64))
                out_sizes.append(np.full(k, k, dtype=np.int32))
            if out_tokens:
                arrays = [pa.array(_signed(np.concatenate(out_tokens))), pa.array(np.concatenate(out_nodes)), pa.array(np.concatenate(out_sizes))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "k"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidied(run), "token bigint, node bigint, k int")


def _gathered(batches, columns: int) -> list[np.ndarray]:
    """All rows of a task as arrays of the first columns."""
    parts = [[np.asarray(b.column(i)) for i in range(columns)] for b in batches if b.num_rows]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(columns)]


def shared_keys(pairs: DataFrame) -> DataFrame:
    """(token, node, k, low, high) of the tokens under several nodes; low and high are the group's least and greatest node."""

    def run(batches):
        token, node, k = _gathered(batches, 3)
        if not len(token):
            return
        order = np.lexsort((node, token))
        token, node, k = token[order], node[order], k[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, k = token[fresh], node[fresh], k[fresh]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        low, high = np.repeat(node[first], size), np.repeat(node[first + size - 1], size)
        keep = np.repeat(size > 1, size)
        for at in range(0, len(keep), 1_000_000):
            part = slice(at, at + 1_000_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part][keep[part]]) for x in (token, node, k, low, high)], names=["token", "node", "k", "low", "high"])

    return pairs.repartition("token").mapInArrow(tidied(run), "token bigint, node bigint, k int, low bigint, high bigint")


def node_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, tokens binary) of the wanted nodes; tokens are the sorted 64-bit hashes."""
    key = F.coalesce("id", F.lit(-(2**63)).cast("bigint"))  # a null id is found again too
    homes = described.filter("node is not null").select("node", key.alias("id")).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    ids = stored(homes.select("id").distinct(), "homes")
    small = ids.count() <= BROADCAST_IDS and wanted.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("id", key).join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def run(batches):
        known, done = WordHashes(), set()
        for batch in batches:
            found = [shingle_set(text, known, width) for text in _texts(batch, 1)]
            nodes = [set_id(f) for f in found]
            fresh = [n for n, node in enumerate(nodes) if node not in done and not done.add(node)]
            if len(done) > 500_000:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[n] for n in fresh], pa.int64()), pa.array([found[n].tobytes() for n in fresh], pa.binary())], names=["node", "tokens"])

    found = rows.mapInArrow(tidied(run), "node bigint, tokens binary")
    return found.join(F.broadcast(wanted) if small else wanted, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough; members (b) travel to their centre (a), a centre's members in parts."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("members"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / STAR_MEMBERS)).cast("int")
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).join(sets.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("centre"), F.col("part").alias("share"), "tokens")
    members = (
        pairs.join(sizes, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
        .join(sets.withColumnRenamed("node", "b"), "b")
        .select("a", "b", "part", F.col("tokens").alias("member"))
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        centre = np.frombuffer(left.column("tokens")[0].as_py(), dtype=np.uint64)
        keep = [linked(centre, np.frombuffer(m.as_py(), dtype=np.uint64), percent) for m in right.column("member")]
        return right.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return centres.groupBy("centre", "share").cogroup(members.groupBy("a", "part")).applyInArrow(run, "a bigint, b bigint")


def star_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each node b the one centre a, least or greatest of a key's nodes, with which it shares most keys.

    A centre with less than STAR_SHARE of the node's keys is left to the trees.
    """
    ends = keys.select("node", "k", F.explode(F.array("low", "high")).alias("centre")).filter("node <> centre")
    counted = ends.groupBy("node", "k", "centre").agg(F.count("*").alias("shared"))
    best = counted.groupBy("node", "k").agg(F.max(F.struct("shared", "centre")).alias("best")).filter(F.col("best.shared") >= STAR_SHARE * F.col("k"))
    return best.select(F.col("best.centre").alias("a"), F.col("node").alias("b"))


def possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps and sizes leave room for enough overlap."""
    left = signatures.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                keep.append(pair_may_link(n_a, n_b, np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return joined.mapInArrow(tidied(run), "a bigint, b bigint")


def pair_may_link(n_a: int, n_b: int, map_a: np.ndarray, map_b: np.ndarray, percent: int) -> bool:
    """The bound between two leaves, for bitmaps of any two widths."""
    if 100 * n_a < percent * n_b or 100 * n_b < percent * n_a:
        return False
    width = min(len(map_a), len(map_b))
    map_a, map_b = fold(map_a, width), fold(map_b, width)
    common, only_a, only_b = (int(np.bitwise_count(m).sum()) for m in (map_a & map_b, map_a & ~map_b, map_b & ~map_a))
    most = min(n_a - only_a, n_b - only_b)
    return common > 0 and 100 * most >= percent * (n_a + n_b - most)


def signature_bits(n: int) -> int:
    """Bits of a set's bitmap: the power of two from twice its size on, 128 at least."""
    return max(128, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bit h mod bits of each token, packed."""
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def fold(packed: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits: size bytes; halves are OR-ed as bits count modulo a power of two."""
    while len(packed) > size:
        packed = packed[: len(packed) // 2] | packed[len(packed) // 2 :]
    return packed


class SignatureTree:
    """Leaves in order of set size; an inner node ORs FANOUT children's bitmaps and spans their sizes.

    A level is (least size, greatest size, greatest number of shingles beyond the bits they set, bitmaps).
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        sizes, bitmaps = sizes[self.order], bitmaps[self.order]
        level = (sizes, sizes, sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64), bitmaps)
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FANOUT)
            level = (
                np.minimum.reduceat(level[0], starts),
                np.maximum.reduceat(level[1], starts),
                np.maximum.reduceat(level[2], starts),
                np.bitwise_or.reduceat(level[3], starts, axis=0),
            )
            self.levels.append(level)


def may_overlap(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, leaf: bool, percent: int) -> np.ndarray:
    """Whether a set below tree node i and one below j can be linked, for arrays of i and j.

    The larger set's size bounds the smaller's from below. Common shingles set common bits, and no more of them share a
    bit than a set has shingles beyond its bits: that bounds the overlap of inner nodes. Between leaves, each bit that the
    other bitmap lacks is a shingle outside the overlap, so the overlap is at most n less those bits, on either side.
    """
    small_a, big_a, spare_a, map_a = (x[i] for x in left)
    small_b, big_b, spare_b, map_b = (x[j] for x in right)
    fits = (100 * big_a >= percent * small_b) & (100 * big_b >= percent * small_a)
    common = np.bitwise_count(map_a & map_b).sum(axis=1, dtype=np.int64)
    if not leaf:
        return fits & (100 * (common + np.minimum(spare_a, spare_b)) >= percent * np.maximum(small_a, small_b))
    missing_a = np.bitwise_count(map_a).sum(axis=1, dtype=np.int64) - common
    missing_b = np.bitwise_count(map_b).sum(axis=1, dtype=np.int64) - common
    most = np.minimum(small_a - missing_a, small_b - missing_b)
    return fits & (100 * most >= percent * (small_a + small_b - most))


def tree_pairs(left: SignatureTree, right: SignatureTree | None, group_l: np.ndarray, group_r: np.ndarray, percent: int):
    """Pairs of leaves (numbers in the trees' inputs) of different components that may be linked; right None: within left."""
    other = left if right is None else right
    deep_l, deep_r = len(left.levels) - 1, len(other.levels) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(i):
        leaf = deep_l == 0 and deep_r == 0
        step = max(1, 4_000_000 // left.levels[deep_l][3].shape[1])
        keep = np.concatenate([may_overlap(left.levels[deep_l], other.levels[deep_r], i[k : k + step], j[k : k + step], leaf, percent) for k in range(0, len(i), step)])
        i, j = i[keep], j[keep]
        if leaf:
            a, b = left.order[i], other.order[j]
            keep = (a != b if right is None else np.ones(len(a), dtype=bool)) & (group_l[a] != group_r[b])
            return a[keep], b[keep]
        down_l, down_r = deep_l >= deep_r and deep_l > 0, deep_r >= deep_l and deep_r > 0
        if down_l:
            i, j = _children(i, j, len(left.levels[deep_l - 1][0]))
        if down_r:
            j, i = _children(j, i, len(other.levels[deep_r - 1][0]))
        deep_l, deep_r = deep_l - down_l, deep_r - down_r
        if right is None:
            i, j = i[i <= j], j[i <= j]
    return i, j


def _children(parent: np.ndarray, other: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each parent beside the parent's partner."""
    child = (parent[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    partner = np.repeat(other, FANOUT)
    there = child < below
    return child[there], partner[there]


class Forest:
    """Union-find over the numbers of some nodes; keeps the pairs that joined two trees."""

    def __init__(self, count: int):
        self.parent = np.arange(count)
        self.left: list[int] = []
        self.right: list[int] = []

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while len(found) and ((above := self.parent[found]) != found).any():
            found = above
        self.parent[nodes] = found
        return found

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the pairs one by one; those that are joined already are passed over."""
        apart = self.roots(i) != self.roots(j)
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.left.append(a)
                self.right.append(b)


def size_band(n, percent: int):
    """The band of a set's size: linked sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def tree_candidates(keys: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a key and may be linked: forests that span all such pairs.

    keys: (token, node, component); signatures: (node, n, bits). Tokens over the same nodes are one key. Every cell is a key,
    or two neighbouring bands of sizes of a key with more than BLOCK nodes, or a pair of their blocks.
    """
    groups = keys.groupBy("token").agg(F.count("*").alias("held"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("name"))
    named = groups.groupBy("held", "name").agg(F.min("token").alias("token")).select("token", "held")
    placed = keys.join(named, "token")
    small = placed.filter(F.col("held") <= BLOCK).select(F.xxhash64("token").alias("cell"), "node", "component", F.lit(0).cast("bigint").alias("side"))
    sized = placed.filter(F.col("held") > BLOCK).join(signatures.select("node", "n"), "node")
    large = sized.withColumn("own", size_band(F.col("n"), percent)).select("token", "node", "component", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    blocks = F.ceil(F.col("in_band") / BLOCK).cast("int")
    banded = large.join(large.groupBy("token", "band").agg(F.count("*").alias("in_band")), ["token", "band"])
    banded = banded.select("token", "band", "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    dealt = banded.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("token", "band", F.least("block", "partner"), F.greatest("block", "partner")).alias("cell"), "node", "component", F.signum(F.col("partner") - F.col("block")).cast("bigint").alias("side")
    )
    rows = small.unionByName(dealt).join(signatures, "node").select("cell", "node", "component", "n", "side", "bits")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        cell, node, component, n, side = (np.concatenate([np.asarray(b.column(k)) for b in parts]) for k in range(5))
        bits = pa.chunked_array([b.column(5) for b in parts])
        names, number = np.unique(node, return_inverse=True)
        forest = Forest(len(names))
        order = np.lexsort((n, cell))
        edges = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True])
        held = np.diff(edges)
        few = order[np.repeat(held <= TREE_FROM, held)]
        i, j = neighbour_pairs(cell[few], node[few], component[few], n[few], side[few], percent)
        i, j = few[i], few[j]
        keep = possible_rows(i, j, n, bits, percent)
        forest.join(number[i[keep]], number[j[keep]])
        for start, end in zip(edges[:-1][held > TREE_FROM], edges[1:][held > TREE_FROM], strict=True):
            rows_ = order[start:end]
            maps = [np.frombuffer(x.as_py(), np.uint8) for x in bits.take(pa.array(rows_))]
            for a, b in cell_pairs(component[rows_], n[rows_], side[rows_], maps, percent):
                forest.join(number[rows_[a]], number[rows_[b]])
        yield ordered_pairs(*(names[np.array(x, np.int64)] for x in (forest.left, forest.right)))

    return rows.repartition("cell").mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def verified_cells(maybe: DataFrame, labels: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that join the nodes of each cluster of maybe (a, b) as far as links connect them.

    labels: (node, component) of known links; signatures: (node, n); sets: (node, tokens). Clusters of more than
    CELL_TOKENS shingles are dealt out as pairs of blocks.
    """
    clusters = components(maybe).withColumnRenamed("component", "cluster").join(signatures.select("node", "n"), "node").join(labels, "node", "left")
    totals = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / CELL_TOKENS).cast("int").alias("blocks"))
    placed = clusters.join(totals, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("cluster", F.least("block", "partner"), F.greatest("block", "partner")).alias("cell"), "node", F.coalesce("component", "node").alias("component"), F.signum(F.col("partner") - F.col("block")).cast("bigint").alias("side")
    )
    rows = dealt.join(sets, "node").select("cell", "node", "component", "side", "tokens")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        cell, node, component, side = (np.concatenate([np.asarray(b.column(k)) for b in parts]) for k in range(4))
        tokens = pa.chunked_array([b.column(4) for b in parts])
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            rows_ = order[start:end]
            found = [np.frombuffer(x.as_py(), np.uint64) for x in tokens.take(pa.array(rows_))]
            a, b = exact_cell(component[rows_], side[rows_], found, percent)
            yield ordered_pairs(node[rows_[a]], node[rows_[b]])

    return rows.repartition("cell").mapInArrow(tidied(run), "a bigint, b bigint")


def exact_cell(component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a cell's sets, fewer than there are sets, that join all sets which links connect."""
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    sets, n, component, side = [sets[k] for k in order], n[order], component[order], side[order]
    forest = Forest(len(sets))
    _, first, label = np.unique(component, return_index=True, return_inverse=True)
    forest.parent = first[label]
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    starts, mark = ends - n, np.zeros(len(names), bool)
    maps = [bitmap(x, signature_bits(len(x))) for x in sets]
    for i, j in cell_pairs(component, n, side, maps, percent):
        by_left = np.lexsort((j, i))
        i, j = i[by_left], j[by_left]
        bounds = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            a, others = int(i[low]), j[low:high]
            own = codes[starts[a] : ends[a]]
            mark[own] = True
            for at in range(0, len(others), COMPARED):
                part = others[at : at + COMPARED]
                part = part[forest.roots(part) != forest.root(a)]
                if not len(part):
                    continue
                cuts = np.cumsum(n[part]) - n[part]
                places = np.arange(n[part].sum()) + np.repeat(starts[part] - cuts, n[part])
                common = np.add.reduceat(mark[codes[places]].astype(np.int64), cuts)
                hit = part[100 * common >= percent * (n[a] + n[part] - common)]
                forest.join(np.full(len(hit), a), hit)
            mark[own] = False
    return order[np.array(forest.left, np.int64)], order[np.array(forest.right, np.int64)]


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def neighbour_pairs(cell, node, component, n, side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of all small cells, sorted by cell and size, that pass on sizes, components and sides; each node pair once."""
    left, right = [], []
    for gap in range(1, TREE_FROM):
        i = np.flatnonzero(cell[gap:] == cell[:-gap]) if gap < len(cell) else np.empty(0, np.int64)
        if not len(i):
            break
        j = i + gap
        keep = (100 * n[i] >= percent * n[j]) & (component[i] != component[j]) & ((side[i] == 0) | (side[i] != side[j]))
        left.append(i[keep])
        right.append(j[keep])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((high, low))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return i[order[first]], j[order[first]]


def possible_rows(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: pa.ChunkedArray, percent: int) -> np.ndarray:
    """The bound between leaves for many pairs of rows, a width of bitmaps at a time."""
    keep = np.zeros(len(i), dtype=bool)
    used, place = np.unique(np.r_[i, j], return_inverse=True)
    maps = [np.frombuffer(x.as_py(), np.uint8) for x in bits.take(pa.array(used))] if len(used) else []
    width = np.array([len(m) for m in maps], dtype=np.int64)
    place_i, place_j = place[: len(i)], place[len(i) :]
    narrow = np.minimum(width[place_i], width[place_j]) if len(i) else np.empty(0, np.int64)
    for w in np.unique(narrow):
        rows = np.flatnonzero(narrow == w)
        own, at = np.unique(np.r_[place_i[rows], place_j[rows]], return_inverse=True)
        table = np.stack([fold(maps[k], int(w)) for k in own])
        ones = np.bitwise_count(table).sum(axis=1, dtype=np.int64)
        for start in range(0, len(rows), max(1, 8_000_000 // int(w))):
            part = slice(start, start + max(1, 8_000_000 // int(w)))
            a, b, r = at[: len(rows)][part], at[len(rows) :][part], rows[part]
            common = np.bitwise_count(table[a] & table[b]).sum(axis=1, dtype=np.int64)
            n_a, n_b = n[i[r]], n[j[r]]
            most = np.minimum(n_a - (ones[a] - common), n_b - (ones[b] - common))
            keep[r] = (common > 0) & (100 * most >= percent * (n_a + n_b - most))
    return keep


def cell_pairs(component, n, side, maps: list[np.ndarray], percent: int):
    """Arrays (i, j) of a cell's nodes, sorted by size, that may be linked and have different components; sides -1 and 1 are two blocks."""
    # sizes are sorted: bands that overlap by the factor of linked sizes keep bitmaps wide enough for each band
    start = 0
    while start < len(n):
        inner = int(np.searchsorted(n, 2 * n[start], "left"))
        end = int(np.searchsorted(n, 2 * n[start] * 100 // percent + 1, "right"))
        inner = max(inner, start + 1)
        band = np.arange(start, end)
        width = min(len(maps[k]) for k in band)
        folded = np.stack([fold(maps[k], width) for k in band])
        lefts = band[side[band] <= 0] - start
        rights = band[side[band] > 0] - start
        if (side[band] == 0).any():
            tree = SignatureTree(n[band], folded)
            a, b = tree_pairs(tree, None, component[band], component[band], percent)
        elif len(lefts) and len(rights):
            a, b = tree_pairs(SignatureTree(n[band[lefts]], folded[lefts]), SignatureTree(n[band[rights]], folded[rights]), component[band[lefts]], component[band[rights]], percent)
            a, b = lefts[a], rights[b]
        else:
            a = b = np.empty(0, np.int64)
        a, b = band[a], band[b]
        own = (a < inner) | (b < inner)
        yield a[own], b[own]
        start = inner


def tree_cell(node, component, n, side, bits, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of cell_pairs as nodes."""
    pairs = list(cell_pairs(component, n, side, [np.frombuffer(x.as_py(), np.uint8) for x in bits], percent))
    return tuple(np.concatenate([node[p[k]] for p in pairs]) for k in range(2))


def open_keys(keys: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(token, node, component) of the keys that hold several components, without nodes too far in size from all others.

    k, the number of a set's keys, stands for its size n: n is less than 100 k / (100 - percent), and no less than that of k - 1.
    """
    labelled = keys.select("token", "node", "k").join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"), "k")

    def run(batches):
        token, node, component, k = _gathered(batches, 4)
        if not len(token):
            return
        order = np.lexsort((component, token))
        token, node, component, k = (x[order] for x in (token, node, component, k))
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        keep = np.repeat(component[first] != component[first + size - 1], size)
        token, node, component, k = (x[keep] for x in (token, node, component, k))
        order = np.lexsort((k, token))
        token, node, component, k = (x[order] for x in (token, node, component, k))
        close = (token[1:] == token[:-1]) & (100 * k[:-1] > percent * (k[1:] - 1))
        keep = np.r_[False, close] | np.r_[close, False] if len(k) else np.empty(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, component)], names=["token", "node", "component"])

    return labelled.repartition("token").mapInArrow(tidied(run), "token bigint, node bigint, component bigint")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(described rows (id, n, node), verified links (a, b) between nodes); the links connect every linked pair's components."""
    described = stored(describe(docs, id_col, text_col, width), "described")
    signatures = described.filter("bits is not null").select("node", "n", "bits")

    def signed(nodes: DataFrame) -> DataFrame:
        return signatures.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return stored(node_sets(docs, described, stored(wanted, "wanted"), id_col, text_col, width), "sets")

    keys = stored(shared_keys(prefixes(docs, text_col, heavy_shingles(described), width, percent)), "keys")
    stars = star_pairs(keys, percent)
    ends = keys.select("node").distinct()
    pairs = stored(possible(stars, signed(ends), percent), "stars")
    near = stored(verified(pairs, sets_of(pairs), percent), "links")
    labels = stored(components(near), "labels")
    rest = stored(open_keys(keys, labels, percent), "open")
    maybe = stored(tree_candidates(rest, signed(rest.select("node").distinct()), percent), "maybe")
    far = stored(verified_cells(maybe, labels, signed(maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()), sets_of(maybe), percent), "links")
    return described.filter("n is not null").select("id", "n", "node"), near.unionByName(far)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the least id reachable by links."""
    described, links = jaccard_links(docs, id_col, text_col, width, percent)
    labels = components(links)
    least = (
        described.filter("node is not null")
        .groupBy("node")
        .agg(F.min("id").alias("id"))
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = least.groupBy("component").agg(F.min("id").alias("component_id"))
    by_node = least.join(smallest, "component").select("node", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = described.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(by_node, ["node", "salt"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of the smallest id of every component, with all columns; of rows equal in id and text one stays.

    Rows are told apart by a hash of id and text, so rows that share an id but not the text are judged each on its own.
    """
    name = free_name(docs, "_mark")
    marked = docs.withColumn(name, F.xxhash64(F.col(id_col), F.col(text_col)))
    described, links = jaccard_links(marked, name, text_col)
    labels = components(links)
    own = marked.select(F.col(name).alias("_mark"), F.col(id_col).cast("bigint").alias("id"))
    groups = described.filter("node is not null").join(labels, "node", "left").select(F.col("id").alias("_mark"), F.coalesce("component", "node").alias("component"))
    placed = stored(groups.distinct().join(own.distinct(), "_mark"), "groups")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("_mark"))).alias("least"))
    kept = first.select(F.col("least._mark").alias("_mark"))
    single = without_keys(marked, placed.select("_mark").join(kept, "_mark", "left_anti").withColumnRenamed("_mark", name), name)
    repeated = stored(own.groupBy("_mark").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("_mark").alias(name)), "repeated")
    once = single.join(repeated, name, "left_semi").dropDuplicates([name])
    return without_keys(single, repeated, name).unionByName(once).select(*docs.columns)
