"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact pairs within a radius."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, save
from .graph import components, local_roots

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
SHARD_POINTS = 2048  # fingerprints aimed at in a shard, before copies near boundaries
SAMPLE_POINTS = 16_384  # fingerprints that place the top tree's boundaries, at most
VANTAGE_TRIES = 24
LEAF_POINTS = 48
SHARD_LIMIT = 16_384  # a shard with more points is split again by its own points, or compared block by block
SHARD_SAMPLE = 1024  # points of such a shard that place its boundaries, about
SPREAD = 1.5  # a split that makes more copies of a point than this is not worth it
GROUP_BYTES = 1 << 21
PAIR_CELLS = 1 << 20  # distances computed at once

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_LANES = np.ascontiguousarray(_BITS).view(np.uint64).ravel()  # bit j of a byte goes to byte j


# -- fingerprints --------------------------------------------------------------------------------


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each text's 3-word shingles, as uint64."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        n = len(words)
        if n == 0:
            continue
        text = b" ".join(words)
        if n < SHINGLE_WORDS:
            hashes.append(digest(text, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - SHINGLE_WORDS] + 1])
        hashes += [digest(text[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]
        sizes[i] = n - SHINGLE_WORDS + 1
    return majority_bits(np.array(hashes, np.uint64), sizes)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; the texts' hashes lie one after another."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    size = sizes[some]
    columns = hashes.view(np.uint8).reshape(-1, 8)
    first = np.cumsum(size) - size
    blocks = -(-size // 255)  # a byte lane counts up to 255
    block_first = np.cumsum(blocks) - blocks
    at = np.repeat(first - 255 * block_first, blocks) + 255 * np.arange(int(blocks.sum()))
    for c in range(8):
        lanes = np.add.reduceat(_LANES[columns[:, c]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(lanes, block_first, axis=0)
        bits = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").ravel()
        out[some] |= bits.astype(np.uint64) << np.uint64(8 * c)
    return out


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of bounded size; at least one list."""
    held, size = [], 0
    for x in texts:
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size > GROUP_BYTES:
            yield held
            held, size = [], 0
    yield held


def fingerprint_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.concatenate([fingerprints(part) for part in _parts(b.column(1))])
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- vantage-point trees -------------------------------------------------------------------------


@dataclass
class Node:
    """Points within ``reach`` of ``vantage`` are inside, the others outside; a leaf has an id or points."""

    vantage: np.uint64 = np.uint64(0)
    reach: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1
    points: np.ndarray | None = None


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, tries: int, balance: float, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and reach with the fewest points near the boundary, parts not too unequal."""
    best, found = None, None
    step = max(1, len(points) // tries)
    for v in points[::step][:tries]:
        count = np.bincount(distance(points, v), minlength=65)
        total = np.cumsum(count)
        for reach in range(1, 63):
            part = total[reach] / len(points)
            if balance <= part <= 1 - balance:
                cost = count[max(0, reach - radius + 1) : reach + 1].sum() / len(points) + 0.1 * abs(part - 0.5)
                if best is None or cost < best:
                    best, found = cost, (v, reach)
    return found


def top_tree(sample: np.ndarray, shards: int, radius: int = RADIUS) -> tuple[Node, int]:
    """A tree whose leaves are numbered shards, and how many there are."""
    leaves = 0

    def grow(points: np.ndarray, want: int) -> Node:
        nonlocal leaves
        cut = _split(points, VANTAGE_TRIES, 0.3, radius) if want > 1 and len(points) >= 8 else None
        if cut is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        near = distance(points, cut[0]) <= cut[1]
        inner = max(1, min(want - 1, round(want * near.mean())))
        return Node(cut[0], cut[1], grow(points[near], inner), grow(points[~near], want - inner))

    return grow(sample, max(1, shards)), leaves


def route(tree: Node, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, shard): each point in its own shard, and a copy wherever a point within
    the radius may be. By the triangle bound only inside points with distance > reach - radius can have
    such a partner outside; any two partners then meet in at least one shard."""
    found: list[tuple[np.ndarray, int]] = []
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, index = stack.pop()
        if not len(index):
            continue
        if node.inside is None:
            found.append((index, node.leaf))
            continue
        d = distance(points[index], node.vantage)
        stack.append((node.inside, index[d <= node.reach]))
        stack.append((node.outside, index[d > node.reach - radius]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([i for i, _ in found]), np.concatenate([np.full(len(i), s, np.int32) for i, s in found])


def pair_chunks(points: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of points at this distance or less, by a vantage-point tree of the points, in bounded parts;
    a pair near a boundary may come twice."""
    stack = [np.arange(len(points))]
    while stack:
        index = stack.pop()
        cut = _split(points[index], 6, 0.2, radius) if len(index) > LEAF_POINTS else None
        if cut is not None:
            d = distance(points[index], cut[0])
            inner, outer = index[d <= cut[1]], index[d > cut[1] - radius]
            if len(outer) < 0.9 * len(index) and len(inner) + len(outer) < 1.3 * len(index):  # else splitting costs more than it prunes
                stack += [inner, outer]
                continue
        rows = 1 + PAIR_CELLS // (len(index) + 1)
        for s in range(0, len(index), rows):
            part = index[s : s + rows]
            i, j = np.nonzero(distance(points[part][:, None], points[index][None, :]) <= radius)
            i, j = part[i], index[j]
            yield i[i < j], j[i < j]


def pairs_within(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of pair_chunks in two arrays."""
    none = np.zeros(0, np.int64)
    chunks = [(none, none), *pair_chunks(points, radius)]
    return np.concatenate([i for i, _ in chunks]), np.concatenate([j for _, j in chunks])


def shard_roots(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest index each point is linked to, from pairs that come and go in bounded parts."""
    root = np.arange(len(points))
    for i, j in pair_chunks(points, radius):
        open_ = root[i] != root[j]
        if open_.any():
            root = local_roots(len(root), root[i[open_]], root[j[open_]])[root]
    return root


# -- the operator --------------------------------------------------------------------------------


def boundary_sample(distinct: DataFrame, column: str, n: int) -> list:
    """At most SAMPLE_POINTS of n distinct rows, those of the least hashes. A bound on the hash leaves about twice
    as many before they are ordered, so that no part of the table sends the driver a whole sample of its own."""
    mixed = F.xxhash64(column)
    share = min(1.0, 2 * SAMPLE_POINTS / max(1, n))
    few = distinct if share == 1.0 else distinct.where(mixed < F.lit(int((share - 0.5) * 2**64)))
    return few.orderBy(mixed).limit(SAMPLE_POINTS).collect()


def _tree_bytes(tree: Node) -> bytes:
    """A tree as rows of (vantage, reach or -1 - leaf), inside before outside."""
    rows: list[tuple[int, int]] = []

    def walk(node: Node) -> None:
        rows.append((int(node.vantage), node.reach if node.inside else -1 - node.leaf))
        if node.inside:
            walk(node.inside)
            walk(node.outside)

    walk(tree)
    return np.array([r[0] for r in rows], "<u8").tobytes() + np.array([r[1] for r in rows], "<i8").tobytes()


def _tree_of(raw: bytes) -> Node:
    vantage, reach = np.frombuffer(raw, "<u8").reshape(2, -1)
    reach, at = reach.view("<i8"), iter(range(len(vantage)))

    def walk() -> Node:
        i = next(at)
        if reach[i] < 0:
            return Node(leaf=int(-1 - reach[i]))
        return Node(vantage[i], int(reach[i]), walk(), walk())

    return walk()


def bounded_shards(spark: SparkSession, shards: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, list[DataFrame]]:
    """(shard, low, high, fp), and the saved tables it reads: shards with over SHARD_LIMIT points are split again by vantage points of their own until
    none is left or a split makes too many copies; those are dealt as pairs of blocks. Any two points within the radius
    still meet in a group, and a group has 2 * SHARD_LIMIT points or so at most.

    A task builds one shard's tree from about SHARD_SAMPLE points; points are routed in parts of SHARD_LIMIT.
    """
    size = F.count(F.lit(1)).alias("n")

    def grow(group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        tree, leaves = top_tree(points, -(-group.column("n")[0].as_py() // SHARD_POINTS), radius)
        index, leaf = route(tree, points, radius)
        grown = leaves > 1 and len(index) <= SPREAD * max(1.0, np.log2(leaves) / 2) * len(points) and np.bincount(leaf).max() <= 0.8 * len(points)
        return pa.table({"shard": group.column("shard")[:1], "tree": pa.array([_tree_bytes(tree) if grown else None], pa.binary())})

    def spread(part: pa.Table, tree: pa.Table) -> pa.Table:
        if not part.num_rows or not tree.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "fp": pa.array([], pa.int64())})
        fp = part.column("fp").to_numpy()
        i, leaf = route(_tree_of(tree.column("tree")[0].as_py()), fp.view(np.uint64), radius)
        parent = part.column("shard")[0].as_py()
        named = np.array([xxhash.xxh64_intdigest(f"{parent}/{k}") >> 1 for k in range(int(leaf.max()) + 1)], np.int64)  # two with one name are one larger shard
        return pa.table({"shard": named[leaf], "fp": fp[i]})

    done, whole, steps = [], [], [shards]
    while True:
        sizes = save(spark, shards.groupBy("shard").agg(size), "shard-sizes")
        steps.append(sizes)
        over = sizes.where(F.col("n") > SHARD_LIMIT)
        if over.isEmpty():
            done.append(shards)
            break
        done.append(shards.join(over, "shard", "left_anti"))
        crowded = shards.join(over, "shard")
        picked = crowded.where(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / SHARD_SAMPLE)) == 0)
        trees = save(spark, picked.groupBy("shard").applyInArrow(grow, "shard long, tree binary"), "shard-trees")
        whole.append(crowded.join(trees.where("tree IS NOT NULL"), "shard", "left_anti"))
        parts = F.ceil(F.col("n") / SHARD_LIMIT).cast("int")
        dealt = crowded.select("shard", "fp", F.pmod(F.xxhash64("fp"), parts).alias("part")).groupBy("shard", "part")
        told = trees.where("tree IS NOT NULL").join(over, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        shards = save(spark, dealt.cogroup(told.groupBy("shard", "part")).applyInArrow(spread, "shard long, fp long"), "split-shards")
        steps += [trees, shards]
    zero = F.lit(0).cast("int")
    out = done[0].select("shard", zero.alias("low"), zero.alias("high"), "fp")
    for d in done[1:]:
        out = out.unionAll(d.select("shard", zero.alias("low"), zero.alias("high"), "fp"))
    for w in whole:
        blocks = F.ceil(F.col("n") / SHARD_LIMIT).cast("int")
        paired = w.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        out = out.unionAll(paired.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"))
    return out, steps


def linked_fingerprints(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) over the distinct fingerprints fp: links of at most ``radius`` bits, followed to the end.

    A sample of at most SAMPLE_POINTS places the top tree's boundaries; every fingerprint is routed
    through it, overfull shards are split again, and every pair is found. A shard reports its links as
    stars (a point and the least point it is linked to), which keeps components and is never more than
    one row a point.
    """
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "node long, root long")
    picked = boundary_sample(distinct, "fp", n)
    tree, _ = top_tree(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), -(-n // SHARD_POINTS), radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            i, shard = route(tree, fp.view(np.uint64), radius)
            yield pa.record_batch([pa.array(shard.astype(np.int64)), pa.array(fp[i])], ["shard", "fp"])

    def stars(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy())
        root = shard_roots(fp.view(np.uint64), radius)
        some = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"u": fp[some], "v": fp[root[some]]})

    shards = save(spark, distinct.select("fp").mapInArrow(spread, "shard long, fp long"), "shards")
    dealt, steps = bounded_shards(spark, shards, radius)
    out = components(spark, dealt.groupBy("shard", "low", "high").applyInArrow(stars, "u long, v long"))
    forget(spark, *steps)
    return out


def near_duplicates(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Cases: a null text has no words and so fingerprint zero, linked like any other; a row with a
    null doc_id links others but is never a component's smallest id (null if it is alone); equal
    rows give equal rows; other columns are ignored; empty in, empty out.
    """
    docs = save(spark, fingerprint_table(df, doc_id, text), "fingerprints")
    distinct = save(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = save(spark, linked_fingerprints(spark, distinct, radius), "fingerprint-roots")
    group = F.coalesce(F.col("root"), F.col("fp"))
    owned = save(spark, distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", group.alias("group")), "fingerprint-groups")
    least = save(spark, owned.groupBy("group").agg(F.min("first_id").alias("component_id")), "group-ids")
    ids = save(spark, owned.join(least, "group").select("fp", "component_id"), "component-ids")
    forget(spark, distinct, roots, owned, least)
    return docs.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir))
