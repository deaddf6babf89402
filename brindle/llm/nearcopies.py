"""Near copies: SimHash vantage-point trees and MinHash bands over five-word shingles gather candidates, exact Jaccard
similarity links them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, release_memory, save
from .graph import components
from .simhash import RADIUS, _parts, linked_fingerprints, majority_bits

SHINGLE_WORDS, SEED = 5, 42
#: Bands of ROWS MinHashes each: two sets of Jaccard similarity 0.8 share none of them with probability
#: (1 - 0.8^6)^40, about 5 in a million, wherever the edits are.
BANDS, ROWS = 40, 6
NUMERATOR, DENOMINATOR = 4, 5  # least similarity, as a fraction: 0.8
BLOCK_SHINGLES = 1 << 20  # a cluster with more is compared block by block
DIGEST = 16  # bytes that stand for a set
KEY = ["doc_id", "k1", "k2"]  # of a row: its id and two hashes of its text
#: 64-bit words of a row filter at most (16 MB), bits for each key up to there. More keys let more rows through to the
#: join that decides: about 1 % at 12 bits, all rows at worst.
FILTER_WORDS, FILTER_BITS = 1 << 21, 12

_ODD = np.random.default_rng(SEED).integers(1 << 31, size=(2, BANDS * ROWS), dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_PLACES = np.random.default_rng(SEED + 1).integers(1 << 63, size=SHINGLE_WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, the sorted 64-bit hashes of its distinct five-word shingles in lower case (the whole sequence if
    it is shorter); no words, none."""
    digest = xxhash.xxh64_intdigest
    out = []
    for t in texts:
        words = np.array([digest(w, SEED) for w in t.lower().split()], np.uint64)
        n = max(1, len(words) - SHINGLE_WORDS + 1) if len(words) else 0
        total = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE_WORDS, len(words))):
            total += words[k : k + n] * _PLACES[k]
        out.append(np.unique(_mixed(total)))
    return out


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit SimHash of each set."""
    return majority_bits(np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): one hash of each band's MinHashes; a set without members has zeros."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    h = np.concatenate([sets[i] for i in some])
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum(size[some]) - size[some]
    for b in range(BANDS):
        key = np.full(len(some), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat(low * _ODD[0, k] + high * _ODD[1, k], start)
            key = _mixed((key ^ least) * np.uint64(0x9E3779B97F4A7C15))
        out[some, b] = key
    return out


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest index each set is linked to, links being pairs of Jaccard similarity 0.8 or more, followed to the end.

    A set's partners hold at least 0.8 of it, so at least one of any fifth of its members and one more: the rarest
    of these name the sets whose overlap is counted. Sets that are linked already are not counted again.
    """
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not size.any():
        return np.zeros(n, np.int64) if n else root
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    token = token.astype(np.int32)
    first = np.concatenate([[0], np.cumsum(size)])
    often = np.bincount(token)
    posting = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(token, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(often)])
    open_ = np.ones(n, bool)
    mark = np.zeros(len(often), np.uint8)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            mine = token[first[i] : first[i + 1]]
            k = len(mine) - -(-NUMERATOR * len(mine) // DENOMINATOR) + 1
            rare = mine[np.argpartition(often[mine], k - 1)[:k]] if 0 < k < len(mine) else mine
            rare = rare[often[rare] > 1]
            near = np.zeros(n, bool)
            if len(mine):
                for t in rare:
                    near[posting[begin[t] : begin[t + 1]]] = True
            else:
                near = size == 0
            near &= open_ & (DENOMINATOR * np.minimum(size, size[i]) >= NUMERATOR * np.maximum(size, size[i]))
            other = np.flatnonzero(near)
            mark[mine] = 1
            for part in np.array_split(other, 1 + int(size[other].sum()) // (1 << 20)) if len(mine) else ():
                if not len(part):
                    continue
                held = np.concatenate([token[first[j] : first[j + 1]] for j in part])
                both = np.add.reduceat(mark[held], np.cumsum(size[part]) - size[part], dtype=np.int64)
                near[part] = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (size[part] + size[i])
            mark[mine] = 0
            other = np.flatnonzero(near)
            open_[other] = False
            root[other] = seed
            queue += other.tolist()
    return root


def band_links(spark: SparkSession, points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v): each point (id, sig) with the least one in each of its bands; and the saved tables read."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(x[DIGEST:] for x in b.column(0).to_pylist()), np.int64)
            ids = np.repeat(b.column(1).to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(keys), pa.array(ids)], ["key", "id"])

    rows = save(spark, points.select("sig", "id").mapInArrow(spread, "key long, id long"), "band-keys")
    least = save(spark, rows.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v <> last").select("key", "v"), "band-stars")
    return rows.join(least, "key").where("id <> v").select(F.col("id").alias("u"), "v"), [rows, least]


def fingerprint_links(spark: SparkSession, points: DataFrame, radius: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v) of points (id, fp) whose fingerprints are joined by links of at most ``radius`` bits, by vantage-point trees;
    and the saved tables read."""
    distinct = save(spark, points.groupBy("fp").agg(F.min("id").alias("first")), "point-fingerprints")
    roots = save(spark, linked_fingerprints(spark, distinct, radius), "point-fingerprint-roots")
    own = points.join(distinct, "fp").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    top = distinct.select(F.col("fp").alias("root"), F.col("first").alias("v"))
    tied = roots.join(distinct, roots["node"] == distinct["fp"]).select("root", F.col("first").alias("u")).join(top, "root").select("u", "v")
    return own.unionAll(tied), [distinct, roots]


def candidate_clusters(spark: SparkSession, points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, cluster) of the points (id, fp, sig) that share a band with another one or have a fingerprint near its, followed
    to the end."""
    (bands, read), (prints, more) = band_links(spark, points), fingerprint_links(spark, points, radius)
    tied = save(spark, components(spark, bands.unionAll(prints)), "candidate-roots")
    forget(spark, *read, *more)
    return tied.select(F.col("node").alias("id"), F.col("root").alias("cluster")).unionAll(tied.select(F.col("root").alias("id"), F.col("root").alias("cluster")).distinct())


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), F.encode(body, "UTF-8").alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), *KEY), F.lit(words)).cast("int")


def _mask() -> Column:
    """Four of the 64 bits of a key's word (some may coincide)."""
    h = F.xxhash64(F.lit(3), *KEY)
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2]).bitwiseOR(one[3])


def row_filter(spark: SparkSession, keys: DataFrame) -> tuple[int, DataFrame]:
    """A Bloom filter of the rows of keys(doc_id, k1, k2): its number of words, and a saved table of one row with them."""
    words = max(1, min(FILTER_WORDS, -(-keys.count() * FILTER_BITS // 64)))
    set_ = keys.select(_word(words).alias("word"), _mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[set_.column("word").to_numpy()] = set_.column("mask").to_numpy()
    row = pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))})
    return words, save(spark, spark.createDataFrame(row), "row-filter")


def filtered(rows: DataFrame, known: tuple[int, DataFrame], how: str) -> DataFrame:
    """rows(doc_id, k1, k2, ...), without a shuffle: left_semi, those that may be in row_filter()'s keys, all that are
    among them; left_anti, the others."""
    words, table = known
    return rows.join(F.broadcast(table), F.get("bits", _word(words)).bitwiseAND(_mask()) == _mask(), how)


def copy_groups(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two saved tables: (doc_id, k1, k2, n, sig), the distinct rows by id and text and how often they come, and
    (sig, cluster) of the texts with words; equal clusters are copies."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[bytes | None] = []
            prints: list[np.ndarray] = []
            for part in _parts(b.column(3)):
                sets = shingle_sets(part)
                rows += [xxhash.xxh3_128_digest(s.tobytes(), SEED) + k.tobytes() if len(s) else None for s, k in zip(sets, band_keys(sets), strict=True)]
                prints.append(simhashes(sets))
            release_memory()
            yield pa.record_batch([*b.columns[:3], pa.array(np.concatenate(prints).view(np.int64)), pa.array(rows, pa.binary())], [*KEY, "fp", "sig"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _parts(b.column(2)):
                sets = shingle_sets(part)
                kept = b.slice(at, len(part))
                at += len(part)
                yield pa.record_batch([kept.column(0), kept.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "id", "n", "members"])
            release_memory()

    def stars(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        node = group.column("id").to_numpy()
        root = exact_links([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("members")])
        some = np.flatnonzero(root != np.arange(len(root)))
        out = pa.table({"u": node[some], "v": node[root[some]]})
        release_memory()
        return out

    texts = _keyed(df, doc_id, text)
    signed = save(spark, texts.mapInArrow(sign, "doc_id long, k1 long, k2 long, fp long, sig binary"), "shingle-signs")
    rows = save(spark, signed.groupBy(*KEY, F.substring("sig", 1, DIGEST).alias("sig")).agg(F.count(F.lit(1)).alias("n")), "copy-rows")
    worded = signed.where("sig IS NOT NULL")
    points = worded.groupBy("sig").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), *KEY)).alias("t"))
    points = save(spark, points.select("sig", "fp", *[f"t.{k}" for k in KEY]).withColumn("id", F.monotonically_increasing_id()), "shingle-points")
    clusters = save(spark, candidate_clusters(spark, points), "candidate-clusters")
    wanted = save(spark, points.join(clusters, "id").select(*KEY, "id", "cluster"), "candidate-texts")
    known = row_filter(spark, wanted)  # texts of other rows stay where they are
    maybe = filtered(texts, known, "left_semi")
    found = maybe.join(wanted, same_row(maybe, wanted)).select("cluster", "id", "text")
    if not rows.where("n > 1").isEmpty():
        found = found.groupBy("cluster", "id").agg(F.first("text").alias("text"))
    sets = save(spark, found.mapInArrow(shingles, "cluster long, id long, n long, members binary"), "shingle-sets", compression="uncompressed")
    blocks = F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int")
    sizes = save(spark, sets.groupBy("cluster").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "cluster-sizes")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        sets.join(sizes, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "members")
    )
    links = dealt.groupBy("cluster", "low", "high").applyInArrow(stars, "u long, v long")
    roots = save(spark, components(spark, links), "copy-roots")
    groups = save(spark, points.join(roots, points["id"] == roots["node"], "left").select(F.substring("sig", 1, DIGEST).alias("sig"), F.coalesce("root", "id").alias("cluster")), "copy-groups")
    forget(spark, signed, points, clusters, wanted, known[1], sets, sizes, roots)
    return rows, groups


def near_copies(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, component_id) for each distinct row (id and text, k1 and k2 being hashes of the text) that
    comes n times: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked, links are followed
    to the end, and component_id is the smallest doc_id.

    Candidates are texts that share a MinHash band or whose 64-bit SimHashes are linked by op5's vantage-point trees
    (2 bits; a similarity of 0.8 moves about 10, beyond what trees prune), gathered in clusters; the texts of a cluster
    are compared exactly (by 64-bit hashes of shingles) in one task, or block against block if it is large. Equal sets
    are one point. Tasks report stars, never pairs.

    Cases: texts that are null or have no words are linked to nothing, their component_id is their doc_id; a null doc_id
    is larger than all (component_id is null if there is no other); one doc_id may have several texts, each decided by
    itself; other columns are ignored; empty in, empty out.
    """
    rows, groups = copy_groups(spark, df, doc_id, text)
    owned = rows.join(groups, "sig").groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
    least = save(spark, groups.join(owned, "cluster").select("sig", "component_id"), "component-ids")
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(least, "sig", "left").select(*KEY, "n", own)


def without_near_copies(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near_copies(): the one of the smallest (doc_id, k1, k2), null ids last. The
    decision is by row, that is by id and text: another text under the same id stays. Of rows with equal id and text one
    stays. Texts that are null or have no words are copies of nothing and all stay. All columns are as they were.
    """
    rows, groups = copy_groups(spark, docs, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("last"), *KEY)
    owned = save(spark, rows.join(groups, "sig").groupBy("cluster").agg(F.min(order).alias("kept")), "kept-copies")
    kept = save(spark, groups.join(owned, "cluster").select("sig", F.struct(*[F.col(f"kept.{k}") for k in KEY]).alias("kept")), "kept-rows")
    marked = rows.join(kept, "sig").select(*KEY, "n", F.struct(*KEY).eqNullSafe(F.col("kept")).alias("stays"))
    gone = save(spark, marked.where("NOT stays OR n > 1"), "near-copies")
    forget(spark, rows, groups, owned, kept)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    at = docs.columns.index(doc_id), docs.columns.index(text)
    body = F.col(names[at[1]]).cast("string")
    keyed = carried.select(*names, F.col(names[at[0]]).cast("long").alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    known = row_filter(spark, gone)  # rows that are not in it stay, and stay where they are
    maybe = filtered(keyed, known, "left_semi")
    out = filtered(keyed, known, "left_anti").select(*names).unionAll(maybe.join(gone, same_row(maybe, gone), "left_anti").select(*names))
    again = gone.where("stays")
    if not again.isEmpty():  # equal rows, one of which stays
        firsts = maybe.join(again, same_row(maybe, again), "left_semi").groupBy(*KEY).agg(F.first(F.struct(*names)).alias("row"))
        out = out.unionAll(firsts.select("row.*"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
