"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in an earlier document.

A sparse suffix array, sorted by a distributed merge sort that knows common prefixes:

1. Of the SEED-byte strings inside a 50-byte window the one with the least hash is its anchor. Equal
   windows have equal anchors at equal offsets, so sorting the suffixes at anchors is enough (about
   one position in sixteen).
2. Suffixes are told apart by ever longer prefixes. First, fingerprints of the SEED-byte prefixes are
   exchanged (sorted, four bytes each); an anchor whose prefix is in one document only needs no more.
3. Each chunk of documents sorts the other anchors' suffixes (50 bytes on, then 30 bytes back), merges
   equal ones to their least document, and sends the sorted run, front coded and cut by key ranges.
4. A range merges its runs with a loser tree whose nodes keep the common prefix with the last output:
   known prefixes are never compared again. Neighbours with equal anchors give, for each window
   around the anchor, the least document that has it; windows count as equal when their bytes are.
   An anchor that fills ranges by itself is cut further: windows of neighbouring offsets share more
   than the anchor, and what they share deals them out.
5. These answers go back to the chunks, which cover and cut their documents' bytes.

Chunks are buckets of a written table, so texts are written once and never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, partitions, release_memory, save, work_dir

LENGTH = 50  # bytes of a repeated string
SEED = 20  # bytes of an anchor
SPAN = LENGTH - SEED  # an anchor lies 0 to SPAN bytes after its window's start
KEY = LENGTH + SPAN + 3  # on, back, how many of each count, a closing 1
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20  # bytes of text for one range of keys
SPOT_BYTES = 64 << 20  # bytes of text for one bucket of fingerprints; each chunk sends it a row
#: Offsets (first, last) of windows that an often repeated anchor is cut into; all windows of a class share 42 bytes or more.
CLASSES = ((0, 7), (8, 15), (16, 23), (24, SPAN))
SAMPLE_ROWS = 4096  # chunks that give keys for the ranges' bounds, at most
SAMPLE_KEYS = 64  # keys of each
BLOCK = 1 << 17
PART_KEYS = 1 << 14  # keys that are put together at once
LOWEST = -(1 << 63)

_rng = np.random.default_rng(20)
_MIX = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + 2 * LENGTH, _ODD)]))
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + 2 * LENGTH, np.uint64(pow(int(_ODD), -1, 1 << 64)))]))


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


# -- anchors -------------------------------------------------------------------------------------


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, fingerprint, first and last window start) of each anchor in documents laid end to end."""
    n = len(data)
    ends = np.cumsum(sizes)
    valid = np.ones(n, bool)  # window starts
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        valid[max(e - s, e - LENGTH + 1) : e] = False
    at: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    firsts: list[np.ndarray] = []
    lasts: list[np.ndarray] = []
    for a in range(0, max(0, n - LENGTH + 1), BLOCK):
        part = data[a : a + BLOCK + LENGTH - 1]
        m = len(part) - SEED + 1
        if m <= SPAN:
            break
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_MIX[part] * _POWERS[: len(part)], out=sums[1:])
        h = _stir((sums[SEED:] - sums[:-SEED]) * _INVERSE[:m])
        low = h >> np.uint64(32) << np.uint64(32) | np.arange(m, dtype=np.uint64)  # ties: the first
        width = 1
        while 2 * width <= SPAN + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN + 1:
            rest = SPAN + 1 - width
            low = np.minimum(low[:-rest], low[rest:])
        starts = np.flatnonzero(valid[a : a + len(low)])
        if not len(starts):
            continue
        q = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first, last = _runs(q, starts, starts)  # of a block at once: one entry for each position of a chunk is too much
        at.append(q[first] + a)
        prints.append(h[q[first]])
        firsts.append(starts[first] + a)
        lasts.append(starts[last] + a)
    if not at:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    q, fp, begin, end = (np.concatenate(x) for x in (at, prints, firsts, lasts))
    first, last = _runs(q, begin, end)  # of neighbouring blocks
    return q[first], fp[first], begin[first], end[last]


def _runs(q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal q whose window starts, begin to end, follow each other."""
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (begin[1:] != end[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(q)) - 1


def _body(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, bytes end to end) of a chunk's documents, in a set order."""
    ids = table.column("__ord").to_numpy()
    texts = [x.as_py() or b"" for x in table.column("__text")]
    return ids, np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(b"".join(texts), np.uint8)


def _spot(fp: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, what tells fingerprints of a bucket apart). Anchors have small hashes, so they are stirred again."""
    g = _stir(fp * _ODD)
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), g.astype(np.uint32)


# -- sorted runs ---------------------------------------------------------------------------------


def suffix_keys(data: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Keys (n x KEY bytes) of anchors at q whose windows start low to high bytes before: the bytes on,
    the bytes before in reverse, how many of each these windows have, and a 1 so that no key ends in
    zero. Bytes outside the windows are zero; low and high follow from the key."""
    ahead, back = np.arange(LENGTH), np.arange(1, SPAN + 1)
    out = np.zeros((len(q), KEY), np.uint8)
    on, before = LENGTH - low, high
    after = sliding_window_view(np.concatenate([data, np.zeros(LENGTH, np.uint8)]), LENGTH)
    ahead_of = sliding_window_view(np.concatenate([np.zeros(SPAN, np.uint8), data]), SPAN)  # at q: the SPAN bytes before q
    for s in range(0, len(q), PART_KEYS):
        e = s + PART_KEYS
        out[s:e, :LENGTH] = after[q[s:e]] * (ahead < on[s:e, None])
        out[s:e, LENGTH : LENGTH + SPAN] = ahead_of[q[s:e]][:, ::-1] * (back <= before[s:e, None])
    out[:, -3], out[:, -2], out[:, -1] = on, before, 1
    return out


def squeezed(raw: bytes) -> bytes:
    """raw, compressed before it is written and exchanged; its size comes first."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueezed(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix with the key before, bytes after it) of sorted keys."""
    if not len(keys):
        return b"", b""
    differ = keys[1:] != keys[:-1]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), keys.shape[1])]).astype(np.uint8)
    return common.tobytes(), keys[np.arange(keys.shape[1]) >= common[:, None]].tobytes()


def front_decode(common: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(common prefixes, keys) of front_code()."""
    lcp = np.frombuffer(common, np.uint8).astype(np.int64)
    n = len(lcp)
    keys = np.zeros((n, KEY), np.uint8)
    keys[np.arange(KEY) >= lcp[:, None]] = np.frombuffer(rest, np.uint8)
    row = np.arange(n)
    for j in range(KEY):
        keys[:, j] = keys[np.maximum.accumulate(np.where(lcp <= j, row, 0)), j]
    return lcp, keys


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the output before) in sorted order, by a loser tree.

    A run is (sorted keys, common prefix of each with the one before). A node keeps the loser and its
    common prefix with the winner that passed; the longer common prefix with the last output is the
    smaller key, and only equal ones are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    lcps = [r[1] for r in runs] + [[] for _ in range(k - len(runs))]
    size = [len(x) for x in keys]
    at = [0] * k

    def beats(a: int, b: int, h: int) -> tuple[bool, int]:
        """Whether run a's key comes first, and the two keys' common prefix, at least h."""
        x, y = keys[a][at[a]][h:], keys[b][at[b]][h:]
        if x == y:
            return True, h + len(x)
        bits = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
        return x < y, h + len(x) - (bits + 7) // 8

    loser, prefix = [0] * k, [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if at[a] >= size[a] or at[b] >= size[b]:
            if at[a] >= size[a]:
                a, b = b, a
            loser[node], prefix[node] = b, (-1 if at[b] >= size[b] else 0)
            return a
        first, common = beats(a, b, 0)
        if not first:
            a, b = b, a
        loser[node], prefix[node] = b, common
        return a

    winner, h = build(1), 0
    while at[winner] < size[winner]:
        yield winner, at[winner], h
        at[winner] += 1
        i = at[winner]
        h = lcps[winner][i] if i < size[winner] else -1
        node = (winner + k) >> 1
        while node:
            g = prefix[node]
            if h < g:
                winner, loser[node] = loser[node], winner
                h, prefix[node] = g, h
            elif h == g and h >= 0:
                first, common = beats(winner, loser[node], h)
                if not first:
                    winner, loser[node] = loser[node], winner
                prefix[node] = common
            node >>= 1


def _equal_windows(h: np.ndarray, group: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A number for each row; equal numbers mean equal groups and equal bytes. Hashes propose, bytes decide."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    like = first[back]
    if np.array_equal(group, group[like]) and np.array_equal(window, window[like]):
        return back
    exact = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), window], axis=1)
    return np.unique(np.ascontiguousarray(exact).view(f"V{exact.shape[1]}").ravel(), return_inverse=True)[1]


def window_minima(keys: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(n x SPAN+1): for each distinct key and each offset low..high the least document of the keys in
    its group whose window at that offset has the same 50 bytes."""
    text = np.concatenate([keys[:, LENGTH : LENGTH + SPAN][:, ::-1], keys[:, :LENGTH]], axis=1)
    sums = np.zeros((len(keys), text.shape[1] + 1), np.uint64)
    np.cumsum(_MIX[text] * _POWERS[: text.shape[1]], axis=1, out=sums[:, 1:])
    salt = _stir(group.astype(np.uint64) * _ODD)
    out = np.repeat(least[:, None], SPAN + 1, axis=1)
    for o in range(SPAN + 1):
        row = np.flatnonzero((o >= low) & (o <= high))
        if not len(row):
            continue
        start = SPAN - o
        h = _stir((sums[row, start + LENGTH] - sums[row, start]) + salt[row])
        back = _equal_windows(h, group[row], text[row, start : start + LENGTH])
        best = np.full(int(back.max()) + 1, (1 << 63) - 1)
        np.minimum.at(best, back, least[row])
        out[row, o] = best[back]
    return out


def hot_anchors(found: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of ranges, anchors that fill two ranges or more, how many) from a sorted sample of anchors."""
    if not len(found):
        return found, found, np.zeros(0, np.int64)
    bounds, often = np.unique(found[[i * len(found) // ranges for i in range(1, ranges)]], return_counts=True)
    return bounds, bounds[often > 1], often[often > 1]


def placed(data: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index into q, low, high, range, key) of each anchor: one range, or for a hot anchor one for each class of offsets
    it has windows of, chosen by the bytes that all windows of the class share."""
    seeds = sliding_window_view(data, SEED)[q].view(f"S{SEED}").ravel() if len(q) else np.zeros(0, f"S{SEED}")
    index, rng = np.arange(len(q)), np.searchsorted(bounds, seeds, "right").astype(np.int64)
    at = np.searchsorted(hot, seeds)
    is_hot = (hot[np.minimum(at, len(hot) - 1)] == seeds) if len(hot) else np.zeros(len(q), bool)
    keys = suffix_keys(data, q[~is_hot], low[~is_hot], high[~is_hot])
    found = [(index[~is_hot], low[~is_hot], high[~is_hot], rng[~is_hot], keys)]
    base = len(bounds) + 1 + len(CLASSES) * (np.cumsum(parts) - parts)
    for c, (first, last) in enumerate(CLASSES):
        mine = np.flatnonzero(is_hot & (low <= last) & (high >= first))
        if not len(mine):
            continue
        lo, hi = np.maximum(low[mine], first), np.minimum(high[mine], last)
        keys = suffix_keys(data, q[mine], lo, hi)
        deal = np.zeros(len(mine), np.uint64)
        for i, j in enumerate([*range(LENGTH - last), *range(LENGTH, LENGTH + first)]):  # the shared bytes
            deal += _MIX[keys[:, j]] * _POWERS[i]
        deal = _stir(deal) >> np.uint64(32)
        n = parts[at[mine]]
        found.append((mine, lo, hi, base[at[mine]] + c * n + (deal.astype(np.int64) % n), keys))
    return tuple(np.concatenate(x) for x in zip(*found))


# -- the distributed sort ------------------------------------------------------------------------

_RUN = "chunk long, range int, common binary, rest binary, least binary, several binary"
_BATCH_KEYS = 20_000


def _merge_range(table: pa.Table) -> pa.Table:
    """The answers of one key range: per chunk and key of its run, the least document of each window."""
    chunk = table.column("chunk").to_pylist()
    col = {c: [unsqueezed(x.as_py()) for x in table.column(c)] for c in ("common", "rest", "least", "several")}
    matrices, runs = [], []
    for common, rest in zip(col["common"], col["rest"], strict=True):
        lcp, keys = front_decode(common, rest)
        flat = keys.tobytes()
        matrices.append(keys)
        runs.append(([flat[i : i + KEY] for i in range(0, len(flat), KEY)], lcp.tolist()))
    least = [np.frombuffer(x, "<i8") for x in col["least"]]
    several = [np.frombuffer(x, np.uint8) for x in col["several"]]
    same: list[list] = [[[], []] for _ in chunk]  # index, least document for all its windows
    each: list[list] = [[[], []] for _ in chunk]  # index, least document by window

    ctx: list[tuple[int, int]] = []  # where a distinct key was first seen
    owner: list[int] = []  # for each entry, its distinct key
    entry: list[tuple[int, int]] = []
    groups: list[int] = []  # for each distinct key, its anchor's group
    group = 0

    def settle() -> None:
        """Answer all entries gathered so far; they are whole groups."""
        nonlocal group
        if not ctx:
            return
        own = np.array(owner)
        docs = np.array([least[r][i] for r, i in entry])
        best = np.full(len(ctx), (1 << 63) - 1)
        np.minimum.at(best, own, docs)
        g = np.array(groups)
        lone = np.bincount(g, minlength=group + 1)[g] == 1
        many = np.flatnonzero(~lone)
        minima = None
        if len(many):
            k = np.stack([matrices[r][i] for r, i in (ctx[m] for m in many.tolist())])
            minima = window_minima(k, g[many], LENGTH - k[:, -3].astype(np.int64), k[:, -2].astype(np.int64), best[many])
            back = np.full(len(ctx), -1)
            back[many] = np.arange(len(many))
        entries = np.bincount(own, minlength=len(ctx))
        for (r, i), o in zip(entry, owner, strict=True):
            if lone[o]:
                if entries[o] > 1 or several[r][i]:
                    same[r][0].append(i)
                    same[r][1].append(best[o])
            else:
                each[r][0].append(i)
                each[r][1].append(minima[back[o]])
        ctx.clear(), owner.clear(), entry.clear(), groups.clear()
        group = 0

    for r, i, h in merge_runs(runs):
        if h < SEED:
            if len(ctx) >= _BATCH_KEYS:
                settle()
            group += 1
        if h < KEY or not ctx:
            ctx.append((r, i))
            groups.append(group)
        owner.append(len(ctx) - 1)
        entry.append((r, i))
    settle()
    matrices.clear()
    runs.clear()
    release_memory()
    rng = table.column("range")[0].as_py()
    keep = [j for j in range(len(chunk)) if same[j][0] or each[j][0]]

    def pack(values: list, kind: str) -> bytes:
        return squeezed(np.array(values, kind).tobytes())

    return pa.table(
        {
            "chunk": pa.array([chunk[j] for j in keep], pa.int64()),
            "range": pa.array([rng] * len(keep), pa.int32()),
            "same_at": pa.array([pack(same[j][0], "<u4") for j in keep], pa.binary()),
            "same": pa.array([pack(same[j][1], "<i8") for j in keep], pa.binary()),
            "each_at": pa.array([pack(each[j][0], "<u4") for j in keep], pa.binary()),
            "each": pa.array([pack(each[j][1], "<i8") for j in keep], pa.binary()),
        }
    )


def repeated_bytes(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns as c0, c1, ... and __ord, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A null text is empty. A null doc_id counts as the smallest of all. Rows with one doc_id do not
    take from each other. Equal documents: all but the one with the smallest id go whole (if of 50
    bytes or more). Texts may be longer than a chunk. Columns of any name, also the operator's own
    (c0, n_bytes, __ord), come back as c0, c1, ... in df's order. Empty in, empty out.
    """
    whole = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("__ord"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text])
    total = whole.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(2 * partitions(spark), -(-total // RANGE_BYTES))
    spots = max(partitions(spark), -(-total // SPOT_BYTES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.fromiter((len(x.as_buffer()) for x in b.column(1)), np.int64, b.num_rows)
            before = done + np.cumsum(size) - size
            done += int(size.sum())
            yield pa.record_batch([pa.array((task << 32) + before // CHUNK_BYTES), *b.columns], ["__chunk", *b.schema.names])

    schema = "__chunk long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    name = f"brindle_chunks_{uuid.uuid4().hex}"
    buckets = max(partitions(spark), min(1000, -(-total // (4 * CHUNK_BYTES))))
    whole.mapInArrow(number, schema).write.bucketBy(buckets, "__chunk").sortBy("__chunk").option("compression", "zstd").option("path", f"{work_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan above has them
    bodies = chunks.select("__chunk", "__ord", "__text")

    def fingerprint(key: tuple, table: pa.Table) -> pa.Table:
        ids, sizes, data = _body(table)
        q, fp, _, _ = anchors(data, sizes)
        doc = ids[np.searchsorted(np.cumsum(sizes), q, "right")]
        order = np.lexsort((doc, fp))
        fp, doc, q = fp[order], doc[order], q[order]
        new = np.ones(len(fp), bool)
        new[1:] = fp[1:] != fp[:-1]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(fp)]]) - 1 if len(first) else first
        shared = doc[first] != doc[last]
        bucket, rest = _spot(fp[first], spots)
        rows = {"bucket": [], "chunk": [], "single": [], "shared": []}
        order = np.argsort(bucket, kind="stable")
        bucket, rest, shared = bucket[order], rest[order], shared[order]
        cuts = np.searchsorted(bucket, np.arange(spots + 1))
        for b in np.unique(bucket).tolist():
            s = slice(cuts[b], cuts[b + 1])
            rows["bucket"].append(b)
            rows["single"].append(rest[s][~shared[s]].astype("<u4").tobytes())
            rows["shared"].append(rest[s][shared[s]].astype("<u4").tobytes())
        if len(q):  # keys that place the ranges' bounds
            pick = q[np.argsort(_stir(q.astype(np.uint64)))[:SAMPLE_KEYS]]
            rows["bucket"].append(-1)
            rows["single"].append(b"".join(data[p : p + SEED].tobytes() for p in pick.tolist()))
            rows["shared"].append(b"")
        release_memory()
        rows["chunk"] = [key[0].as_py()] * len(rows["bucket"])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()), "single": pa.array(rows["single"], pa.binary()), "shared": pa.array(rows["shared"], pa.binary())})

    prints = save(spark, bodies.groupBy("__chunk").applyInArrow(fingerprint, "bucket int, chunk long, single binary, shared binary"), "fingerprint-runs", compression="uncompressed")
    sample = prints.where("bucket = -1").orderBy(F.xxhash64("chunk")).limit(SAMPLE_ROWS).select("single").collect()
    found = np.sort(np.frombuffer(b"".join(r["single"] for r in sample), f"S{SEED}"))
    bounds, hot, parts = hot_anchors(found, ranges)

    def living(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        single, shared = ([np.frombuffer(x.as_py(), "<u4") for x in table.column(c)] for c in ("single", "shared"))
        every = np.sort(np.concatenate(single))
        twice = every[1:][every[1:] == every[:-1]]
        alive = np.unique(np.concatenate([twice, *shared]))
        out = []
        for a, b in zip(single, shared, strict=True):
            both = np.concatenate([a, b])
            spot = np.minimum(np.searchsorted(alive, both), max(0, len(alive) - 1))
            out.append(np.sort(both[alive[spot] == both]).tobytes() if len(alive) else b"")
        release_memory()
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(chunk), pa.int32()), "alive": pa.array(out, pa.binary())})

    alive = prints.where("bucket >= 0").groupBy("bucket").applyInArrow(living, "chunk long, bucket int, alive binary")

    def sort_chunk(key: tuple, table: pa.Table, lives: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _RUN.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        rows: list[list] = [[] for _ in names]
        if table.num_rows and lives.num_rows:
            ids, sizes, data = _body(table)
            ends = np.cumsum(sizes)
            q, fp, p1, p2 = anchors(data, sizes)
            bucket, rest = _spot(fp, spots)
            known = np.concatenate([np.zeros(0, np.uint64), *[np.uint64(b.as_py()) << np.uint64(32) | np.frombuffer(x.as_py(), "<u4").astype(np.uint64) for b, x in zip(lives.column("bucket"), lives.column("alive"), strict=True)]])
            known.sort()
            mine = bucket.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))] == mine) if len(known) else np.zeros(0, np.int64)
            q, p1, p2 = q[hit], p1[hit], p2[hit]
            if len(q):
                own, low, high, rng, matrix = placed(data, q, q - p2, q - p1, bounds, hot, parts)
                q = q[own]
                d = np.searchsorted(ends, q, "right")
                tagged = np.concatenate([rng.astype(">u4").view(np.uint8).reshape(-1, 4), matrix], axis=1)
                keys, where, back = np.unique(tagged.reshape(-1).view(f"S{KEY + 4}"), return_index=True, return_inverse=True)
                del tagged
                least = np.full(len(keys), (1 << 63) - 1)
                most = np.full(len(keys), LOWEST)
                np.minimum.at(least, back, ids[d])
                np.maximum.at(most, back, ids[d])
                matrix, cut = matrix[where], rng[where]
                here, edges = np.unique(cut, return_index=True)
                edges = np.append(edges, len(cut))
                for r, a, b in zip(here.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    s = slice(a, b)
                    common, tail = front_code(matrix[s])
                    for c, v in zip(rows, (key[0].as_py(), r, *map(squeezed, (common, tail, least[s].astype("<i8").tobytes(), (most[s] > least[s]).astype(np.uint8).tobytes()))), strict=True):
                        c.append(v)
                spot = (back - edges[np.searchsorted(here, rng)]).astype("<u4")  # the key's place in its run
                for c, v in zip(rows, (key[0].as_py(), -1, *map(squeezed, (q.astype("<i8").tobytes(), spot.tobytes(), rng.astype("<i4").tobytes(), np.concatenate([low, high]).astype(np.uint8).tobytes()))), strict=True):
                    c.append(v)
        release_memory()
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    runs = save(spark, bodies.groupBy("__chunk").cogroup(alive.groupBy("chunk")).applyInArrow(sort_chunk, _RUN), "suffix-runs", compression="uncompressed")
    forget(spark, prints)
    answers = runs.where("range >= 0").groupBy("range").applyInArrow(_merge_range, "chunk long, range int, same_at binary, same binary, each_at binary, each binary")
    places = runs.where("range = -1").select("chunk", "range", F.col("common").alias("same_at"), F.col("rest").alias("same"), F.col("least").alias("each_at"), F.col("several").alias("each"))
    back = places.unionByName(answers)
    kept_cols = [f for f in whole.schema if f.name.startswith("c")]

    def cut_chunk(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        ids, sizes, data = _body(table)
        ends = np.cumsum(sizes)
        edge = np.zeros(len(data) + 1, np.int32)
        by_range = {r: i for i, r in enumerate(found.column("range").to_pylist())}
        if len(by_range) > 1 and -1 in by_range:
            cell = lambda i, c, kind: np.frombuffer(unsqueezed(found.column(c)[i].as_py()), kind)
            o = by_range.pop(-1)
            q, spot, rng = cell(o, "same_at", "<i8"), cell(o, "same", "<u4").astype(np.int64), cell(o, "each_at", "<i4")
            low, high = cell(o, "each", np.uint8).astype(np.int64).reshape(2, -1)
            doc = ids[np.searchsorted(ends, q, "right")]
            order = np.argsort(rng, kind="stable")
            for r, i in by_range.items():
                a, b = np.searchsorted(rng[order], [r, r + 1])
                mine = order[a:b]
                at, value = cell(i, "same_at", "<u4"), cell(i, "same", "<i8")
                if len(at):
                    sort = np.argsort(at)
                    j = sort[np.minimum(np.searchsorted(at[sort], spot[mine]), len(at) - 1)]
                    gone = mine[(at[j] == spot[mine]) & (value[j] < doc[mine])]
                    np.add.at(edge, q[gone] - high[gone], 1)
                    np.add.at(edge, q[gone] - low[gone] + LENGTH, -1)
                at, value = cell(i, "each_at", "<u4"), cell(i, "each", "<i8").reshape(-1, SPAN + 1)
                if len(at):
                    sort = np.argsort(at)
                    j = sort[np.minimum(np.searchsorted(at[sort], spot[mine]), len(at) - 1)]
                    known = at[j] == spot[mine]
                    mine, j = mine[known], j[known]
                    offset = np.arange(SPAN + 1)
                    gone, o = np.nonzero((value[j] < doc[mine][:, None]) & (offset >= low[mine][:, None]) & (offset <= high[mine][:, None]))
                    np.add.at(edge, q[mine[gone]] - o, 1)
                    np.add.at(edge, q[mine[gone]] - o + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept, removed, spans = [], [], []
        for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
            c = covered[e - s : e]
            removed.append(int(c.sum()))
            spans.append(int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()))
            kept.append(data[e - s : e][~c].tobytes() if removed[-1] else data[e - s : e].tobytes())
        release_memory()
        cols = {"__ord": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
        return pa.table(cols | {f.name: table.column(f.name) for f in kept_cols})

    out = "__ord long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_cols)
    return chunks.groupBy("__chunk").cogroup(back.groupBy("chunk")).applyInArrow(cut_chunk, out)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut from ``text``; characters that a cut broke go whole. Documents that
    lose every byte go; those that had none stay. Other columns are as they were, n_chars is counted anew.

    Cases as in repeated_bytes(): a null text comes back empty; rows with one doc_id, or without one, do not take from
    each other, so equal rows stay or are cut alike; long texts are whole; columns of any name; empty in, empty out.
    """
    out = repeated_bytes(spark, docs).where("n_bytes = 0 OR n_removed < n_bytes")
    names = [c for c in docs.columns if c != "text"]
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in names}
    fixed = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(fixed, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    new = out.withColumn("__kept", text)
    cols = [F.col("__kept").alias("text") if c == "text" else F.length("__kept").cast("long").alias(c) if c == "n_chars" else at[c].alias(c) for c in docs.columns]
    return new.select(*cols)


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column(4)]
        yield pa.record_batch([*b.columns[:4], pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept").mapInArrow(_sha, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
