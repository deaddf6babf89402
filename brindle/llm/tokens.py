"""Token ids: exact BPE digests, and a frequency-ranked byte-aligned file format."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_tokenizer_path, digests, tokenizer
from .common import documents, forget, partitions, save, text_or_empty, worker_threads

END_ID = 0  # closes each document in the files
BLOCK_IDS = 1 << 18  # ids in a block of the files, more only if one document has more
BUCKET_IDS = 1 << 26  # ids aimed at in a bucket of the files
SAMPLE_ROWS = 1 << 15  # rows whose keys place the buckets' bounds, about


# -- encoding and decoding -----------------------------------------------------------------------


def token_digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; see bpe.py for the method.

    Cases: a null text is an empty one (no ids); a null doc_id stays null; equal rows give equal
    rows; very long texts are halved into leaves; other columns are ignored; empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        for b in batches:
            out = digests(path, b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), default_tokenizer_path())


# -- the file format -----------------------------------------------------------------------------


def _length_tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: the lengths of its four numbers, and their sum."""
    code = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    return (code + 1).astype(np.uint8), (code + 1).sum(1).astype(np.int64)


LENGTHS, TOTALS = _length_tables()


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): 2 bits of length and 1 to 4 little-endian bytes for each number."""
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = code
    four = four.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes(), data.tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(n numbers, data bytes used), by table lookup of the control bytes."""
    length = LENGTHS[control[: -(-n // 4)]].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(length) - length
    used = int(start[-1] + length[-1]) if n else 0
    padded = np.concatenate([data[:used], np.zeros(4, np.uint8)]).astype(np.uint32)
    out = padded[start]
    for k in range(1, 4):
        more = length > k
        if more.any():
            out[more] |= padded[start[more] + k] << np.uint32(8 * k)
    return out, used


def write_token_files(spark: SparkSession, df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Encode, rank ids by their frequency in the corpus, write blocks; (the files' rows, id of each rank).

    The files are Parquet rows of blocks (bucket, start in bucket, doc_ids, known, counts, control,
    data); buckets are ranges of (doc_id, length, hash of the ids, row), nulls first, and so ordered
    are the documents inside: a doc_id that many rows share, or rows that are all equal, are many
    buckets. Spark's commit protocol makes a retried task harmless. Only the id counts (at most the
    vocabulary) and about SAMPLE_ROWS keys of four numbers come to the driver.
    """
    bpe = tokenizer(path)
    vocab = bpe.vocab_size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        for b in batches:
            ids = tokenizer(path).encode(b.column(1).to_pylist())
            kind = "<u2" if vocab <= 1 << 16 else "<u4"
            yield pa.record_batch([b.column(0), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([np.append(x, END_ID).astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    encoded = rows.mapInArrow(encode, "doc_id long, n long, ids binary")
    encoded = save(spark, encoded.select("*", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row")), "token-ids")
    kind = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocab, np.int64)
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=vocab)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for r in encoded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(vocab), -counts)).astype(np.uint32)
    rank_of = np.empty(vocab, np.uint32)
    rank_of[by_rank] = np.arange(vocab, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # one number for each entry of the vocabulary

    size = encoded.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    buckets = max(4 * partitions(spark), -(-size["ids"] // BUCKET_IDS))
    key = (F.col("doc_id").isNotNull().cast("int").alias("known"), "doc_id", "n", "h", "row")
    part = F.pmod(F.xxhash64("row"), F.lit(max(1, size["rows"] // SAMPLE_ROWS)))
    sample = sorted((r[0], r[1] or 0, *r[2:]) for r in encoded.where(part == 0).select(*key).collect())
    bounds = sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            control, data = [], []
            for x in b.column(2):
                c, d = pack_ranks(rank[np.frombuffer(x.as_buffer(), kind)])
                control.append(c)
                data.append(d)
            own = [bisect_right(bounds, (int(doc is not None), doc or 0, *rest)) for doc, *rest in zip(*[b.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True)]
            yield pa.record_batch([pa.array(own, pa.int32()), b.column(0), b.column(1), b.column(3), b.column(4), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["bucket", "doc_id", "n", "h", "row", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "start", "n", "doc_ids", "known", "counts", "control", "data"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        open_bucket, at = None, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, known = np.array([h[0] or 0 for h in held], "<i8"), np.array([h[0] is not None for h in held], np.uint8)
            row = [open_bucket, at, size, ids.tobytes(), known.tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), b"".join(h[2] for h in held), b"".join(h[3] for h in held)]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for bk, doc, n, c, d in zip(*cols, strict=True):
                if held and (bk != open_bucket or size >= BLOCK_IDS):
                    yield flush()
                    at = at + size if bk == open_bucket else 0
                    held, size = [], 0
                elif bk != open_bucket:
                    at = 0
                open_bucket = bk
                held.append((doc, n, c, d))
                size += n
        if held:
            yield flush()

    packed = encoded.select("doc_id", "n", "ids", "h", "row").mapInArrow(pack, "bucket int, doc_id long, n long, h long, row long, control binary, data binary")
    ordered = packed.repartition(min(buckets, max(partitions(spark), buckets // 4)), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "h", "row").select("bucket", "doc_id", "n", "control", "data")
    files = save(spark, ordered.mapInArrow(blocks, "bucket int, start long, n long, doc_ids binary, known binary, counts binary, control binary, data binary"), "token-files", compression="uncompressed")
    forget(spark, encoded)
    return files, by_rank


def read_token_files(spark: SparkSession, files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    shared = spark.sparkContext.broadcast(by_rank)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        for b in batches:
            for bucket, start, docs, known, counts, control, data in zip(*[b.column(i) for i in range(7)], strict=True):
                docs, counts = np.frombuffer(docs.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i8")
                control, data = np.frombuffer(control.as_buffer(), np.uint8), np.frombuffer(data.as_buffer(), np.uint8)
                crc = np.empty(len(docs), np.int64)
                c = d = 0
                for i, n in enumerate(counts.tolist()):
                    ranks, used = unpack_ranks(control[c:], data[d:], n)
                    crc[i] = zlib.crc32(ids_of[ranks].astype("<u4").tobytes())
                    c, d = c + -(-n // 4), d + used
                null = np.frombuffer(known.as_buffer(), np.uint8) == 0
                yield pa.record_batch(
                    [pa.array(np.full(len(docs), bucket.as_py(), np.int32)), pa.array(docs, pa.int64(), mask=null), pa.array(start.as_py() + np.cumsum(counts) - counts), pa.array(counts, pa.int64()), pa.array(crc)],
                    ["bucket", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    totals = files.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each bucket, their number is set
    rows = files.select("bucket", "start", "doc_ids", "known", "counts", "control", "data").mapInArrow(decode, "bucket int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "bucket").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_file_index(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write df's token files and read them back.

    Cases: a null text is an empty one (the end id alone); a null doc_id sorts before all;
    rows with one doc_id are ordered by length and a hash of their ids; other columns are ignored;
    an empty table gives no files and no rows. A document's ids are one cell: 2 GB of them at most.
    """
    return read_token_files(spark, *write_token_files(spark, df, path))


def op10_ranked_varbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(spark, documents(spark, sf_dir), default_tokenizer_path())
