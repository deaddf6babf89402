"""Quality rules: base counts, and a linear-chain CRF that labels lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, CLOSERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?:;,"
WINDOW = 8  # words of the windows whose repetition counts
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
TRAIN_DOCS = 600  # labelled documents of each class that the CRF is fitted on, at most
TRAIN_LINES = 64  # lines of a training sequence; longer documents give several
TRAIN_SEQUENCES = 8  # training sequences of one document, at most; of more, evenly spread ones
EPOCHS, RATE, RIDGE = 120, 0.1, 1e-3
CONTENT_SHARE = 0.5  # of the characters
GROUP_BYTES = 1 << 21


# -- features of lines ---------------------------------------------------------------------------


def _steps(value: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return (value[:, None] > np.array(edges)).astype(np.float32)


def line_features(lines: list[bytes], repeated: np.ndarray) -> np.ndarray:
    """0/1 features of each line: thresholds on shares of symbols, capitals, digits, distinct words and so on."""
    n = len(lines)
    raw = np.zeros((n, 7))
    for i, line in enumerate(lines):
        words = line.split()
        size = len(line)
        w = len(words)
        raw[i] = (size, w, size - len(line.translate(None, SYMBOLS)), size - len(line.translate(None, UPPER)), size - len(line.translate(None, DIGITS)), len(set(words)), size - len(line.translate(None, CLOSERS)))
    size, w = np.maximum(raw[:, 0], 1), np.maximum(raw[:, 1], 1)
    return np.hstack(
        [
            np.ones((n, 1), np.float32),
            _steps(raw[:, 2] / w, (0.02, 0.1, 0.3, 0.6, 1.0)),
            _steps(raw[:, 3] / size, (0.05, 0.15, 0.3, 0.5)),
            _steps(raw[:, 4] / size, (0.02, 0.1, 0.3)),
            _steps(raw[:, 5] / w, (0.1, 0.3, 0.5, 0.7, 0.9)),
            _steps(raw[:, 6] / w, (0.02, 0.2, 0.5, 0.8, 1.2)),
            _steps(size / w, (3, 4.5, 6.5, 9, 14)),
            _steps(raw[:, 1], (0, 3, 8, 20, 60)),
            repeated.astype(np.float32)[:, None],
        ]
    )


# -- the conditional random field ----------------------------------------------------------------


@dataclass
class LineCRF:
    """Two labels (0 boilerplate, 1 content). emit: features x 2, move: 2 x 2 (from, to)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence of one document's lines; ties go to content."""
        s = features @ self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = 0.0, 0.0
        back0, back1 = [], []
        for i, (e0, e1) in enumerate(s.tolist()):
            if i:
                p, q = a + m00, b + m10
                u, v = a + m01, b + m11
                back0.append(q >= p)
                back1.append(v >= u)
                a, b = max(p, q) + e0, max(u, v) + e1
            else:
                a, b = e0, e1
        out = np.empty(len(s), np.int8)
        if not len(s):
            return out
        label = int(b >= a)
        out[-1] = label
        for i in range(len(s) - 2, -1, -1):
            label = int(back1[i] if label else back0[i])
            out[i] = label
        return out


def fit_crf(sequences: list[np.ndarray], labels: list[int]) -> LineCRF:
    """Maximum conditional likelihood by Adam; every line of a sequence carries its document's label."""
    size = line_features([b""], np.zeros(1, bool)).shape[1]
    crf = LineCRF(np.zeros((size, 2)), np.zeros((2, 2)))
    if len(set(labels)) < 2:
        return crf
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    seqs, y = [sequences[i] for i in order], np.array(labels)[order]
    length = np.array([len(x) for x in seqs])
    n, t_max = len(seqs), int(length[0])
    x = np.zeros((n, t_max, size), np.float32)
    for i, s in enumerate(seqs):
        x[i, : len(s)] = s
    mask = np.arange(t_max)[None, :] < length[:, None]
    live = mask.sum(0)  # sequences are sorted, so live ones come first
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    weight = weight / length
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (crf.emit, crf.move)]
    flat = x.reshape(n * t_max, size)
    for step in range(1, EPOCHS + 1):
        e = (flat @ crf.emit).reshape(n, t_max, 2)
        alpha, beta = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, t_max):
            k = live[t]
            alpha[:k, t] = np.logaddexp(alpha[:k, t - 1, :1] + crf.move[0], alpha[:k, t - 1, 1:] + crf.move[1]) + e[:k, t]
        for t in range(t_max - 2, -1, -1):
            k = live[t + 1]
            nxt = e[:k, t + 1] + beta[:k, t + 1]
            beta[:k, t] = np.logaddexp(crf.move[:, 0] + nxt[:, :1], crf.move[:, 1] + nxt[:, 1:])
        z = np.logaddexp(*(alpha + beta)[:, 0].T)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        gold = np.zeros_like(node)
        gold[np.arange(n), :, y] = mask
        diff = (gold - node) * weight[:, None, None]
        grad_emit = flat.T @ diff.reshape(n * t_max, 2) - RIDGE * crf.emit
        grad_move = -RIDGE * crf.move
        both = mask[:, 1:]
        for a in range(2):
            for b in range(2):
                pair = np.exp(alpha[:, :-1, a] + crf.move[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * both
                right = both * ((y == a) & (a == b))[:, None]
                grad_move[a, b] += ((right - pair) * weight[:, None]).sum()
        for (m, v), p, g in zip(moments, (crf.emit, crf.move), (grad_emit, grad_move), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return crf


# -- documents -----------------------------------------------------------------------------------


def repeated_lines(lines: list[bytes]) -> np.ndarray:
    """True for a line with a word that equals an earlier line of the text."""
    seen: set[bytes] = set()
    out = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if line and not line.isspace():
            if line in seen:
                out[i] = True
            else:
                seen.add(line)
    return out


def repeated_words(word_lists: list[list[bytes]]) -> list[int]:
    """Per text: words inside WINDOW-word windows that occur twice or more in the text."""
    sizes = np.array([len(w) for w in word_lists], np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return [0] * len(word_lists)
    h = np.fromiter((hash(w) for ws in word_lists for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(word_lists)), sizes)
    n = total - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    key ^= key >> np.uint64(31)
    key = key * np.uint64(0xBF58476D1CE4E5B9) + doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    hit = np.flatnonzero(twice)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:total]) > 0
    return np.bincount(doc, weights=covered, minlength=len(word_lists)).astype(np.int64).tolist()


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(texts: list[bytes], crf: LineCRF) -> dict[str, list]:
    """Base counts and verdicts of UTF-8 texts."""
    out: dict[str, list] = {c: [] for c in [*COUNTS, "base_failed", "content_share", "kept"]}
    words = [t.split() for t in texts]
    repeats = repeated_words(words)
    for t, ws, n_repeat in zip(texts, words, repeats, strict=True):
        lines = t.split(b"\n")
        dup = repeated_lines(lines)
        letters = t.translate(None, b" \t\n\x0b\x0c\r")
        chars = len(letters.decode("utf-8", "surrogatepass")) if not letters.isascii() else len(letters)
        failed = len(ws) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(ws)
        share = 0.0
        if not failed:
            label = crf.viterbi(line_features(lines, dup))
            size = np.fromiter(map(len, lines), np.int64, len(lines))
            share = float(size[label == 1].sum() / max(1, size.sum()))
        row = (len(ws), chars, len(t) - len(t.translate(None, SYMBOLS)), int(dup.sum()), n_repeat, failed, share, not failed and share >= CONTENT_SHARE)
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    return out


def train_line_crf(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> LineCRF:
    """Fit on at most TRAIN_DOCS labelled documents of each quality, those of the smallest id hashes, and of each on at
    most TRAIN_SEQUENCES runs of TRAIN_LINES lines. Executors turn texts into features; only these come to the driver,
    2 * TRAIN_DOCS * TRAIN_SEQUENCES * TRAIN_LINES lines of one byte a feature at most (under 25 MB).

    Cases: of an id's several labels the lowest quality counts, of its several texts the one of the least hash; null
    ids, labels and texts do not train. Without both classes the model is neutral: ties go to content and the base
    rules alone decide.
    """
    bounded_batches(spark)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    mix = F.xxhash64("doc_id")
    picks = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(mix, "doc_id").limit(TRAIN_DOCS).collect()]
    if not picks:
        return fit_crf([], [])
    chosen = spark.createDataFrame([(r["doc_id"], int(r["quality"])) for r in picks], "doc_id long, quality int")
    size = line_features([b""], np.zeros(1, bool)).shape[1]

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = b.column(1)[i].as_py().split(b"\n")
                again = repeated_lines(lines)
                starts = range(0, len(lines), TRAIN_LINES)
                if len(starts) > TRAIN_SEQUENCES:
                    starts = [starts[k] for k in np.linspace(0, len(starts) - 1, TRAIN_SEQUENCES).astype(int)]
                packed = [line_features(lines[a : a + TRAIN_LINES], again[a : a + TRAIN_LINES]).astype(np.uint8).tobytes() for a in starts]
                k = len(packed)
                yield pa.record_batch([pa.array([b.column(0)[i].as_py()] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([b.column(2)[i].as_py()] * k, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "part", "quality", "features"])

    body = F.col("text").cast("string")
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    order = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    one = hits.groupBy("doc_id", "quality").agg(F.min_by("text", order).alias("text"))
    rows = one.select("doc_id", F.encode("text", "UTF-8").alias("text"), "quality").mapInArrow(sequences, "doc_id long, part int, quality int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["part"]))
    return fit_crf([np.frombuffer(r["features"], np.uint8).reshape(-1, size).astype(np.float32) for r in rows], [r["quality"] for r in rows])


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of the batch of about GROUP_BYTES of text."""
    start, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def quality_table(spark: SparkSession, docs: DataFrame, crf: LineCRF) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, content_share.

    Cases: a null text has no words and fails; a null doc_id stays null; equal texts are judged
    alike; a text without line ends is one line; other columns are ignored; empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _groups(b, 1):
                j = judge(texts, crf)
                yield pa.record_batch(
                    [b.column(0).slice(start, len(texts)), *[pa.array(j[c], pa.int64()) for c in COUNTS], pa.array(j["base_failed"], pa.bool_()), pa.array(j["kept"], pa.bool_()), pa.array(j["content_share"], pa.float64())],
                    ["doc_id", *COUNTS, "base_failed", "kept", "content_share"],
                )

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, content_share double")


def keep_quality(docs: DataFrame, crf: LineCRF) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are called.

    Cases: a null or empty text fails the base rules and goes; each row is judged by its text alone, so equal rows
    stay or go together; long texts are judged whole; empty in, empty out.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kept = []
                as_bytes = pa.record_batch([b.column(at).cast(pa.binary())], ["t"])
                for _, texts in _groups(as_bytes, 0):
                    kept += judge(texts, crf)["kept"]
                yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_table(spark, docs, train_line_crf(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
