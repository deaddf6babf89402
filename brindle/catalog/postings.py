"""GIN indexes as posting tables. A text index has (token, ids) rows, the ids of a piece of the rows, sorted by token in
each file, so that a search reads the pages of its tokens; a JSONB index has (token, id) rows in ranges of tokens.

Tokens follow from the index's tokenizer: ``word`` the words of a text in lower case, ``bigram`` its pairs of
neighbouring characters in lower case, ``jsonb_path_ops`` one ``path=value`` for each scalar of a JSONB document, a
backslash before what is no word character in a key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J

ROWS_OF_FILE = 4_000_000  # postings of one file of a JSONB index, about
PIECE, PIECE_TOKENS = 2_000_000, 500_000  # postings and words that a task holds at once, about
TEXTS = 512  # taken out of an Arrow batch at once
#: All ASCII but a-z and 0-9 parts words; everything else is inside them.
SPACED = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else 32 for c in range(256))
NARROW = 256  # characters with a code of their own: pairs of them are told apart by a table


class Words:
    """Distinct words of texts in lower case, as numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def of(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, set(text.translate(SPACED).split())), np.int64)

    def full(self) -> bool:
        return len(self.numbers) >= PIECE_TOKENS

    def texts(self, numbers: np.ndarray) -> list[bytes]:
        names = list(self.numbers)
        out = [names[n] for n in numbers]
        self.numbers.clear()
        return out


class Bigrams:
    """Distinct pairs of neighbouring characters, as numbers: the first character's, 21 bits, the second's."""

    def __init__(self):
        self.codes = np.full(0x110000, -1, np.int64)  # of the first NARROW characters that were met
        self.chars = np.zeros(NARROW, np.int64)
        self.known = 0
        self.seen = np.zeros(NARROW * NARROW, bool)

    def of(self, text: bytes) -> np.ndarray:
        # bytes that are no UTF-8 are characters, too
        chars = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[chars]
        if self.known < NARROW and codes.size and codes.min() < 0:
            new = np.unique(chars[codes < 0])[: NARROW - self.known]
            self.codes[new] = np.arange(self.known, self.known + new.size)
            self.chars[self.known : self.known + new.size] = new
            self.known += new.size
            codes = self.codes[chars]
        if codes.size and codes.min() < 0:
            wide = chars.astype(np.int64)
            return np.unique(wide[:-1] << 21 | wide[1:])
        pairs = codes[:-1] * NARROW + codes[1:]
        self.seen[pairs] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return self.chars[found // NARROW] << 21 | self.chars[found % NARROW]

    def full(self) -> bool:
        return False

    def texts(self, numbers: np.ndarray) -> list[bytes]:
        return [(chr(n >> 21) + chr(n & 0x1FFFFF)).encode("utf-8", "surrogateescape") for n in numbers.tolist()]


def grouped(tokens: Words | Bigrams, ids: list[int], numbers: list[np.ndarray]) -> pa.RecordBatch:
    """(token, ids) of a piece."""
    owners = np.repeat(np.array(ids, np.int64), [len(n) for n in numbers])
    flat = np.concatenate(numbers)
    order = np.argsort(flat, kind="stable")
    found, starts = np.unique(flat[order], return_index=True)
    texts = pa.array(tokens.texts(found), pa.binary()).view(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(owners[order], pa.int64()))
    return pa.record_batch([texts, lists], ["token", "ids"])


def pieces(kind: Callable[[], Words | Bigrams]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, id) to (token, ids): the rows of a task in pieces of about PIECE postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, numbers, size = kind(), [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                for text, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = tokens.of(text)
                    if not found.size:
                        continue
                    ids.append(i)
                    numbers.append(found)
                    size += found.size
                    if size >= PIECE or tokens.full():
                        yield grouped(tokens, ids, numbers)
                        ids, numbers, size = [], [], 0
        if ids:
            yield grouped(tokens, ids, numbers)

    return run


def paths(rows: DataFrame, column: str, rowid: str) -> DataFrame:
    """(token, id) of every scalar in a JSONB column, level by level."""
    spark = rows.sparkSession
    level = rows.select(F.col(rowid).alias("id"), F.lit("$").alias("path"), F.col(column).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        level.createOrReplaceTempView("brindle_json_level")
        text = J.scalar_text("v")
        scalars = spark.sql(f"SELECT concat(path, '=', {text}) AS token, id FROM brindle_json_level WHERE {text} IS NOT NULL")
        found = scalars if found is None else found.unionAll(scalars)
        inner = spark.sql("SELECT id, path, v FROM brindle_json_level WHERE startswith(to_json(v), '{') OR startswith(to_json(v), '[')")
        if inner.isEmpty():
            spark.catalog.dropTempView("brindle_json_level")
            return found
        inner.createOrReplaceTempView("brindle_json_inner")
        level = spark.sql(
            "SELECT i.id, concat(i.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', regexp_replace(e.key, '([^\\\\w])', '\\\\\\\\$1')) END) AS path, e.value AS v"
            " FROM brindle_json_inner i, LATERAL variant_explode(i.v) AS e WHERE e.value IS NOT NULL"
        )
        spark.catalog.dropTempView("brindle_json_inner")


def build(rows: DataFrame, column: str, tokenizer: str, rowid: str, path: str) -> None:
    """Write the postings of a table's column. Texts are tokenized once, where they are read, and nothing is dealt out: a
    file has the tokens of its own rows, a hot token some rows in each. A JSONB column's are ranges of tokens."""
    if tokenizer == "jsonb_path_ops":
        # a token may be in any number of rows: ranges are of (token, id)
        postings = paths(rows, f"`{column}`", rowid).repartitionByRange("token", "id").sortWithinPartitions("token", "id")
        postings.write.option("maxRecordsPerFile", ROWS_OF_FILE).parquet(path)
        return
    texts = rows.where(F.col(f"`{column}`").isNotNull()).select(F.lower(F.col(f"`{column}`")).cast("binary").alias("text"), F.col(rowid).alias("id"))
    postings = texts.mapInArrow(pieces({"word": Words, "bigram": Bigrams}[tokenizer]), "token string, ids array<long>")
    postings.sortWithinPartitions("token").write.parquet(path)


def read(spark: SparkSession, tokenizer: str, parts: list[str]) -> DataFrame:
    """(token, id) of what build() wrote."""
    if tokenizer == "jsonb_path_ops":
        return spark.read.schema("token string, id long").parquet(*parts)
    return spark.read.schema("token string, ids array<long>").parquet(*parts).select("token", F.explode("ids").alias("id"))
