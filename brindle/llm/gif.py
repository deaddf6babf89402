"""Media columns: texts as GIF pixels, and a GIF decoder (LZW, palettes, disposal, transparency, timing)."""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WIDTH = 192  # pixels of a row
FRAME_ROWS = 128  # rows of a frame, fewer in the last
DELAY_CS = 10  # hundredths of a second that a frame stays
LITERALS = 512  # single samples after a clear code
LEVELS = 4  # of red, green and blue in a colour histogram, so LEVELS**3 bins
MAX_PIXELS = 1 << 26  # a larger canvas (256 MB as red, green, blue, opacity) counts as damaged
BATCH_BYTES = 4 << 20  # of frames that are handed on at once
CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
GREY = bytes(v for i in range(256) for v in (i, i, i))

_INDEX = np.arange(FULL - FIRST + 1)
_WIDTHS = np.minimum(12, np.ceil(np.log2(np.maximum(FIRST + np.maximum(_INDEX - 1, 0), 257) + 1))).astype(np.int64)  # of the i-th code after a clear code
_OFFSETS = np.cumsum(_WIDTHS) - _WIDTHS


class DamagedGIF(ValueError):
    """A file that is no GIF, is cut off or contradicts itself."""


# -- LZW -----------------------------------------------------------------------------------------


def lzw_encode(data: bytes) -> bytes:
    """A code stream of 8-bit samples, made with numpy: after a clear code come LITERALS single samples,
    whose neighbours enter the table; then such pairs are taken left to right wherever they occur, until
    the table is full. (A stream may use any code the reader's table has; longer entries are not used.)
    """
    s = np.frombuffer(data, np.uint8)
    values: list[np.ndarray] = []
    widths: list[np.ndarray] = [_WIDTHS[:1]]
    at = 0
    room = FULL - FIRST - 1
    while True:
        values.append(np.array([CLEAR], np.uint16))
        head = s[at : at + LITERALS].astype(np.uint16)
        at += len(head)
        codes = head
        rest = s[at : at + 2 * (room - len(head))].astype(np.int64)
        if len(rest) > 1:
            table = np.full(1 << 16, -1, np.int32)
            pairs = head[:-1].astype(np.int64) << 8 | head[1:]
            table[pairs[::-1]] = FIRST + np.arange(len(pairs))[::-1]
            code = table[rest[:-1] << 8 | rest[1:]]
            place = np.arange(len(code))
            gap = np.maximum.accumulate(np.where(code < 0, place, -1))
            take = (code >= 0) & ((place - gap) & 1 == 1)
            first = np.ones(len(rest), bool)
            first[1:] = ~take
            tokens = rest.copy()
            tokens[:-1][take] = code[take]
            start = np.flatnonzero(first)
            tokens = tokens[start][: room - len(head)]
            at += int(start[len(tokens)]) if len(tokens) < len(start) else len(rest)
            codes = np.concatenate([head, tokens.astype(np.uint16)])
        elif len(rest):
            at += 1
            codes = np.concatenate([head, rest.astype(np.uint16)])
        values.append(codes)
        widths.append(_WIDTHS[: len(codes) + 1])  # the next clear or end code counts with these
        if at >= len(s):
            break
    values.append(np.array([END], np.uint16))
    bits = np.unpackbits(np.concatenate(values).view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < np.concatenate(widths)[:, None]], bitorder="little").tobytes()


def _codes(data: np.ndarray, bit: int, count: int) -> np.ndarray:
    """Up to count codes from this bit on, as if a clear code had come just before and none follows."""
    count = min(count, int(np.searchsorted(_OFFSETS + _WIDTHS, 8 * (len(data) - 3) - bit, "right")))
    at = bit + _OFFSETS[:count]
    byte = at >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return word >> (at & 7) & ((1 << _WIDTHS[:count]) - 1)


def _strings(codes: np.ndarray) -> bytes:
    """The samples of codes that follow a clear code. Table entry FIRST+j is the string of code j and
    the first sample of code j+1, so chains of parents give lengths, first samples, then all samples."""
    parent, cur = codes, codes.copy()
    length = np.ones(len(codes), np.int64)
    active = np.flatnonzero(cur >= FIRST)
    while len(active):
        if (cur[active] - FIRST >= active).any():
            raise DamagedGIF("a code that is not in the table")
        cur[active] = parent[cur[active] - FIRST]
        length[active] += 1
        active = active[cur[active] >= FIRST]
    root = cur.astype(np.uint8)
    end = np.cumsum(length)
    out = np.empty(int(end[-1]), np.uint8)
    out[end - length] = root
    at, active = end - 1, np.flatnonzero(codes >= FIRST)
    cur = codes.copy()
    while len(active):
        entry = cur[active] - FIRST
        out[at[active]] = root[entry + 1]
        at[active] -= 1
        cur[active] = parent[entry]
        active = active[cur[active] >= FIRST]
    return out.tobytes()


def lzw_decode(stream: bytes, minimum: int, pixels: int) -> bytes:
    """Samples of a code stream. Streams of fewer than 8 bits a sample take the general path."""
    if minimum != 8:
        return _lzw_decode_bits(stream, minimum, pixels)
    data = np.frombuffer(stream + b"\0\0\0", np.uint8)
    out: list[bytes] = []
    bit, ended = 0, False
    while not ended:
        codes = _codes(data, bit, len(_WIDTHS))
        if not len(codes):
            break
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        ended = bool(len(stop)) and codes[n] == END
        if n:
            out.append(_strings(codes[:n]))
        if not len(stop):
            if n < len(_WIDTHS):
                break
            return _lzw_decode_bits(stream, minimum, pixels)  # the table stays full: codes of 12 bits go on
        bit += int(_OFFSETS[n] + _WIDTHS[n])
    return b"".join(out)[:pixels]


def _lzw_decode_bits(stream: bytes, minimum: int, pixels: int) -> bytes:
    """Any stream, code by code; bits wait in a small integer."""
    clear = 1 << minimum
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, prev = base.copy(), minimum + 1, b""
    held, bits, out, made = 0, 0, [], 0
    for byte in stream:
        held |= byte << bits
        bits += 8
        if bits < width:
            continue
        code = held & (1 << width) - 1
        held >>= width
        bits -= width
        while True:
            if code == clear:
                table, width, prev = base.copy(), minimum + 1, b""
            elif code == clear + 1:
                return b"".join(out)[:pixels]
            else:
                if code < len(table):
                    cur = table[code]
                elif prev and code == len(table):
                    cur = prev + prev[:1]
                else:
                    raise DamagedGIF("a code that is not in the table")
                if prev and len(table) < FULL:
                    table.append(prev + cur[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
                out.append(cur)
                made += len(cur)
                prev = cur
                if made >= pixels:
                    return b"".join(out)[:pixels]
            if bits < width:
                break
            code = held & (1 << width) - 1  # narrow codes: a byte may hold several
            held >>= width
            bits -= width
    return b"".join(out)[:pixels]


# -- files ---------------------------------------------------------------------------------------


def gif_of(payload: bytes) -> bytes:
    """A GIF whose grey pixels are the payload's bytes; its length is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        codes = lzw_encode(part)
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


@dataclass
class Frame:
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height of the part that was drawn
    canvas: np.ndarray  # height x width x 4, as shown: red, green, blue, opacity

    def drawn(self) -> np.ndarray:
        left, top, w, h = self.box
        return self.canvas[top : top + h, left : left + w]

    def histogram(self) -> list[int]:
        """Opaque pixels of the canvas by colour: LEVELS equal steps of red, of green and of blue, red counting most."""
        pixels = self.canvas.reshape(-1, 4)
        pixels = pixels if pixels[:, 3].all() else pixels[pixels[:, 3] > 0]
        step = pixels // (256 // LEVELS)
        return np.bincount((step[:, 0] * LEVELS + step[:, 1]) * LEVELS + step[:, 2], minlength=LEVELS**3).tolist()


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def frames_of(data: bytes) -> Iterator[Frame]:
    """Frames as shown, after disposal and transparency, one by one: a frame's canvas changes when the next one is asked for.
    A damaged file raises DamagedGIF after the frames before the damage."""
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise DamagedGIF("the file is cut off") from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise DamagedGIF("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise DamagedGIF(f"a canvas of more than {MAX_PIXELS} pixels")
    at = 13
    common = None

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        size = 3 << (flags & 7) + 1
        if at + size > len(data):
            raise DamagedGIF("the file is cut off")
        out = np.zeros((256, 4), np.uint8)
        out[: size // 3, :3], out[: size // 3, 3] = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), 255
        at += size
        return out

    if flags & 0x80:
        common = colours(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    while True:
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise DamagedGIF("a block of no known kind")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MAX_PIXELS:
            raise DamagedGIF(f"a frame of more than {MAX_PIXELS} pixels")
        at += 10
        palette = colours(local) if local & 0x80 else common
        if palette is None:
            raise DamagedGIF("no palette")
        minimum = data[at]
        if not 1 <= minimum <= 8:
            raise DamagedGIF("samples of no valid size")
        stream, at = _blocks(data, at + 1)
        pixels = lzw_decode(stream, minimum, w * h)
        if len(pixels) < w * h:
            raise DamagedGIF("a frame without all of its samples")
        index = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if local & 0x40:
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            index = index[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        index = index[: part.shape[0], : part.shape[1]]
        if clear_index >= 0:
            shown = index != clear_index
            part[shown] = palette[index[shown]]
        else:
            part[:] = palette[index]
        yield Frame(delay, (left, top, part.shape[1], part.shape[0]), canvas)
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1


def read_gif(data: bytes) -> list[Frame]:
    """All frames, each with a canvas of its own."""
    return [Frame(f.delay_ms, f.box, f.canvas.copy()) for f in frames_of(data)]


# -- tables --------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def _media(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))


def media_column(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF.

    Cases: a null text is an empty one, which is one row of spaces; a null doc_id stays null; equal
    texts give equal bytes; long texts get more frames; other columns are ignored; empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [x.as_py() for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([gif_of(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return _media(df, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frame_table(media: DataFrame) -> DataFrame:
    """Timed frames of a (doc_id, media) table: doc_id, frame, start_ms, delay_ms, the drawn box (left_px, top_px, box_width,
    box_height), width and height of the canvas, histogram (colours, see Frame.histogram), pixels (the whole canvas as
    shown, rows of red, green, blue, opacity).

    Cases: a null medium has no frames; a damaged one has the frames before the damage; a null doc_id stays null;
    equal media give equal rows; frames are read one by one, so a long animation is no more memory than one of its
    canvases; other columns are ignored; empty in, empty out.
    """
    kinds = {"doc_id": pa.int64(), "frame": pa.int32(), "start_ms": pa.int64(), "delay_ms": pa.int64(), "left_px": pa.int32(), "top_px": pa.int32(), "box_width": pa.int32(), "box_height": pa.int32(), "width": pa.int32(), "height": pa.int32(), "histogram": pa.list_(pa.int64()), "pixels": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds.values(), strict=True)], list(kinds))
            held.clear()
            return out

        for b in batches:
            for doc, m in zip(b.column(0), b.column(1), strict=True):
                start = 0
                with contextlib.suppress(DamagedGIF):
                    for i, f in enumerate(frames_of(m.as_py()) if m.is_valid else ()):
                        held.append((doc.as_py(), i, start, f.delay_ms, *f.box, f.canvas.shape[1], f.canvas.shape[0], f.histogram(), f.canvas.tobytes()))
                        start += f.delay_ms
                        size += f.canvas.nbytes
                        if size >= BATCH_BYTES:
                            yield flush()
                            size = 0
        if held:
            yield flush()

    schema = "doc_id long, frame int, start_ms long, delay_ms long, left_px int, top_px int, box_width int, box_height int, width int, height int, histogram array<long>, pixels binary"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, schema)


def media_digests(media: DataFrame) -> DataFrame:
    """Read each stored GIF of (doc_id, n_bytes, media) back: sizes and digests of what was read (the red samples of the
    drawn parts, frame after frame), a feature (frames, duration, colours of the canvases), and ``damage``.

    Cases: a null medium gives nulls; a damaged one the digests of the frames before the damage, and what is wrong in
    ``damage`` (else null); otherwise as frame_table().
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "damage"]

    def digests(stored: bytes) -> tuple:
        n, ms, size, tail, damage = 0, 0, 0, b"", None
        sha, total = hashlib.sha256(), np.zeros(LEVELS**3, np.int64)
        try:
            for f in frames_of(stored):
                payload = f.drawn()[..., 0].tobytes()
                sha.update(payload)
                size += len(payload)
                tail = (tail + payload[-16:])[-16:]
                total += f.histogram()
                n, ms = n + 1, ms + f.delay_ms
        except DamagedGIF as e:
            damage = str(e)
        colours = ",".join(f"{i}:{v}" for i, v in enumerate(total.tolist()) if v)
        return size, sha.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), f"frames={n};ms={ms};colours={colours}", damage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = [digests(m.as_py()) if m.is_valid else (None,) * 7 for m in b.column(2)]
            cols = zip(*rows) if rows else [()] * 7
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("media").cast("binary").alias("media")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damage string")


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_column(documents(spark, sf_dir)))
