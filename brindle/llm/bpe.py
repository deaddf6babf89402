"""Byte-level BPE over Arrow batches: vectorised pre-splitting, tree concatenation of long texts.

A text is cut into halves down to leaves of LEAF_CHARS; all leaves of a batch are encoded side by
side with numpy; at each join a window that starts at a sure piece boundary of the left half and
grows into the right half is encoded again until one of its boundaries is also a boundary of the
right half. From a shared boundary on both encodings are the same (the splitter never looks back),
so the joined ids are exactly those of the whole text. Inside one unsplit piece the same is done
on tokens: windows grow until the pairs at both seams encode to themselves, which is sufficient
for BPE. Every batch is checked: the tokens' bytes must be the text's bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

LEAF_CHARS = 1 << 14  # longer texts are halved
PIECE_LEAF = 96  # bytes of one unsplit piece that are encoded directly
PIECE_WINDOW = 4  # tokens on each side of a join to begin with
LOOKAHEAD = 3  # characters after a boundary that could still change it
MAX_ENTRIES = 1 << 20  # pieces kept by a worker
BATCH_CHARS = 1 << 18
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 9
STABLE = 0x250  # classes of lower code points are looked up at once, others when seen


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def tree(n: int, leaf: int) -> list[tuple[int, int]]:
    """Leaves of halving [0, n) until no part is longer than leaf."""
    parts = [(0, n)]
    while any(b - a > leaf for a, b in parts):
        parts = [p for a, b in parts for p in ([(a, b)] if b - a <= leaf else [(a, (a + b) // 2), ((a + b) // 2, b)])]
    return parts


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        #: Added tokens are cut out before anything else; the plain kind is found as written, the longest first.
        self.cut = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        self.cutter = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        vocab = {v: bytes(letters[c] for c in k) for k, v in spec["model"]["vocab"].items() if k not in special}
        self.vocab_size = max([*vocab, *special.values()]) + 1
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={b: i for i, b in vocab.items()}, special_tokens={})
        token = [vocab.get(i, b"") for i in range(self.vocab_size)]
        for text, i in special.items():
            token[i] = text.encode()
        self.token = token
        self.token_len = np.array([len(b) for b in token], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        rng = np.random.default_rng(12345)
        self.byte_mix = rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._classify(np.arange(STABLE, dtype=np.uint32))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.slot_hash = np.zeros(1 << 20, np.uint64)
        self.slot_entry = np.full(1 << 20, -1, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool_used = 0
        self.entry_at = np.zeros(1 << 16, np.int64)
        self.entry_len = np.zeros(1 << 16, np.int64)

    # -- splitting ---------------------------------------------------------------------------

    def _classify(self, points: np.ndarray) -> None:
        """Ask the library's own splitter what a character joins with: letters, digits or neither."""
        for cp in points.tolist():
            ch = chr(cp)
            if 0xD800 <= cp < 0xE000:
                kind = OTHER
            elif len(self.library.pre_tokenizer.pre_tokenize_str("a" + ch)) == 1:
                kind = LETTER
            elif len(self.library.pre_tokenizer.pre_tokenize_str("1" + ch)) == 1:
                kind = NUMBER
            else:
                kind = OTHER if len(self.library.pre_tokenizer.pre_tokenize_str("!" + ch)) == 1 else SPACE
            self.classes[cp] = kind

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, piece starts in characters, piece starts in bytes, text starts in characters)."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        n = len(joined)
        if n == 0:
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64), text_at
        cp = data if len(data) == n else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = self.classes[cp]
        if (cls == UNKNOWN).any():
            self._classify(np.unique(cp[cls == UNKNOWN]))
            cls = self.classes[cp]
        prev = np.empty(n, np.uint8)
        prev[0] = UNKNOWN
        prev[1:] = cls[:-1]
        first = np.zeros(n + 1, bool)
        first[text_at] = True
        prev[text_at[:-1][sizes > 0]] = UNKNOWN
        run = cls != prev
        start = run.copy()
        after_space = np.flatnonzero(run & (prev == SPACE))  # a run of white space ended just before
        start[after_space - 1] = True
        blank = cp[after_space - 1] == 32
        start[after_space[blank]] = False
        for q in np.flatnonzero(cp == 39).tolist():  # contractions
            if not run[q] or q + 1 >= n or first[q + 1] or cls[q + 1] != LETTER or (prev[q] == SPACE and cp[q - 1] == 32):
                continue
            c, size = chr(cp[q + 1]), 0
            if c in "stmd":
                size = 1
            elif q + 2 < n and not first[q + 2] and c + chr(cp[q + 2]) in ("re", "ve", "ll"):
                size = 2
            if size:
                start[q + 1] = False
                if q + 1 + size < n and not first[q + 1 + size] and cls[q + 1 + size] == LETTER:
                    start[q + 1 + size] = True
        chars = np.flatnonzero(start)
        if len(data) == n:
            return data, chars, chars, text_at
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        return data, chars, lead[chars], text_at

    # -- pieces ------------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """BPE of one unsplit piece, by tree concatenation when it is long."""
        if len(piece) <= PIECE_LEAF:
            return self.pieces._encode_single_piece(piece)
        parts = [self.pieces._encode_single_piece(piece[a:b]) for a, b in tree(len(piece), PIECE_LEAF)]
        while len(parts) > 1:
            parts = [self._join_pieces(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _sound(self, a: int, b: int) -> bool:
        return self.pieces._encode_single_piece(self.token[a] + self.token[b]) == [a, b]

    def _join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        w = PIECE_WINDOW
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            window = self.pieces._encode_single_piece(b"".join(self.token[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._sound(left[i - 1], window[0])) and (j == len(right) or self._sound(window[-1], right[j])):
                return left[:i] + window + right[j:]
            w *= 2

    def _add(self, keys: list[int], pieces: list[bytes]) -> range:
        """New entries for these pieces."""
        direct = self.pieces._core_bpe.encode_single_piece
        ids = [direct(p) if len(p) <= PIECE_LEAF else self.encode_piece(p) for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        first = len(self.known)
        new = range(first, first + len(ids))
        while new.stop > len(self.entry_at):
            self.entry_at, self.entry_len = np.resize(self.entry_at, 2 * len(self.entry_at)), np.resize(self.entry_len, 2 * len(self.entry_len))
        while self.pool_used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.pool_used : self.pool_used + len(flat)] = flat
        self.entry_at[first : new.stop], self.entry_len[first : new.stop] = self.pool_used + np.cumsum(size) - size, size
        self.pool_used += len(flat)
        self.known.update(zip(keys, new, strict=True))
        return new

    def _hashes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if len(self.powers) < n + 1:
            size = max(n + 1, 2 * len(self.powers))
            odd = pow(int(self.base), -1, 1 << 64)
            self.powers, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x), np.uint64)])) for x in (int(self.base), odd))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte_mix[data] * self.powers[:n], out=sums[1:])
        ends = np.concatenate([at[1:], [n]])
        h = (sums[ends] - sums[at]) * self.inverse[at] + (ends - at).astype(np.uint64)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9), ends

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each piece)."""
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > MAX_ENTRIES:
            self._forget()
        h, ends = self._hashes(data, at)
        slot = (h >> np.uint64(44)).astype(np.int64)
        entry = np.where(self.slot_hash[slot] == h, self.slot_entry[slot], -1)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            keys, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            found = np.fromiter((self.known.get(k, -1) for k in keys.tolist()), np.int32, len(keys))
            new = np.flatnonzero(found < 0)
            if len(new):
                raw, at_new, end_new = data.tobytes(), at[miss[where[new]]].tolist(), ends[miss[where[new]]].tolist()
                found[new] = self._add(keys[new].tolist(), [raw[s:e] for s, e in zip(at_new, end_new, strict=True)])
            self.slot_hash[slot[miss[where]]], self.slot_entry[slot[miss[where]]] = keys, found
            entry[miss] = found[back]
        size = self.entry_len[entry]
        total = np.cumsum(size)
        index = np.arange(total[-1]) + np.repeat(self.entry_at[entry] - (total - size), size)
        return self.pool[index], size

    # -- texts -------------------------------------------------------------------------------

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, end to end."""
        size = self.token_len[ids]
        total = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.token_bytes[np.arange(total[-1]) + np.repeat(self.token_at[ids] - (total - size), size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without special tokens added."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            found = self.cutter.split(t) if self.cutter else [t]
            if len(found) > 1 and not self.cut:
                continue
            parts += found[::2]  # what lies between special tokens; they are the odd ones
            owner += [i] * len(found[::2])
        coded = self._encode_parts(parts)
        if len(parts) == len(texts):
            return coded
        lists: list[list[np.ndarray]] = [[] for _ in texts]
        for i, x in zip(owner, coded, strict=True):
            lists[i].append(x)
        out = []
        for t, own in zip(texts, lists, strict=True):
            if not own:
                out.append(self._library(t))
            elif len(own) == 1:
                out.append(own[0])
            else:
                ids = [np.array([self.special[x]], np.uint32) for x in self.cutter.split(t)[1::2]]
                out.append(np.concatenate([x for pair in zip(own, [*ids, own[0][:0]], strict=True) for x in pair]))
        return out

    def _encode_parts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        size = 0
        for i in range(len(texts)):
            if group and size + len(texts[i]) > BATCH_CHARS:
                self._encode_group(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(texts[i])
        self._encode_group(texts, group, out)
        return out

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_group(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        leaves = [texts[i][a:b] for i in group for a, b in tree(len(texts[i]), LEAF_CHARS)]
        data, chars, at, leaf_at = self.split(leaves)
        ids, size = self._pieces(data, at)
        if not np.array_equal(self.bytes_of(ids), data):  # two pieces with one 64-bit hash
            for i in group:
                out[i] = self._library(texts[i])
            return
        id_at = np.concatenate([[0], np.cumsum(size)])
        piece_at = np.searchsorted(chars, leaf_at)
        k = 0
        for i in group:
            n = len(tree(len(texts[i]), LEAF_CHARS))
            if n == 1:
                out[i] = ids[id_at[piece_at[k]] : id_at[piece_at[k + 1]]]
            else:
                parts = []
                for j in range(k, k + n):
                    a, b = piece_at[j], piece_at[j + 1]
                    parts.append((leaves[j], chars[a:b] - leaf_at[j], id_at[a : b + 1] - id_at[a], ids[id_at[a] : id_at[b]]))
                while len(parts) > 1:
                    parts = [self._join(parts[j], parts[j + 1]) if j + 1 < len(parts) else parts[j] for j in range(0, len(parts), 2)]
                out[i] = parts[0][3]
            k += n

    def _join(self, left: tuple, right: tuple) -> tuple:
        """Join (text, piece starts, id starts, ids) of two halves; see the module's docstring."""
        text_l, at_l, id_l, ids_l = left
        text_r, at_r, id_r, ids_r = right
        sure = int(np.searchsorted(at_l, len(text_l) - LOOKAHEAD, "right")) - 1
        sure = max(sure, 0)
        b = int(at_l[sure]) if len(text_l) > LOOKAHEAD else 0
        sure = sure if b else 0
        tail, grow = text_l[b:], 32
        while True:
            c = min(grow, len(text_r))
            window = tail + text_r[:c]
            data, chars, at, _ = self.split([window])
            ids, size = self._pieces(data, at)
            limit = len(window) if c == len(text_r) else len(window) - LOOKAHEAD
            cut = chars[(chars >= len(tail)) & (chars <= limit)] - len(tail)
            shared = cut[np.isin(cut, at_r)]
            if len(shared) or c == len(text_r):
                break
            grow *= 2
        starts = np.concatenate([[0], np.cumsum(size)])
        if len(shared):
            j, m = int(np.searchsorted(at_r, shared[0])), int(np.searchsorted(chars, shared[0] + len(tail)))
        else:
            j, m = len(at_r), len(chars)
        new_ids = np.concatenate([ids_l[: id_l[sure]], ids[: starts[m]], ids_r[id_r[j] :]])
        new_at = np.concatenate([at_l[:sure], chars[:m] + b, at_r[j:] + len(text_l)])
        base = id_l[sure]
        new_id = np.concatenate([id_l[:sure], starts[:m] + base, id_r[j:] - id_r[j] + base + starts[m]])
        return text_l + text_r, new_at, new_id, new_ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids).tobytes().decode("utf-8", errors="replace").encode("utf-8")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def digests(path: str, texts: list[str]) -> list[tuple[int, str, str]]:
    """(number of ids, sha256 of the ids as little-endian uint32, sha256 of the decoded text)."""
    bpe = tokenizer(path)
    ids = bpe.encode(texts)
    return [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode_bytes(x)).hexdigest()) for x in ids]
