"""Exact byte-level BPE over whole Arrow batches.

A vocabulary's split pattern cuts a text into pieces; a piece's tokens depend on the piece alone.
The split runs in numpy over all texts of a slice at once, every distinct piece is encoded once per
worker, and the tokens of a text are gathered from that memory. Results equal the plain encoder's.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tabulon.llm import kernels as K

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers before it starts anew.
MEMORY = 500_000

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, value in (("L", _LETTER), ("N", _NUMBER)):
        found = "".join(regex.findall(rf"\p{{{name}}}+", everything))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    table[_WHITE] = _SPACE
    return table


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the split pattern starts a piece; every non-empty row starts one."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    where = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[points]
    n = len(kind)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(where, offsets)] = True  # offsets lie on characters
    row[n] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= row[:-1]
    space = kind == _SPACE
    # The last white space before other text stands alone, or joins that text if it is a blank.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~row[1:-1])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~row[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~row[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < n]] = True
        # A blank after the shortened word still joins what follows it.
    return where[start]


class Encoder:
    """Encodes and decodes columns with one vocabulary of ``token rank`` lines."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._plain._core_bpe.encode_single_piece
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.by_rank = by_rank
        self._token_ends = np.cumsum([len(t) for t in by_rank])
        self.token_lengths = np.array([len(t) for t in by_rank], np.int64)
        self._token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._lengths = np.zeros(0, np.int64)
        self._begins = np.zeros(0, np.int64)
        self._pool = np.zeros(0, self.dtype)

    def _known(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of each distinct piece's entry, after unknown pieces are encoded."""
        if len(self._hashes) > MEMORY:
            self._forget()
        at = np.searchsorted(self._hashes, hashes)
        known = at < len(self._hashes)
        known[known] = self._hashes[at[known]] == hashes[known]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids = [self._piece(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for one in ids for x in one), self.dtype, int(lengths.sum()))
            begins = len(self._pool) + np.cumsum(lengths) - lengths
            self._pool = np.concatenate([self._pool, flat])
            merged = np.concatenate([self._hashes, hashes[new]])
            order = np.argsort(merged, kind="stable")
            self._hashes = merged[order]
            self._lengths = np.concatenate([self._lengths, lengths])[order]
            self._begins = np.concatenate([self._begins, begins])[order]
            at = np.searchsorted(self._hashes, hashes)
        return at

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every piece of a slice, pieces before each row, and all rows' offsets."""
        data, offsets = K.utf8(column)
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes, first, back = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        entry = self._known(hashes, data, starts[first], ends[first])[back]
        return entry, np.searchsorted(starts, offsets)

    def count(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Tokens of each row; null and empty texts have none."""
        out = []
        for part in K.slices(K.strings(column)):
            entry, before = self._pieces(part)
            total = np.concatenate([[0], np.cumsum(self._lengths[entry])])
            out.append(total[before[1:]] - total[before[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows in one array, and len+1 offsets into it."""
        ids, counts = [], []
        for part in K.slices(K.strings(column)):
            entry, before = self._pieces(part)
            lengths = self._lengths[entry]
            total = np.concatenate([[0], np.cumsum(lengths)])
            counts.append(total[before[1:]] - total[before[:-1]])
            ids.append(self._pool[np.repeat(self._begins[entry] - total[:-1], lengths) + np.arange(total[-1])])
        if not ids:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode_open(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, for non-empty rows that other text may follow.

        Adds the tokens and bytes at each row's end that such text may change: those from the first
        piece on that ends within two characters of the end, as far as the split pattern looks ahead.
        """
        ids, counts, tail_tokens, tail_bytes = [], [], [], []
        for part in K.slices(K.strings(column)):
            data, offsets = K.utf8(part)
            starts = piece_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            hashes, first, back = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            entry, before = self._known(hashes, data, starts[first], ends[first])[back], np.searchsorted(starts, offsets)
            lengths = self._lengths[entry]
            total = np.concatenate([[0], np.cumsum(lengths)])
            counts.append(total[before[1:]] - total[before[:-1]])
            ids.append(self._pool[np.repeat(self._begins[entry] - total[:-1], lengths) + np.arange(total[-1])])
            where = np.flatnonzero((data & 0xC0) != 0x80)
            limit = np.maximum(where[np.maximum(np.searchsorted(where, offsets[1:]) - 2, 0)], offsets[:-1])
            open_from = np.searchsorted(ends, limit, side="right")
            tail_tokens.append(total[before[1:]] - total[open_from])
            tail_bytes.append(offsets[1:] - starts[open_from])
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(tail_tokens), np.concatenate(tail_bytes)

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece of the split pattern."""
        return self._piece(text.encode())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in one array, and len+1 offsets into it."""
        lengths = self.token_lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        begin = self._token_ends[ids] - lengths
        return self._token_bytes[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])], total[offsets]

    def plain(self, text: str) -> list[int]:
        """The library's own encoding, for comparison."""
        return self._plain.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    return Encoder(path)
