"""Progressive JPEG files for tests and for tables that hold no images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.jpeg import _COSINES, ZIGZAG

QUANTA = (np.add.outer(np.arange(8), np.arange(8)).reshape(64)[ZIGZAG] + 3).astype(np.int64)
#: Components, first and last coefficient, and the bit position before and after, of each scan.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2),
    ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
)


def planes(rgb: np.ndarray, factor: int) -> list[np.ndarray]:
    """Quantised coefficients (down x across x 64, in scan order) of Y, Cb and Cr."""
    h, w = rgb.shape[:2]
    unit = 8 * factor
    rgb = np.pad(rgb.astype(float), ((0, -h % unit), (0, -w % unit), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    out = []
    for plane, f in ((y - 128, 1), ((b - y) / 1.772, factor), ((r - y) / 1.402, factor)):
        plane = plane.reshape(plane.shape[0] // f, f, plane.shape[1] // f, f).mean(axis=(1, 3))
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2)
        c = (_COSINES @ blocks @ _COSINES.T).reshape(*blocks.shape[:2], 64)[..., ZIGZAG]
        out.append(np.rint(c / QUANTA).astype(np.int64))
    return out


class _Writer:
    """Symbols and plain bits of one scan; the code table is made when all are known."""

    def __init__(self) -> None:
        self.items: list[tuple[int | None, int, int]] = []
        self.run, self.pending = 0, []

    def put(self, symbol: int | None, value: int = 0, bits: int = 0) -> None:
        self.items.append((symbol, value, bits))

    def number(self, high: int, value: int) -> None:
        size = abs(value).bit_length()
        self.put(high << 4 | size, value if value >= 0 else value + (1 << size) - 1, size)

    def flush(self) -> None:
        if self.run:
            size = self.run.bit_length() - 1
            self.put(size << 4, self.run - (1 << size), size)
            for bit in self.pending:
                self.put(None, bit, 1)
            self.run, self.pending = 0, []

    def result(self, kind: int) -> bytes:
        symbols = sorted({s for s, _, _ in self.items if s is not None})
        length = max(1, len(symbols).bit_length())
        code = {s: k for k, s in enumerate(symbols)}
        counts = bytes(len(symbols) if n == length else 0 for n in range(1, 17))
        body = bytes([kind << 4]) + counts + bytes(symbols)
        acc, n = 1, 0
        for s, value, bits in self.items:
            if s is not None:
                acc, n = acc << length | code[s], n + length
            if bits:
                acc, n = acc << bits | value, n + bits
        pad = -n % 8
        acc, n = acc << pad | (1 << pad) - 1, n + pad
        data = acc.to_bytes(n // 8 + 1, "big")[1:]
        table = b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body if symbols else b""
        return table, data.replace(b"\xff", b"\xff\0")


def encode(rgb: np.ndarray, factor: int = 2, restart: int = 0) -> bytes:
    """A progressive JPEG with spectral selection and successive approximation; chroma reduced by ``factor``."""
    h, w = rgb.shape[:2]
    parts = planes(rgb, factor)
    own = [(-(-h // 8), -(-w // 8))] + [(-(-(-(-h // factor)) // 8), -(-(-(-w // factor)) // 8))] * 2
    out = [b"\xff\xd8", b"\xff\xdb\0\x43\0" + bytes(QUANTA.tolist())]
    frame = b"".join(bytes([k + 1, (factor << 4 | factor) if k == 0 else 0x11, 0]) for k in range(3))
    out.append(b"\xff\xc2\0\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + frame)
    if restart:
        out.append(b"\xff\xdd\0\x04" + restart.to_bytes(2, "big"))
    for used, first, last, high, low in SCANS:
        if len(used) == 1:
            rows, columns = own[used[0]]
            units = [[(used[0], y, x)] for y in range(rows) for x in range(columns)]
        else:
            units = []
            for y in range(parts[1].shape[0]):
                for x in range(parts[1].shape[1]):
                    units.append([(0, factor * y + a, factor * x + b) for a in range(factor) for b in range(factor)] + [(1, y, x), (2, y, x)])
        writer, pieces, before = _Writer(), [], [0, 0, 0]
        marks = []
        for number, unit in enumerate(units):
            if restart and number and number % restart == 0:
                writer.flush()
                marks.append(len(writer.items))
                before = [0, 0, 0]
            for k, y, x in unit:
                c = parts[k][y, x].tolist()
                if first == 0 and not high:
                    value = c[0] >> low
                    writer.number(0, value - before[k])
                    before[k] = value
                elif first == 0:
                    writer.put(None, c[0] >> low & 1, 1)
                elif not high:
                    zeros = 0
                    for value in c[first : last + 1]:
                        value = (abs(value) >> low) * (1 if value > 0 else -1)
                        if not value:
                            zeros += 1
                            continue
                        writer.flush()
                        while zeros > 15:
                            writer.put(0xF0)
                            zeros -= 16
                        writer.number(zeros, value)
                        zeros = 0
                    if zeros:
                        writer.run += 1
                        if writer.run == 0x7FFF:
                            writer.flush()
                else:
                    _refine(writer, c[first : last + 1], low)
        writer.flush()
        pieces = [writer.items[a:b] for a, b in zip([0, *marks], [*marks, len(writer.items)])]
        head = b"\xff\xda" + (6 + 2 * len(used)).to_bytes(2, "big") + bytes([len(used)]) + b"".join(bytes([k + 1, 0]) for k in used) + bytes([first, last, high << 4 | low])
        table, data = writer.result(int(first > 0))
        if marks:  # the same table, each part padded on its own
            data = []
            for piece in pieces:
                known = {s for s, _, _ in writer.items if s is not None}
                length = max(1, len(known).bit_length())
                data.append(_bits(piece, {s: n for n, s in enumerate(sorted(known))}, length))
            data = b"".join(d + (b"" if n == len(data) - 1 else bytes([0xFF, 0xD0 + n % 8])) for n, d in enumerate(data))
        out += [table, head, data]
    return b"".join([*out, b"\xff\xd9"])


def _bits(items: list[tuple[int | None, int, int]], code: dict[int, int], length: int) -> bytes:
    acc, n = 1, 0
    for s, value, bits in items:
        if s is not None:
            acc, n = acc << length | code[s], n + length
        if bits:
            acc, n = acc << bits | value, n + bits
    pad = -n % 8
    acc, n = acc << pad | (1 << pad) - 1, n + pad
    return acc.to_bytes(n // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")


def _refine(writer: _Writer, c: list[int], low: int) -> None:
    size = [abs(v) >> low for v in c]
    newest = max((k for k, v in enumerate(size) if v == 1), default=-1)
    zeros, corrections = 0, []
    for k, v in enumerate(size):
        if v == 0:
            zeros += 1
            continue
        while zeros > 15 and k <= newest:
            writer.flush()
            writer.put(0xF0)
            zeros -= 16
            for bit in corrections:
                writer.put(None, bit, 1)
            corrections = []
        if v > 1:
            corrections.append(v & 1)
            continue
        writer.flush()
        writer.put(zeros << 4 | 1, int(c[k] > 0), 1)
        for bit in corrections:
            writer.put(None, bit, 1)
        zeros, corrections = 0, []
    if zeros or corrections:
        writer.run += 1
        writer.pending += corrections
        if writer.run == 0x7FFF:
            writer.flush()


def picture(number: int, vector: np.ndarray) -> np.ndarray:
    """A picture of a vector; its size varies with the number: small, and every 64th some hundred pixels wide."""
    h, w = (72 + number % 29, 80 + number % 33) if number % 64 == 0 else (12 + number % 7, 14 + number % 5)
    v = np.resize(np.nan_to_num(vector) if len(vector) else np.zeros(1), h * w).reshape(h, w)
    span = float(np.ptp(v)) or 1.0
    grey = 255 * (v - v.min()) / span
    slope = np.add.outer(np.linspace(0, 128, h), np.linspace(0, 127, w))
    return np.stack([grey / 2 + slope / 2, slope, 255 - grey / 4 - slope / 2], axis=2).astype(np.uint8)


def settings(number: int) -> tuple[int, int]:
    """How a picture is written: by what chroma is reduced, and the units between restart markers."""
    return 1 + number % 2, (0, 2, 0, 0, 5)[number % 5]


def drawn(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``media`` (progressive JPEG bytes) of every embedding; null embeddings give null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [None if v is None else encode(picture(i or 0, np.array(v, float)), *settings(i or 0)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["vec_id", "media"])

    return embeddings.select("vec_id", "embedding").mapInArrow(apply, "vec_id bigint, media binary")
