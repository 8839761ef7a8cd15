"""Operator 8: progressive JPEG media columns as full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.llm import shared

#: Bytes of decoded pictures that are held before they are sent on.
SENT_BYTES = 16 << 20

#: Natural place of each coefficient in scan order.
ZIGZAG = np.array(sorted(range(64), key=lambda n: (n // 8 + n % 8, (n // 8 if (n // 8 + n % 8) % 2 else n % 8))))

_u = np.arange(8)
_COSINES = np.where(_u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16)


class Broken(ValueError):
    """The bytes are no JPEG that this decoder reads."""


@lru_cache(maxsize=256)
def _codes(counts: bytes, symbols: bytes) -> tuple[list[int], dict[int, int]]:
    """Length * 256 + symbol for every 8 bits that may follow (0 where no such code does), and of longer codes by length and code."""
    short, long = [0] * 256, {}
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            entry = length << 8 | symbols[k]
            if length <= 8:
                low = code << (8 - length)
                short[low : low + (1 << (8 - length))] = [entry] * (1 << (8 - length))
            else:
                long[length << 16 | code] = entry
            code, k = code + 1, k + 1
        code <<= 1
    if len(short) > 256:
        raise Broken("codes that overlap")
    return short, long


class _Bits:
    """Bits of one segment: ``windows`` holds the three bytes from each byte on as one number, so a look takes one access."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
        self.windows = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist()
        self.at, self.end = 0, 8 * len(data)

    def code(self, table: tuple[list[int], dict[int, int]]) -> int:
        at = self.at
        if at >= self.end:
            raise Broken("the scan ends early")
        next16 = self.windows[at >> 3] >> (8 - (at & 7)) & 0xFFFF
        entry = table[0][next16 >> 8] or _long(table, next16)
        self.at = at + (entry >> 8)
        return entry & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        if n > 16:
            raise Broken("too long a number")
        if at + n > self.end:
            raise Broken("the scan ends early")
        self.at = at + n
        return self.windows[at >> 3] >> (24 - (at & 7) - n) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _long(table: tuple[list[int], dict[int, int]], next16: int) -> int:
    """The entry of a code of over eight bits."""
    for n in range(9, 17):
        if entry := table[1].get(n << 16 | next16 >> (16 - n)):
            return entry
    raise Broken("no such code")


class _Component:
    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table

    def size(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.across, self.down = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.own_across, self.own_down = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        self.coefficients = [0] * (64 * self.across * self.down)


# Both hot loops read bits in place: a call for each would take longer than the reading.


def _first_ac(bits: _Bits, c: list[int], at: int, codes: tuple, low: int, first: int, last: int, run: int) -> int:
    if run:
        return run - 1
    k, p, end, windows, short = first, bits.at, bits.end, bits.windows, codes[0]
    while k <= last:
        if p >= end:
            raise Broken("the scan ends early")
        next16 = windows[p >> 3] >> (8 - (p & 7)) & 0xFFFF
        entry = short[next16 >> 8] or _long(codes, next16)
        p += entry >> 8
        r, s = entry >> 4 & 15, entry & 15
        if s:
            k += r
            if k > last:
                raise Broken("a coefficient outside its band")
            if p + s > end:
                raise Broken("the scan ends early")
            value = windows[p >> 3] >> (24 - (p & 7) - s) & ((1 << s) - 1)
            p += s
            c[at + k] = (value if value >> (s - 1) else value - (1 << s) + 1) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            bits.at = p
            return (1 << r) + bits.take(r) - 1
    bits.at = p
    return 0


def _refine_ac(bits: _Bits, c: list[int], at: int, codes: tuple, low: int, first: int, last: int, run: int) -> int:
    one = 1 << low
    k, p, end, windows = first, bits.at, bits.end, bits.windows
    if not run:
        short = codes[0]
        while k <= last:
            if p >= end:
                raise Broken("the scan ends early")
            next16 = windows[p >> 3] >> (8 - (p & 7)) & 0xFFFF
            entry = short[next16 >> 8] or _long(codes, next16)
            p += entry >> 8
            r, new = entry >> 4 & 15, 0
            if entry & 15:
                if p >= end:
                    raise Broken("the scan ends early")
                new = one if windows[p >> 3] >> (23 - (p & 7)) & 1 else -one
                p += 1
            elif r < 15:
                bits.at = p
                run = (1 << r) + bits.take(r)
                p = bits.at
                break
            while k <= last:
                value = c[at + k]
                if value:
                    if p >= end:
                        raise Broken("the scan ends early")
                    if windows[p >> 3] >> (23 - (p & 7)) & 1 and not abs(value) & one:
                        c[at + k] = value + (one if value > 0 else -one)
                    p += 1
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if new and k <= last:
                c[at + k] = new
            k += 1
    if run:
        left = c[at + k : at + last + 1]
        if any(left):
            for place, value in enumerate(left, at + k):
                if value:
                    if p >= end:
                        raise Broken("the scan ends early")
                    if windows[p >> 3] >> (23 - (p & 7)) & 1 and not abs(value) & one:
                        c[place] = value + (one if value > 0 else -one)
                    p += 1
        run -= 1
    bits.at = p
    return run


def _scan(data: bytes, parts: list[tuple[_Component, tuple | None, tuple | None]], first: int, last: int, high: int, low: int, restart: int, units: tuple[int, int], sequential: bool) -> None:
    """Adds one scan's bits to the coefficients. ``data``: entropy-coded bytes with their markers."""
    segments, begin, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        if 0xD0 <= data[i + 1] <= 0xD7:
            segments.append(data[begin:i])
            begin = i + 2
        i += 2
    segments = [s.replace(b"\xff\0", b"\xff") for s in [*segments, data[begin:]]]
    if len(parts) == 1:
        part = parts[0][0]
        blocks = [[(0, 64 * (y * part.across + x))] for y in range(part.own_down) for x in range(part.own_across)]
    else:
        blocks = []
        for y in range(units[1]):
            for x in range(units[0]):
                blocks.append([(k, 64 * ((y * p.v + b) * p.across + x * p.h + a)) for k, (p, _, _) in enumerate(parts) for b in range(p.v) for a in range(p.h)])
    step = restart or len(blocks)
    for number in range(0, len(blocks), max(1, step)):
        if number // step >= len(segments):
            raise Broken("the scan ends early")
        bits, run, before = _Bits(segments[number // step]), 0, [0] * len(parts)
        for unit in blocks[number : number + step]:
            for k, at in unit:
                part, dc, ac = parts[k]
                c = part.coefficients
                if first == 0:
                    if high:
                        c[at] |= bits.take(1) << low
                    else:
                        before[k] += bits.signed(bits.code(dc))
                        c[at] = before[k] * (1 << low)
                    if sequential:
                        _first_ac(bits, c, at, ac, 0, 1, 63, 0)
                elif high:
                    run = _refine_ac(bits, c, at, ac, low, first, last, run)
                else:
                    run = _first_ac(bits, c, at, ac, low, first, last, run)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 3 RGB of a progressive (or baseline) JPEG of one or three components."""
    try:
        return _decode(data)
    except Broken:
        raise
    except (IndexError, TypeError, KeyError, ValueError, ArithmeticError) as error:
        raise Broken(f"broken off or inconsistent: {error!r}") from error


def _decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise Broken("no start of image")
    tables: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], tuple] = {}
    parts: dict[int, _Component] = {}
    width = height = restart = 0
    adobe, sequential, at, scans = None, False, 2, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Broken("no end of image")
        marker = data[at + 1]
        if marker in (0, 1, 0xFF) or 0xD0 <= marker <= 0xD7:
            at += 1 + (marker != 0xFF)
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                if wide > 2 or len(body) < 1 + 64 * wide:
                    raise Broken("a quantisation table of the wrong length")
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            sequential = marker != 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] not in (1, 3) or not height or not width:
                raise Broken("only 8 bits, one or three components and a stated size are read")
            parts = {body[6 + 3 * k]: _Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            hmax, vmax = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            if -(-width // 8) * -(-height // 8) > 8 * len(data):  # a block has a bit at least
                raise Broken("a size that the data cannot fill")
            for p in parts.values():
                p.size(width, height, hmax, vmax)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Broken("lossless, hierarchical and arithmetic coding are not read")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if not parts:
                raise Broken("a scan before its frame")
            n = body[0]
            used = [(parts[body[1 + 2 * k]], codes.get((0, body[2 + 2 * k] >> 4)), codes.get((1, body[2 + 2 * k] & 15))) for k in range(n)]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise Broken("no end of image")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            first, last = (0, 0) if sequential else (body[1 + 2 * n], body[2 + 2 * n])
            if last > 63 or first > last or (first == 0 and last) or (first and n != 1):
                raise Broken("a band that no scan may have")
            units = (-(-width // (8 * hmax)), -(-height // (8 * vmax)))
            _scan(data[at:end], used, first, last, 0 if sequential else body[3 + 2 * n] >> 4, 0 if sequential else body[3 + 2 * n] & 15, restart, units, sequential)
            at, scans = end, scans + 1
    if not scans:
        raise Broken("no scan")
    planes = []
    for p in parts.values():
        blocks = np.zeros((p.down * p.across, 64))
        blocks[:, ZIGZAG] = np.array(p.coefficients, np.int64).reshape(-1, 64) * tables[p.table]
        pixels = _COSINES.T @ blocks.reshape(-1, 8, 8) @ _COSINES
        plane = pixels.reshape(p.down, p.across, 8, 8).swapaxes(1, 2).reshape(8 * p.down, 8 * p.across) + 128
        y = np.arange(height) * p.v // vmax  # chroma is repeated to the full resolution
        x = np.arange(width) * p.h // hmax
        planes.append(np.clip(np.rint(plane), 0, 255)[y[:, None], x[None, :]])
    if len(planes) == 1:
        planes *= 3
    elif adobe != 0:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def decode_column(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """The id column, ``height``, ``width``, ``rgb`` and ``error`` of every row's image.

    ``rgb`` holds height x width x 3 bytes, by row, column and colour. A null image gives null in all
    four; bytes that cannot be read give the reason in ``error`` and null in the rest. Null ids and
    repeated rows are kept. Other columns are ignored.
    """
    schema = T.StructType([media.schema[id_column], T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])

    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            begin = size = 0

            def done(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = list(zip(*rows)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(rows)), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=schema.names)

            for data in batch.column(1):
                if not data.is_valid:
                    rows.append((None, None, None, None))
                else:
                    try:
                        image = decode(data.as_py())
                        rows.append((*image.shape[:2], image.tobytes(), None))
                        size += image.size
                    except Broken as error:
                        rows.append((None, None, None, str(error)))
                if size > SENT_BYTES:
                    yield done()
                    begin, size = begin + len(rows), 0
                    rows = []
            yield done()

    return media.select(id_column, media_column).mapInArrow(apply, schema)


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and broken bytes as :func:`decode_column` says. Every embedding drawn as a progressive JPEG (the tables hold no images), then decoded."""
    from tabulon.llm.jpeg_fixture import drawn

    return decode_column(drawn(shared.load(spark, sf_dir, "embeddings")), "vec_id", "media")
