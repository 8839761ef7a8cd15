"""Operator 7: BPE encoding that encodes content-defined chunks once, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import bpe, shared
from tabulon.llm import kernels as K

#: A cut falls on average after so many bytes, a power of two, and never within so many of the last.
AVERAGE, LEAST = 1024, 128
#: Bytes of tokens that a task gathers before it sends them on.
SENT_BYTES = 4 << 20
#: Bits (as a power of two) of the filter of chunks that occur again: 16 MB, whatever the input.
FILTER_BITS = 27
#: Chunks that a task remembers to have sent.
REMEMBERED = 200_000

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks start; every non-empty row starts one.

    A cut depends on the 32 bytes before it and on the last cut of its row alone, so equal passages
    are cut alike soon after their start, wherever they stand.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    at = np.flatnonzero(h >> np.uint32(32 - (AVERAGE.bit_length() - 1)) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    row = np.searchsorted(offsets, at, side="right") - 1
    last, now, kept = 0, -1, []
    for position, r, begin in zip(at.tolist(), row.tolist(), offsets[row].tolist()):
        if r != now:
            last, now = begin, r
        if position - last >= LEAST:
            kept.append(position)
            last = position
    return np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], np.array(kept, np.int64)]))


def _contents(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a slice's chunks, chunks before each row, and the chunks' 64-bit digests."""
    from xxhash import xxh3_64_intdigest as digest

    data, offsets = K.utf8(part)
    starts, raw = cuts(data, offsets), memoryview(data.tobytes())
    edges = [*starts.tolist(), len(raw)]
    digests = np.fromiter((digest(raw[a:b]) for a, b in zip(edges, edges[1:])), np.uint64, len(starts))
    return starts, np.searchsorted(starts, offsets), digests


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(bpe.PATTERN)


Chunk = tuple[np.ndarray, int, int]  # tokens, and tokens and bytes that following text may change


def _head(encoder: bpe.Encoder, ids: np.ndarray, size: int) -> tuple[str, bool]:
    """The first ``size`` tokens' text up to the last whole character, and whether that is all."""
    raw = b"".join([encoder.by_rank[t] for t in ids[:size].tolist()])
    return raw.decode("utf-8", "ignore"), size >= len(ids)


def join(encoder: bpe.Encoder, chunks: list[Chunk]) -> np.ndarray:
    """Tokens of the text whose chunks these are, equal to encoding it whole.

    ``open_text`` is the text from the last certain piece on. At each join it is split anew together
    with more and more of the next chunk, until a piece starts where the chunk's own first pieces
    have one: from there on the chunk's tokens hold, up to what its own end leaves open.
    """
    if len(chunks) == 1:
        return chunks[0][0]
    split = _pattern()
    out: list[np.ndarray] = []
    open_text = ""
    for k, (ids, tail_tokens, tail_bytes) in enumerate(chunks):
        tail = b"".join([encoder.by_rank[t] for t in ids[len(ids) - tail_tokens :].tolist()]).decode()
        if k == 0:
            out.append(ids[: len(ids) - tail_tokens])
            open_text = tail
            continue
        size, agreed = 16, False
        while not agreed:
            head, whole = _head(encoder, ids, size)
            both = open_text + head
            certain = len(both) - 2
            own = {m.start() + len(open_text) for m in split.finditer(head)}
            pieces: list[str] = []
            for m in split.finditer(both):
                q = m.start()
                if q > certain:
                    break
                if q >= len(open_text) and q in own:
                    agreed = True
                    break
                pieces.append(m.group())
            if agreed or whole:
                break
            size *= 4
        if not agreed:
            open_text = both
            continue
        out.append(np.array([t for p in pieces for t in encoder.piece(p)], encoder.dtype))
        skip_bytes = len(head[: q - len(open_text)].encode())
        skip = 0
        while skip_bytes > 0:
            skip_bytes -= len(encoder.by_rank[ids[skip]])
            skip += 1
        stop = len(ids) - tail_tokens
        if skip <= stop:
            out.append(ids[skip:stop])
            open_text = tail
        else:
            open_text = b"".join([encoder.by_rank[t] for t in ids[skip:].tolist()]).decode()
    out.append(np.array([t for m in split.finditer(open_text) for t in encoder.piece(m.group())], encoder.dtype))
    return np.concatenate(out)


def _filter(tallied: DataFrame, bits: int) -> np.ndarray:
    """A bit for the digests of chunks that occur again. What doesn't may have its bit set too; then a text goes by its chunks for nothing."""
    again = tallied.where("n > 1").select(F.shiftrightunsigned("digest", 64 - bits + 6).alias("word"), F.shiftrightunsigned("digest", 64 - bits).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = again.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text", filter_bits: int = FILTER_BITS, work: shared.Workspace | None = None) -> DataFrame:
    """Token ids of every document; a chunk that many documents share is encoded once.

    A first pass counts chunks by 64-bit digest and sets a bit for each that occurs again in a filter
    of 2 ** ``filter_bits`` bits, of one size for any input. Texts with no such chunk are encoded
    where they lie. The others' chunks are joined by their content's 128-bit digest to the tokens of
    each distinct one, encoded once, and a document's chunks are then joined to its text's tokens.
    The joins are Spark's own, so partitions spill and hot chunks are split as adaptive execution
    sees fit. A fuller filter sends more texts by their chunks, with the same result.

    Result: the id column, ``n_tokens``, ``tokens`` (little-endian unsigned integers, 16-bit if the
    vocabulary fits, else 32-bit) and ``n_bytes`` (of the decoded text); a row for every input row.
    Null texts give null in all three, empty ones no tokens. Null ids and repeated rows are kept.
    Other columns are ignored. What is known of one document's chunks is held in memory at once.
    """
    import xxhash  # noqa: F401 - fails here rather than in the tasks
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_column].dataType
    id_type = to_arrow_type(kind)
    work = work or shared.Workspace(spark, "chunks")
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("n_bytes", T.LongType())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(K.strings(batch.column(0))):
                found, n = np.unique(_contents(part)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["digest", "n"])

    source = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    tallied = source.select("text").mapInArrow(tally, "digest bigint, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    again = spark.sparkContext.broadcast(_filter(tallied, filter_bits))

    def by_chunks(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of a slice's chunks, chunks before each row, and whether a row goes by its chunks."""
        starts, first, digests = _contents(part)
        word, bit = digests >> np.uint64(64 - filter_bits + 6), digests >> np.uint64(64 - filter_bits) & np.uint64(63)
        hit = np.concatenate([[0], np.cumsum((again.value[word] >> bit & np.uint64(1)).astype(np.int64))])
        return starts, first, hit[first[1:]] > hit[first[:-1]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            before = 0
            for part in K.slices(K.strings(batch.column(1))):
                rows = np.flatnonzero(~by_chunks(part)[2])
                ids, offsets = encoder.encode(part.take(pa.array(rows)))
                edges = (offsets * encoder.dtype.itemsize).tolist()
                raw, at = ids.tobytes(), pa.array(before + rows)
                null = batch.column(1).take(at).is_null().to_numpy(zero_copy_only=False)
                sizes = np.concatenate([[0], np.cumsum(encoder.token_lengths[ids])])[offsets]
                tokens = pa.array([None if none else raw[a:b] for none, a, b in zip(null, edges[:-1], edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.diff(offsets), mask=null), tokens, pa.array(np.diff(sizes), mask=null)], names=schema.names)
                before += len(part)

    pieces = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("digest", T.BinaryType()), T.StructField("content", T.StringType())])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text that goes by its chunks, with their digests, and one for each chunk that the task hasn't sent."""
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest as digest

        row, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            before = 0
            for part in K.slices(K.strings(batch.column(1))):
                data, offsets = K.utf8(part)
                raw = data.tobytes()
                starts, first, chosen = by_chunks(part)
                edges, first = [*starts.tolist(), len(raw)], first.tolist()
                rows, lists, new = np.flatnonzero(chosen), [], {}
                for k in rows.tolist():
                    own = []
                    for c in range(first[k], first[k + 1]):
                        content = raw[edges[c] : edges[c + 1]]
                        of = digest(content)
                        own.append(of)
                        if of not in seen:
                            new[of] = content
                            seen.add(of)
                    lists.append(own)
                if len(seen) > REMEMBERED:
                    seen = set()
                n, m = len(rows), len(new)
                ids = pa.concat_arrays([batch.column(0).take(pa.array(before + rows)).cast(id_type), pa.nulls(m, id_type)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([*range(row, row + n), *[None] * m], pa.int64()), ids, pa.array([*lists, *[None] * m], pa.list_(pa.binary())),
                    pa.array([*[None] * n, *new], pa.binary()), pa.array([*[None] * n, *new.values()], pa.binary()).cast(pa.string()),
                ], names=pieces.names)
                row, before = row + n, before + len(part)

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets, tail_tokens, tail_bytes = encoder.encode_open(K.strings(batch.column(1)))
            raw, edges = ids.tobytes(), (offsets * encoder.dtype.itemsize).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary()), pa.array(tail_tokens), pa.array(tail_bytes)], names=["digest", "tokens", "tail_tokens", "tail_bytes"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            every, ends = batch.column(1).values, batch.column(1).offsets.to_pylist()
            place, tails, sizes = every.field("place").to_numpy(), every.field("tail_tokens").to_pylist(), every.field("tail_bytes").to_pylist()
            tokens = every.field("tokens")
            rows: list[list] = [[], [], []]
            begin = size = 0

            def done(stop: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.binary(), pa.int64()))]
                for c in rows:
                    c.clear()
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), *columns], names=schema.names)

            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                order = (a + np.argsort(place[a:b])).tolist()
                joined = join(encoder, [(np.frombuffer(tokens[c].as_py(), encoder.dtype), tails[c], sizes[c]) for c in order])
                rows[0].append(len(joined))
                rows[1].append(joined.tobytes())
                rows[2].append(int(encoder.token_lengths[joined].sum()))
                size += len(rows[1][-1])
                if size > SENT_BYTES:
                    yield done(k + 1)
                    begin, size = k + 1, 0
            yield done(batch.num_rows)

    sent = work.table(source.mapInArrow(chunk, pieces), "pieces")
    once = sent.where("digest is not null").groupBy("digest").agg(F.first("content").alias("content"))
    encoded = once.mapInArrow(encode_once, "digest binary, tokens binary, tail_tokens bigint, tail_bytes bigint")
    refs = sent.where("row is not null").select("row", "id", F.posexplode("digests").alias("place", "digest"))
    parts = refs.join(encoded, "digest").groupBy("row").agg(F.first("id").alias("id"), F.collect_list(F.struct("place", "tokens", "tail_tokens", "tail_bytes")).alias("parts"))
    return source.mapInArrow(whole, schema).unionAll(parts.select("id", "parts").mapInArrow(assemble, schema))


def decode(encoded: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """The id column and ``text`` of rows whose ``tokens`` :func:`encode` made; null tokens give null.

    Bytes that are no UTF-8 (tokens cut within a character) are replaced by U+FFFD.
    """
    schema = T.StructType([encoded.schema[id_column], T.StructField("text", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            raw = [None if t is None else np.frombuffer(t, encoder.dtype) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.zeros(0, encoder.dtype), *[r for r in raw if r is not None]])
            offsets = np.cumsum([0, *[0 if r is None else len(r) for r in raw]])
            data, ends = encoder.decode(flat, offsets)
            data = data.tobytes()
            text = [None if r is None else data[a:b].decode("utf-8", "replace") for r, a, b in zip(raw, ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=schema.names)

    return encoded.select(id_column, "tokens").mapInArrow(apply, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document; nulls, empty texts and repeated rows as :func:`encode` says."""
    return encode(spark, shared.load(spark, sf_dir, "documents"))
