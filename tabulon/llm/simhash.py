"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import kernels as K
from tabulon.llm import shared
from tabulon.llm.components import components

#: Bits that the tables cover, and as many more of another hash that candidates are checked by.
BITS = 128
#: Parts that a signature is cut into, and the distance that a part's masks cover.
PARTS, PART_RADIUS = 4, 4
#: Two signatures this close are near-duplicates: pigeonholes leave one part within PART_RADIUS.
RADIUS = PARTS * (PART_RADIUS + 1) - 1
#: And over both halves they must be this close: short texts with the same few common words then stay apart.
BOTH_RADIUS = 40
#: Signatures of a bucket that are compared in one task; a larger bucket is split into blocks, and blocks meet by twos.
BUCKET_ROWS = 200_000
#: From so many signatures on a bucket is compared around pivots, not pair by pair.
PIVOT_ROWS = 256

_WORDS_AT_ONCE = 1 << 14
#: Columns of a signature: the covered words, then the others.
_NAMES = ("low", "high", "check0", "check1")
_SALTS = np.array([0, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1.0).astype(np.float64)


def _sums(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights for less those against each bit, by row; ``row`` ascends. Sums of whole numbers, so both ways agree."""
    words = len(_SALTS)
    every = [h if not salt else K.mix(h + salt) for salt in _SALTS]
    sums = np.zeros((n, 64 * words), np.int64)
    if len(h) >= 128 * n:  # many words a row: weights by value of each byte, then one product
        for k, one in enumerate(every):
            for byte in range(8):
                value = (one >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)
                by_value = np.bincount(row * 256 + value, weight, 256 * n).reshape(n, 256)
                at = 64 * k + 8 * byte
                sums[:, at : at + 8] = np.rint(by_value @ _SIGNS)
        return sums
    for a in range(0, len(h), _WORDS_AT_ONCE):
        part = slice(a, a + _WORDS_AT_ONCE)
        both = np.stack([one[part] for one in every], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").astype(np.int32)
        bits *= 2
        bits -= 1
        bits *= weight[part, None]
        first = np.flatnonzero(np.diff(row[part], prepend=-1))
        sums[row[part][first]] += np.add.reduceat(bits, first, axis=0)
    return sums


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """256-bit SimHash of each row (n x 4 words, the covered two first), and whether the row has a word.

    A distinct word weighs the root of its count, in 16ths and rounded, so sums are exact and equal
    bags of words have equal signatures. A bit is set where the weights for it exceed those against.
    """
    n = len(column)
    h, row = K.hashed_words(column)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, row = h[at], row[at]
    weight = np.rint(16 * np.sqrt(count)).astype(np.int32)
    packed = np.packbits(_sums(h, row, weight, n) > 0, axis=1, bitorder="little").view(np.uint64) if n else np.zeros((0, len(_SALTS)), np.uint64)
    return packed, np.bincount(row, minlength=n) > 0


def masks(bits: int = BITS // PARTS, radius: int = PART_RADIUS, seed: int = 7) -> np.ndarray:
    """2**(radius+1) - 1 masks such that any ``radius`` bits are all left out by one of them at least.

    Each bit gets a non-zero vector of radius+1 bits; a mask is a non-zero vector and keeps the bits
    whose vectors have an odd product with it. The vectors of ``radius`` bits leave a direction free.
    """
    some = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, some), bits)
    np.random.default_rng(seed).shuffle(vectors)
    product = np.bitwise_count(np.arange(1, some)[:, None] & vectors[None, :]) & 1
    return (product.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def costs(n: int, parts: int = PARTS, part_radius: int = PART_RADIUS) -> dict[str, float]:
    """What ``n`` distinct signatures cost with these parameters, for choosing them.

    ``radius`` that is covered, ``tables`` (so many copies of a signature are sent), ``key_bits`` that
    a table keeps on average, and ``comparisons`` of unrelated signatures in all tables. Comparisons
    grow with the square of n, so a larger corpus wants fewer parts: more key bits, at more tables for
    the same radius or a smaller radius for as many.
    """
    tables, bits = parts * ((2 << part_radius) - 1), BITS // parts * (1 << part_radius) / ((2 << part_radius) - 1)
    return {"radius": parts * (part_radius + 1) - 1, "tables": tables, "key_bits": bits, "comparisons": tables * n * n / 2 ** (bits + 1)}


def buckets(high: np.ndarray, low: np.ndarray, parts: int = PARTS, part_radius: int = PART_RADIUS) -> Iterator[np.ndarray]:
    """The bucket of every signature in one table after the other: a hash of the table's number and the kept bits.

    Two buckets of one hash are compared as one, which costs time and finds nothing less.
    """
    width = BITS // parts
    every, mask = masks(width, part_radius), np.uint64((1 << width) - 1)
    for part in range(parts):
        word = (low, high)[part * width // 64] >> np.uint64(part * width % 64) & mask
        for k, m in enumerate(every):
            yield K.mix((word & m) ^ np.uint64((part * len(every) + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def _apart(words: list[np.ndarray], i, j) -> tuple[np.ndarray, np.ndarray]:
    """Distances over the covered words and over all."""
    covered = np.bitwise_count(words[0][i] ^ words[0][j]).astype(np.int16) + np.bitwise_count(words[1][i] ^ words[1][j])
    return covered, covered + sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in words[2:])


def _middle(words: list[np.ndarray], rows: np.ndarray) -> int:
    """The row nearest to the bits that most of the rows have."""
    most = [np.packbits(sum(np.unpackbits(w[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(rows, -(-len(rows) // 65_536))) * 2 > len(rows), bitorder="little").view(np.uint64)[0] for w in words]
    return int(rows[np.argmin(sum(np.bitwise_count(w[rows] ^ m).astype(np.int16) for w, m in zip(words, most)))])


def around_pivots(words: list[np.ndarray], radius: int, both_radius: int) -> tuple[list[int], list[int], np.ndarray]:
    """Edges that connect copies of one text in one bucket without comparing them with each other, and the rows that are left.

    A pivot is linked to all signatures near it, which then leave. Of the rest only those within twice
    the radius of the pivot can be near one that left (the triangle's rule); they are compared with
    them unless they are connected already. So it goes on while pivots have many near them. With the
    pairs of the rows that are left, the edges connect what all pairs of the bucket connect.
    """
    root = np.arange(len(words[0]))
    a: list[int] = []
    b: list[int] = []
    rest = np.arange(len(root))

    def seen_from(pivot: int) -> tuple[int, np.ndarray, np.ndarray]:
        covered, both = _apart(words, pivot, rest)
        return pivot, covered, (covered <= radius) & (both <= both_radius)

    while len(rest) > 1:
        many = min(256, -(-len(rest) // 8))
        pivot, covered, near = seen_from(_middle(words, rest))
        if near.sum() < many and len(rest) >= 4096:  # no cluster leads; look from some rows
            pivot, covered, near = max((seen_from(int(rest[k])) for k in np.linspace(0, len(rest) - 1, 16).astype(int)), key=lambda seen: int(seen[2].sum()))
        if near.sum() < many:
            break
        members, distance = rest[near], covered[near]
        others = members[root[members] != root[pivot]]
        roots, first = np.unique(root[others], return_index=True)
        a += [pivot] * len(roots)  # one edge for each component that joins
        b += others[first].tolist()
        root[np.isin(root, roots)] = root[pivot]
        order = np.argsort(-distance, kind="stable")  # the farthest are the likeliest to be near what is farther
        members, distance = members[order], distance[order]
        close = ~near & (covered <= 2 * radius)
        for x, d in zip(rest[close].tolist(), covered[close].tolist()):
            if root[x] == root[pivot]:
                continue
            some = int(np.searchsorted(-distance, radius - d, side="right"))  # distance >= d - radius
            for at in range(0, some, 8192):
                part = members[at : min(some, at + 8192)]
                c, e = _apart(words, x, part)
                hit = np.flatnonzero((c <= radius) & (e <= both_radius))
                if len(hit):
                    a.append(x)
                    b.append(int(part[hit[0]]))
                    root[root == root[x]] = root[pivot]
                    break
        rest = rest[~near]
    return a, b, rest


def forest(bucket: np.ndarray, words: list[np.ndarray], radius: int = RADIUS, both_radius: int = BOTH_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, in each bucket, whatever its pairs connect that are within ``radius`` and, over all words, ``both_radius``.

    All pairs of a small bucket are compared, those of a large one around pivots, with the same
    components. Rows must be sorted by bucket.
    """
    n = len(bucket)
    root = np.arange(n)
    a, b, left = [], [], [np.arange(n)]
    begin = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ 1)) if n else np.zeros(0, np.int64)
    size = np.diff(begin, append=n)
    if (size >= PIVOT_ROWS).any():
        small = np.repeat(size < PIVOT_ROWS, size)
        left = [np.flatnonzero(small)]
        for at, m in zip(begin[size >= PIVOT_ROWS].tolist(), size[size >= PIVOT_ROWS].tolist()):
            x, y, rest = around_pivots([w[at : at + m] for w in words], radius, both_radius)
            a += [at + min(p, q) for p, q in zip(x, y)]
            b += [at + max(p, q) for p, q in zip(x, y)]
            left.append(at + rest)
    row = np.sort(np.concatenate(left))
    stop = np.searchsorted(bucket[row], bucket[row], side="right")
    k, step = np.arange(len(row)), 1
    while True:
        k = k[k + step < stop[k]]
        if not len(k):
            break
        i, j = row[k], row[k + step]
        covered = np.bitwise_count(words[0][i] ^ words[0][j]) + np.bitwise_count(words[1][i] ^ words[1][j])
        near = np.flatnonzero(covered <= radius)
        x, y = i[near], j[near]
        rest = sum((np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words[2:]), covered[near].astype(np.int64))
        x, y = x[rest <= both_radius], y[rest <= both_radius]
        apart = root[x] != root[y]
        merged = False
        for p, q in zip(x[apart].tolist(), y[apart].tolist()):
            rp, rq = p, q
            while root[rp] != rp:
                rp = root[rp]
            while root[rq] != rq:
                rq = root[rq]
            if rp != rq:
                root[max(rp, rq)] = min(rp, rq)
                a.append(p)
                b.append(q)
                merged = True
        while merged:
            up = root[root]
            merged = not np.array_equal(up, root)
            root = up
        step += 1
    return np.array(a, np.int64), np.array(b, np.int64)


def _large_buckets(nodes: DataFrame, n: int, rows: int, parts: int, part_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of over ``rows`` signatures, sorted, and the blocks that each is split into.

    A partition reports a bucket that has a quarter of what its share would be in one so large, so
    little is sent and three quarters of a large bucket are counted at least. There are at most
    4 / 3 * tables * n / rows of them, two numbers each.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(batches, pa.schema([("low", pa.int64()), ("high", pa.int64())]))
        low, high = (own[c].to_numpy().view(np.uint64) for c in ("low", "high"))
        least = max(2, -(-rows * len(low) // (4 * n)))
        for bucket in buckets(high, low, parts, part_radius) if len(low) >= least else ():
            found, count = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[count >= least]), pa.array(count[count >= least])], names=["bucket", "n"])

    if n <= rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = nodes.select("low", "high").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > rows * 3 // 4).toArrow().sort_by("bucket")
    return found["bucket"].to_numpy(), -(-4 * 2 * found["n"].to_numpy() // (3 * rows))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", work: shared.Workspace | None = None,
    parts: int = PARTS, part_radius: int = PART_RADIUS, both_radius: int = BOTH_RADIUS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Groups of documents whose signatures are linked by distances of at most the radius and ``both_radius`` bits.

    The radius is parts * (part_radius + 1) - 1; ``parts`` is 2, 4, 8 or 16, and :func:`costs` says
    what they cost. Result, one row per input row: the id column, ``digest`` (xxhash64 of the text),
    ``keeper`` (id of the group's first document by id, null ids last), ``group_size`` and ``kept``
    (this row is that document; of repeated rows one is). A text without words (null, empty, signs
    only) is alone in its group. Other columns are ignored. Every pair within the radius is found, as
    some table puts both in one bucket and buckets are compared in full; it is linked if the whole 256
    bits agree. A bucket of over ``bucket_rows`` signatures is compared in several tasks.
    """
    if parts not in (2, 4, 8, 16) or part_radius < 1:
        raise ValueError("parts must be 2, 4, 8 or 16, and the radius of a part 1 at least")
    radius = parts * (part_radius + 1) - 1
    work = work or shared.Workspace(spark, "simhash")
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.LongType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.LongType()) for c in _NAMES], T.StructField("worded", T.BooleanType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            parts = [signatures(part) for part in K.slices(K.strings(batch.column(2)))]
            word = np.concatenate([w for w, _ in parts]).astype(np.int64)
            n = len(word)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(row + np.arange(n)), *[pa.array(np.ascontiguousarray(word[:, k])) for k in range(len(_NAMES))], pa.array(np.concatenate([w for _, w in parts]))], names=schema.names)
            row += n

    source = docs.select(docs[id_column].alias("id"), F.xxhash64(docs[text_column]).alias("digest"), docs[text_column].alias("text"))
    signed = work.table(source.mapInArrow(sign, schema), "signatures")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    distinct = signed.where("worded").groupBy(*_NAMES).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("size"), F.min(first).alias("first"))
    nodes = work.table(distinct, "nodes")
    n = nodes.count()
    large, blocks = _large_buckets(nodes, n, bucket_rows, parts, part_radius)
    split = spark.sparkContext.broadcast((large, blocks))
    spread = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", *_NAMES, "node")])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, blocks = split.value
        for batch in batches:
            columns = [batch.column(c) for c in (*_NAMES, "node")]
            own = K.mix(batch.column("node").to_numpy().view(np.uint64) + np.uint64(1))
            for bucket in buckets(batch.column("high").to_numpy().view(np.uint64), batch.column("low").to_numpy().view(np.uint64), parts, part_radius):
                if len(large):
                    at = np.minimum(np.searchsorted(large, bucket), len(large) - 1)
                    several = np.where(large[at] == bucket, blocks[at], 1)
                    for k in np.flatnonzero(several > 2).tolist():  # its block with each other one
                        s = int(several[k])
                        block = int(own[k] % np.uint64(s))
                        other = np.delete(np.arange(s), block)
                        both = np.minimum(block, other) * s + np.maximum(block, other) + 1
                        keys = K.mix(bucket[k : k + 1].view(np.uint64) + both.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), *[c.take(pa.array(np.full(s - 1, k))) for c in columns]], names=spread.names)
                    alone = pa.array(np.flatnonzero(several <= 2))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket).take(alone), *[c.take(alone) for c in columns]], names=spread.names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], names=spread.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(batches, pa.schema([(c, pa.int64()) for c in spread.names]))
        order = np.argsort(every["bucket"].to_numpy(), kind="stable")
        node = every["node"].to_numpy()[order]
        a, b = forest(every["bucket"].to_numpy()[order], [every[c].to_numpy()[order].view(np.uint64) for c in _NAMES], radius, both_radius)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    copies = n * parts * len(masks(BITS // parts, part_radius)) + int(blocks.sum()) * bucket_rows
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-copies // 1_000_000))
    edges = nodes.select(*_NAMES, "node").mapInArrow(scatter, spread).repartition(partitions, "bucket").mapInArrow(compare, "u bigint, v bigint")
    roots = components(edges, work)
    # Sizes and keepers are added up by signature, then by group, so that no group is gathered anywhere.
    rooted = nodes.join(roots, nodes["node"] == roots["u"], "left").select(*_NAMES, F.coalesce("v", "node").alias("group"), "size", "first")
    groups = rooted.groupBy("group").agg(F.sum("size").alias("group_size"), F.min("first").alias("keeps"))
    verdicts = rooted.select(*_NAMES, "group").join(groups, "group").drop("group").withColumn("worded", F.lit(True))
    found = signed.join(verdicts, [*_NAMES, "worded"], "left")
    keeper = F.when(F.col("worded"), F.col("keeps.id")).otherwise(F.col("id"))
    kept = F.when(F.col("worded"), F.col("keeps.row") == F.col("row")).otherwise(True)
    return found.select(F.col("id").alias(id_column), "digest", keeper.alias("keeper"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), kept.alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pipeline stage: the first document of each group, with the columns it came with.

    Documents without words (null, empty, signs only) all stay. Of repeated rows, and of rows that
    share id and text, one stays; null ids come last among a group's. An empty table stays empty.
    """
    work = shared.Workspace(spark, "dedup")
    found = work.table(near_duplicates(spark, docs, id_column, text_column), "verdicts")
    per = found.groupBy(F.col(id_column).alias("v_id"), F.col("digest").alias("v_digest")).agg(F.count(F.lit(1)).alias("v_rows"), F.sum(F.col("kept").cast("int")).alias("v_kept"))
    less = work.table(per.where("v_kept < v_rows"), "less")
    same = docs[id_column].eqNullSafe(less["v_id"]) & F.xxhash64(docs[text_column]).eqNullSafe(less["v_digest"])
    out = docs.join(less.hint("shuffle_hash"), same, "left_anti")
    if not less.where("v_kept > 0").isEmpty():  # rows repeated with id and text: one of them stays
        some = less.where("v_kept > 0")
        same = docs[id_column].eqNullSafe(some["v_id"]) & F.xxhash64(docs[text_column]).eqNullSafe(some["v_digest"])
        once = docs.join(some, same, "left_semi")
        out = out.unionAll(once.dropDuplicates([id_column, text_column]))
    return out


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document; nulls, ties and repeated rows as :func:`near_duplicates` says."""
    return near_duplicates(spark, shared.load(spark, sf_dir, "documents")).drop("digest")
