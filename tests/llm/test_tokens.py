"""Operators 1, 7 and 9 against the library's own encoding."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import bpe, chunk_reuse, shared, token_counts, token_files

PARTS = st.sampled_from(["'s", "'t", "'re", "'ll", "'", "s", "l", "don", " ", "  ", "\n", "\t", "　", "\x85", "1", "²", "é", "ß", "!", "?!", "漢", "😀", "A", "\r\n", "\x1c", "word "])
TEXT = st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=30).map("".join))


@given(st.lists(st.one_of(TEXT, st.none()), max_size=8))
@settings(max_examples=300, deadline=None)
def test_batches_encode_as_the_library(texts):
    encoder = bpe.encoder()
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    column = pa.array(texts, pa.string())
    ids, offsets = encoder.encode(column)
    want = [encoder.plain(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert encoder.count(column).tolist() == [len(w) for w in want]
    data, ends = encoder.decode(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == [t or "" for t in texts]


@given(TEXT, st.lists(st.integers(1, 60), max_size=6))
@settings(max_examples=500, deadline=None)
def test_joins_of_chunks_are_repaired(text, at):
    encoder = bpe.encoder()
    text = text.encode("utf-8", "ignore").decode()
    if not text:
        return
    edges = [0, *sorted({a for a in at if a < len(text)}), len(text)]
    parts = [text[a:b] for a, b in zip(edges, edges[1:])]
    ids, offsets, tokens, size = encoder.encode_open(pa.array(parts))
    chunks = [(ids[offsets[k] : offsets[k + 1]], int(tokens[k]), int(size[k])) for k in range(len(parts))]
    assert chunk_reuse.join(encoder, chunks).tolist() == encoder.plain(text)


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 20_000, dtype=np.uint8)
    a, b = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), passage]), passage
    one = {int(x) - 777 for x in chunk_reuse.cuts(a, np.array([0, len(a)]))}
    two = {int(x) for x in chunk_reuse.cuts(b, np.array([0, len(b)]))}
    assert len(one & two) >= len(two) - 2
    same = np.full(5000, 97, np.uint8)
    assert np.diff(chunk_reuse.cuts(same, np.array([0, 5000]))).min(initial=10_000) >= chunk_reuse.LEAST


def _expected(frame):
    encoder = bpe.encoder()
    return Counter((r.doc_id, None if r.text is None else tuple(encoder.plain(r.text))) for r in frame.select("doc_id", "text").collect())


@pytest.mark.parametrize("bits", [chunk_reuse.FILTER_BITS, 7])
def test_chunk_reuse_is_exact(spark, awkward, bits):
    """With the filter nearly empty and with one so small that nearly all texts go by their chunks."""
    made = chunk_reuse.encode(spark, awkward, filter_bits=bits)
    rows = made.collect()
    got = Counter((r.doc_id, None if r.tokens is None else tuple(np.frombuffer(bytes(r.tokens), "<u2").tolist())) for r in rows)
    assert got == _expected(awkward)
    assert all(r.tokens is None or r.n_tokens == len(r.tokens) // 2 for r in rows)
    back = Counter((r.doc_id, r.text) for r in chunk_reuse.decode(made).collect())
    assert back == Counter((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect())


def test_chunk_reuse_of_documents(spark, documents):
    got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.tokens), "<u2").tolist())) for r in chunk_reuse.encode(spark, documents).collect())
    assert got == _expected(documents)


def test_a_chunk_in_all_documents(spark):
    """One long passage in every document, and more chunks than a task remembers."""
    from tests.llm.conftest import words

    passage = words(5, 900)
    rows = [(k, f"{words(k, k % 7)} {passage} {words(-k, 300)}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    before, chunk_reuse.REMEMBERED = chunk_reuse.REMEMBERED, 5
    try:
        got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.tokens), "<u2").tolist())) for r in chunk_reuse.encode(spark, frame).collect())
    finally:
        chunk_reuse.REMEMBERED = before
    assert got == _expected(frame)


def test_filter_holds_what_occurs_again(spark):
    digests = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 500)
    frame = spark.createDataFrame([(int(d), 1 + k % 2) for k, d in enumerate(digests)], "digest bigint, n bigint")
    words = chunk_reuse._filter(frame, 20)
    own = digests.view(np.uint64)
    bit = words[own >> np.uint64(50)] >> (own >> np.uint64(44) & np.uint64(63)) & np.uint64(1)
    assert bit[1::2].all() and bit[::2].sum() < 5


def test_token_files(spark, awkward):
    work = shared.Workspace(spark, "files")
    rows = token_files.write_token_files(spark, awkward, work=work).collect()
    files, encoder = token_files.TokenFiles(work.path), bpe.encoder()
    got = Counter((r.doc_id, tuple(files.read(r.token_offset, r.n_tokens).tolist())) for r in rows)
    assert got == Counter((r.doc_id, tuple(encoder.plain(r.text or ""))) for r in awkward.select("doc_id", "text").collect())
    spans = sorted((r.token_offset, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    for name in files.shards:
        own = sorted((r.shard_offset, r.n_tokens) for r in rows if r.shard == name)
        assert files.offsets(name).tolist() == [0, *np.cumsum([n for _, n in own]).tolist()]


def test_token_counts_use_the_cache(spark, awkward, tmp_path):
    cache = f"file://{tmp_path}/cache"
    encoder = bpe.encoder()
    want = Counter((r.doc_id, len(encoder.plain((r.text or "").replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n")))) for r in awkward.select("doc_id", "text").collect())
    first = token_counts.count_tokens(spark, awkward.where("doc_id < 9"), cache).count()
    stored = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(spark, awkward, cache)
    assert first == awkward.where("doc_id < 9").count()
    assert Counter((r.doc_id, r.n_tokens) for r in again.collect()) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == again.select("digest").distinct().count() > stored
    # A digest that is there is not encoded again: a planted count comes back.
    planted = f"file://{tmp_path}/planted"
    digests = awkward.select(token_counts.F.unhex(token_counts.F.sha2(token_counts.normalised(awkward["text"]), 256)).alias("digest")).distinct()
    digests.selectExpr("digest", "cast(-7 as bigint) n_tokens").write.parquet(f"{planted}/version={token_counts.version(bpe.DEFAULT_VOCABULARY)}")
    assert {r.n_tokens for r in token_counts.count_tokens(spark, awkward, planted).collect()} == {-7}


def test_a_warm_cache_encodes_nothing(spark, documents, tmp_path, monkeypatch):
    cache = f"{tmp_path}/cache"  # without a scheme
    first = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(spark, documents, cache).collect()}
    files = sorted(tmp_path.rglob("*.parquet"))
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(spark, documents, cache).collect()} == first
    assert sorted(tmp_path.rglob("*.parquet")) == files
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == documents.select("text").distinct().count()


def test_rows_in_another_order_at_the_second_scan(spark, documents, tmp_path):
    """Places that don't hold are noticed, and what they left out is counted all the same."""
    real = token_counts.F.monotonically_increasing_id
    docs = documents.select("doc_id", "text").repartition(3, "doc_id")
    try:
        token_counts.F.monotonically_increasing_id = lambda: token_counts.F.floor(token_counts.F.rand() * (1 << 20)).cast("bigint")
        rows = token_counts.count_tokens(spark, docs, f"file://{tmp_path}/odd").collect()
    finally:
        token_counts.F.monotonically_increasing_id = real
    encoder = bpe.encoder()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(encoder.plain(r.text.replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n")))) for r in docs.collect())


def test_empty_tables(spark, empty, tmp_path):
    assert token_files.write_token_files(spark, empty).count() == 0
    assert chunk_reuse.encode(spark, empty).count() == 0
    assert token_counts.count_tokens(spark, empty, f"file://{tmp_path}/none").count() == 0


def test_folders_without_scheme_are_qualified(spark, tmp_path):
    """Spark and Python's file systems must mean the same place, whatever file system is the default one."""
    made = shared.qualified(spark, f"{tmp_path}/x")
    assert made == f"file://{tmp_path}/x" and shared.qualified(spark, made + "/") == made
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", f"viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
    try:
        assert shared.qualified(spark, "/shared/x") == "viewfs://cluster/shared/x"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_workspaces_are_closed(spark, tmp_path):
    from pathlib import Path

    with shared.closing():
        work = shared.Workspace(spark, "closed")
        work.table(spark.range(3).toDF("x"), "t")
        assert Path(work.path.removeprefix("file://")).exists()
    assert not Path(work.path.removeprefix("file://")).exists() and work not in shared.Workspace.opened
