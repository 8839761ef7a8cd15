from collections import defaultdict

import numpy as np

from tabulon.llm import bpe, packing


def brute(lengths, capacity, linear, quadratic):
    sequences = [[0.0, capacity] for _ in range(max(1, -(-sum(lengths) // capacity)))]
    out = []
    for n in lengths:
        fit = [k for k, (_, room) in enumerate(sequences) if room >= n]
        if not fit:
            sequences.append([0.0, capacity])
            fit = [len(sequences) - 1]
        k = min(fit, key=lambda k: (sequences[k][0], k))
        out.append((k, capacity - sequences[k][1]))
        sequences[k][0] += linear * n + quadratic * n * n
        sequences[k][1] -= n
    return out


def test_assign_is_the_greedy_rule():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 65, rng.integers(1, 80)))[::-1].astype(np.int64)
        a, b = packing.assign(lengths, 64, 1.0, 0.25)
        assert list(zip(a.tolist(), b.tolist())) == brute(lengths.tolist(), 64, 1.0, 0.25)


def test_pack(spark, awkward):
    rows = packing.pack(spark, awkward, capacity=512, sequences=8).collect()
    encoder = bpe.encoder()
    want, got = defaultdict(int), defaultdict(int)
    for r in awkward.select("doc_id", "text").collect():
        want[r.doc_id] += len(encoder.plain(r.text or ""))
    used = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        if r.n_tokens:
            used[r.bin, r.sequence].append((r.sequence_offset, r.n_tokens))
            assert r.token_start == 512 * r.piece
        else:
            assert (r.bin, r.sequence, r.sequence_offset, r.piece) == (None, None, None, 0)
    assert got == want
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) <= 512
    by_bin = defaultdict(list)
    for r in rows:
        if r.n_tokens:
            by_bin[r.bin].append(r)
    for members in by_bin.values():
        lengths = sorted((r.n_tokens for r in members), reverse=True)
        placed = sorted((r.sequence, r.sequence_offset, r.n_tokens) for r in members)
        assert placed == sorted((s, o, n) for (s, o), n in zip(brute(lengths, 512, packing.LINEAR, packing.QUADRATIC), lengths))


def test_empty(spark, empty):
    assert packing.pack(spark, empty).count() == 0


def test_ids_come_back_exactly(spark):
    """Ids beyond a double's whole numbers beside a null in one group, and ids of text."""
    rows = [(9007199254740993, "a b c"), (9007199254740995, "d e"), (None, "f")]
    for kind, of in (("bigint", lambda x: x), ("string", lambda x: x if x is None else f"id {x}")):
        frame = spark.createDataFrame([(of(i), t) for i, t in rows], f"doc_id {kind}, text string").coalesce(1)
        assert {r.doc_id for r in packing.pack(spark, frame).collect()} == {of(i) for i, _ in rows}


def test_rows_of_one_id_spread(spark):
    frame = spark.range(4000).selectExpr("1L as doc_id", "'some words here' as text")
    rows = packing.pack(spark, frame, capacity=64, sequences=4).collect()
    assert len(rows) == 4000 and len({r.bin for r in rows}) > 20
