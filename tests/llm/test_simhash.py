import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tabulon.llm import components, shared, simhash


def test_masks_leave_any_few_bits_out():
    every = [int(m) for m in simhash.masks()]
    assert len(every) == 2 ** (simhash.PART_RADIUS + 1) - 1
    rng = np.random.default_rng(0)
    few = [rng.choice(32, simhash.PART_RADIUS, replace=False) for _ in range(20_000)]
    few += [np.array([*c, c[0], c[0]]) for c in itertools.combinations(range(32), 2)]
    for bits in few:
        x = sum(1 << int(b) for b in set(bits.tolist()))
        assert any(not m & x for m in every)


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        a = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        flips = rng.choice(128, simhash.RADIUS, replace=False)
        b = a.copy()
        for f in flips:
            b[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
        assert any(x[0] == x[1] for x in simhash.buckets(np.array([a[1], b[1]]), np.array([a[0], b[0]])))
        flips = rng.choice(128, 7, replace=False)
        b = a.copy()
        for f in flips:
            b[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
        assert any(x[0] == x[1] for x in simhash.buckets(np.array([a[1], b[1]]), np.array([a[0], b[0]]), 2, 3))


def test_signatures_by_brute_force(awkward):
    from tabulon.llm import kernels as K

    texts = [r["text"] for r in awkward.select("text").collect()]
    column = K.strings(pa.array(texts, pa.string()))
    got, worded = simhash.signatures(column)
    hashes, rows = K.hashed_words(column)
    for k in range(len(texts)):
        counts = Counter(hashes[rows == k].tolist())
        assert worded[k] == bool(counts)
        if len(counts) > 3000:
            continue
        sums = [0] * 256
        for h, n in counts.items():
            w = int(np.rint(16 * np.sqrt(n)))
            bits = h
            for place, salt in enumerate(simhash._SALTS[1:].tolist(), 1):
                bits |= int(K.mix(np.array([(h + salt) % 2**64], np.uint64))[0]) << 64 * place
            for b in range(256):
                sums[b] += w if bits >> b & 1 else -w
        want = sum(1 << b for b in range(256) if sums[b] > 0)
        assert sum(int(got[k, w]) << 64 * w for w in range(4)) == want


def test_both_ways_of_summing_agree():
    rng = np.random.default_rng(6)
    row = np.sort(rng.integers(0, 3, 2000))
    h, weight = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), rng.integers(16, 200, 2000).astype(np.int32)
    many = simhash._sums(h, row, weight, 3)
    few = [simhash._sums(h[row == k][a : a + 100], np.zeros(len(h[row == k][a : a + 100]), np.int64), weight[row == k][a : a + 100], 1) for k in range(3) for a in range(0, 2000, 100) if (row == k).sum() > a]
    assert (many.sum(axis=0) == np.concatenate(few).sum(axis=0)).all()


def _groups_by_brute_force(frame):
    from tabulon.llm import kernels as K

    rows = frame.select("doc_id", "text").collect()
    sigs, worded = simhash.signatures(K.strings(pa.array([r.text for r in rows], pa.string())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        apart = np.bitwise_count(sigs[i] ^ sigs[j])
        if worded[i] and worded[j] and int(apart[:2].sum()) <= simhash.RADIUS and int(apart.sum()) <= simhash.BOTH_RADIUS:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r.doc_id)
    out = Counter()
    for ids in groups.values():
        keeper = min((i for i in ids if i is not None), default=None)
        out.update((i, keeper, len(ids)) for i in ids)
    return out


def test_groups_by_brute_force(spark, documents, awkward):
    for frame in (documents, awkward):
        rows = simhash.near_duplicates(spark, frame).collect()
        assert Counter((r.doc_id, r.keeper, r.group_size) for r in rows) == _groups_by_brute_force(frame)
        kept = Counter(r.keeper for r in rows if r.kept)
        assert all(r.doc_id == r.keeper for r in rows if r.kept)
        assert sum(kept.values()) == round(sum(1 / r.group_size for r in rows))


def test_planted_copies(spark):
    r = random.Random(4)
    stock = ["the", "of", "and", "to", "in"] + ["".join(r.choices("abcdefghijklm", k=r.randint(3, 9))) for _ in range(3000)]
    base = [[r.choice(stock) for _ in range(r.randint(60, 300))] for _ in range(60)]
    rows, want = [], []
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
        for c in range(3):
            near = [w if r.random() > 0.03 else r.choice(stock) for w in b]
            rows.append((10 * k + 1 + c, " ".join(near)))
            want.append((10 * k, 10 * k + 1 + c))
    found = {x.doc_id: x.keeper for x in simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert np.mean([found[a] == found[b] for a, b in want]) > 0.95
    assert len({found[10 * k] for k in range(60)}) == 60


def test_forest_compares_whole_buckets():
    rng = np.random.default_rng(3)
    high = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    high[1::2] = high[::2] ^ np.uint64(0b1011)
    low = np.zeros(400, np.uint64)
    bucket = np.repeat([1, 2], 200)
    a, b = simhash.forest(bucket, [low, high, low, low], radius=3)
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(k, k + 1) for k in range(0, 400, 2)}
    same = np.zeros(300, np.uint64)
    a, b = simhash.forest(np.zeros(300, np.int64), [same] * 4)
    assert len(a) == 299


def test_components(spark):
    r = random.Random(8)
    pairs = [(k, k + 1) for k in range(100, 180)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(5, 5), (7, 6), (6, 7)] + [(500, k) for k in range(501, 560)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame([*pairs, (None, 3)], "u bigint, v bigint")
    got = {x.u: x.v for x in components.components(frame, shared.Workspace(spark, "c")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_stage_keeps_one_of_each_group(spark, awkward, empty):
    kept = simhash.keep_one(spark, awkward, "")
    assert kept.columns == awkward.columns
    groups = _groups_by_brute_force(awkward)
    assert kept.count() == round(sum(n / size for (_, _, size), n in groups.items()))
    every = Counter(map(tuple, awkward.collect()))
    assert not Counter(map(tuple, kept.collect())) - every
    assert simhash.keep_one(spark, empty, "").count() == 0
    assert simhash.near_duplicates(spark, empty).count() == 0


def _components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(n)]


def test_pivots_connect_what_pairs_connect():
    """Clusters around centres, chains that leave them, and noise, at all sizes of a bucket."""
    rng = np.random.default_rng(5)
    for round_ in range(12):
        centres = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
        sigs = centres[rng.choice(3, 400, p=[0.8, 0.15, 0.05])].copy()
        sigs[:100] = sigs[0]
        for row in sigs:
            for f in rng.choice(256, rng.integers(0, 45 if round_ % 2 else 30), replace=False):
                row[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
        sigs[350:] = rng.integers(0, 1 << 63, (50, 4), dtype=np.uint64)
        words = [np.ascontiguousarray(sigs[:, k]) for k in range(4)]
        apart = np.bitwise_count(sigs[:, None] ^ sigs[None]).astype(int)
        near = (apart[..., :2].sum(axis=2) <= 19) & (apart.sum(axis=2) <= 40)
        want = _components_of(400, zip(*np.nonzero(np.triu(near, 1))))
        a, b, rest = simhash.around_pivots(words, 19, 40)
        assert all(near[i, j] for i, j in zip(a, b)) and (round_ % 2 or len(rest) < 300)
        within = [(i, j) for i in rest.tolist() for j in rest.tolist() if i < j and near[i, j]]
        assert _components_of(400, [*zip(a, b), *within]) == want
        c, d = simhash.forest(np.zeros(400, np.int64), words)
        assert _components_of(400, zip(c.tolist(), d.tolist())) == want


def test_a_hot_group_of_near_copies(spark):
    """A third of the rows are near copies of one text; their buckets are split into blocks and nothing is lost."""
    r = random.Random(9)
    stock = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 9))) for _ in range(4000)]
    base = [r.choice(stock) for _ in range(200)]
    rows = [(k, " ".join(w if r.random() > 0.02 else r.choice(stock) for w in base)) for k in range(600)]
    rows += [(1000 + k, " ".join(r.choice(stock) for _ in range(60))) for k in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _groups_by_brute_force(frame)
    for size in (simhash.BUCKET_ROWS, 150, 40):
        assert Counter((x.doc_id, x.keeper, x.group_size) for x in simhash.near_duplicates(spark, frame, bucket_rows=size).collect()) == want
    assert max(n for _, _, n in want) > 500


def test_other_radii(spark, documents):
    """With two parts of radius 4 the pairs within 9 of 128 bits are linked, those and no others."""
    rows = documents.select("doc_id", "text").collect()
    from tabulon.llm import kernels as K

    sigs, worded = simhash.signatures(K.strings(pa.array([r.text for r in rows], pa.string())))
    apart = np.bitwise_count(sigs[:, None] ^ sigs[None]).astype(int)
    near = (apart[..., :2].sum(axis=2) <= 9) & (apart.sum(axis=2) <= 40) & worded[:, None] & worded[None]
    want = _components_of(len(rows), zip(*np.nonzero(np.triu(near, 1))))
    got = {x.doc_id: x.group_size for x in simhash.near_duplicates(spark, documents, parts=2, part_radius=4).collect()}
    sizes = Counter(want)
    assert got == {r.doc_id: sizes[w] for r, w in zip(rows, want)}
    assert simhash.costs(10**6, 2, 4)["radius"] == 9 and simhash.costs(2 * 10**6)["comparisons"] == 4 * simhash.costs(10**6)["comparisons"]
