import numpy as np
import pytest

from tabulon.llm import jpeg, jpeg_fixture


def inverse(parts, h, w, factor):
    """The picture of quantised coefficients, block by block and pixel by pixel."""
    cosine = [[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    cosine = np.array(cosine)
    out = []
    for k, c in enumerate(parts):
        plane = np.zeros((8 * c.shape[0], 8 * c.shape[1]))
        for y in range(c.shape[0]):
            for x in range(c.shape[1]):
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = c[y, x] * jpeg_fixture.QUANTA
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.einsum("uy,uv,vx->yx", cosine, block.reshape(8, 8), cosine)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        f = 1 if k == 0 else factor
        out.append(np.array([[plane[y // f, x // f] for x in range(w)] for y in range(h)]))
    y, b, r = out[0], out[1] - 128, out[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b], 2)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("seed", range(25))
def test_progressive_scans(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 45, 2)
    factor, restart = int(rng.integers(1, 3)), int(rng.choice([0, 0, 1, 3]))
    noise = rng.normal(0, rng.choice([0, 5, 60]), (h, w, 3))
    image = np.clip(np.add.outer(np.linspace(0, 200, h), np.linspace(0, 50, w))[..., None] + noise, 0, 255).astype(np.uint8)
    got = jpeg.decode(jpeg_fixture.encode(image, factor, restart))
    assert got.shape == (h, w, 3)
    assert np.abs(got.astype(int) - inverse(jpeg_fixture.planes(image, factor), h, w, factor)).max() <= 1


def test_smooth_pictures_come_back():
    image = np.stack([np.add.outer(np.linspace(0, 120, 40), np.linspace(0, 120, 56))] * 3, axis=2).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg_fixture.encode(image, 2)).astype(int) - image).mean() < 3


def test_broken_bytes_are_refused():
    data = jpeg_fixture.encode(jpeg_fixture.picture(3, np.arange(64.0)))
    rng = np.random.default_rng(0)
    for cut in range(0, len(data) - 1, 5):
        with pytest.raises(jpeg.Broken):
            jpeg.decode(data[:cut])
    for _ in range(400):
        bent = bytearray(data)
        bent[rng.integers(0, len(bent))] = rng.integers(0, 256)
        try:
            jpeg.decode(bytes(bent))
        except jpeg.Broken:
            pass


@pytest.mark.parametrize("band", [(1, 64), (1, 255), (9, 5), (0, 5), (64, 70)])
def test_a_band_outside_the_block_is_refused(band):
    data = bytearray(jpeg_fixture.encode(jpeg_fixture.picture(3, np.arange(64.0))))
    scans = [i for i in range(len(data) - 1) if data[i : i + 2] == b"\xff\xda"]
    for at in scans:
        bent = bytearray(data)
        place = at + 5 + 2 * bent[at + 4]
        bent[place : place + 2] = bytes(band)
        with pytest.raises(jpeg.Broken, match="band"):
            jpeg.decode(bytes(bent))


def test_column(spark):
    good = jpeg_fixture.encode(jpeg_fixture.picture(1, np.arange(9.0)))
    rows = [(1, bytearray(good), "x"), (1, bytearray(good), "x"), (None, bytearray(good), None), (2, None, "y"), (3, bytearray(b""), "z"), (4, bytearray(good[:100]), "z")]
    media = spark.createDataFrame(rows, "vec_id bigint, media binary, height string")
    image = jpeg.decode(good)
    out = jpeg.decode_column(media, "vec_id", "media").collect()
    assert len(out) == 6
    for r in out:
        if r.vec_id in (1, None):
            assert (r.height, r.width, bytes(r.rgb), r.error) == (*image.shape[:2], image.tobytes(), None)
        elif r.vec_id == 2:
            assert (r.height, r.rgb, r.error) == (None, None, None)
        else:
            assert r.rgb is None and r.error
    assert jpeg.decode_column(media.where("1 = 0"), "vec_id", "media").count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = jpeg.op8_progressive_jpeg(spark, sf_dir).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert len(rows) == len(vectors)
    large = [r for r in rows if r.vec_id % 64 == 0]
    assert large and min(r.width for r in large) >= 72 and {jpeg_fixture.settings(r.vec_id) for r in rows} == {(f, n) for f in (1, 2) for n in (0, 2, 5)}
    for r in [*rows[:40], *large[:3]]:
        image = jpeg_fixture.picture(r.vec_id, np.array(vectors[r.vec_id], float))
        factor, _ = jpeg_fixture.settings(r.vec_id)
        want = inverse(jpeg_fixture.planes(image, factor), *image.shape[:2], factor)
        got = np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3)
        assert np.abs(got.astype(int) - want).max() <= 1


def test_odd_embeddings(spark):
    frame = spark.createDataFrame([(1, [1.0, float("nan")]), (2, []), (3, None), (None, [5.0])], "vec_id bigint, embedding array<float>")
    out = {r.vec_id: r for r in jpeg.decode_column(jpeg_fixture.drawn(frame), "vec_id", "media").collect()}
    assert out[3].rgb is None and out[3].error is None and all(out[k].rgb for k in (1, 2, None))


def test_bad_tables_are_refused():
    """A quantisation table that is cut short, of 16 bits and odd, or of a precision that doesn't exist."""
    data = jpeg_fixture.encode(jpeg_fixture.picture(3, np.arange(64.0)))
    at = data.index(b"\xff\xdb")
    for table in (b"\0" + bytes(40), b"\x10" + bytes(67), b"\x50" + bytes(64), b"\0" + bytes(range(1, 65)) + b"\x01\x02"):
        with pytest.raises(jpeg.Broken):
            jpeg.decode(data[:at] + b"\xff\xdb" + (len(table) + 2).to_bytes(2, "big") + table + data[at + 69 :])


def test_corrupt_bytes_never_raise_anything_else():
    data = jpeg_fixture.encode(jpeg_fixture.picture(5, np.arange(64.0)))
    rng = np.random.default_rng(7)
    for _ in range(3000):
        bent = bytearray(data)
        for _ in range(rng.integers(1, 4)):
            bent[rng.integers(0, len(bent))] = rng.integers(0, 256)
        try:
            jpeg.decode(bytes(bent))
        except jpeg.Broken:
            pass


def test_batches_are_sent_by_bytes(spark, monkeypatch):
    good = jpeg_fixture.encode(jpeg_fixture.picture(1, np.arange(9.0)))
    media = spark.createDataFrame([(k, bytearray(good) if k % 3 else None) for k in range(50)], "vec_id bigint, media binary").coalesce(1)
    monkeypatch.setattr(jpeg, "SENT_BYTES", 1000)
    rows = jpeg.decode_column(media, "vec_id", "media").collect()
    assert [r.vec_id for r in rows] == list(range(50)) and all((r.rgb is None) == (r.vec_id % 3 == 0) for r in rows)
