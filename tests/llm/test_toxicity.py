import numpy as np

from tabulon.llm import toxicity


def test_held_out(spark, documents):
    base = documents.where("lang = 'en' and text not like '%idiot%' and text not like '%moron%'").select("doc_id", "text")
    planted = base.selectExpr("doc_id", "doc_id % 3 = 0 as bad", "case when doc_id % 3 = 0 then concat(substring(text, 1, 40), ' zork you blarg zork ', substring(text, 41)) else text end as text")
    labels = planted.where("doc_id % 2 = 0").selectExpr("doc_id", "cast(bad as int) toxic", "1 quality")
    weights = toxicity.fit(planted, labels, epochs=20)
    assert 0 < len(weights[0]) < 5000
    rows = toxicity.score(planted.where("doc_id % 2 = 1"), weights).collect()
    bad, good = [r for r in rows if r.bad], [r for r in rows if not r.bad]
    assert np.mean([r.toxic for r in bad]) > 0.9 and np.mean([r.toxic for r in good]) < 0.05


def test_scores_by_brute_force(spark, awkward):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(1 << 20, 300_000, replace=False)).astype(np.int32)
    value = rng.normal(0, 0.01, len(at)).astype(np.float32)
    known = dict(zip(at.tolist(), value.tolist()))
    for r in toxicity.score(awkward, (at, value, -1.0)).collect():
        slots = set(toxicity.features(pa.array([r["text"] or ""], pa.large_string()))[0].tolist())
        p = 1 / (1 + np.exp(-np.clip(sum(known.get(s, 0.0) for s in slots) - 1.0, -30, 30)))
        assert abs(p - r.toxicity) < 1e-5 and r.toxic == (r.toxicity > toxicity.THRESHOLD)


def test_ftrl_steps():
    """Against the update rule written out for one coordinate at a time."""
    model = toxicity.Ftrl(4)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + np.sqrt(n[i])) / model.alpha + model.l2)

    rng = np.random.default_rng(2)
    for _ in range(300):
        slots, y = np.unique(rng.integers(0, 16, 5)), int(rng.integers(0, 2))
        w = {i: weight(i) for i in [*slots.tolist(), 16]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
        model.learn(slots, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_labels_of_one_kind_and_nulls(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id bigint, toxic int")
    at, _, bias = toxicity.fit(awkward, labels)
    assert len(at) == 0 and bias == 0
    assert toxicity.fit(empty, labels)[2] == 0
    assert toxicity.score(empty, (at, np.zeros(0, np.float32), 0.0)).count() == 0


def test_ids_of_any_type_and_names_of_columns(spark):
    rows = [(f"id {k}", ("zork blarg " if k % 2 else "mild words ") * 5, k % 2) for k in range(60)]
    frame = spark.createDataFrame(rows, "key string, body string, bad int")
    weights = toxicity.fit(frame, frame.select("key", "bad"), epochs=10, label_column="bad", id_column="key", text_column="body")
    assert len(weights[0])
    assert all(r.toxic == bool(r.bad) for r in toxicity.score(frame, weights, text_column="body").collect())


def test_what_is_fitted_is_bounded_by_bytes(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(500)), k % 2) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    assert toxicity.fit(frame, frame, slot_bytes=100)[2] == 0  # no row fits, so nothing is learned
    few, all_of_them = toxicity.fit(frame, frame, slot_bytes=60_000, epochs=30), toxicity.fit(frame, frame, epochs=30)
    assert 0 < len(few[0]) < len(all_of_them[0])
