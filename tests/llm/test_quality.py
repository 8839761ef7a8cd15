import numpy as np
import pyarrow as pa

from tabulon.llm import quality


def brute(text: str) -> list[float]:
    raw = text.encode()
    word = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    words, now = [], b""
    for b in raw:
        if word(b):
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    words += [now] if now else []
    lines = [x for x in raw.split(b"\n") if x]
    count = lambda f: sum(map(f, raw))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    digit, blank, high = count(lambda b: 48 <= b <= 57), count(lambda b: b in b"\t\n\r "), count(lambda b: b >= 128)
    size, n = max(1, len(raw)), max(1, len(words))
    sign = len(raw) - upper - lower - digit - blank - high
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [len(raw), len(words), sum(map(len, words)) / n, upper / max(1, upper + lower), sign / size, digit / size, raw.count(b"|") / size, blank / size, repeats / n, len(set(words)) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(raw) / max(1, len(lines))]


def test_statistics(awkward):
    texts = [r["text"] or "" for r in awkward.select("text").collect()]
    got = quality.measure(pa.array(texts, pa.large_string()))
    assert np.allclose(got, [brute(t) for t in texts])
    stats = quality.with_statistics(awkward).collect()
    assert all(np.allclose(list(r["__stats"]), brute(r["text"] or "")) for r in stats)


def test_learn_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = (x[:, 4] > 0.9) | ((x[:, 1] < 0.2) & (x[:, 8] > 0.7))
    rules = quality.learn(x, y)
    found = np.zeros(len(x), bool)
    for rule in rules:
        found |= quality._covers(rule, x)
    assert (found == y).mean() > 0.97 and len(rules) <= 6
    assert quality.learn(x, np.zeros(len(x), bool)) == [] and quality.learn(x[:0], y[:0]) == []


def test_rules_as_columns_equal_brute_force(awkward):
    rules = [(quality.Condition("sign_share", True, 0.3), quality.Condition("n_bytes", True, 5.0)), (quality.Condition("n_words", False, 2.0),), (quality.Condition("distinct_share", False, 0.5),)]
    for r in quality.judge(awkward, rules).collect():
        x = np.array([brute(r["text"] or "")])
        first = next((k for k, rule in enumerate(rules, 1) if quality._covers(rule, x)[0]), None)
        assert (r.rule, r.accepted) == (first, first is None)


def test_held_out(spark, documents, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, rules, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.accepted for r in good]) > 0.97 and np.mean([r.accepted for r in bad]) < 0.2


def test_nothing_to_learn(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id bigint, quality int")
    assert quality.fit(awkward, labels) == [] == quality.fit(empty, labels)
    assert quality.judge(awkward, []).where("accepted").count() == awkward.count()
    assert quality.judge(empty, []).count() == 0


def test_a_callers_columns_come_back(awkward):
    rows = quality.judge(awkward, [(quality.Condition("n_words", False, 2.0),)]).collect()
    assert rows and all(r["__stats"] == "z" and r["column0"] if "column0" in r else r["__stats"] == "z" for r in rows)


def test_many_rules_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((20_000, len(quality.STATISTICS)))
    y = ((x > 0.99) | (x < 0.01)).any(axis=1)
    assert len(quality.learn(x, y)) > 20 and len(quality.learn(x, y, most=5)) == 5


def test_ids_and_names_of_any_kind(spark):
    rows = [(f"k{k}", "||| --- |||" if k % 2 else "some quiet words of prose", k % 2) for k in range(90)]
    frame = spark.createDataFrame(rows, "key string, body string, bad int")
    rules = quality.fit(frame, frame.selectExpr("key", "1 - bad as good"), id_column="key", text_column="body", label_column="good")
    assert rules and all(r.accepted != bool(r.bad) for r in quality.judge(frame, rules, text_column="body").collect())
