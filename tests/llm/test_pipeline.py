from collections import Counter

import corpus_pipeline
from tabulon.llm import language, quality, simhash


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]


def test_run_equals_the_decisions_taken_one_by_one(spark, sf_dir):
    """Each decision from the operator's own verdicts, applied to rows in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in language.identify(docs, language.fit(docs)).collect() if r.accepted}
    left = docs.where(docs.doc_id.isin(sorted(good)))
    good = {r.doc_id for r in quality.judge(left, quality.fit(left, labels), ["doc_id"]).collect() if r.accepted}
    left = left.where(left.doc_id.isin(sorted(good)))
    good = {r.doc_id for r in simhash.near_duplicates(spark, left).collect() if r.kept}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == good
    assert 0.5 * docs.count() < len(good) < docs.count()
    assert max(Counter((r.bin, r.sequence, r.sequence_offset) for r in rows if r.n_tokens).values()) == 1


def test_filter_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def _brute_pipeline(rows, dictionaries, fitted):
    """Ids and texts that the first three stages leave, each decided in plain Python for one row, or one pair, at a time."""
    from itertools import combinations

    import numpy as np
    import pyarrow as pa

    from tabulon.llm import kernels as K
    from tests.llm.test_quality import brute as statistics

    model = language.Classifier(dictionaries)
    left = []
    for r in rows:
        text = language.letters(pa.array([r["text"]], pa.string()))[0].as_py()
        sizes = sorted(model.sizes(text.encode())) if text and dictionaries else []
        if sizes and (len(sizes) == 1 or sizes[1] - sizes[0] >= language.MARGIN * sizes[1]):
            left.append(r)
    rules = fitted(left)
    left = [r for r in left if not any(quality._covers(rule, np.array([statistics(r["text"])]))[0] for rule in rules)]
    sigs, worded = simhash.signatures(K.strings(pa.array([r["text"] for r in left], pa.string())))
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(left)), 2):
        apart = np.bitwise_count(sigs[i] ^ sigs[j])
        if worded[i] and worded[j] and int(apart[:2].sum()) <= simhash.RADIUS and int(apart.sum()) <= simhash.BOTH_RADIUS:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, r in enumerate(left):
        groups.setdefault(find(k), []).append(r["doc_id"])
    return Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())


def _tables(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_by_brute_force_with_awkward_rows(spark, sf_dir, awkward, tmp_path):
    """The given documents with nulls, empty and very long texts, repeated rows, null ids and clashing columns among them."""
    from collections import defaultdict

    from tabulon.llm import bpe, packing
    from tests.llm.test_packing import brute as packed

    own = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")
    folder = _tables(spark, tmp_path, own.unionByName(awkward, allowMissingColumns=True).coalesce(2), labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def fitted(left):
        schema = "doc_id bigint, text string"
        return quality.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in left], schema), labels)

    want = _brute_pipeline([r.asDict() for r in docs.collect()], language.fit(docs), fitted)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == want
    encoder, texts = bpe.encoder(), defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].add(len(encoder.plain(r.text or "")))
    by_bin, tokens = defaultdict(list), Counter()
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
        if r.n_tokens:
            by_bin[r.bin].append(r)
    assert all(n in texts[i] for i, n in tokens.items() if want[i] == 1)
    for members in by_bin.values():
        lengths = sorted((r.n_tokens for r in members), reverse=True)
        assert sorted((r.sequence, r.sequence_offset, r.n_tokens) for r in members) == sorted((s, o, n) for (s, o), n in zip(packed(lengths, packing.CAPACITY, packing.LINEAR, packing.QUADRATIC), lengths))


def test_run_of_empty_tables_and_of_nothing_but_nulls(spark, sf_dir, awkward, tmp_path):
    from pathlib import Path

    from tabulon.llm import shared

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for k, frame in enumerate((awkward.where("1 = 0"), awkward.where("text is null"), awkward.where("doc_id is null"))):
        folder = _tables(spark, tmp_path / str(k), frame, labels)
        before = set(shared.Workspace.opened)
        assert corpus_pipeline.run(spark, folder).count() == 0
        (left,) = set(shared.Workspace.opened) - before
        assert [p.name for p in Path(left.path.removeprefix("file://")).iterdir()] == ["packing"]
