from collections import Counter

from tabulon.llm import language


def test_held_out_accuracy(documents):
    train, rest = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    found = language.identify(rest, language.fit(train)).toPandas()
    kept = found[found.accepted]
    assert (kept.lang == kept.detected_lang).mean() > 0.97
    assert len(kept) > 0.9 * len(found)


def test_brute_force(awkward):
    import zstandard as z

    dictionaries = {"a": b"abcdefghij " * 20, "b": "ñandú 漢字 été".encode() * 20}
    model = language.Classifier(dictionaries)
    rows = language.identify(awkward, dictionaries).collect()
    assert len(rows) == awkward.count() and set(awkward.columns) <= set(rows[0].asDict())
    how = z.ZstdCompressionParameters(window_log=20, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in rows:
        import pyarrow as pa

        text = language.letters(pa.array([r["text"]], pa.string()))[0].as_py().encode()
        if not text:
            assert (r.detected_lang, r.code_size, r.second_size, r.accepted) == (None, None, None, False)
            continue
        sizes = {}
        for label, content in dictionaries.items():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            code = z.ZstdCompressor(dict_data=d, compression_params=how).compress
            sizes[label] = sum(len(code(text[i : i + language.BLOCK] + language.FILLER)) - len(code(language.FILLER)) for i in range(0, len(text), language.BLOCK))
        assert model.sizes(text) == [sizes["a"], sizes["b"]]
        best, second = sorted(sizes, key=lambda k: (sizes[k], k))
        assert (r.detected_lang, r.code_size, r.second_size) == (best, sizes[best], sizes[second])
        assert r.accepted == (sizes[second] - sizes[best] >= language.MARGIN * sizes[second])


def test_short_texts_are_told_apart(documents):
    found = language.identify(documents, language.fit(documents)).where("length(text) between 12 and 60").toPandas()
    assert found.accepted.mean() > 0.9 and (found.lang == found.detected_lang)[found.accepted].mean() > 0.95


def test_one_dictionary_or_none(awkward, empty):
    one = language.identify(awkward, {"a": b"abc " * 50}).collect()
    assert {(r.detected_lang, r.accepted) for r in one} == {("a", True), (None, False)}
    assert not any(r.accepted for r in language.identify(awkward, {}).collect())
    assert language.fit(empty) == {}
    assert language.identify(empty, {"a": b"abc"}).count() == 0


def test_stage_keeps_columns_as_they_came(spark, awkward):
    kept = language.keep_identified(spark, awkward, "")
    assert kept.columns == awkward.columns
    every = Counter(map(tuple, awkward.collect()))
    assert not Counter(map(tuple, kept.collect())) - every


def test_fit_takes_whole_rows_within_its_bounds(documents):
    known = {r.text for r in documents.collect() if len(r.text.encode()) <= 1000}
    for label, content in language.fit(documents, rows=5, row_bytes=1000).items():
        assert label and len(content) <= 5 * 1001
        whole = [t for t in known if language.content([t]) and language.content([t]) in content]
        assert whole


def test_every_chosen_row_is_whole_in_its_dictionary(spark):
    rows = [(k, f"first{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]} " + "same words again " * 300 + f"last{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}", "a") for k in range(59)] + [(99, "short", "a"), (100, "x" * 9000, "a"), (99, "short", "a")]
    content = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))["a"].split()
    assert len({w for w in content if w.startswith(b"first")}) == 59 == len({w for w in content if w.startswith(b"last")})
    assert content.count(b"short") == 1 and b"x" * 9000 not in content


def test_repeated_lines_are_taken_once():
    assert language.content(["aa", "", "x y\nx y\nz", "word 1 word\n\nword 1 word"]) == b"aa x y z word word"


def test_sizes_have_one_rule_for_all_lengths(documents):
    """A text's code size never falls by much when a letter is added, at the lengths where rules might change."""
    model = language.Classifier(language.fit(documents))
    text = " ".join(language.letters(language.pa.array([r.text for r in documents.limit(40).collect()])).to_pylist()).encode()
    for k in range(len(model.labels)):
        sizes = [model.sizes(text[:n])[k] for n in range(1, 600)]
        assert min(b - a for a, b in zip(sizes, sizes[1:])) >= -16  # of some 20 to 200 bytes: the coder itself begins to code letters by frequency


def test_invented_words_are_rejected(documents):
    import random

    model, r = language.Classifier(language.fit(documents)), random.Random(3)
    margins = []
    for n in [10] * 40 + [40] * 40:
        a, b = sorted(model.sizes(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(n)).encode()))[:2]
        margins.append((b - a) / b >= language.MARGIN)
    assert sum(margins) < 0.25 * len(margins)
