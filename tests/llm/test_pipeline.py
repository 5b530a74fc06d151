import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from terravane.llm import containment, near_dedup  # noqa: E402


def test_stages_on_a_small_corpus(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "encode":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps[name] = (before, docs)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(texts, steps["near-dedup"])
    want = {i for i, (_, c) in near_dedup.brute_components(list(before.items()), 5, 80).items() if i == c}
    assert set(after) == want
    before, after = map(texts, steps["decontaminate"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, *_ in containment.brute(list(before.items()), items, 5, 80)}
    before, after = map(texts, steps["secrets"])
    assert set(before) == set(after) and not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in after.values())
    assert steps["encode"][1].count() == len(after)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [
        (0, None, "en", "s", None, 1.0), (1, "", "en", None, 0, 1.0), (2, "good words in a row here now", None, "s", 28, None), (2, "good words in a row here now", None, "s", 28, None),
        (None, "no id at all", "en", "s", 12, 1.0), (3, 'my token = "abcdef1234567890"', "en", "s", 29, 1.0), (4, "one two three four five six seven", "en", "s", 33, 1.0), (5, "word " * 50_000, "en", "s", 250_000, 1.0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    at = str(tmp_path)
    spark.createDataFrame([(2, 1, 0), (4, 1, 0), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, "two three four five six"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{at}/none/documents.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
    assert seen["quality"].count() == len(rows)
    assert sorted(str(r.doc_id) for r in seen["near-dedup"].collect()) == ["0", "1", "2", "3", "4", "5", "None"]
    assert sorted(str(r.doc_id) for r in seen["decontaminate"].collect()) == ["0", "1", "2", "3", "5", "None"]
    clean = {r.doc_id: (r.text, r.n_chars) for r in seen["secrets"].collect()}
    assert clean[3] == ('my [SECRET]"', 12) and clean[0] == (None, None)
    assert seen["encode"].count() == 6
    empty = spark.read.parquet(f"{at}/none/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, at)
    assert empty.count() == 0


def test_encode_writes_the_ids(spark, odd_texts=("One two", None, "", "été 漢字 🙂 don't", "word " * 5000)):
    import public_tokenizers as P
    import tiktoken

    from terravane.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(odd_texts)], "doc_id long, text string, lang string")
    coded = dict(corpus_pipeline.STAGES)["encode"](spark, docs, "")
    assert coded.columns == ["doc_id", "lang", "ids", "n_tokens"]
    got = {r.doc_id: (r.lang, r.ids, r.n_tokens) for r in coded.collect()}
    assert got == {i: ("en", w := ref.encode_ordinary(t or ""), len(w)) for i, t in enumerate(odd_texts)}
    assert {r.doc_id: bytes(r.plain).decode() for r in bpe.decoded(coded, path).collect()} == {i: t or "" for i, t in enumerate(odd_texts)}
