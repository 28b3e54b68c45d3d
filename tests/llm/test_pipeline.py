"""The whole pipeline on odd and empty tables."""

from hashlib import sha256

import corpus_pipeline
import pytest

from casemill.llm import bpe


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([("a", "one two three"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_on_odd_rows(odd, spark, folder):
    """Documents with few words go, of the repeated row and its near copies one stays, extra columns are kept."""
    text = "a clean document with enough different words to be kept by all rules of the first stage"
    secret = text.upper() + " and more so that it is no copy password=Xk29dkwiqQz0 as well as ten other words of its own"
    more = [(20, text, "en", "a", 1), (20, text, "en", "a", 1), (20, text, "en", "a", 1), (21, text + " ", None, None, None), (22, secret, "en", "z", 3)]
    rows = spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    every = odd.unionByName(rows, allowMissingColumns=True)
    every.write.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [c for c in odd.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "decoded_sha256"]
    kept = {r["doc_id"]: r for r in found.collect()}
    assert sorted(kept) == [1, 6, 20, 22] and found.count() == 4
    assert kept[20]["decoded_sha256"] == sha256(text.encode()).hexdigest()
    ranks = bpe.load_ranks(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    said = bpe.StreamDecoder({i: t for t, i in ranks.items()}).decode(bpe.unpacked(kept[22]["ids"]))
    assert said == secret.replace("password=Xk29dkwiqQz0", "[assign]") and kept[22]["lang"] == "en"


def test_run_on_empty_tables(none, spark, folder):
    none.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_on_odd_rows(odd, none, spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            made = stage(spark, docs, folder)
            assert made.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns
