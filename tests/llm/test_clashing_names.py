"""Extra columns keep their values, also where an operator once had working columns of those names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import host_paths, line_crf, raking, sentence_spans, suffix_dedup

SF_DIR = "/root/testdata/sf0.001"
EXTRA = """_id _key _places _spans _text _host _won_host _won_votes _cell_lang _cell_source _mass _score _own _vec _query
host votes name id at known tokens topic weight probability kept n_removed score component_id address label ids""".split()


def marked(docs):
    """The documents with extra columns that tell their row and column."""
    return docs.withColumns({c: F.concat(F.col("doc_id").cast("string"), F.lit(f" {c}")) for c in EXTRA})


def intact(found, left_out=()):
    wrong = [~F.col(c).eqNullSafe(F.concat(F.col("doc_id").cast("string"), F.lit(f" {c}"))) for c in EXTRA if c not in left_out]
    return not found.where(F.exists(F.array(*wrong), lambda x: x)).count()


@pytest.fixture(scope="module")
def some(spark):
    return marked(spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(120)).repartition(3).persist()


def test_operators(some):
    text = sentence_spans.dedup(some)
    assert text.count() == some.count() and set(EXTRA) <= set(text.columns) and intact(text, ["n_removed"])
    cut = suffix_dedup.dedup_text(some)
    assert cut.columns == [c for c in some.columns if c not in ("text", "n_removed")] + ["text", "n_removed"]
    assert cut.count() == some.count() and intact(cut, ["n_removed"])
    shares = {"lang": {"en": 0.5}, "source": {"src0": 0.1}}
    mixed = raking.mix(some.withColumn("size", F.length("text")), shares, 0.5, tokens="size")
    assert mixed.count() == some.count() and intact(mixed, ["weight", "probability", "kept"])
    pages = some.withColumns({"url": F.lit("http://a.example.org/"), "html": F.concat(F.lit("<body><div class=t><p>"), "text", F.lit("</p></div></body>"))})
    read = host_paths.extract(pages.drop("text"))
    assert read.count() == some.count() and intact(read)
    scored = line_crf.score(some, None, out="mine")
    assert scored.count() == some.count() and intact(scored)


def test_stages(spark, some):
    docs = some
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF_DIR)
        assert found.columns == some.columns, name
        rows = found.persist()
        assert rows.count() and intact(rows), name
    plain = corpus_pipeline.substrings(spark, some.drop(*EXTRA), SF_DIR)
    assert sorted(map(str, corpus_pipeline.substrings(spark, some, SF_DIR).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
