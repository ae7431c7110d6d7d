import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import line_crf, queries, raking
from furrow.lineage import cut

from test_bpe_prefix import PLAIN
from test_shingle_join import plain as components_of
from test_suffix_dedup import plain as substrings_of

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, documents):
    held, docs = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        docs = held[name] = cut(stage(spark, docs, SF_DIR))
        assert name == "tokens" or docs.columns == documents.columns
    rows = lambda name: [(r.doc_id, r.text) for r in held[name].collect()]

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = line_crf.score(documents, line_crf.train(documents, labels)).toPandas()
    assert {i for i, _ in rows("quality")} == set(scores[scores.score >= 0.5].doc_id)
    marked = labels.toPandas().set_index("doc_id").quality
    kept = {i for i, _ in rows("quality")}
    assert np.mean([i in kept for i in marked[marked == 1].index]) > 0.97

    first = {int(i) for i, _, c in components_of(rows("quality")) if int(i) == c}
    assert {i for i, _ in rows("near_duplicates")} == first

    left = {int(i): k.decode(errors="ignore") for i, n, g, _, k in substrings_of(rows("near_duplicates"), 200) if k or not g}
    assert dict(rows("substrings")) == left
    assert all(r.n_chars == len(r.text) for r in held["substrings"].collect())

    sized = queries.with_topic(held["substrings"].withColumn("tokens", queries.token_count("text")), spark, SF_DIR)
    chosen = raking.mix(sized, queries.MIX, queries.RATE).toPandas()
    assert {i for i, _ in rows("mixture")} == set(chosen[chosen.kept].doc_id)
    assert np.isclose((chosen.tokens * chosen.probability).sum(), queries.RATE * chosen.tokens.sum())

    texts = dict(rows("mixture"))
    assert {r.doc_id: r.ids for r in held["tokens"].collect()} == {i: PLAIN.encode_ordinary(t) for i, t in texts.items()}
    assert public_tokenizers.PATTERN

    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, whole.collect())) == sorted(map(str, held["tokens"].collect()))


def test_repeated_rows_and_rows_without_ids(spark, documents, frame):
    """Copies change nothing: one row of each text stays, through all stages."""
    unlabelled = documents.join(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id"), "doc_id", "left_anti")
    some = [tuple(r) for r in unlabelled.select(*documents.columns).where("length(text) > 400").orderBy("doc_id").collect()]
    nameless = (None, some[0][1][::-1], *some[0][2:])
    other = (some[1][0], some[1][1][::-1], *some[1][2:])  # an id with another text
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    once = documents.unionByName(frame([nameless, other], kind))
    copies = [*some, *some, *((None, *r[1:]) for r in some), *((None, r[1] + " more", *r[2:]) for r in some[:5]), nameless, nameless, other]
    held = {}
    for name, docs in (("once", once), ("copied", once.unionByName(frame(copies, kind)))):
        held[name] = {}
        for stage, run in corpus_pipeline.STAGES:
            docs = cut(run(spark, docs, SF_DIR))
            held[name][stage] = sorted(map(str, docs.collect()))
    assert len(held["copied"]["quality"]) > len(held["once"]["quality"])
    for stage in ("near_duplicates", "substrings", "mixture", "tokens"):
        assert held["copied"][stage] == held["once"][stage]


def test_copies_through_the_stages_that_drop(spark, frame):
    text = " ".join(f"word{i}" for i in range(100))
    wide = " ".join(f"term{i}" for i in range(100))
    rows = [(1, text), (1, text), (None, text), (2, text + " end"), (None, wide), (None, wide), (3, "short"), (3, "short"), (4, None), (4, None), (3, wide[::-1])]
    docs = frame([(*r, "en", "src0", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    want = sorted(map(str, [(1, text), (None, wide), (3, "short"), (3, wide[::-1]), (4, None)]))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want
    left = corpus_pipeline.substrings(spark, cut(kept), SF_DIR)
    assert sorted(str((r.doc_id, r.text or None)) for r in left.collect()) == want


def test_no_documents(spark, documents):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_stages_send_texts_in_small_batches(spark, documents):
    """Whatever the session's batches are: some 4 MB of 16 MB of texts in one partition go to a worker at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    wide = documents.limit(1).crossJoin(spark.range(4000)).withColumn("text", F.repeat(F.lit("some words "), 400)).coalesce(1)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(setting, "64m")
            stage(spark, documents.limit(20), SF_DIR)
            assert wide.select("doc_id", "text").mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 5 << 20
        spark.conf.set(setting, "48m")
        corpus_pipeline.run(spark, SF_DIR)
        assert spark.conf.get(setting) == "48m"  # the caller's own
    finally:
        spark.conf.set(setting, before)
