"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, where the operators' own tests leave gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryframe.llm import ann, common, decontaminate, quality, substring_dedup, suffix_dedup, warc

ITEM = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "so " + ITEM + " it was", "a"), (1, "so " + ITEM + " it was", "b"), (None, ITEM, "c"), (2, None, "d"), (3, "", "e"), (4, "word " * 200_000 + ITEM, "f"), (5, "word " * 100, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string")


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "", 0)], "item_id long, text string, distance int")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [("1", 1, 0), ("4", 1, 0), ("None", 1, 0)]
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.TEXT for r in kept.collect()) == ["d", "e", "g"]
    none = docs.limit(0)
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.remove_contaminated(none, bench).count() == 0


def test_archives_with_clashing_names(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>", "x", 9), (2, "u", "<p>a</p>", "y", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string, payload int")
    got = warc.records(warc.read_chunks(warc.write_warc(warc.with_record_types(pages), f"file://{tmp_path}/w"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None)]


def test_neighbours_with_clashing_names(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6)], [0.0], 1.0, "p") for i in range(60)] + [(3, [9.0] * 6, [0.0], 1.0, "p")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, EMBEDDING array<double>, score double, part string")
    got = ann.search(df, df.filter("vec_id = 0"), 5).orderBy("rank").collect()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    best: dict[int, float] = {}
    for i, s in zip([r[0] for r in rows], x @ x[0], strict=True):
        if i:
            best[i] = max(s, best.get(i, -9e9))
    assert len(got) == 5 and len({r.vec_id for r in got}) == 5 and all(r.score == pytest.approx(best[r.vec_id]) for r in got)


def test_quality_of_odd_rows(spark):
    rows = [(i, "fine words here" if i % 2 else "BAD !!! ***", "s") for i in range(40)] + [(90, "fine words here " * 100_000, "s"), (91, None, None), (92, "", "s"), (None, "fine words here", "s"), (93, "fine words here", "s"), (93, "fine words here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    s = quality.Settings(per_round=5, steps=40)
    model = quality.train(df, labels, s)
    got = quality.classify(df, model, s).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    # equal texts score alike, and one at the threshold stays
    assert by[93].score == by[1].score == by[None].score and by[93].keep and not by[0].keep
    edge = quality.classify(df, model, quality.Settings(threshold=by[93].score)).filter("doc_id = 93").collect()
    assert [r.keep for r in edge] == [True, True]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and a clashing column go through all stages; so does an empty table."""
    prose = lambda k: " ".join(f"w{(i * k) % 97}" for i in range(60))
    rows = [(i, prose(i + 2), "en", "s", 1, "X") for i in range(12)]
    rows += [(3, prose(5), "en", "s", 1, "X"), (None, prose(50), "en", "s", 1, "X"), (20, None, None, None, None, None), (21, "", "en", "s", 0, "X"), (22, "word " * 50_000, "en", "s", 1, "X")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("odd", rows), ("none", [])):
        d = spark.createDataFrame(some, schema)
        at = 0
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.stored(stage(spark, d, str(tmp_path)), "t")
            assert out.columns == d.columns
            d, at = out, at + 1
        packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        ids = {r.doc_id for r in packed.collect()}
        assert ids == {r.doc_id for r in d.collect()} and (ids >= {None, 22, 0, 11} if name == "odd" else not ids)
        if name == "odd":
            assert d.filter(F.col("doc_id") == 3).count() == 2  # equal rows of the class's own id both stay


def test_one_id_of_many_rows_is_split(spark, tmp_path):
    """Rows without an id, or of one, lie in several chunks, and the outcome stays defined."""
    texts = [" ".join(f"w{(i * k) % 89}" for i in range(40)) for k in range(2, 12)]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex.for_docs(df, f"file://{tmp_path}/i", 400)
    assert index.chunked(df, 0).select("chunk").distinct().count() > 4
    got = substring_dedup.dedup_windows(df, index).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([("7", 0)] * 10 + [("None", 40)] * 11)
    got = suffix_dedup.dedup_substrings(df, chunk_bytes=400).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in got) == sorted([("7", False)] * 10 + [("None", True)] * 11)
