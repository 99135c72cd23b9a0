"""The corpus queries against their SQL, and the pipeline against its stages taken one by one."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quarryframe.llm import decontaminate, line_dedup, minhash, packing, quality
from quarryframe.llm.common import work_path
from quarryframe.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    text = df[cols].astype(str).replace({"<NA>": "nan", "None": "nan"})
    for c in cols:
        text[c] = text[c].str.replace(r"\.0$", "", regex=True)
    return text.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()).equals(plain(duck.sql(ORACLE[name]).df()))


def test_ten_operators_and_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stages[0](spark, docs, DATA).persist()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert good.columns == docs.columns and ids(good) == ids(quality.classify(docs, model).filter("keep"))

    lined = stages[1](spark, good, DATA).persist()
    texts = {t for (t,) in ((r.text,) for r in good.collect())}
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    held: dict[str, int] = {}
    for t in texts:
        for k in {key(x) for x in t.split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if held.get(key(x), 0) < 10) for r in good.collect()}
    got = {r.doc_id: r.text for r in lined.collect()}
    assert lined.columns == docs.columns and got == {i: t for i, t in want.items() if t.strip() or t == dict((r.doc_id, r.text) for r in good.collect())[i]}

    one = stages[2](spark, lined, DATA).persist()
    assert ids(one) == sorted({r.class_id for r in minhash.near_duplicates(lined).collect()})
    clean = stages[3](spark, one, DATA).persist()
    leaks = {r.doc_id for r in decontaminate.contaminated(one, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert ids(clean) == sorted(set(ids(one)) - leaks)
    packed = stages[4](spark, clean, DATA)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean) and packed.columns == packing.pack(clean).columns
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()
    assert line_dedup.LineRuns(spark, work_path(spark, "none")).runs() == []
