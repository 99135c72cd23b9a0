"""Bounds that only large tables reach."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarryframe.llm import minhash, npwords, quality, suffix_dedup
from quarryframe.llm.common import stored


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    """Few ids with long lists beside them aren't broadcast, and the answer is the same when nothing is."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"))
    kind = "array<struct<bucket: long, ys: array<long>>>"
    light = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast(kind).alias("ys"))
    heavy = spark.range(3).select(F.col("id").alias("doc_id"), F.array(F.struct(F.lit(0).cast("long").alias("bucket"), F.sequence(F.lit(0).cast("long"), F.lit(2_000_000).cast("long")).alias("ys"))).alias("ys"))
    plans = [docs.join(minhash._joinable(ids), "doc_id")._jdf.queryExecution().toString() for ids in (light, heavy)]
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(120)]
    rows += [(200 + i, t + " and so on") for i, (_, t) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(minhash.near_duplicates(df).collect())
    kept = sorted(minhash.keep_one(df).collect())
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", 0)
    assert sorted(minhash.near_duplicates(df).collect()) == want and sorted(minhash.keep_one(df).collect()) == kept


def test_common_small_sets_are_counted_in_place(spark, monkeypatch):
    """Small texts that very many others hold leave no pairs behind, and have the links and classes that pairs gave. Rows that
    are there twice count once."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(2, 9)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words, rng.integers(30, 400)))) for i in range(60)]
    rows += [rows[3], rows[70], rows[70]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = []
    whole = minhash.containers
    monkeypatch.setattr(minhash, "containers", lambda *a: pairs.append(whole(*a)) or pairs[-1])
    got = sorted(minhash.near_duplicates(df).collect())
    far, tiny = pairs[-1]
    assert far.filter("x < 60").count() == 0 and tiny.agg(F.sum("n")).first()[0] > 1000
    monkeypatch.setattr(minhash, "TABLE", 64)  # many rounds
    assert sorted(minhash.near_duplicates(df).collect()) == got
    assert sorted(minhash.near_duplicates(df, minhash.Settings(tiny=0)).collect()) == got
    far, tiny = pairs[-1]
    assert far.filter("x < 60").count() > 500 and tiny.count() == 0


def test_tables_of_common_sets_share_a_pass(spark, monkeypatch):
    """Texts aren't read once for each table of common sets, and of such tables a shingle that few hold is found by its mark."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(2, 9)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words, rng.integers(30, 400)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(minhash.near_duplicates(df, minhash.Settings(tiny=0)).collect())
    tables, passes, make, read = [], [], minhash.Tiny.of, minhash._sets_of
    monkeypatch.setattr(minhash.Tiny, "of", staticmethod(lambda *a: tables.append(1) or make(*a)))
    monkeypatch.setattr(minhash, "_sets_of", lambda docs, ids, s, then, schema: passes.append(schema.startswith("id long, n double")) or read(docs, ids, s, then, schema))
    monkeypatch.setattr(minhash, "TABLE", 64)
    assert sorted(minhash.near_duplicates(df).collect()) == want
    assert len(tables) >= 4 and sum(passes) <= -(-len(tables) // 3)


def _shuffled(spark, do):
    """What do() returns, and the bytes that it shuffled."""

    def stages():
        none, jvm = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
        return {(x := every.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(every.size())}

    before = stages()
    out = do()
    return out, sum(v for k, v in stages().items() if k not in before)


def test_chance_hits_are_not_shuffled(spark, monkeypatch):
    """Texts half of which is made of phrases that some thirty share: none holds another, as is known from how many of its shingles
    larger ones hold, whatever is known of how rare each is. The links that there are stay."""
    rng = np.random.default_rng(9)
    phrases = [f"a{i} b{i} c{i}" for i in range(3000)]

    def text(i, n):
        return " ".join(f"{p} u{i}v{k}" for k, p in enumerate(rng.choice(phrases, n, replace=False)))

    rows = [(i, text(i, int(rng.integers(20, 110)))) for i in range(1500)]
    rows += [(2000 + i, " ".join(rows[i][1].split()[: 4 * 15])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = stored(df, "docs")  # a shuffle isn't read twice where it is made of what is cached

    def found():
        return sorted(tuple(r) for r in minhash.near_duplicates(df).collect())

    monkeypatch.setattr(minhash, "BUCKET", 8_000)  # sets lie in many buckets
    monkeypatch.setattr(minhash, "SAMPLE", 10)  # too few sets to tell the rare shingles by
    got, shuffled = _shuffled(spark, lambda: [tuple(r) for r in minhash.near_duplicates(df).collect()])
    assert sum(r[3] for r in got) == 80 and all(r[1] == r[0] - 2000 for r in got if r[0] >= 2000)
    assert shuffled < 4_880_000, shuffled  # 4.6 MB; 5.1 MB where hits of sets in no other were shuffled too


def test_numbers_travel_in_planes():
    for x in ([], [0], [3, 255, 7], [1, 70_000, 5], [5, -7, 1 << 40], [1 << 33, 2]):
        x = np.array(x, np.int64)
        assert minhash.wide(pa.chunked_array([[minhash.narrow(x)]]))[0].tolist() == x.tolist()


def test_chunks_and_buckets_meet_seldom():
    """Rows between the chunks and the buckets of op7 are as many as their product; 10 GB of text made six million of them."""
    chunks = [-(-n // suffix_dedup.chunk_size(n)) for n in (1, 10_000_000, 860_000_000, 10_300_000_000)]
    assert chunks[:2] == [1, 3] and chunks[2] <= 64 and chunks[3] ** 2 < 500_000


def test_chunks_of_several_slices(spark, monkeypatch):
    """A chunk's texts are cut out slice by slice, with the same result."""
    rng = np.random.default_rng(1)
    part = "".join(rng.choice(list("abcdefgh "), 200))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 300)))) + part[: int(rng.integers(40, 200))]) for i in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(suffix_dedup.dedup_substrings(df, chunk_bytes=1 << 20).collect())
    many = sorted(suffix_dedup.dedup_substrings(df, chunk_bytes=500).collect())
    assert one == many and sum(r.n_removed for r in one) > 1000 and len(one) == 42
    large = df.unionAll(spark.range(100, 103).selectExpr("id AS doc_id", "repeat(concat(sha2(cast(id AS string), 256), char(id)), 40000) AS text"))
    assert suffix_dedup.chunk_size(7_800_000) < 7_800_000  # three slices, where they are one chunk
    one = sorted(suffix_dedup.dedup_substrings(large, chunk_bytes=64 << 20, with_text=False).collect())
    assert one == sorted(suffix_dedup.dedup_substrings(large, chunk_bytes=500_000, with_text=False).collect())


def test_fitting_takes_little_more_than_its_rows():
    """The classifier's fit works on a part of its pairs at a time; all at once took 20 bytes a pair besides them. The parts give
    what the whole gives."""
    rng = np.random.default_rng(7)
    n = rng.integers(0, 400, 10_000)
    at = np.append(0, np.cumsum(n))
    x = quality.Sparse(at, rng.integers(0, 5_000, at[-1]).astype(np.int32), rng.random(at[-1], np.float32))
    y, w = (rng.random(len(n)) < 0.5).astype(float), rng.normal(size=5_000)
    tracemalloc.start()
    quality.fit(x, y, 5_000, 2)
    quality.log_ratios(x, y, 5_000, 9)
    assert tracemalloc.get_traced_memory()[1] < 8 * at[-1]
    tracemalloc.stop()
    rows = np.repeat(np.arange(len(n)), n)
    assert np.allclose(x.dot(w), np.bincount(rows, x.val * w[x.col], len(n)), rtol=1e-12)
    assert np.allclose(x.sums(y, 5_000), np.bincount(x.col, x.val * y[rows], 5_000), rtol=1e-12)
    some = rng.permutation(len(n))[:7_000]
    own = np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
    part = x.take(some)
    assert (np.diff(part.at) == n[some]).all() and (part.col == x.col[own]).all() and (part.val == x.val[own]).all()


def test_tables_of_powers_follow_the_longest_text():
    """They stay in memory between tasks; a slice a little longer than those before doubled them."""
    p = npwords._Powers(npwords.BASE)
    p.get(1 << 20)
    up, down = p.get((1 << 20) + 5)
    assert len(p.up) < 1.5 * (1 << 20) and (up * down == 1).all() and up[3] == npwords.BASE**3


def test_merges_get_repeated_strings_only(monkeypatch):
    """Of stretches that share a piece, what no other document has isn't merged, nor what several have alike."""
    rng = np.random.default_rng(11)
    passages = [rng.bytes(n) for n in (20, 45, 50, 58, 80)]
    texts = [rng.bytes(int(rng.integers(0, 60))) + passages[i % 5][: 80 if i % 7 else 55] + rng.bytes(int(rng.integers(0, 60))) for i in range(300)]
    data, offsets = npwords.text_arrays(pa.array(texts, pa.binary()))
    key, at, n = suffix_dedup.stretches(data, offsets, 50, 16)
    doc, size = np.searchsorted(offsets, at, "right") - 1, n + 49
    merged, merge = [], suffix_dedup.merge_shards
    monkeypatch.setattr(suffix_dedup, "merge_shards", lambda text, *a: (merged.append(len(text)), merge(text, *a))[1])
    who, first, many = suffix_dedup.lost_strings(key & suffix_dedup.MASK, doc, size, suffix_dedup.taken(data, at, size), 50, 16)
    lost = {(int(doc[w]), int(at[w] + f + k - offsets[doc[w]])) for w, f, m in zip(who, first, many, strict=True) for k in range(m)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        strings = [t[k : k + 50] for k in range(len(t) - 49)]
        want |= {(i, k) for k, x in enumerate(strings) if x in seen}
        seen |= set(strings)
    assert lost == want and len(want) > 1000
    assert sum(merged) < 5000 < size.sum() // 5
