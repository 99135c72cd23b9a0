"""The corpus operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryframe.llm import ann, bwt, components, decontaminate, html_wrapper, line_dedup, minhash, packing, quality, substring_dedup, suffix_dedup, warc
from quarryframe.llm.common import work_path

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with shared passages, copies, near copies, short and odd texts."""
    rng = random.Random(5)
    passage, licence = prose(rng, 60), "Licence: as is, without warranty of any kind"
    docs = []
    for i in range(60):
        t = prose(rng, rng.randint(20, 120))
        if i % 4 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if i % 3 == 0:
            t += "\n  " + (licence.upper() if i % 2 else licence) + "\t"
        docs.append((i, t))
    docs += [(100 + i, docs[i][1]) for i in range(0, 20, 2)]
    for i in range(10):
        w = docs[i + 5][1].split(" ")
        w[len(w) // 2] = "edited"
        docs.append((200 + i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, "   \n\n "), (303, "one"), (304, "é" * 60 + " ünï"), (305, "the the the " * 50), (306, "x\x00y " * 30), (307, "a b c"), (308, prose(rng, 5000))]
    return docs


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns that clash by name with the operators' own, and in letter case."""
    rows = [(i, t, "X", "en", "src", len(t or ""), 7) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, lang string, source string, n_chars long, chunk int").repartition(5)


@pytest.fixture(scope="module")
def messy(spark):
    """Rows that repeat, null ids and null texts."""
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, None), (None, "alpha beta"), (2, None), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# line dedup


def lines_by_hand(corpus, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\f\r"))
    n = Counter()
    for _, t in corpus:
        n.update({key(x) for x in (t or "").split("\n")} - {""})
    out = {}
    for i, t in corpus:
        a = (t or "").split("\n")
        kept = [x for x in a if n[key(x)] < least]
        out[i] = (len(a), len(a) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_line_dedup(spark, docs, corpus, broadcast_keys):
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"))
    runs.add(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_frequent_lines(docs, runs, 10, broadcast_keys).collect()}
    assert got == lines_by_hand(corpus, 10) and any(v[1] for v in got.values())


def test_line_runs_in_batches(spark, docs, corpus):
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"), fanout=2)
    for k in range(5):
        runs.add(docs.filter(F.col("doc_id") % 5 == k))
    assert [lv for lv, _ in runs.runs()] == [2, 0]
    whole = line_dedup.LineRuns(spark, work_path(spark, "runs"))
    whole.add(docs)
    assert {tuple(r) for r in runs.frequent(10).collect()} == {tuple(r) for r in whole.frequent(10).collect()}
    assert line_dedup.LineRuns(spark, work_path(spark, "runs")).frequent(1).count() == 0
    new = spark.createDataFrame([(1, corpus[0][1] + "\nnever seen")], "doc_id long, text string")
    assert [r.line for r in runs.new_lines(new).collect()] == ["never seen"]


@pytest.mark.parametrize("fanout", [2, 3])
def test_line_dedup_by_batches(spark, docs, corpus, fanout):
    """The query's way: batches anti-joined with what is settled, runs compacted."""
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"), fanout)
    runs.add_in_batches(docs, 4, settled=10)
    assert [lv for lv, _ in runs.runs()] == ([2] if fanout == 2 else [1, 0])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_frequent_lines(docs, runs, 10).collect()}
    assert got == lines_by_hand(corpus, 10)
    # a key of many documents stops being added
    same = spark.createDataFrame([(i, "a line of all") for i in range(400)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"), 99)
    runs.add_in_batches(same, 4, settled=10)
    assert 50 < runs.read().agg(F.sum("n")).first()[0] < 150 and runs.read().count() == 1


def test_line_dedup_edges(spark, messy, empty):
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"))
    runs.add(messy)
    got = sorted(((r.doc_id, r.n_dropped, r.kept) for r in line_dedup.drop_frequent_lines(messy, runs, 3).collect()), key=str)
    assert got == sorted([(1, 1, ""), (1, 1, ""), (None, 0, ""), (None, 1, ""), (2, 0, ""), (2, 0, "")], key=str)
    assert line_dedup.drop_frequent_lines(empty, runs, 3).count() == 0
    once = line_dedup.LineRuns(spark, work_path(spark, "runs"))
    once.add(messy, distinct_texts=True)
    assert once.frequent(2).count() == 0


def test_whole_rows_keep_their_columns(spark, docs):
    runs = line_dedup.LineRuns(spark, work_path(spark, "runs"))
    runs.add(docs)
    out = line_dedup.without_frequent_lines(docs, runs, 10)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert all(r.n_chars == len(r.text or "") and r.TEXT == "X" for r in out.collect())


# windows of words


def windows_by_hand(corpus, k, seen=None):
    seen, out = dict(seen or {}), {}
    for i, t in sorted(corpus, key=lambda x: x[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if g in seen:
                gone[j : j + k] = [True] * k
            seen[g] = i
        out[i] = (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y))
    return out, seen


@pytest.mark.parametrize(("window", "shingle", "chunk"), [(20, 8, 4000), (20, 8, 1 << 22), (5, 2, 3000)])
def test_substring_dedup(spark, docs, corpus, window, shingle, chunk):
    index = substring_dedup.FingerprintIndex.for_docs(docs, work_path(spark, "fp"), chunk, window=window, shingle=shingle)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup_windows(docs, index).collect()}
    want = windows_by_hand(corpus, window)[0]
    assert got == want and sum(v[1] for v in got.values()) > 500


def test_substring_dedup_in_batches(spark, docs, corpus):
    index = substring_dedup.FingerprintIndex.for_docs(docs, work_path(spark, "fp"), 3000, fanout=2)
    first, second = docs.filter("doc_id < 100"), docs.filter("doc_id >= 100")
    substring_dedup.dedup_windows(first, index).count()
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup_windows(second, index, first).collect()}
    assert got == {i: v for i, v in windows_by_hand(corpus, 20)[0].items() if i >= 100}
    assert [lv for lv, _ in index.runs()] == [1]


def test_substring_dedup_by_batches(spark, docs, corpus):
    """The query's way: one table as several batches, merge-joined with the runs before and compacted."""
    index = substring_dedup.FingerprintIndex.for_docs(docs, work_path(spark, "fp"), 3000, fanout=2)
    assert index.n_chunks > 8
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup_windows(docs, index, batches=5).collect()}
    assert got == windows_by_hand(corpus, 20)[0]
    assert [lv for lv, _ in index.runs()] == [2, 0]


def test_substring_dedup_edges(spark, messy, empty):
    text = " ".join(map(str, range(25)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex.for_docs(rows, work_path(spark, "fp"))
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.dedup_windows(rows, index).collect()) == [("1", 0), ("1", 25), ("2", 0), ("None", 25)]
    for df in (messy, empty):
        index = substring_dedup.FingerprintIndex.for_docs(df, work_path(spark, "fp"))
        assert substring_dedup.dedup_windows(df, index).count() == df.count()


# byte strings


def strings_by_hand(corpus, k):
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in corpus}
    for i in sorted(data):
        for j in range(len(data[i]) - k + 1):
            first.setdefault(data[i][j : j + k], i)
    for i, b in data.items():
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if first[b[j : j + k]] < i:
                gone[j : j + k] = b"\1" * k
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("length", "piece", "chunk", "hot"), [(50, 16, 4000, 10_000), (50, 16, 1 << 22, 10_000), (50, 16, 4000, 2), (12, 4, 5000, 10_000)])
def test_suffix_dedup(docs, corpus, length, piece, chunk, hot):
    out = suffix_dedup.dedup_substrings(docs, length, piece, chunk, hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}
    assert got == strings_by_hand(corpus, length) and all(r.kept_sha256 == sha(bytes(r.kept)) for r in out)


def test_suffix_dedup_edges(spark, messy, empty):
    text = "".join(map(str, range(100)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (3, "a\x00" * 40), (4, "a\x00" * 40)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup_substrings(rows).collect())
    assert got == [("1", 0), ("1", 0), ("3", 0), ("4", 80), ("None", len(text))]
    for df in (messy, empty):
        assert suffix_dedup.dedup_substrings(df).count() == df.count()


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_merged_transforms(shards):
    rng = random.Random(shards)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(12)] + [b"a\x00b", b"abab" * 6] * 2
    data = np.frombuffer(b"".join(strings), np.uint8)
    depth = 8
    text, places, block, lcp = bwt.merge_shards(data, np.cumsum([len(s) for s in strings]), depth, shards)
    assert sorted(places.tolist()) == list(range(len(text)))

    def head(p):
        out = text[p : p + depth].tolist()
        return out[: out.index(0) + 1] if 0 in out else out

    heads = [head(p) for p in places]
    assert heads == sorted(heads)
    for i in range(1, len(heads)):
        same = 0
        while same < depth and same < min(len(heads[i]), len(heads[i - 1])) and heads[i][same] == heads[i - 1][same]:
            same += 1
        assert (block[i] == block[i - 1]) == (heads[i] == heads[i - 1])
        if heads[i] != heads[i - 1]:
            assert lcp[i] == same


# near duplicates


def classes_by_hand(corpus, s):
    sets = {}
    for i, t in corpus:
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(zip(*[w[k:] for k in range(s.shingle)], strict=False)) if len(w) >= s.shingle else frozenset([tuple(w)] if w else [])
    same = defaultdict(list)
    for i in sets:
        same[sets[i]].append(i)
    reps = {min(v): k for k, v in same.items()}
    links, parent = defaultdict(set), {r: r for r in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in reps:
        for b in reps:
            x, y = reps[a], reps[b]
            if a != b and x and len(x) <= len(y) <= s.max_ratio * len(x) and len(x & y) >= s.containment * len(x):
                links[a].add(b)
                links[b].add(a)
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (find(min(v)), len(v) - 1, len(links[min(v)])) for v in same.values() for i in v}


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(block=4), minhash.Settings(containment=0.5, max_ratio=1.5, n_hashes=512)])
def test_near_duplicates(docs, corpus, settings):
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in minhash.near_duplicates(docs, settings).collect()}
    want = classes_by_hand(corpus, settings)
    assert got == want and sum(v[2] > 0 for v in want.values()) >= 10
    kept = minhash.keep_one(docs, settings)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v[0] for v in want.values()}


def test_near_duplicates_edges(messy, empty):
    got = sorted(str((r.doc_id, r.class_id, r.n_copies)) for r in minhash.near_duplicates(messy).collect())
    assert got == sorted(map(str, [(1, 1, 1), (1, 1, 1), (None, None, 0), (None, None, 0), (2, 2, 1), (2, 2, 1)]))
    assert minhash.near_duplicates(empty).count() == 0


def test_dense_groups_are_checked_whole(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)] = f"z{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in minhash.near_duplicates(df).collect()}
    assert got == classes_by_hand(rows, minhash.Settings()) and got[0][2] == 59


def test_containment_across_sizes(spark):
    rng = random.Random(3)
    long, other = [f"a{i}" for i in range(2000)], [f"b{i}" for i in range(1500)]
    part = long[100:140]
    bent = [w if i % 9 else f"z{rng.random()}" for i, w in enumerate(part)]  # contained to 75 % or more, or not
    rows = [(1, part), (2, long), (3, long[300:700]), (4, other + part), (5, bent), (6, ["a7", "a8"]), (7, long[300:340]), (8, ["c1", "c2"]), (9, [*long[:-1], "end"])]
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash.near_duplicates(df).collect()}
    s = minhash.Settings()
    by_hand = classes_by_hand(rows, s)
    assert {i: v[1] for i, v in got.items()} == {i: v[2] for i, v in by_hand.items()} and got[1][1] >= 3
    # passages go into the class of the largest text that holds them, and don't join texts that share one
    assert {i: v[0] for i, v in got.items()} == {**dict.fromkeys((1, 2, 3, 6, 7, 9), 2), 4: 4, 8: 8, 5: 2 if by_hand[5][2] else 5}
    assert {r.doc_id for r in minhash.keep_one(df).collect()} == {v[0] for v in got.values()}


def test_rows_of_one_id_are_judged_one_by_one(spark):
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    rows = [(1, one, "a"), (9, one, "b"), (9, other, "c"), (None, one, "d"), (9, other, "e")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, note string"))
    assert sorted(r["note"] for r in kept.collect()) == ["a", "c", "d", "e"]


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (6, 3), (20, 21), (22, 20), (23, 22), (24, 23)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), one_task).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 6, 7, 8), 1), 4: 4, 5: 4, **dict.fromkeys(range(20, 25), 20)}


# decontamination


def least_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        last, row = row, [i + 1]
        for j, d in enumerate(t):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_myers_and_pieces_by_hand():
    rng = random.Random(3)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc ") for _ in range(n)).strip() or "a" for n in (rng.randint(8, 40), rng.randint(5, 150)))
        if rng.random() < 0.7:
            q = list(p)
            for _ in range(rng.randint(0, 4)):
                q[rng.randrange(len(q))] = rng.choice(["", "x", "ab"])
            t += "".join(q) + "cab"
        t, p = decontaminate.normalise(t), decontaminate.normalise(p)
        assert decontaminate.myers(decontaminate.bits(p), len(p), t) == min(least_distance(p, t), len(p))
        found = decontaminate.Items([(1, p)], 0.15).matches(t)
        best = least_distance(p, t)
        assert found == ({0: best} if best <= int(0.15 * len(p)) else {})


@pytest.mark.parametrize("block_chars", [1 << 20, 150])
def test_contaminated(spark, docs, corpus, block_chars):
    items = [(1, corpus[7][1][20:140]), (2, "  " + corpus[9][1][10:120].upper().replace("W1", "Q1", 1)), (3, "nothing of the kind anywhere here"), (4, None), (5, " "), (6, corpus[7][1][20:140])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench, block_chars=block_chars).collect()}
    want = {}
    for i, t in corpus:
        for n, x in items:
            p, t2 = decontaminate.normalise(x), decontaminate.normalise(t)
            if p and (p in t2 or len(t2) < 900):
                d = 0 if p in t2 else least_distance(p, t2)
                if d <= int(0.1 * len(p)):
                    want[i, n] = d
    assert got == want and {n for _, n in got} == {1, 2, 6}
    kept = decontaminate.remove_contaminated(docs, bench, block_chars=block_chars)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in corpus} - {i for i, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.remove_contaminated(docs, none).count() == len(corpus)


# packing


def test_packing(docs, corpus, messy, empty):
    caps = (32, 64, 128)
    rows = packing.pack(docs, capacities=caps, shard_docs=20).collect()
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.bin_no is not None:
            bins[r.shard, r.bin_no].append(r)
    for i, size in n.items():
        p = sorted(pieces[i], key=lambda r: r.piece_no)
        assert sum(r.length for r in p) == size and all(r.piece_start == r.piece_no * 128 for r in p)
    for b in bins.values():
        used, cap = sum(r.length for r in b), {r.capacity for r in b}
        assert len(cap) == 1 and min(c for c in caps if c >= used) == cap.pop()
        spans = sorted((r.bin_offset, r.length) for r in b)
        assert all(x[0] + x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert sum(r.length for r in rows) / sum(b[0].capacity for b in bins.values()) > 0.95
    assert packing.pack(empty).count() == 0
    assert sorted((str(r.doc_id), r.copy_no, r.length) for r in packing.pack(messy).collect()) == [("1", 0, 2), ("1", 1, 2), ("2", 0, 0), ("2", 1, 0), ("None", 0, 0), ("None", 0, 2)]


def test_best_fit_by_hand():
    where, offset, caps = packing.pack_lengths([60, 50, 40, 10, 4], [64, 100])
    assert (where, offset, caps) == ([0, 1, 0, 1, 1], [0, 0, 60, 50, 60], [100, 64])


# archives


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 700_000 + "</p>"
    rows = [(1, "http://a/x y\r\nZ", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"), (7, "http://c/", None), (8, "http://d/%20", ""), (9, "u", big), (9, "u", big), (None, "n", "<i>n</i>"), (11, "e", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    typed = warc.with_record_types(pages)
    chunks = warc.read_chunks(warc.write_warc(typed, f"file://{tmp_path}/w", file_bytes=2000), chunk_bytes=100_000)
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) for r in warc.records(chunks).collect()), key=str)
    keep = {"<p>same</p>": 5, "": 8}
    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        last = keep.get(h or "", i)
        want.append((i, u, len(body), warc.b32(hashlib.sha1(body).digest()), "response" if last == i else "revisit", None if last == i else last, True))
    assert got == sorted(want, key=str)
    parts = chunks.filter("page_id = 9").orderBy("path", "record_no", "chunk_no").collect()
    assert len(parts) == 2 * 15 and b"".join(bytes(r.data) for r in parts) == 2 * big.encode() and max(len(r.data) for r in parts) <= 100_000
    own = warc.with_record_types(pages, min_bytes=1, broadcast_groups=0)
    assert {r.page_id: r.record_type for r in own.collect()}[7] == "response"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(warc.read_chunks(warc.write_warc(warc.with_record_types(none), f"file://{tmp_path}/none"))).count() == 0


def test_broken_archives_are_noticed(tmp_path):
    import zlib

    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = z.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc") + z.flush()
    (tmp_path / "x").write_bytes(raw)
    for cut in (len(raw), len(raw) - 9):
        (tmp_path / "x").write_bytes(raw[:cut])
        with open(tmp_path / "x", "rb") as f, pytest.raises(EOFError):
            list(warc.records_of(f, 10))


# neighbours


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, 24)), rng.normal(size=24) + 0.01 * rng.normal(size=(1500, 24))]).astype(np.float32)
    x[10:14] = x[9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 23), (9004, [float("nan")] + [1.0] * 23), (9005, [float("inf")] + [1.0] * 23), (9006, [None] + [1.0] * 23), (None, [1.0] * 24), (20, rows[20][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    out = ann.search(df, df.filter("vec_id % 50 = 0"), 20, ann.Settings(bucket_rows=200, part_rows=3000, sample_rows=2000)).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    hits = 0
    for q in range(0, 4500, 50):
        s = d @ d[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:20]
        got = [v for v, _ in by[q]]
        assert len(set(got)) == 20 and q not in got and max(got) < 9000
        assert np.allclose([z for _, z in by[q]], s[got]) and all(a[1] >= b[1] for a, b in zip(by[q], by[q][1:], strict=False))
        hits += len(set(got) & set(true.tolist()))
    assert hits / (90 * 20) >= 0.9 and len(by) == 90
    few = df.filter("vec_id < 5")
    assert [r.n for r in ann.search(few, few, 20).groupBy("query_id").agg(F.count("*").alias("n")).collect()] == [4] * 5
    assert ann.search(df.filter("vec_id > 9000 and vec_id < 9003"), df).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id = 7"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_index_at_fifty_thousand_rows(spark):
    """No size is searched by brute force: a query visits under a third of the rows, by its own buckets, and still finds
    nine of ten."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50_000, 64))
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    out = ann.search(df, df.filter("vec_id % 1000 = 0"), 20).toPandas()
    q = x[::1000].astype(float)
    score = q @ x.T.astype(float)
    score[np.arange(50), np.arange(0, 50_000, 1000)] = -9
    true = np.argsort(-score, 1, kind="stable")[:, :20]
    found = {i: set(g.vec_id) for i, g in out.groupby("query_id")}
    assert np.mean([len(found[i * 1000] & set(t.tolist())) / 20 for i, t in enumerate(true)]) >= 0.9
    s = ann.Settings()
    m = ann.tune(x[::3].astype(float), 1.0, len(x), 20, s)
    h = ann.Hashes(64, m.functions, s)
    cells = h.cells(m.clip(h.slots(h.project(ann.augment(x.astype(float), 1.0 + 1e-6)))))
    p = h.project(ann.augment_query(q[:10]))
    share = []
    for r, own in zip(h.ratios(p, m), h.slots(p), strict=True):
        visited, _ = h.probes(r, own, m)
        share.append(np.isin(cells, visited).any(1).mean())
    assert m.functions > 4 and np.mean(share) < 1 / 3


def test_short_queries_are_finished_exactly(spark):
    """Buckets that hold too few rows don't shorten an answer."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann.search(df, df.filter("vec_id % 100 = 0"), 20, ann.Settings(max_probes=1, recall=0.2, exact_block=2)).toPandas()
    d = x.astype(float)
    for i, g in out.sort_values("rank").groupby("query_id"):
        assert len(g) == 20 and list(g["rank"]) == list(range(1, 21))
    s = d @ d[0]
    s[0] = -np.inf
    ids = out[out.query_id == 0].sort_values("rank").vec_id.tolist()
    assert len(set(ids) & set(np.argsort(-s, kind="stable")[:20].tolist())) >= 4


def test_probes_come_in_order_of_their_success():
    s = ann.Settings(tables=1, width=1.0)
    h = ann.Hashes(5, 3, s)
    rng = np.random.default_rng(1)
    m = ann.Model(3, 1, np.full(3, -3), np.full(3, 2), 0.5, 0.8, np.log(np.full((3, 6), 1 / 6)), -4.0)
    p = rng.normal(size=(1, 3))
    r, own = h.ratios(p, m)[0], np.clip(h.slots(p)[0], -3, 2)
    cells, prefixes = h.probes(r, own, m)
    every = sorted(((r[0, a] + r[1, b] + r[2, c], np.array([[a - 3, b - 3, c - 3]])) for a in range(6) for b in range(6) for c in range(6)), key=lambda v: -v[0])
    want = [int(h.cells(slot)[0, 0]) for total, slot in every if total >= m.least]
    assert [int(c) for c in cells[: len(want)]] == want and int(h.cells(own[None])[0, 0]) in cells.tolist()
    heads = {int(h.cells(slot)[0, 0]): int(h.cells(slot, 1)[0, 0]) for _, slot in every}
    assert [heads[int(c)] for c in cells] == [int(v) for v in prefixes]


# pages


def page(body, i, extra=""):
    return f"<!doctype html><html><head><title>T{i}</title><script>if(a<b)'</p>'</script></head><body><nav><ul><li><a href='/'>Home</a><li>More</ul></nav><div class='cookie-notice'>We use cookies</div>{extra}<div id=content><h1>Title {i}</h1>{body}<div>Share this article</div></div><div class=comments><article class=comment>Nice &amp; good</article></div><footer>(c)</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://Host.example/{i}", page(f"<p>Text {i} with <b>bo</b>ld &amp;amp; &eacute;<br>line<p>More\n\n of {i}", i, "<form>q</form>" if i % 3 else "<aside>side</aside>")) for i in range(20)]
    rows += [(100, None, None), (101, "nonsense", ""), (102, "http://x.example/", "just <i>te</i>xt <!-- no --> &lt;tag&gt;"), (103, "http://y.example/", "<nav>menu<article><p>cut off"), (104, "http://z.example", "<div>" * 3000 + "deep")]
    for size in (1 << 20, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), size).collect()}
        for i in range(20):
            assert got[i][0] == f"Title {i} Text {i} with bold &amp; é line More of {i}"
        assert [got[i][0] for i in range(100, 105)] == ["", "", "just text <tag>", "cut off", "deep"]
        assert all(n == len(t) for t, n in got.values())


def test_wrapper_alignment():
    a, b = html_wrapper.page_tree("<div><h2>A</h2><p>1<p>2</div>"), html_wrapper.page_tree("<div><p>1<p>3<p>4<ul><li>x</ul></div>")
    w = html_wrapper.merge(a, b)
    assert [(c.label, c.often) for c in w.children[0].children] == [("h2", "?"), ("p", "+"), ("ul", "?")]
    slot = w.children[0].children[1].children[0]
    assert slot.label == "#" and slot.value is None
    assert html_wrapper.Node.load(w.dump()) == w


def texts_of(pages):
    w = None
    for p in pages:
        tree = html_wrapper.page_tree(p)
        w = tree if w is None else html_wrapper.merge(w, tree)
    r = html_wrapper.Region.load(html_wrapper.region(html_wrapper.Node.load(w.dump())).dump())
    return [html_wrapper.extract(p, r) for p in pages]


@pytest.mark.parametrize("name", ["widget-content", "story related", "search result", "header-content", "share article", "alert"])
def test_articles_named_like_asides(name):
    pages = [f"<body><nav>Home</nav><div class='{name}'><h1>Title {i}</h1><p>The article number {i} and all of its long text</p></div><div class='related'><a>Other {i}</a></div><footer>(c)</footer></body>" for i in range(12)]
    assert texts_of(pages) == [f"Title {i} The article number {i} and all of its long text" for i in range(12)]
    assert html_wrapper.extract(pages[3], None) == "Title 3 The article number 3 and all of its long text"


def test_plain_blocks():
    pages = [f"<body><div>Home News</div><div><h1>Title {i}</h1><p>Words of {i}</p><p>and more of them</p></div><div>Copyright us</div></body>" for i in range(20)]
    pages[7] = pages[7].replace("<div>Home News</div>", "<div>Home News</div><div>Extra menu</div>")
    assert texts_of(pages) == [f"Title {i} Words of {i} and more of them" for i in range(20)]


def test_host_texts_go_by_their_place():
    note = "Read our terms. " * 60
    pages = [f"<body><article><h1>Title {i}</h1><p>Word {i}</p><p>{note.strip() if i == 4 else 'x'}</p><div class=legal><span>{note}</span></div></article></body>" for i in range(20)]
    got = texts_of(pages)
    assert got[4] == f"Title 4 Word 4 {note.strip()}" and got[5] == "Title 5 Word 5 x"


def test_long_lists_are_aligned_in_time():
    import time

    rng = random.Random(3)
    tags = ["p", "h2", "ul", "pre", "table", "blockquote"]
    lists = ["".join(f"<{t}>{rng.random()}</{t}>" for t in rng.choices(tags, k=6_000)) for _ in range(2)]
    began = time.time()
    w = html_wrapper.merge(*(html_wrapper.page_tree(f"<article>{x}</article>") for x in lists))
    assert time.time() - began < 30
    got = html_wrapper.extract(f"<article>{lists[0]}</article>", html_wrapper.region(w))
    assert got == " ".join(re.findall(r">([\d.e-]+)<", lists[0]))


def test_steps_align():
    for a, b in (("abcd", "abxcd"), ("abc", ""), ("", "ab"), ("aabbcc", "abc"), ("xyz", "abc")):
        steps = list(html_wrapper._steps(list(a), list(b)))
        assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in steps if i is not None and j is not None)
    assert sum(i is not None and j is not None for i, j in html_wrapper._steps(list("abcd"), list("abxcd"))) == 4


def test_html_edges(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "k"), (1, "http://a/1", "<p>x</p>", "k"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string")
    assert sorted((r.page_id or 0, r.text) for r in html_wrapper.main_text(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html_wrapper.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [60, 3000])
def test_articles_under_many_blocks(spark, depth):
    html = lambda i: "<div class=title><h1>Heading</h1></div>" + "<div>" * depth + f"<p>The whole article {i}</p><p>and its end</p>" + "</div>" * depth
    rows = [(i, "http://deep.example/", html(i)) for i in range(10)]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(f"The whole article {i} and its end" in got[i] for i in range(10))


# quality


def quality_rows(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = [rng.choice(WORDS) for _ in range(60)]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["clown", "moron"])
        rows.append((i, " ".join(words), "good.example" if kind in (0, 3) else "bad.example", "en"))
        if i % 2 or i % 5 == 0:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return rows, labels


def test_quality(spark, docs, messy, empty):
    rows, labels = quality_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    lab = spark.createDataFrame([*labels, (1, None, 0), (labels[0][0], labels[0][1], labels[0][2])], "doc_id long, quality int, toxic int")
    s = quality.Settings(max_labelled=400, per_round=50, steps=60)
    model = quality.train(d, lab, s)
    out = {r.doc_id: r for r in quality.classify(d, model, s).collect()}
    known = {x[0] for x in labels}
    fresh = [i for i in range(600) if i not in known]
    right = sum(out[i].keep == (i % 4 in (0, 3)) for i in fresh)
    assert len(out) == 600 and right / len(fresh) > 0.95
    assert quality.train(d, lab, s) == model
    kept = quality.reject(d, lab, s)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].keep}
    assert quality.classify(docs, model, s).count() == docs.count() and quality.classify(messy, model, s).count() == 6
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(d, no_labels, s) is None and quality.reject(d, no_labels, s).count() == 600
    assert quality.classify(empty, model, s).count() == 0
    assert all(r.keep and r.score is None for r in quality.classify(messy, None).collect())
