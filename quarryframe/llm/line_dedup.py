"""Line deduplication over levelled sorted runs of line hashes. Native: DataFrame functions only.

A run is an immutable Parquet folder of (h1, h2, n): the 128-bit hash of a line's key and the number of documents of the
batches in it that hold the key, sorted by hash within partitions. A batch adds one run at level 0; as soon as a level
holds `fanout` runs they merge into one run of the next level. A reader only ever sees folders with _SUCCESS, and a merged
run replaces its parts through its name, so a job that dies halfway leaves the former state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, delete_dir, list_dirs, table, work_path

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys up to this count are broadcast (32 MB of hashes); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: The query puts its table in as so many batches.
BATCHES = 4


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() gives the same for ASCII text and is quicker there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The array of (h1, h2, n_chars of the key is 0) of a text's lines."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: _hashes(F.btrim(x, F.lit(BLANK))))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), (key == "").alias("empty"))


class LineRuns:
    """The levelled index. min_chars is the least length of a key that counts."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def runs(self) -> list[tuple[int, str]]:
        """(level, folder) of the live runs. A folder is named L<level>-<first batch>-<last batch>; one whose batches lie
        within those of a higher level is a leftover of a finished merge."""
        found = []
        for name in list_dirs(self.spark, self.path):
            level, first, last = (int(x) for x in name[1:].split("-"))
            found.append((level, first, last, name))
        live = [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        return [(r[0], r[3]) for r in sorted(live, key=lambda r: r[1])]

    def read(self, names: list[str] | None = None) -> DataFrame | None:
        names = [n for _, n in self.runs()] if names is None else names
        if not names:
            return None
        return reduce(DataFrame.unionAll, [self.spark.read.schema("h1 long, h2 long, n long").parquet(f"{self.path}/{n}") for n in names])

    def _write(self, df: DataFrame, name: str) -> None:
        df.sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame, distinct_texts: bool = False, settled: int | None = None) -> str:
        """Adds a batch as one sorted run, then merges full levels. With distinct_texts, equal texts of the batch count once.

        With settled, keys that the runs hold in so many documents already are decided: the batch is merge-anti-joined with
        them, and only its other keys are added, so that the hot lines of a corpus aren't written with every batch."""
        batch = max([int(n.split("-")[2]) for _, n in self.runs()], default=-1) + 1
        name = f"L0-{batch}-{batch}"
        counts = document_counts(docs, distinct_texts=distinct_texts)
        if settled is not None and batch:
            counts = counts.join(self.frequent(settled).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, name)
        self.compact()
        return name

    def add_in_batches(self, docs: DataFrame, batches: int, settled: int | None = None) -> None:
        """Adds a table as several batches by a hash of doc_id, each a run of its own."""
        d = columns(docs, doc_id="long", text="string")
        for i in range(batches):
            self.add(d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), settled=settled)

    def compact(self) -> None:
        level = 0
        while True:
            live = self.runs()
            same = [n for lv, n in live if lv == level]
            if len(same) >= self.fanout:
                merged = self.read(same).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
                first, last = same[0].split("-")[1], same[-1].split("-")[2]
                self._write(merged, f"L{level + 1}-{first}-{last}")
                for n in same:
                    delete_dir(self.spark, f"{self.path}/{n}")
            elif level >= max([lv for lv, _ in live], default=0):
                return
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys in at least min_docs documents of all batches."""
        names = [n for _, n in self.runs()]
        all_runs = self.read(names)
        if all_runs is None:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        if len(names) > 1:
            all_runs = all_runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        return all_runs.filter(F.col("n") >= min_docs).select("h1", "h2")

    def new_lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, pos, line of a batch's lines whose key no earlier batch holds: a merge anti-join with the runs."""
        d = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
        lines = d.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", "\n", -1).alias("line"), line_keys(F.col("text")).alias("k"))).alias("pos", "z"))
        lines = lines.select("doc_id", "pos", "z.line", "z.k.h1", "z.k.h2")
        seen = self.read()
        if seen is not None:
            lines = lines.join(seen.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines.select("doc_id", "pos", "line")


def document_counts(docs: DataFrame, min_chars: int = 1, distinct_texts: bool = False) -> DataFrame:
    """(h1, h2, n): for each key of at least one code point, how many rows of docs, or different texts, hold it."""
    d = columns(docs, doc_id="long", text="string")
    keys = F.array_distinct(line_keys(F.coalesce("text", F.lit(""))))
    if min_chars > 0:
        keys = F.filter(keys, lambda k: ~k["empty"])
    if distinct_texts:
        lines = d.select(F.xxhash64("text").alias("t"), F.explode(keys).alias("k"))
        return lines.select("t", "k.h1", "k.h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return d.select(F.explode(keys).alias("k")).groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"))


def drop_frequent_lines(docs: DataFrame, runs: LineRuns, min_docs: int, broadcast_keys: int = BROADCAST_KEYS, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_lines (all), n_dropped, kept (text of the lines that stay) for every row of docs; with whole_rows also `row`,
    a struct of all columns in their order, c0, c1 and so on.

    Null text is one empty line. Empty keys are never dropped. A row that repeats another counts as a document of its own
    and is returned again; a null doc_id is kept as such. Frequent keys are broadcast only when counted to be at most
    `broadcast_keys`; otherwise the hashes shuffle, and adaptive execution splits the partition of a hot key."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    row = [F.struct(*safe.columns).alias("row")] if whole_rows else []
    d = safe.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *row)
    hot = runs.frequent(min_docs)
    few = hot.limit(broadcast_keys + 1).count() <= broadcast_keys
    hot = F.broadcast(hot) if few else hot
    d = d.withColumn("t", F.xxhash64("text"))
    lines = d.select("doc_id", "t", F.posexplode(line_keys(F.col("text"))).alias("pos", "k")).filter(~F.col("k.empty"))
    hits = lines.select("doc_id", "t", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).join(hot, ["h1", "h2"], "left_semi")
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("t2")).agg(F.collect_set("pos").alias("drop"))
    joined = d.join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("t2")), "left")
    rest = ["row"] if whole_rows else []
    joined = joined.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"), *rest)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.size("drop") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), kept.alias("kept"), *rest)


def without_frequent_lines(docs: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """docs, with all columns, without their frequent lines; n_chars, if there, follows the text. Rows of which nothing but
    blanks is left, though they had text, go. A row that loses no line is as it was."""
    names = docs.columns
    out = drop_frequent_lines(docs, runs, min_docs, whole_rows=True)
    out = out.filter((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(BLANK)) != ""))
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    first = {n: names.index(n) for n in new if n in names}
    cols = [F.when(changed, new[n].cast(docs.schema[i].dataType)).otherwise(F.col(f"row.c{i}")) if first.get(n) == i else F.col(f"row.c{i}") for i, n in enumerate(names)]
    return out.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).toDF(*names)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = LineRuns(spark, work_path(spark, "line-runs"))
    runs.add_in_batches(docs, BATCHES, settled=10)
    out = drop_frequent_lines(docs, runs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH s AS (SELECT doc_id, split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM s),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE key IN (SELECT key FROM hot)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
