"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut at the largest permitted length, spread over shards of bounded size by hash, and packed in each shard by
decreasing length: a piece goes into the open bin that it leaves fullest; if none takes it, that permitted length is opened
which costs least once the pieces still to come are reckoned as filling; at last every bin shrinks to the smallest
permitted length that holds its contents. Only lengths travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

CAPACITIES = (512, 1024, 2048, 4096)
PIECES = "doc_id long, copy_no long, piece_no int, piece_start long, length int, shard long, bin_no int, capacity int, bin_offset int"
_ARROW = {"long": pa.int64(), "int": pa.int32()}
PIECES_ARROW = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in PIECES.split(", ")])


def n_words(text: Column) -> Column:
    """Runs of other than space and \\x09-\\x0D: the default length of a document."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def token_counter(vocabulary: str, pattern: str):
    """An Arrow-batched length by a byte-level BPE file of ranks (base64 and rank per line), for pack(length=...). The file is
    read on each executor from its path."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def count(texts: Iterator) -> Iterator:
        import base64

        import pandas as pd
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in texts:
            yield pd.Series([0 if t is None else len(bpe.encode_ordinary(t)) for t in s], dtype="int64")

    count.__annotations__ = {}
    return count


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int], prices: Sequence[float] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bins of pieces given in non-increasing length, each at most the largest capacity: (bin of each piece, its offset in
    the bin, capacity of each bin). prices: of a bin of each capacity, else the capacity itself plus 2 % of the largest."""
    caps = sorted(capacities)
    top = caps[-1]
    price = dict(zip(sorted(capacities), prices, strict=True)) if prices else {c: c + 0.02 * top for c in caps}
    per_token = min(price[c] / c for c in caps)
    left_over = sum(lengths)
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms = 0  # bit r: a bin with r left is open
    used: list[int] = []
    bin_of, offset = [], []
    for n in lengths:
        left_over -= n
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            # an open bin's rest counts as filled as far as later pieces reach
            best = min((price[c] - per_token * min(c - n, left_over), -c) for c in caps[bisect_left(caps, n) :])
            room, b = -best[1], len(used)
            used.append(0)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += n
        room -= n
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bin_of, offset, [caps[bisect_left(caps, u)] for u in used]


def pack(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, prices: Sequence[float] | None = None, shard_docs: int = 50_000) -> DataFrame:
    """One row per piece of every document: doc_id, copy_no, piece_no, piece_start, length, shard, bin_no, capacity, bin_offset.

    A document longer than the largest capacity is cut there, nothing is dropped. A document of length 0 (null or blank
    text) is one piece without bin, offset and capacity. Rows that repeat a doc_id are told apart by copy_no, from 0 in order
    of length; null doc_ids are packed likewise. Shards hold about shard_docs documents, so that an equal table gives equal
    bins on any cluster."""
    d = columns(docs, doc_id="long", text="string")
    d = d.select("doc_id", (n_words(F.col("text")) if length is None else length).cast("long").alias("n"))
    # copies of an id are counted before they are spread, so that no id, null or other, makes a hot shard
    per = d.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    n_shards = max(1, -(-docs.count() // shard_docs))
    rows = per.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy_no"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "copy_no"), F.lit(n_shards)))
    top = max(capacities)

    def pack_shard(t: pa.Table) -> pa.Table:
        doc, n, copy, shard = (t.column(c).combine_chunks() for c in ("doc_id", "n", "copy_no", "shard"))
        n = n.to_numpy(zero_copy_only=False)
        pieces = np.maximum(-(-n // top), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * top, top)
        ids = doc.fill_null(-1).to_numpy()[row]
        order = np.lexsort((piece, copy.to_numpy()[row], ids, -size))
        real = order[size[order] > 0]
        bin_of, offset, caps = pack_lengths(size[real].tolist(), capacities, prices)
        no = np.full((3, len(row)), -1)
        no[0, real], no[1, real] = bin_of, offset
        no[2, real] = np.asarray(caps or [0])[np.asarray(bin_of, int)]
        blank = no[0] < 0
        at = pa.array(row)
        return pa.table(
            [doc.take(at), copy.take(at), pa.array(piece, pa.int32()), pa.array(piece * top, pa.int64()), pa.array(size, pa.int32()), shard.take(at)]
            + [pa.array(no[k], pa.int32(), mask=blank) for k in (0, 2, 1)],
            schema=PIECES_ARROW,
        )

    return rows.groupBy("shard").applyInArrow(pack_shard, PIECES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
