"""Full-text search: postings, BM25, phrases, fuzzy and regular-expression terms, paging."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer, query_terms, stemmed, tokens

K1, B = 1.5, 0.75
Idf = Callable[[Column, Column], Column]


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


@dataclass
class TextIndex:
    """postings (term, doc, tf, positions, dl) and stats (one row: n_docs, avgdl). Postings are clustered by term where they
    are stored, so that a query reads the files of its terms.

    An index that isn't stored still has its texts as `tokens` (doc, toks). A query then reads the few terms it needs from the
    token arrays, in one pass without a shuffle, instead of making postings of all terms first."""

    postings: DataFrame
    stats: DataFrame
    analyzer: Analyzer
    tokens: DataFrame | None = None

    def persist(self) -> TextIndex:
        self.postings.persist()
        self.stats.persist()
        return TextIndex(self.postings, self.stats, self.analyzer)

    def save(self, path: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str, analyzer: Analyzer = Analyzer()) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), analyzer)

    def of_terms(self, terms: list[str]) -> DataFrame:
        """(term, doc, tf, dl) of some terms."""
        wanted = sorted(set(terms))
        if self.tokens is None or not wanted:
            return self.postings.filter(F.col("term").isin(wanted)).select("term", "doc", "tf", "dl")
        t = F.col("toks")
        found = F.array(*[F.struct(F.lit(w).alias("term"), F.size(F.filter(t, _is(w))).cast("long").alias("tf")) for w in wanted])
        # everything is asked for in the generator: a filter on the tokens would be pushed down and cut the text again
        rows = self.tokens.select("doc", F.size(t).cast("long").alias("dl"), F.explode(found).alias("f"))
        return rows.select("f.term", "doc", "f.tf", "dl").filter(F.col("tf") > 0)

    def counted(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """(term, doc, tf, dl) of some terms, each once and sorted; and one row: n_docs, avgdl, and the terms' document frequencies
        as `dfs`, an array in their order. Of token arrays both come from the same numbers, a short row for each document,
        which are shuffled so that the texts are cut once."""
        if self.tokens is None:
            counts = self.postings.filter(F.col("term").isin(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            one = counts.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("m"))
            dfs = F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0).cast("long")) for t in terms])
            return self.of_terms(terms), self.stats.crossJoin(F.broadcast(one.select(dfs.alias("dfs"))))  # one row by one row
        t = F.col("toks")
        names = [f"n{i}" for i in range(len(terms))]
        tfs = [F.size(F.filter(t, _is(w))).cast("long").alias(n) for w, n in zip(terms, names, strict=True)]
        each = self.tokens.select("doc", F.size(t).cast("long").alias("dl"), *tfs).repartition("doc")
        one = each.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.avg(F.nullif("dl", F.lit(0))).alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(n) for n in names])
        # everything is asked for in the generator: a filter before it would go down to the texts, and these be cut twice
        rows = each.select("doc", "dl", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(n).alias("tf")) for w, n in zip(terms, names, strict=True)])).alias("f"))
        return rows.select("f.term", "doc", "f.tf", "dl").filter(F.col("tf") > 0), one.select("n_docs", "avgdl", F.array(*names).alias("dfs"))

    def vocabulary(self) -> DataFrame:
        """Each term of the index once."""
        if self.tokens is None:
            return self.postings.select("term").distinct()
        return self.tokens.select(F.explode("toks").alias("term")).distinct()


def text_of(df: DataFrame, fields: list[str]) -> Column:
    """Strings, and strings in arrays, of all fields as one text."""
    parts = [F.array_join(F.col(f), " ") if df.schema[f].dataType.typeName() == "array" else F.col(f) for f in fields]
    return parts[0] if len(parts) == 1 else F.concat_ws(" ", *parts)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are too few for them: a table of one small file is else cut into tokens by one task.
    The plan's own size decides, nothing runs; of a table that fills the cores anyway nothing is moved."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 1 << 20 < size < cores * (4 << 20) else df


def token_arrays(df: DataFrame, fields: list[str], analyzer: Analyzer = Analyzer(), key: str = "_id") -> DataFrame:
    """(doc, toks): the terms of each document in order, stemmed where the analyzer stems, row by row: no token is shuffled."""
    text = text_of(df, fields)
    toks = stemmed(text, analyzer) if analyzer.kind == "english" and analyzer.stemming else tokens(text, analyzer, normalise=True)
    return df.select(F.col(key).alias("doc"), toks.alias("toks"))


def token_frame(df: DataFrame, fields: list[str], analyzer: Analyzer = Analyzer(), key: str = "_id") -> DataFrame:
    """(doc, dl, pos, term): positions count kept tokens and go on over fields, dl is their number."""
    t = token_arrays(df, fields, analyzer, key)
    return t.select("doc", F.size("toks").cast("long").alias("dl"), F.posexplode("toks").alias("pos", "term"))


def build_index(df: DataFrame, fields: list[str], analyzer: Analyzer = Analyzer(), key: str = "_id") -> TextIndex:
    """Documents without terms don't count; each key is there once."""
    df = spread(df.select(key, *fields))
    grouped = token_frame(df, fields, analyzer, key).groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    toks = token_arrays(df, fields, analyzer, key)
    size = F.size("toks")
    stats = toks.filter(size > 0).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(size).alias("avgdl"))
    return TextIndex(grouped, stats, analyzer, toks)


def idf_v1(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf_unified(n: Column, df: Column) -> Column:
    return F.log((n - df) / df + 1)


def scored(postings: DataFrame, stats: DataFrame, terms: list[str], idf) -> DataFrame:
    """(doc, score): BM25 over query terms, a term that is repeated counts as often."""
    wanted = Counter(terms)
    rows = postings.filter(F.col("term").isin(list(wanted))) if wanted else postings.filter(F.lit(False))
    weight = F.create_map(*[x for t, n in wanted.items() for x in (F.lit(t), F.lit(float(n)))]) if wanted else F.lit(None).cast("map<string,double>")
    # document frequencies of the query's terms only: as many rows as terms
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = rows.join(F.broadcast(counts), "term").join(F.broadcast(stats.withColumn("__one", F.lit(1))), F.lit(1) == F.col("__one"))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = idf(F.col("n_docs").cast("double"), F.col("df").cast("double")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return joined.groupBy("doc").agg(F.sum(part * F.try_element_at(weight, F.col("term"))).alias("score"))


def score_terms(index: TextIndex, terms: list[str], idf: Idf) -> DataFrame:
    """(doc, score) as scored() has it, from the index's rows of these terms and one row of its statistics."""
    wanted = Counter(terms)
    names = sorted(wanted)
    if not names:
        return scored(index.postings, index.stats, [], idf)
    rows, one = index.counted(names)
    place = F.create_map(*[x for i, t in enumerate(names) for x in (F.lit(t), F.struct(F.lit(i).alias("i"), F.lit(float(wanted[t])).alias("w")))])
    rows = rows.crossJoin(F.broadcast(one)).withColumn("__q", F.try_element_at(place, F.col("term")))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    df = F.get("dfs", F.col("__q.i")).cast("double")
    part = idf(F.col("n_docs").cast("double"), df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return rows.groupBy("doc").agg(F.sum(part * F.col("__q.w")).alias("score"))


@dataclass(frozen=True)
class SearchRequest:
    text: str = ""
    regex: str | None = None
    phrase: bool = False
    fuzzy: int | None = None
    fields: tuple[str, ...] = ()
    limit: int = 20
    offset: int = 0

    @classmethod
    def parse(cls, body: dict) -> SearchRequest:
        """{"q": ...} or {"query": {"$text", "$regex", "$phrase", "$fuzzy"}}, with limit, offset and fields."""
        q = body.get("query", {})
        q = {"$text": q} if isinstance(q, str) else q
        pattern = q.get("$regex", body.get("regex"))
        if isinstance(pattern, dict):
            pattern = next(iter(pattern.values()), None)
        fuzzy = q.get("$fuzzy", body.get("fuzzy"))
        fuzzy = None if fuzzy in (None, False) else 2 if fuzzy is True or fuzzy <= 0 else int(fuzzy)
        return cls(body.get("q", q.get("$text", "")), pattern, bool(q.get("$phrase", body.get("phrase", False))), fuzzy, tuple(body.get("fields", ())), int(body.get("limit") or 20), int(body.get("offset") or 0))


def term_candidates(index: TextIndex, terms: list[str]) -> DataFrame:
    return index.of_terms(terms).select("doc").distinct()


def phrase_candidates(index: TextIndex, terms: list[str]) -> DataFrame:
    """Documents with the terms at consecutive positions. In token arrays the phrase is looked for as such; of postings each
    votes for the starts it implies, and a start needs all terms: one aggregation, whatever the length."""
    if len(terms) < 2:
        return term_candidates(index, terms)
    if index.tokens is not None:
        t, n = F.col("toks"), len(terms)
        phrase = F.array(*[F.lit(x) for x in terms])
        starts = F.filter(F.transform(t, lambda x, i: F.when(x == F.lit(terms[0]), i + 1)), lambda i: i.isNotNull())
        found = index.tokens.select("doc", t, F.explode(F.array(starts)).alias("starts"))
        found = found.select("doc", F.explode(F.array(F.exists("starts", lambda i: F.slice(t, i, n) == phrase))).alias("has"))
        return found.filter("has").select("doc").distinct()
    offsets = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.array(*[F.lit(i) for i, u in enumerate(terms) if u == t]))])
    rows = index.postings.filter(F.col("term").isin(terms)).select("doc", "positions", F.explode(F.try_element_at(offsets, F.col("term"))).alias("i"))
    votes = rows.select("doc", "i", F.explode("positions").alias("p")).select("doc", "i", (F.col("p") - F.col("i")).alias("start"))
    return votes.groupBy("doc", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(terms)).select("doc").distinct()


def fuzzy_terms(index: TextIndex, terms: list[str], distance: int) -> DataFrame:
    """Terms of the index within an edit distance (in code points) of a query term."""
    near = F.lit(False)
    for t in terms:
        near = near | (F.levenshtein(F.col("term"), F.lit(t), distance) >= 0)
    return index.vocabulary().filter(near)


def fuzzy_candidates(index: TextIndex, terms: list[str], distance: int = 2) -> DataFrame:
    return index.postings.join(fuzzy_terms(index, terms, distance), "term", "left_semi").select("doc").distinct()


def regex_candidates(index: TextIndex, pattern: str) -> DataFrame:
    """(doc, score): the sum of frequencies of the terms that match; an invalid pattern matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return index.postings.filter(F.lit(False)).groupBy("doc").agg(F.sum("tf").cast("double").alias("score"))
    if index.tokens is not None:
        found = F.size(F.filter("toks", lambda x: x.rlike(pattern))).cast("double")
        return index.tokens.select("doc", F.explode(F.array(found)).alias("score")).filter(F.col("score") > 0).groupBy("doc").agg(F.sum("score").alias("score"))
    return index.postings.filter(F.col("term").rlike(pattern)).groupBy("doc").agg(F.sum("tf").cast("double").alias("score"))


def search(index: TextIndex, request: SearchRequest, documents: DataFrame | None = None, key: str = "_id") -> DataFrame:
    """(doc, score) of a page of results, best first, ties by doc. With documents, their rows, kept where a term is contained
    in one of request.fields (after paging)."""
    terms = query_terms(request.text, index.analyzer)
    if not request.text and request.regex:
        found = regex_candidates(index, request.regex)
    else:
        if request.phrase:
            candidates = phrase_candidates(index, terms)
        elif request.fuzzy is not None:
            candidates = fuzzy_candidates(index, terms, request.fuzzy)
        else:
            candidates = None  # those that have a score
        if request.regex:
            matching = regex_candidates(index, request.regex)
            candidates = (term_candidates(index, terms) if candidates is None else candidates).join(matching, "doc", "left_semi")
        found = score_terms(index, terms, idf_v1)
        if candidates is not None:
            found = candidates.join(found, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))
    page = found.orderBy(F.desc("score"), F.asc("doc")).offset(request.offset).limit(request.limit)
    if documents is None:
        return page
    rows = documents.join(page, documents[key] == page["doc"]).drop("doc")
    if request.fields and terms:
        hit = F.lit(False)
        for f in request.fields:
            for t in terms:
                hit = hit | F.coalesce(F.lower(F.col(f)).contains(t), F.lit(False))
        rows = rows.filter(hit)
    return rows.orderBy(F.desc("score"), F.asc(key))


def bm25_unified(df: DataFrame, field: str, text: str, analyzer: Analyzer = Analyzer("standard"), key: str = "_id", limit: int = 10) -> DataFrame:
    """(key, score) of the best rows by the unified collections' BM25, whose idf is ln(N / n)."""
    index = build_index(df, [field], analyzer, key)
    found = score_terms(index, query_terms(text, analyzer), idf_unified)
    return found.orderBy(F.desc("score"), F.asc("doc")).limit(limit).select(F.col("doc").alias(key), "score")
