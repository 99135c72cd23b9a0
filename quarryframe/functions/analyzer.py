"""Text analysis as Columns: token arrays of documents, and the same for query strings."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

#: sorted, each once
STOPWORDS = (
    "a about above after again against all also am an and are as at be because been before being below between both but by can could dare did do does doing "
    "don down during each every few for from further had has have having he her here hers herself him himself his how i if in into is it it's its itself "
    "just may me might more most must my myself need no nor not now of off on once only or other ought our ours ourselves out over own s same shall she "
    "should so some such t than that the their theirs them themselves then there these they this those through to too under until up used very was we were "
    "what when where which while who whom whose why will with would you your yours yourself yourselves"
).split()
_STOP = frozenset(STOPWORDS)
#: of the plain analyzer of unified collections
PLAIN_STOPWORDS = "a an and are as at be been being but by could did do does for from had has have if in is it its may might must of on or should so than that the then these this those to was were will with would".split()
LETTERS, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Analyzer:
    """kind: "standard" (letters and digits, stop words), "simple" (no stop words), "whitespace" (case kept), or "english"
    (Unicode letters and digits, NFKC, lower case, stop words, two bytes at least, Porter 2 unless stemming is off)."""

    kind: str = "english"
    stemming: bool = True
    case_sensitive: bool = False


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: None if ts is None else [unicodedata.normalize("NFKC", t) for t in ts])


@lru_cache(maxsize=1)
def _unstable() -> str:
    """A class of few ranges that holds the letters and digits that NFKC may change: those with another form, and jamo, which
    join. It may hold others; each range costs time on each character."""
    ranges: list[list[int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        if (category[0] == "L" or category == "Nd") and (not unicodedata.is_normalized("NFKC", c) or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2):
            if ranges and ranges[-1][1] >= code - (1 if code < 0x250 else 96):
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{z:X}}}" if z > a else "") for a, z in ranges) + "]"


@lru_cache(maxsize=1 << 16)
def _english(token: str, case_sensitive: bool) -> str | None:
    """The stem of a token as a text has it; null for one that doesn't count. Workers live on between batches, whose tokens are
    mostly the same."""
    t = unicodedata.normalize("NFKC", token)
    t = t if case_sensitive else t.lower()
    return None if t.lower() in _STOP or len(t.encode()) < 2 else stem(t)


def _stems(lists: pa.Array, case_sensitive: bool) -> pa.Array:
    found = lists.flatten().dictionary_encode()
    stems = pa.array([None if t is None else _english(t, case_sensitive) for t in found.dictionary.to_pylist()], lists.type.value_type)
    place = found.indices.to_numpy(zero_copy_only=False)
    keep = ~stems.is_null().to_numpy(zero_copy_only=False)[place]
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))
    offsets = np.append(0, np.cumsum(keep))[ends]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(pa.array(place[keep])), mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(lists: pa.Array) -> pa.Array:
    return _stems(lists, False)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed_case(lists: pa.Array) -> pa.Array:
    return _stems(lists, True)


def stemmed(text: Column, a: Analyzer = Analyzer()) -> Column:
    """The stems of a text in order, as query_terms() finds them. The text is cut in the JVM; the rest is done in one visit to
    Python, once for each distinct token of a batch."""
    return (_stemmed_case if a.case_sensitive else _stemmed)(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)))


def nfkc(text: Column, found: Column) -> Column:
    """The tokens found in a text with compatibility forms joined, each by itself; null for a text without a character that may
    have such a form. Of these only a null goes to Python."""
    return _nfkc(F.when(text.rlike(_unstable()), found))


def tokens(text: Column, a: Analyzer = Analyzer(), normalise: bool = False) -> Column:
    """The token array of a text before stemming, JVM-side but for NFKC. Tokens are cut first and normalised then, as query_terms()
    does it."""
    if a.kind == "english":
        fold = (lambda x: x) if a.case_sensitive else F.lower
        word = F.lit(r"([\p{L}\p{Nd}]+)")
        raw = F.regexp_extract_all(fold(text), word, F.lit(1))
        if normalise:
            raw = F.coalesce(F.transform(nfkc(text, F.regexp_extract_all(text, word, F.lit(1))), fold), raw)
        return F.filter(raw, lambda x: ~(F.lower(x) if a.case_sensitive else x).isin(STOPWORDS) & (F.octet_length(x) >= 2))
    if a.kind == "whitespace":
        return F.filter(F.split(text, "[ \t\n\r]+"), lambda x: x != "")
    if a.kind in ("standard", "simple"):
        raw = F.regexp_extract_all(F.translate(text, UPPER, LETTERS), F.lit("([a-z0-9]+)"), F.lit(1))
        if a.kind == "simple":
            return raw
        return F.filter(raw, lambda x: ~x.isin(PLAIN_STOPWORDS))
    raise ValueError(f"unknown analyzer {a.kind}")


def ascii_folded(text: Column) -> Column:
    """Accented Latin letters without their marks."""
    marked, plain = "", ""
    for code in range(0xC0, 0x250):
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d.isascii():
            marked, plain = marked + c, plain + d
    return F.translate(text, marked + "ßøđłæ", plain + "sodla")


def query_terms(text: str, a: Analyzer = Analyzer()) -> list[str]:
    """The terms of a query string, analysed as documents are."""
    import re

    if a.kind == "english":
        known = [c if (k := unicodedata.category(c))[0] == "L" or k == "Nd" else " " for c in text]
        found = [unicodedata.normalize("NFKC", t) for t in "".join(known).split()]
        found = [t if a.case_sensitive else t.lower() for t in found]
        found = [t for t in found if t.lower() not in STOPWORDS and len(t.encode()) >= 2]
        return [stem(t) for t in found] if a.stemming else found
    if a.kind == "whitespace":
        return [t for t in re.split("[ \t\n\r]+", text) if t]
    found = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LETTERS)))
    return found if a.kind == "simple" else [t for t in found if t not in PLAIN_STOPWORDS]
