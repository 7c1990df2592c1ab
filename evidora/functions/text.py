"""Text columns: names, tokens, ids and contexts. Patterns mean the same in Java, RE2 and Python's regex."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.work import small_batches

TOKEN = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_\s-]"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """Spark has no unicode normal forms; batches cross to Python for this alone."""
    return F.pandas_udf(_nfkc, StringType())(c)


def clean_string(name: Column, normal_form: bool = True) -> Column:
    """Lower case, marks and hyphens at word edges to blanks, blanks collapsed."""
    s = F.lower(nfkc(name) if normal_form else name)
    s = F.regexp_replace(s, NOT_WORD, " ")
    s = F.regexp_replace(s, r"(^|\s)-+|-+(\s|$)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def name_hash(name: Column, kind: Column, normal_form: bool = True) -> Column:
    return F.sha2(F.concat_ws("|", clean_string(name, normal_form), kind), 256)


def sanitize_query(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(q, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def token_count(text: Column) -> Column:
    """Words and marks: the stand-in for a vocabulary that can't be fetched offline."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def sha_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def context_window(text: Column, name: Column, size: int = 400) -> Column:
    """Up to ``size`` characters around the first hit, in any case; the head of the text if there is none."""
    n = F.length(text)
    hit = F.instr(F.lower(text), F.lower(name))
    middle = hit - 1 + F.floor(F.length(name) / 2)
    start = F.greatest(F.lit(0), F.least(middle - size // 2, n - size))
    start = F.when((hit > 0) & (F.length(name) > 0), start).otherwise(F.lit(0))
    return F.substring(text, (start + 1).cast("int"), F.lit(size))


#: Dashes that count as hyphens, maths that keeps its marks, and marks that a key doesn't end with.
DASHES = str.maketrans("–—−", "---")
MATHS_OR_EMPHASIS = re.compile(r"(\\\(.+?\\\)|\$[^$]+\$)|[*`_]", re.S)
END_MARKS = ".,:;!\"'()[]{}"


def normal_heading(text: str) -> str:
    """A heading as a key: NFKC, plain hyphens, no emphasis outside maths, lower case, no accents, single blanks, and no
    marks at the end but question marks and the end of maths."""
    s = text or ""
    plain = s.isascii()  # then it has no other form
    if not plain:
        s = unicodedata.normalize("NFKC", s).translate(DASHES)
    s = MATHS_OR_EMPHASIS.sub(lambda m: m[1] or "", s).lower()
    if not plain:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    s = " ".join(s.split())
    while s.endswith(tuple(END_MARKS)) and not s.endswith("\\)"):
        s = s[:-1].rstrip()
    return s


def _headings(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else normal_heading(v))


def normalize_heading(c: Column) -> Column:
    small_batches(SparkSession.active())
    return F.pandas_udf(_headings, StringType())(c)
