"""Text functions as columns; what Spark has no built-in for is an Arrow UDF."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Maximal runs of Unicode word characters of the NFKC case-folded text, numbers as <number>; null text has none."""

    def work(texts: pd.Series) -> pd.Series:
        import re

        one = lambda t: ["<number>" if w.isdigit() else w for w in re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())]
        return texts.map(one)

    work.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "array<string>")(F.coalesce(text, F.lit("")))


def fixed(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """df.select(*keep, columns by name), with each new column computed once for a row.

    Filters on a plain projection's columns are moved below it with the expression in place of the name, and inside a
    lambda that would be evaluated for every element. They stay above a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\u000B]+", " "))


def clean_text(text: Column) -> Column:
    """De-hyphenate line ends, keep paragraph ends, join other lines, and close up AS numbers."""
    t = F.regexp_replace(text, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.replace(t, F.lit("\n\n"), F.lit("\u0001"))
    t = F.replace(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\u0001"), F.lit("\n\n"))
    return F.btrim(F.regexp_replace(t, r"\bAS ([0-9]+)\b", "AS$1"))


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of size words, one shorter run for short texts, none for empty ones. words must be a column."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def minhash(items: Column, n: int = 64) -> Column:
    """n minima of seeded SHA-256, as 16 hex digits each; zeros without items."""
    one = lambda seed: F.coalesce(F.array_min(F.transform(items, lambda s: F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), s).cast("binary"), 256), 1, 16))), F.lit("0" * 16))
    return F.array(*[one(i) for i in range(n)])


def same_minima(both: list[bytes], apart: list[bytes], least: int, n: int = 64, sha: Callable = hashlib.sha256) -> bool:
    """Whether two sets have at least so many of n minima (see minhash) in common, of which both hold one part, one the rest.

    A minimum is common if it lies in the common part. So the smaller part is hashed whole and the larger one until an
    element falls below, for as many seeds as decide. Different elements with the same first 64 bits are not looked for.
    """
    few, many = sorted((both, apart), key=len)
    if not few:
        return (0 if apart else n) >= least
    agree = 0
    for seed in range(n):
        head = b"%d\0" % seed
        low = min([sha(head + x).digest() for x in few])
        agree += any(sha(head + x).digest() < low for x in many) == (few is apart)
        if agree >= least or agree + n - 1 - seed < least:
            break
    return agree >= least


def minima_agree(both: Column, apart: Column, threshold: float, n: int = 64) -> Column:
    """same_minima of the common and the other elements of two sets, for the least count that is threshold of n; null is empty."""
    least = next(k for k in range(n + 2) if k / n >= threshold or k > n)

    def work(both: pd.Series, apart: pd.Series) -> pd.Series:
        held = lambda xs: [] if xs is None else [x.encode() for x in xs]
        return pd.Series([same_minima(held(x), held(y), least, n) for x, y in zip(both, apart, strict=True)], dtype=bool)

    work.__annotations__ = {"both": pd.Series, "apart": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "boolean")(both, apart)


def stable_vector(text: Column, size: int = 8) -> Column:
    """A vector that depends on the text alone, each value in [-1, 1]."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit("‖"), i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(part(i) / 4294967296.0 * 2 - 1, 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, empty, zero or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(dot(a, b) / norm)


def _folded(form: str, fold: bool, keep_lines: bool):
    def work(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            t = unicodedata.normalize(form, t.replace("\r\n", "\n").replace("\r", "\n"))
            t = "\n".join(" ".join(x.split()) for x in t.split("\n")).strip() if keep_lines else " ".join(t.split())
            return t.casefold() if fold else t

        return texts.map(one, na_action="ignore")

    work.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "string")


def normal_form(text: Column, form: str = "NFKC", fold: bool = False, keep_lines: bool = True) -> Column:
    """Unicode normal form with white space collapsed in each line; fold also folds case."""
    return _folded(form, fold, keep_lines)(text)


def simhash(words: Column) -> Column:
    """64 signed votes of token hashes; a tie sets the bit, so no words set all."""

    def work(lists: pd.Series) -> pd.Series:
        from collections import Counter
        from functools import lru_cache

        import numpy as np

        digest = lru_cache(1 << 16)(lambda w: hashlib.sha256(w.encode()).digest()[:8])

        def one(ws) -> int:
            seen = Counter([] if ws is None else ws)
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            bits = np.unpackbits(np.frombuffer(b"".join(map(digest, seen)), np.uint8)).reshape(len(seen), 64)
            return int(np.packbits(2 * (counts @ bits) >= counts.sum()).view(">i8")[0])

        return lists.map(one)

    work.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "long")(words)
