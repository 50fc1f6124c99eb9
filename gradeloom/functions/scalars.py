"""Scalar and array expressions shared by the operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILED = -1
#: Latin-1 characters where lower-casing differs from compatibility folding, and everything beyond Latin-1.
NEEDS_FOLDING = "[^\\x00-\\xFF]|[\\x1C-\\x1F\\x85\\xA0\\xA8\\xAA\\xAF\\xB2-\\xB5\\xB8-\\xBA\\xBC-\\xBE]"


def keyed(tag, key) -> Column:
    """A pseudo-random integer in [0, 2^32): the first 8 hex digits of md5('tag:key')."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.conv(F.substring(F.md5(F.concat(tag, F.lit(":"), key.cast("string"))), 1, 8), 16, 10).cast("long")


@F.pandas_udf(T.StringType())
def _folded(texts):
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def normalized_text(text: Column) -> Column:
    """Fast form of NFKC + casefold + collapsed blanks, exact for texts without ``NEEDS_FOLDING``."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def folded_text(text: Column) -> Column:
    """NFKC + casefold + collapsed blanks; texts that need it go through an Arrow function."""
    needed = text.rlike(NEEDS_FOLDING)
    # a Python function runs on every row, whatever stands around it: other rows hand it null
    return F.when(needed, _folded(F.when(needed, text))).otherwise(normalized_text(text))


def coded(label: Column, n_classes: int, error: Column | None = None) -> Column:
    """The predicted class, or -1 for anything failed, missing or out of range."""
    ok = label.between(0, n_classes - 1)
    if error is not None:
        ok = ok & error.isNull()
    return F.when(ok, label).otherwise(FAILED).cast("int")


def argmax(p: Column) -> Column:
    """Index of the largest entry, the lowest on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def softmax(s: Column) -> Column:
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / total(e))


def valid_probabilities(p: Column, n_classes: int, tolerance: float = 1e-6) -> Column:
    entries = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return p.isNotNull() & (F.size(p) == n_classes) & entries & (F.abs(total(p) - 1) <= tolerance)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)
