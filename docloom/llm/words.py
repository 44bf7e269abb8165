"""Word, line and shingle expressions shared by the text operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"
LETTERS_DIGITS = r"[\p{L}\p{N}]+"


def words(text: Column, pattern: str = LETTERS) -> Column:
    """Runs that match `pattern` in lower case, in order; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once (lambdas have no local names)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """64-bit hashes of the sequences of `n` successive tokens, in order, repeats kept."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - n),
            lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def lines(text: Column) -> Column:
    """The pieces between line feeds, blank ones included; null text has none."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def most_frequent(counts: DataFrame, k: int, word: str = "word", n: str = "n") -> DataFrame:
    """The `k` rows of the largest `n` (ties by `word`).

    A histogram over powers of two, 64 rows at most, first gives the power that
    at least `k` rows reach; only those are sorted, so that no task sorts `k`
    rows of each of very many partitions.
    """
    power = F.floor(F.log2(n)).cast("int")
    hist = sorted(((r["p"], r["rows"]) for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, seen = 0, 0
    for p, rows in hist:
        least, seen = p, seen + rows
        if seen >= k:
            break
    return counts.where(F.col(n) >= 2**least).orderBy(F.desc(n), word).limit(k)
