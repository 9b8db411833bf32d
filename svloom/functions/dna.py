"""Functions on DNA strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def compress(s: Column) -> Column:
    """Each run of a character becomes one character."""
    return F.regexp_replace(s, r"(.)\1+", "$1")


def longest_run(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))


def low_complexity(kmer: Column) -> Column:
    """One base only, or one base in at least 0.8 of the places, or a run of at least 0.6 of them."""
    n = F.length(kmer)
    most = F.greatest(*[n - F.length(F.translate(kmer, base, "")) for base in "ACGT"])
    return (most == n) | (10 * most >= 8 * n) | (10 * longest_run(kmer) >= 6 * n)


#: Bases of a piece: a substring is found by walking from its string's start, so long strings are cut first.
PIECE = 64


def cut(s: Column, size: int) -> Column:
    """The string in parts of ``size``, in linear time; an empty string has none."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def pieces(s: Column, k: int, size: int = PIECE) -> Column:
    """Parts of ``size`` places, each with the k - 1 characters behind it, so that every k-mer starts in one part and lies in it."""
    size = max(size, k)  # what a part lends from the next one is all there
    parts = cut(s, size)
    return F.zip_with(parts, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0))), lambda x, y: F.concat(x, F.coalesce(F.substring(y, 1, k - 1), F.lit(""))))


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order, as an array; a shorter string has none. For long strings, explode ``pieces`` first."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_rows(rows: DataFrame, s: str, k: int, strands: bool = False) -> DataFrame:
    """``rows`` with ``kmer``, one row for each k-mer of the string column ``s``, which is left out; linear in its length.

    With ``strands`` the canonical k-mers; each part is complemented once, not each k-mer.
    """
    keep = [c for c in rows.columns if c != s]
    parts = rows.select(*keep, F.explode(pieces(F.col(s), k)).alias("piece")).where(F.length("piece") >= k)
    if not strands:
        return parts.select(*keep, F.explode(kmers(F.col("piece"), k)).alias("kmer"))
    parts = parts.select(*keep, "piece", reverse_complement(F.col("piece")).alias("back"), (F.length("piece") - k + 1).alias("n"))
    both = lambda i: F.least(F.substring("piece", i, F.lit(k)), F.substring("back", F.col("n") + 1 - i, F.lit(k)))
    return parts.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), both)).alias("kmer"))


def valid(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def context(s: Column, start: Column, end: Column, window: int) -> Column:
    """The string around [start, end), widened by ``window`` on both sides and cut at its ends."""
    left = F.greatest(F.lit(0), start - window)
    right = F.least(F.length(s), end + window)
    return F.when(left < right, F.substring(s, (left + 1).cast("int"), (right - left).cast("int"))).otherwise("")
