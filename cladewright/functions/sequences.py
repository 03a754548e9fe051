"""Column expressions over sequences, qualities and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(x: Column | str) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places of two strings; surplus places of the longer count as differing."""
    return F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def quality_hamming(a: Column, b: Column, qa: Column, qb: Column, least: int) -> Column:
    """Differing places where both qualities (offset 33) reach least."""
    pair = F.arrays_zip(letters(a).alias("a"), letters(b).alias("b"), letters(qa).alias("p"), letters(qb).alias("q"))
    good = lambda z: (F.ascii(z["p"]) - 33 >= least) & (F.ascii(z["q"]) - 33 >= least)
    return F.size(F.filter(pair, lambda z: ~z["a"].eqNullSafe(z["b"]) & good(z)))


def all_qualities_reach(qual: Column | str, least: int) -> Column:
    return F.forall(letters(qual), lambda c: F.ascii(c) - 33 >= least)


def cigar_chunks(cigar: Column | str) -> Column:
    """array<struct<length:int,kind:string>> of a CIGAR string."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z])"), F.lit(1))
    kind = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z])"), F.lit(2))
    return F.zip_with(n, kind, lambda a, b: F.struct(a.cast("int").alias("length"), b.alias("kind")))


def log_sum_exp(x: Column, *by: str) -> Column:
    """Stable log of summed exponentials as a window over by. Nulls are left out; where all are minus infinity, so is the log."""
    from pyspark.sql import Window

    top = F.max(x).over(Window.partitionBy(*by))
    summed = top + F.log(F.sum(F.exp(x - top)).over(Window.partitionBy(*by)))
    return F.when(top == float("-inf"), top).otherwise(summed)


def is_missing(token: Column) -> Column:
    """Tokens that mean a missing state: '-', '?', alphabetic symbols and negative integers."""
    return token.isin("-", "?", "-1") | token.rlike(r"^[A-Za-z]+$") | token.rlike(r"^-\d+$")


def soft_states(token: Column) -> Column:
    """'s:p/s:p' as map<string,double>."""
    return F.transform_values(F.str_to_map(token, F.lit("/"), F.lit(":")), lambda _, p: p.cast("double"))
