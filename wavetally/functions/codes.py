"""Rhythm codes: alphabet checks, overlaps, balanced words, the choice of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the symbols of a rhythm (short, long, equal dwell and pause).
ALPHABET = "SLEP"


def valid_rhythm(word: Column) -> Column:
    """Only the alphabet's symbols, and a dwell among them."""
    return word.rlike(f"^[{ALPHABET}]+$") & word.rlike("[SLE]")


def hamming(a: Column, b: Column) -> Column:
    """Differing places of words of equal length, else null."""
    differ = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    return F.when(F.length(a) == F.length(b), differ)


def overlap_lengths(a: Column, b: Column) -> Column:
    """Lengths of proper suffixes of a that are prefixes of b."""
    most = F.least(F.length(a), F.length(b)) - 1
    lengths = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.filter(lengths, lambda n: F.right(a, n) == F.left(b, n))


def overlaps(codes: DataFrame, id_col: str = "code_id", word_col: str = "rhythm") -> DataFrame:
    """All ordered pairs of codes with their overlaps: proper suffixes of one meet the equal
    proper prefixes of the other."""
    proper = lambda side: F.transform(F.filter(F.sequence(F.lit(0), F.length(word_col) - 1), lambda n: n > 0), lambda n: F.struct(n.alias("overlap"), side(F.col(word_col), n).alias("sequence")))
    rows = codes.where(F.length(word_col) > 0)
    ends = rows.select(F.col(id_col).alias("suffix_code"), F.inline(proper(F.right)))
    starts = rows.select(F.col(id_col).alias("prefix_code"), F.inline(proper(F.left)))
    return ends.join(starts, ["overlap", "sequence"]).select("suffix_code", "prefix_code", "overlap", "sequence")


def binary_words(numbers: DataFrame, number: str, length: int = 8) -> DataFrame:
    """The last ``length`` bits of the numbers as distinct words of S (0) and L (1)."""
    bits = F.lpad(F.bin(F.pmod(F.col(number).cast("long"), F.lit(1 << length))), length, "0")
    return numbers.select(F.translate(bits, "01", "SL").alias("word")).distinct()


def balanced_words(words: DataFrame, most_run: int = 2, word: str = "word") -> DataFrame:
    """Words of S and L with as many of each and no run over ``most_run``."""
    runs = "|".join(c * (most_run + 1) for c in "SL")
    count = lambda c: F.regexp_count(word, F.lit(c))
    return words.where(F.col(word).rlike("^[SL]+$") & (count("S") == count("L")) & ~F.col(word).rlike(runs))


def cross_bifix_free(a: Column, b: Column) -> Column:
    return ~F.greatest(*[F.size(overlap_lengths(x, y)) > 0 for x, y in ((a, a), (a, b), (b, a), (b, b))])


def pairs_by_distance(words: DataFrame) -> DataFrame:
    """Unordered cross-bifix-free pairs with their distance."""
    a, b = words.select(F.col("word").alias("first")), words.select(F.col("word").alias("second"))
    both = a.join(b, F.col("first") < F.col("second"))
    free = both.where(cross_bifix_free(F.col("first"), F.col("second")))
    return free.withColumn("distance", hamming(F.col("first"), F.col("second")))


def select_pair(words: DataFrame) -> DataFrame:
    """The cross-bifix-free pair of the greatest distance among words that start with their
    only SS. More than one pair is an error of the design; the caller sees all."""
    marked = words.where(F.col("word").startswith("SS") & (F.regexp_count("word", F.lit("SS")) == 1))
    found = pairs_by_distance(marked)
    best = found.agg(F.max("distance").alias("best"))
    return found.join(F.broadcast(best), F.col("distance") == F.col("best")).drop("best")  # one row
