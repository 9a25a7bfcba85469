"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words where an operator counts `[^\\x20\\x09-\\x0D]+`.
GAP = r"[\x20\x09-\x0D]+"


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Just these columns, cast; one that the table lacks is null. Other columns of the table are ignored."""
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names for helper columns, each lengthened until the table has no column so called (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP), "")), F.lit(0)).cast("long")


#: Words of 64 bits in the bitmap of `may_hold`.
BITMAP_WORDS = 2**18


def may_hold(df: DataFrame, key: str, others: DataFrame, out: str) -> DataFrame:
    """`df` with the new column `out`: false only where `key` is not among the values of the one column of `others`.

    That column, null included, becomes a broadcast bitmap of bounded size, in which other keys are found by chance: a join of the rows
    that have `out` must decide. The others, with their texts, need no shuffle.
    """
    word, bits = unused(df, "_word", "_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * BITMAP_WORDS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    one = F.col(others.columns[0])
    bitmap = others.groupBy(F.floor(place(one) / 64).alias(word)).agg(F.bit_or(bit(one)).alias(bits))
    tried = df.join(F.broadcast(bitmap), F.floor(place(df[key]) / 64) == F.col(word), "left")
    return tried.withColumn(out, F.coalesce(F.col(bits).bitwiseAND(bit(df[key])) != 0, F.lit(False))).drop(word, bits)


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
