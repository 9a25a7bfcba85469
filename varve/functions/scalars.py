"""Row-level expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_map(col: Column, mapping: dict) -> Column:
    """Recode by lookup on the text of the value; values outside the map become null.

    A whole double reads like the integer it stands for, as in an integer column with gaps that was read as double.
    """
    if not mapping:
        return F.lit(None).cast("string")
    whole = lambda k: int(k) if isinstance(k, float) and k.is_integer() else k
    by_text = {str(whole(k)): v for k, v in mapping.items()}
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(by_text.items())])
    number = col.cast("double")
    is_whole = F.typeof(col).isin("double", "float") & (number == F.floor(number))
    return F.element_at(pairs, F.when(is_whole, number.cast("long").cast("string")).otherwise(col.cast("string")))


def right_closed_bin(col: Column, thresholds, labels) -> Column:
    """(-inf,t1], (t1,t2], ..., (tk,inf); null stays null."""
    out = F.when(col.isNull() | F.isnan(col.cast("double")), F.lit(None))
    for threshold, label in zip(sorted(thresholds), labels):
        out = out.when(col <= threshold, F.lit(label))
    return out.otherwise(F.lit(labels[len(thresholds)]))


def left_closed_bin(col: Column, edges) -> Column:
    """Index of [e0,e1), [e1,e2), ... clipped into the first and last bin."""
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + (col >= edge).cast("int")
    return F.when(col.isNotNull(), index)


def comorbid(a: Column, b: Column) -> Column:
    """Worst of two labels; Control only where both are Control."""

    def either(label):
        return F.coalesce(a == label, F.lit(False)) | F.coalesce(b == label, F.lit(False))

    return (
        F.when(either("Clinical"), "Clinical")
        .when(either("Subclinical"), "Subclinical")
        .when((a == "Control") & (b == "Control"), "Control")
    )


def number(col: Column) -> Column:
    """Numeric value of text, null where it does not parse or is not finite."""
    parsed = col.try_cast("double")
    return F.when(finite(parsed), parsed)


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def any_equal(cols, value=1) -> Column:
    """1 if any column equals the value, else 0; nulls do not count."""
    return F.greatest(F.lit(0), *[F.coalesce((c == value).cast("int"), F.lit(0)) for c in cols])


def count_equal(cols, value=1) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce((c == value).cast("int"), F.lit(0))
    return total


def asymmetry(left: Column, right: Column) -> Column:
    """(L - R) / (L + R), null where the total is within 1e-6 of zero."""
    total = left + right
    return F.when(F.abs(total) >= 1e-6, (left - right) / total)


def asymmetry_columns(pairs, ai=True, total=True) -> list[Column]:
    out = []
    if ai:
        out += [asymmetry(F.col(l), F.col(r)).alias(f"{n}_AI") for n, l, r in pairs]
    if total:
        out += [(F.col(l) + F.col(r)).alias(f"{n}_total") for n, l, r in pairs]
    return out


def concordance(ai_cols) -> tuple[Column, Column]:
    """Mean absolute asymmetry and agreement of signs over structures; null if any is null."""
    p = len(ai_cols)
    burden = sum((F.abs(c) for c in ai_cols), F.lit(0.0)) / p
    agreement = F.abs(sum((F.signum(c) for c in ai_cols), F.lit(0.0)) / p)
    return burden, agreement


def extreme_group(col: Column, low_max=None, high_min=None, low_values=None, high_values=None) -> Column:
    """High / Low / null, from thresholds or from lists of values."""
    high = col.isin(list(high_values)) if high_values else col >= high_min
    low = col.isin(list(low_values)) if low_values else col <= low_max
    return F.when(high, "High").when(low, "Low")


def clip(col: Column, low=None, high=None) -> Column:
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def expit(col: Column) -> Column:
    return 1 / (1 + F.exp(-col))


def in_range(col: Column, low, high) -> Column:
    """Half-open [low, high)."""
    return (col >= low) & (col < high)
