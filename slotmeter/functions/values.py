"""Column expressions on slot values: canonical forms, equality, grades, rubric scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synonyms of yes and no.
YES = ("yes", "y", "true", "1", "on", "present", "available")
NO = ("no", "n", "false", "0", "off", "absent", "unavailable")
#: The looser canonicaliser knows fewer.
YES_LOOSE = ("yes", "y", "true", "1")
NO_LOOSE = ("no", "n", "false", "0")
#: Lower bounds of the grades of 1 - SER and of slot F1.
SER_CUTS = ((0.9, 4), (0.75, 3), (0.5, 2), (0.25, 1))
F1_CUTS = ((0.9, 6), (0.8, 5), (0.7, 4), (0.6, 3), (0.5, 2), (0.25, 1))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _unquoted(c: Column) -> Column:
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def canon_scalar(c: Column) -> Column:
    """Trimmed, unquoted, without edge punctuation, lower case, yes and no synonyms mapped."""
    s = F.lower(F.btrim(_unquoted(c), F.lit(" ;,.")))
    return F.when(s.isin(*YES), "yes").when(s.isin(*NO), "no").otherwise(s)


def canon_scalar_loose(c: Column) -> Column:
    """The other order: synonyms before edge punctuation, and fewer of them."""
    s = F.lower(_unquoted(c))
    return F.when(s.isin(*YES_LOOSE), "yes").when(s.isin(*NO_LOOSE), "no").otherwise(F.btrim(s, F.lit(" ;,.")))


def listed(c: Column) -> Column:
    """The parts of 'a, b' or 'a and b'; null if there are fewer than two."""
    parts = F.filter(F.transform(F.split(strip(c), r",|\band\b"), strip), lambda x: x != "")
    return F.when((F.contains(c, F.lit(",")) | F.contains(c, F.lit(" and "))) & (F.size(parts) >= 2), parts)


def canon_value(values: Column, is_list: Column) -> Column:
    """struct(items, multi): a list is a sorted set; a bare string that reads as a list is one too."""
    as_set = lambda xs: F.array_sort(F.array_distinct(F.transform(F.filter(xs, lambda x: x.isNotNull()), canon_scalar)))
    first = F.try_element_at(values, F.lit(1))
    parts = listed(first)
    items = F.when(is_list, as_set(values)).when(parts.isNotNull(), as_set(parts)).when(first.isNotNull(), F.array(canon_scalar(first)))
    return F.struct(items.alias("items"), (is_list | parts.isNotNull()).alias("multi"))


def value_equal(a: Column, b: Column, containment: bool = True) -> Column:
    """Equality of two canonical values: sets as sets, a scalar with a set by containment, scalars as strings."""
    x, y, mx, my = a["items"], b["items"], a["multi"], b["multi"]
    inside = F.lit(containment)
    one = lambda items, other: inside & F.array_contains(items, F.element_at(other, 1))
    return F.when(mx == my, x == y).when(mx, one(x, y)).otherwise(one(y, x))


def _grade(good: Column, cuts: tuple) -> Column:
    out = F.when(good >= cuts[0][0], cuts[0][1])
    for cut, grade in cuts[1:]:
        out = out.when(good >= cut, grade)
    return out.otherwise(0)


def grade_ser(ser: Column) -> Column:
    """0 to 4 from 1 - SER; negative scores are 0."""
    return _grade(1 - ser, SER_CUTS)


def grade_f1(f1: Column) -> Column:
    """0 to 6 from slot F1."""
    return _grade(f1, F1_CUTS)


def rubric_score(p: Column) -> Column:
    """Sum of (d - 3) * p_d over the digits 3 to 6 of a seven-digit distribution."""
    return F.aggregate(F.zip_with(F.slice(p, 4, 4), F.array(*[F.lit(float(k)) for k in range(4)]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def rubric_expectation(p: Column) -> Column:
    return F.aggregate(F.zip_with(p, F.array(*[F.lit(float(k)) for k in range(7)]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
