"""Four-valued predicates as status columns.

A status is one of no_match, unresolved, unsupported and match. Conjunctions take the
first of no_match, unsupported, unresolved, match; disjunctions the first of match,
unsupported, unresolved, no_match. A null value is missing, a null status unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO, UNRESOLVED, UNSUPPORTED, YES = "no_match", "unresolved", "unsupported", "match"
AND_ORDER = (NO, UNSUPPORTED, UNRESOLVED, YES)
OR_ORDER = (NO, UNRESOLVED, UNSUPPORTED, YES)


def _code(status: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(status, F.lit(UNRESOLVED))).cast("int")


def _name(code: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), code.cast("int"))


def _fold(statuses: tuple[Column, ...], order: tuple[str, ...], pick) -> Column:
    codes = [_code(s, order) for s in statuses]
    return _name(pick(*codes) if len(codes) > 1 else codes[0], order)


def all_of(*statuses: Column) -> Column:
    return _fold(statuses, AND_ORDER, F.least)


def any_of(*statuses: Column) -> Column:
    return _fold(statuses, OR_ORDER, F.greatest)


def group_all(status: Column) -> Column:
    """Conjunction over the rows of a group."""
    return _name(F.min(_code(status, AND_ORDER)), AND_ORDER)


def group_any(status: Column) -> Column:
    """Disjunction over the rows of a group."""
    return _name(F.max(_code(status, OR_ORDER)), OR_ORDER)


def negate(status: Column) -> Column:
    return F.when(status == YES, NO).when(status == NO, YES).otherwise(F.coalesce(status, F.lit(UNRESOLVED)))


def known(test: Column, *values: Column) -> Column:
    """The test's answer where all values are known."""
    missing = F.lit(False)
    for v in values:
        missing = missing | v.isNull()
    return F.when(missing, UNRESOLVED).when(test, YES).otherwise(NO)


def equal(a: Column, b: Column) -> Column:
    return known(a == b, a, b)


def unequal(a: Column, b: Column) -> Column:
    return known(a != b, a, b)


def is_in(a: Column, values: Column) -> Column:
    return known(F.array_contains(values, a), a, values)


def contains(values: Column, a: Column) -> Column:
    return known(F.array_contains(values, a), values, a)


def all_in(values: Column, allowed: Column) -> Column:
    """Subset; an empty left side is unresolved."""
    return F.when(F.size(values) == 0, UNRESOLVED).otherwise(known(F.size(F.array_except(values, allowed)) == 0, values, allowed))


def present(value: Column, size: Column) -> Column:
    """`size` is the value's length or number of members."""
    return known(size > 0, value)


def nonblank_text(value: Column) -> Column:
    return known(F.length(F.trim(value)) > 0, value)


def nonblank_text_array(values: Column) -> Column:
    return known((F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))), values)


def nonnegative_integer(value: Column) -> Column:
    return known((value >= 0) & (value == F.floor(value)), value)


def binding_absent(supported: Column, uncertain: Column, complete: Column) -> Column:
    """No candidate at all and a complete search; an uncertain one leaves it open."""
    return F.when(supported > 0, NO).when((uncertain > 0) | ~complete, UNRESOLVED).otherwise(YES)
