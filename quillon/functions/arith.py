"""Operators on numbers, booleans and strings.

Integers are longs by default: what overflows raises and never wraps. Division
and remainder of integers are Euclidean, so the remainder is never negative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def fail(message: str | Column) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def check(condition: Column, value: Column, message: str | Column) -> Column:
    """value where the condition holds; else the row raises."""
    return F.when(condition, value).otherwise(fail(message))


def int_div(a: Column, b: Column) -> Column:
    quotient = F.call_function("div", a - F.pmod(a, F.abs(b)), b)
    return check(b != 0, F.when(b != 0, quotient), "division by zero")


def int_mod(a: Column, b: Column) -> Column:
    return check(b != 0, F.when(b != 0, F.pmod(a, F.abs(b))), "division by zero")


def float_div(a: Column, b: Column) -> Column:
    """A division by zero gives an infinity of the dividend's sign; zero by zero raises."""
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(fail("division of zero by zero"))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a, b))


def _left(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, F.least(n, F.lit(63)))


def _right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, F.least(n, F.lit(63)))


def shift_left(a: Column, n: Column) -> Column:
    a, n = a.cast("long"), n.cast("int")
    room = _right(_left(a, n), n) == a
    fits = (a == 0) | ((n < 64) & room)
    return F.when(n < 0, fail("negative shift")).when(a == 0, F.lit(0).cast("long")).otherwise(check(fits, _left(a, n), "integer overflow in shift"))


def shift_right(a: Column, n: Column) -> Column:
    a, n = a.cast("long"), n.cast("int")
    return check(n >= 0, _right(a, n), "negative shift")


def both(a: Column, b: Column) -> Column:
    """a and b; b is not evaluated where a is false."""
    return F.when(a, b).otherwise(F.lit(False))


def either(a: Column, b: Column) -> Column:
    """a or b; b is not evaluated where a is true."""
    return F.when(a, F.lit(True)).otherwise(b)


def to_int(x: Column) -> Column:
    """Truncated toward zero; what is too large becomes the largest long of its sign."""
    x = x.cast("double")
    return F.when(x >= float(1 << 63), F.lit(LONG_MAX)).when(x < float(LONG_MIN), F.lit(LONG_MIN)).otherwise(x.cast("long"))


def to_float(x: Column) -> Column:
    return x.cast("double")


def cond(test: Column, then: Column, other: Column) -> Column:
    """if: only the branch taken is evaluated, as far as it may raise."""
    return F.when(test, then).otherwise(other)


def panic(message: Column | str) -> Column:
    return fail(message)


def error(code: Column | int, message: Column | str) -> Column:
    code = F.lit(code) if isinstance(code, int) else code
    message = F.lit(message) if isinstance(message, str) else message
    return fail(F.concat(F.lit("error "), code.cast("string"), F.lit(": "), message))


def delay(x: Column) -> Column:
    """Columns are lazy, so delaying one does nothing."""
    return x
