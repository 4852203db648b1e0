"""Algebra on columns in place of an external system (MTH03, MTH09). Polynomials are arrays of coefficients, the constant first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(p: Column, x: Column) -> Column:
    """The polynomial at x."""
    return F.aggregate(F.reverse(p), F.lit(0.0), lambda a, c: a * x + c)


def derivative(p: Column) -> Column:
    """MTH03: the coefficients of the derivative; a constant's is [0]."""
    d = F.slice(F.transform(p, lambda c, i: c * i), F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    return F.when(F.size(p) > 1, d).otherwise(F.array(F.lit(0.0)))


def integral(p: Column, low: Column, high: Column) -> Column:
    """MTH03: the definite integral."""
    whole = F.concat(F.array(F.lit(0.0)), F.transform(p, lambda c, i: c / (i + 1)))
    return value(whole, high) - value(whole, low)


def common_factor(terms: Column) -> Column:
    """MTH09: the greatest common divisor of an array of whole numbers."""
    def step(a, b):
        turns = F.sequence(F.lit(0), F.lit(92))  # no pair of longs needs more divisions
        pair = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
        return F.aggregate(turns, pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))), lambda s: s["a"])

    return F.aggregate(terms, F.lit(0).cast("long"), step)


def completed_square(a: Column, b: Column, c: Column) -> Column:
    """MTH09: struct(factor, shift, rest) with factor (x + shift)^2 + rest = a x^2 + b x + c."""
    return F.struct(a.alias("factor"), (b / (2 * a)).alias("shift"), (c - b * b / (4 * a)).alias("rest"))


#: A sign that begins a term: not one of an exponent, a factor or a number's power of ten.
SIGN = r"(?<![\^*/(]|[0-9.][eE])[+-]"
#: What an operator costs; any function costs CALL.
COSTS, CALL = {"+": 1, "*": 1, "/": 3, "^": 10}, 50


def term_count(expression: Column) -> Column:
    """MTH09: the number of terms of a sum without parentheses; blanks don't count."""
    return F.size(F.filter(F.split(F.regexp_replace(expression, r"\s", ""), SIGN), lambda t: t != ""))


def operation_cost(expression: Column) -> Column:
    """MTH09: the cost of an expression's operators (a sign between terms is a +) and functions, and 1 for each number and name."""
    bare = F.regexp_replace(expression, r"\s", "")
    signs = F.regexp_count(bare, F.lit(r"(?<=[\w)])(?<![0-9.][eE])[+-]"))
    cost = signs * COSTS["+"] + F.regexp_count(bare, F.lit(r"[A-Za-z_]\w*\(")) * CALL
    for op in "*/^":
        cost = cost + F.regexp_count(bare, F.lit(rf"\{op}")) * COSTS[op]
    return cost + F.regexp_count(bare, F.lit(r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[A-Za-z_]\w*+(?!\()"))


def prefactor(p: Column) -> Column:
    """MTH09: struct(factor, power, rest): the polynomial of whole coefficients as factor * x^power * rest, both as great as they can be.

    The factor has the sign of the highest coefficient; of zero alone it is 0, and the rest empty.
    """
    nonzero = F.filter(F.transform(p, lambda c, i: F.when(c != 0, i).otherwise(-1)), lambda i: i >= 0)
    low, high = F.array_min(nonzero), F.array_max(nonzero)
    factor = common_factor(p) * F.signum(F.get(p, high)).cast("long")
    rest = F.transform(F.slice(p, low + 1, high - low + 1), lambda c: F.try_divide(c, factor).cast("long"))
    none = F.size(nonzero) == 0
    return F.struct(F.when(none, 0).otherwise(factor).cast("long").alias("factor"), F.when(none, 0).otherwise(low).cast("int").alias("power"), F.when(none, F.array().cast("array<bigint>")).otherwise(rest).alias("rest"))
