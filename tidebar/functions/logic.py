"""Column builders under three-valued logic: an unknown (null) is never taken as false.

All windows share the partitioning (product) and order (i), so that a plan has one exchange and one sort for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: a since-operator looks back at most so many bars.
STREAK_CAP = 400


def by_day():
    return Window.partitionBy("product").orderBy("i")


def up_to():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def number(c: Column) -> Column:
    """A double without NaN."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def all3(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any3(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def atleast(n: int, columns: list[Column]) -> Column:
    yes = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in columns], F.lit(0))
    unknown = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in columns], F.lit(0))
    return F.when(yes >= n, True).when(yes + unknown < n, False)


def case3(pairs: list[tuple[Column, Column]], otherwise: Column, kind: str) -> Column:
    """The value of the first true condition; null if a condition before it is unknown."""
    out = None
    for c, v in pairs:
        out = (F.when(c.isNull(), F.lit(None).cast(kind)) if out is None else out.when(c.isNull(), F.lit(None).cast(kind))).when(c, v)
    return out.otherwise(otherwise)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def both(pick, a: Column, b: Column) -> Column:
    """pick (greatest, least) of two values; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def strict(agg, c: Column, n: int) -> Column:
    """agg over the n bars up to this one; null if one of them is unknown or missing."""
    w = by_day().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def compare(op: str, a: Column, b: Column, a_bound: Column | None = None, b_bound: Column | None = None) -> Column:
    """a op b, op one of gt ge lt le; a bound says that the true value is at least the given one."""
    exact = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
    if a_bound is None and b_bound is None:
        return exact
    on_left = {"gt": F.when(a > b, True), "ge": F.when(a >= b, True), "lt": F.when(a >= b, False), "le": F.when(a > b, False)}[op]
    on_right = {"lt": F.when(b > a, True), "le": F.when(b >= a, True), "gt": F.when(b >= a, False), "ge": F.when(b > a, False)}[op]
    left, right = (F.lit(False) if x is None else F.coalesce(x, F.lit(False)) for x in (a_bound, b_bound))
    return F.when(left & right, F.lit(None).cast("boolean")).when(left, on_left).when(right, on_right).otherwise(exact)


def since(c: Column) -> dict[str, Column]:
    """Position of the last true c, that of the last unknown one, and the lower bound of the bars since."""
    return {"lt": F.max(F.when(c, F.col("i"))).over(up_to()), "ln": F.max(F.when(c.isNull(), F.col("i"))).over(up_to())}


def since_known(lt: Column, ln: Column) -> Column:
    """Whether the last true bar lies within the cap and after the last unknown one."""
    return F.coalesce(lt.isNotNull() & (lt > F.coalesce(ln, F.lit(-1))) & (F.col("i") - lt < STREAK_CAP), F.lit(False))


def barssince(lt: Column, ln: Column) -> tuple[Column, Column]:
    """(value, whether it is a lower bound)."""
    known = since_known(lt, ln)
    least = F.least(F.lit(STREAK_CAP), F.col("i") - F.coalesce(ln, F.lit(-1)))
    return F.when(known, (F.col("i") - lt).cast("double")).when(least > 0, least.cast("double")), ~known & (least > 0)


def valuewhen(lt: Column, ln: Column, c: Column, s: Column) -> Column:
    return F.when(since_known(lt, ln), F.last(F.when(c, F.struct(s.alias("s"))), ignorenulls=True).over(up_to())["s"])


def extreme_since(agg, lt: str, ln: Column, c: Column, s: Column) -> Column:
    """agg (min, max) of s from the last true c on; null if a c or s is unknown in between."""
    seg = Window.partitionBy("product", lt).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.max((c.isNull() | s.isNull()).cast("int")).over(seg)
    return F.when(since_known(F.col(lt), ln) & (bad == 0), agg(s).over(seg))
