"""A keyed permutation of 0 .. n - 1 as a column expression, so that a shuffled order needs no list, no sort and no join.

A place x is split as l * b + r, a and b being about the root of n, and for six rounds one half is moved by a keyed function of the other,
modulo its size; every round can be undone. Of the a * b >= n values fewer than a lie at n or above; a value that lands there is sent on
until it comes below n (cycle walking), which keeps the map one to one. Up to 4,096 values the walk is as long as the values allow; beyond,
it ends within WALK steps but for one chance in 64 ** 64, and then an error is raised rather than a wrong place given.

The order depends on n and the seed alone. `where_to` finds the place of a row in the shuffled order, `where_from` the row at a place. All
numbers stay below 2 ** 62, so that other engines compute the same (`where_to_sql`).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, WALK = 6, 64
#: Two primes below 2 ** 31 and a factor for each; a product modulo one, then modulo the other, is no linear function.
P1, P2 = 2147483647, 2147483629
C1, C2 = 1103515245, 1664525013


def _sizes(n: int) -> tuple[int, int]:
    if not 0 < n < 1 << 60:
        raise ValueError("a permutation needs 1 to 2 ** 60 values")
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def round_keys(seed: int) -> list[int]:
    """Numbers below 2 ** 31 for the rounds."""
    x, out = seed & (1 << 64) - 1, []
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = x
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> shift)) * factor & (1 << 64) - 1
        out.append((z ^ (z >> 31)) >> 33)
    return out


def _plain(number: int):
    return number


def _moved(x, key: int, size: int, of):
    """A keyed function of a half, below size."""
    return (x + of(key)) % of(P1) * of(C1) % of(P1) * of(C2) % of(P2) % of(size)


def once(x, sizes, seed: int, div, of=_plain):
    """One pass through the rounds, of a number, a column or an SQL text; may be n or above. div divides whole numbers, of makes what x is of a number."""
    a, b = sizes
    left, right = div(x, of(b)), x % of(b)
    for k, key in enumerate(round_keys(seed)):
        if k % 2:
            right = (right + _moved(left, key, b, of)) % of(b)
        else:
            left = (left + _moved(right, key, a, of)) % of(a)
    return left * of(b) + right


def once_back(x, sizes, seed: int, div, of=_plain):
    a, b = sizes
    left, right = div(x, of(b)), x % of(b)
    for k, key in reversed(list(enumerate(round_keys(seed)))):
        if k % 2:
            right = (right + of(b) - _moved(left, key, b, of)) % of(b)
        else:
            left = (left + of(a) - _moved(right, key, a, of)) % of(a)
    return left * of(b) + right


def place_of(i: int, n: int, seed: int, step=once) -> int:
    """The same for one number, in Python."""
    x = step(i, _sizes(n), seed, lambda p, q: p // q)
    while x >= n:
        x = step(x, _sizes(n), seed, lambda p, q: p // q)
    return x


def _long(number: int) -> Column:
    return F.expr(f"{number}L")


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def _walked(i: Column, n: int, seed: int, step) -> Column:
    # of an array of one value, so that the rounds see a variable and stand in the plan twice, not once for each use
    again = lambda x: step(x, _sizes(n), seed, _div, _long)
    first = F.transform(F.array(i.cast("long")), again)
    walk = lambda x: F.aggregate(F.array_repeat(F.lit(0), WALK), x, lambda y, _: F.when(y < _long(n), y).otherwise(again(y)))
    out = F.get(F.transform(first, lambda x: F.when(x < _long(n), x).otherwise(walk(x))), F.lit(0))
    ended = F.transform(F.array(out), lambda x: F.when(x < _long(n), x).otherwise(F.raise_error(F.lit("the permutation's walk did not end")).cast("long")))
    return F.when(i.isNotNull() & (i >= 0) & (i < n), F.get(ended, F.lit(0)))


def where_to(i: Column, n: int, seed: int) -> Column:
    """The place of row i, 0 <= i < n, in the shuffled order; null for other rows."""
    return _walked(i, n, seed, once)


def where_from(place: Column, n: int, seed: int) -> Column:
    """The row at a place of the shuffled order; null for places that it has not."""
    return _walked(place, n, seed, once_back)


class _Sql(str):
    """An SQL text that arithmetic extends."""

    def _with(self, sign: str, other: str) -> _Sql:
        return _Sql(f"({self} {sign} {other})")

    __add__ = lambda self, other: self._with("+", other)
    __sub__ = lambda self, other: self._with("-", other)
    __mul__ = lambda self, other: self._with("*", other)
    __mod__ = lambda self, other: self._with("%", other)


def once_sql(x: str, a: str, b: str, seed: int) -> str:
    """DuckDB's expression for one pass; a is floor(sqrt(n - 1)) + 1, and b is n / a rounded up."""
    return once(_Sql(x), (_Sql(a), _Sql(b)), seed, lambda p, q: p._with("//", q), lambda v: _Sql(v) if isinstance(v, str) else _Sql(f"{v}::bigint"))
