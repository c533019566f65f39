"""Rounding that agrees with Python's ``round(x, n)``.

Python rounds the *exact* binary value of a double (half-even only on exact
ties). Spark's ``bround``/``round`` round the shortest decimal string of the
double instead, so a value printed as ``80.525`` (exactly
80.52500000000000568...) becomes 80.52 in Spark and 80.53 in Python.

The two can only disagree when the value lies next to a rounding midpoint,
i.e. when ``x * 10^(n+1)`` rounds to an integer ending in 5. Only there the
exact side of the midpoint is decided with error-free double arithmetic:
the value is split into two halves of 26 bits (Veltkamp), each half times
``10^(n+1)`` is exact, and so is the sign of their sum minus the midpoint.
Everything is built-in arithmetic without lambdas, so it stays inside
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2^27 + 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _py_round_value(y: Column, n: int) -> Column:
    s = float(10 ** (n + 1))
    t = F.round(y * F.lit(s))  # nearest multiple of 10^-(n+1), as a double
    tie_candidate = F.pmod(t.cast("long"), F.lit(10)) == F.lit(5)
    c = y * F.lit(_SPLITTER)
    hi = c - (c - y)
    lo = y - hi
    # exact sign of y * s - t
    side = F.signum((hi * F.lit(s) - t) + lo * F.lit(s))
    down = (t - F.lit(5.0)) / F.lit(s)
    up = (t + F.lit(5.0)) / F.lit(s)
    lower_even = F.pmod(((t - F.lit(5.0)) / F.lit(10.0)).cast("long"), F.lit(2)) == F.lit(0)
    exact = F.when(side > 0, up).when(side < 0, down).when(lower_even, down).otherwise(up)
    # "+ 0.0" turns a negative zero into 0.0, so every engine prints 0.0.
    return F.when(tie_candidate, exact).otherwise(F.bround(y, n)) + F.lit(0.0)


def py_round(x, n: int = 2) -> Column:
    """``round(x, n)`` with Python's semantics, for doubles of moderate size
    (|x| * 10^(n+1) well below 2^53). A negative zero comes back as 0.0.

    The result refers to ``x`` several times, so a costly argument should be
    staged as a column first; it is plain arithmetic, without lambdas, and
    generated code computes the repeated parts once."""
    return _py_round_value(_col(x).cast("double"), n)
