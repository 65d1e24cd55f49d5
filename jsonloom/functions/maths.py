"""Math on doubles. What Spark has is used as it is; the rest goes through Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Functions of one number under the name that Spark has for them.
UNARY = {
    "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "fabs": F.abs, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log10": F.log10, "log2": F.log2, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "rint": F.rint, "nearbyint": F.rint,
}
NAN, INFINITE = float("nan"), float("inf")


def unary(name: str, x: Column) -> Column:
    x = x.cast("double")
    if name == "log":
        return log(x)
    if name in ("log10", "log2", "log1p"):
        low = -1.0 if name == "log1p" else 0.0
        return F.when(x < low, F.lit(NAN)).when(x == low, F.lit(-INFINITE)).otherwise(UNARY[name](x))
    return UNARY[name](x).cast("double")


def log(x: Column) -> Column:
    """-Infinity at zero and NaN below, where Spark has null."""
    x = x.cast("double")
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INFINITE)).otherwise(F.ln(x))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def round(x: Column) -> Column:
    """Halves go away from zero."""
    x = x.cast("double")
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5))


def trunc(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def pow(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def fmod(x: Column, y: Column) -> Column:
    """NaN for a zero divisor."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, F.lit(NAN)).otherwise(x % F.when(y == 0, F.lit(1.0)).otherwise(y))


def remainder(x: Column, y: Column) -> Column:
    """The IEEE remainder: what is left of the nearest multiple."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, F.lit(NAN)).otherwise(x - y * F.rint(x / F.when(y == 0, F.lit(1.0)).otherwise(y)))


def fmax(x: Column, y: Column) -> Column:
    """The greater; NaN only if both are."""
    return F.greatest(F.nanvl(x.cast("double"), y.cast("double")), F.nanvl(y.cast("double"), x.cast("double")))


def fmin(x: Column, y: Column) -> Column:
    return F.least(F.nanvl(x.cast("double"), y.cast("double")), F.nanvl(y.cast("double"), x.cast("double")))


def fdim(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.greatest(x.cast("double") - y.cast("double"), F.lit(0.0)))


def copysign(x: Column, y: Column) -> Column:
    """The size of x with the sign of y; a zero's sign counts."""
    negative = (y < 0) | (y.cast("double").cast("string") == "-0.0")
    return F.when(negative, -F.abs(x)).otherwise(F.abs(x))


def ldexp(x: Column, n: Column) -> Column:
    return x.cast("double") * F.pow(F.lit(2.0), n)


def logb(x: Column) -> Column:
    """The binary exponent."""
    return F.when(x == 0, F.lit(-INFINITE)).otherwise(floor_log2(x).cast("double"))


def floor_log2(x: Column) -> Column:
    """floor(log2|x|), put right where the logarithm rounds over a power of two."""
    near = F.floor(F.log2(F.abs(x.cast("double"))))
    return F.when(F.pow(F.lit(2.0), near) > F.abs(x), near - 1).when(F.pow(F.lit(2.0), near + 1) <= F.abs(x), near + 1).otherwise(near)


def significand(x: Column) -> Column:
    x = x.cast("double")
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == INFINITE), x).otherwise(x / F.pow(F.lit(2.0), floor_log2(x)))


def frexp(x: Column) -> Column:
    """[mantissa in [0.5, 1), exponent]."""
    x = x.cast("double")
    exponent = floor_log2(x) + 1
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == INFINITE), F.array(x, F.lit(0.0))).otherwise(F.array(x / F.pow(F.lit(2.0), exponent), exponent.cast("double")))


def modf(x: Column) -> Column:
    """[fraction, whole part], both with the number's sign."""
    x = x.cast("double")
    return F.array(F.when(F.abs(x) == INFINITE, F.lit(0.0)).otherwise(x - trunc(x)), trunc(x))


def special(name: str, *args: Column) -> Column:
    """gamma (the logarithm), lgamma, tgamma, erf, erfc, nextafter, nexttoward, fma, j0, j1, jn, y0, y1, yn; null for null."""

    def over(*columns):
        some = pc.and_(columns[0].is_valid(), columns[-1].is_valid()) if len(columns) < 3 else pc.and_(pc.and_(columns[0].is_valid(), columns[1].is_valid()), columns[2].is_valid())
        given = [c.filter(some).to_numpy(zero_copy_only=False) for c in columns]
        found = BATCHED[name](*given) if name in BATCHED else np.array([_value(name, *row) for row in zip(*(g.tolist() for g in given), strict=True)])
        out = np.zeros(len(some))
        out[some.to_numpy(zero_copy_only=False)] = found
        return pa.array(out, pa.float64(), mask=pc.invert(some).to_numpy(zero_copy_only=False))

    takes = {1: lambda x: over(x), 2: lambda x, y: over(x, y), 3: lambda x, y, z: over(x, y, z)}[len(args)]
    takes.__annotations__ = dict.fromkeys([*"xyz"[: len(args)], "return"], pa.Array)
    return arrow_udf(takes, "double")(*[a.cast("double") for a in args])


def _value(name: str, *args: float) -> float:
    try:
        return SINGLE[name](*args)
    except (ValueError, OverflowError):
        return INFINITE if "gamma" in name else NAN


def lgamma_r(x: Column) -> Column:
    """[logarithm of gamma's size, gamma's sign]; the sign is 1 at poles below zero."""
    x = x.cast("double")
    negative = (x.cast("string") == "-0.0") | ((x < 0) & (F.floor(x) != x) & (F.pmod(F.floor(x), F.lit(2)) == 1))
    return F.when(x.isNotNull(), F.array(special("lgamma", x), F.when(negative, -1.0).otherwise(1.0)))


def _by_series(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J and Y of order n for moderate x > 0: a recurrence down the orders gives J, Neumann's series Y of orders 0 and 1."""
    order, here, norm, even, odd, wanted, one = 0, 1, 2, 3, 4, 5, 6
    state = np.zeros((7, len(x)))
    state[here] = 1e-200
    for k in range(int(max(x.max(), n) + 12 * x.max() ** (1 / 3) + 40) | 1, -1, -1):
        half, sign = k // 2, -1 if k // 2 % 2 else 1
        if k % 2 == 0:
            state[norm] += state[here] * (2 if k else 1)
            state[even] += state[here] * (sign / half if k else 0)
        elif half:
            state[odd] += state[here] * (sign * k / (half * (half + 1)))
        if k == n:
            state[wanted] = state[here]
        if k == 1:
            state[one] = state[here]
        if k:
            state[order], state[here] = state[here].copy(), 2 * k / x * state[here] - state[order]
            state *= np.where(np.abs(state[here]) > 1e200, 1e-200, 1.0)
    state /= state[norm].copy()
    log = np.log(x / 2) + np.euler_gamma
    y, above = 2 / np.pi * (log * state[here] - 2 * state[even]), 2 / np.pi * (-state[here] / x + (log - 1) * state[one] - state[odd])
    for k in range(1, n + 1):
        y, above = above, 2 * k / x * above - y
    return state[wanted], y


def _far(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J and Y of order n for x far above the order's square, by Hankel's expansion."""
    p, q, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, 16):
        term = term * (4 * n * n - (2 * k - 1) ** 2) / (8 * k * x)
        if k % 2:
            q += term * (-1 if k % 4 == 3 else 1)
        else:
            p += term * (-1 if k % 4 == 2 else 1)
    angle, size = n % 4 * np.pi / 2 + np.pi / 4, np.sqrt(2 / (np.pi * x))
    c, s = np.cos(x) * np.cos(angle) + np.sin(x) * np.sin(angle), np.sin(x) * np.cos(angle) - np.cos(x) * np.sin(angle)
    return size * (p * c - q * s), size * (p * s + q * c)


def bessel(n: np.ndarray, x: np.ndarray, second: bool) -> np.ndarray:
    """J, or with `second` Y, of whole orders n at x: NaN for Y below zero."""
    out = np.full(len(x), NAN)
    with np.errstate(all="ignore"):
        for order in np.unique(np.trunc(n[np.isfinite(n)])).astype(int):
            m, mine = abs(int(order)), np.trunc(n) == order
            size = np.abs(x)
            flip = -1.0 if order < 0 and m % 2 else 1.0
            signs = np.full(len(x), flip) if second else np.where((x < 0) & (m % 2 == 1), -flip, flip)
            for which, f in (
                (size == INFINITE, lambda m, v: (np.zeros_like(v), np.zeros_like(v))),
                ((size >= max(60, 2 * m * m)) & (size < INFINITE), _far),
                ((size >= 1e-8) & (size < max(60, 2 * m * m)), _by_series),
                (size < 1e-8, lambda m, v: ((v / 2) ** m / math.gamma(m + 1) if m < 170 else v * 0, 2 / np.pi * (np.log(v / 2) + np.euler_gamma) if m == 0 else -(math.gamma(m) if m < 170 else INFINITE) / np.pi * (2 / v) ** m)),
            ):
                at = np.flatnonzero(mine & which & ~((x < 0) & second))
                if len(at):
                    out[at] = f(m, size[at])[second] * signs[at]
    return out


def tgamma(x: float) -> float:
    """Infinite at zero, with its sign; NaN at the other poles."""
    if x == 0:
        return math.copysign(INFINITE, x)
    return NAN if x < 0 and x == math.floor(x) else math.gamma(x)


#: Functions of numbers, and of numpy arrays.
SINGLE = {"gamma": math.lgamma, "lgamma": math.lgamma, "tgamma": tgamma, "erf": math.erf, "erfc": math.erfc, "fma": math.fma}
BATCHED = {
    "nextafter": np.nextafter, "nexttoward": np.nextafter, "j0": lambda x: bessel(np.zeros_like(x), x, False), "j1": lambda x: bessel(np.ones_like(x), x, False), "jn": lambda n, x: bessel(n, x, False),
    "y0": lambda x: bessel(np.zeros_like(x), x, True), "y1": lambda x: bessel(np.ones_like(x), x, True), "yn": lambda n, x: bessel(n, x, True),
}


def drem(x: Column, y: Column) -> Column:
    return remainder(x, y)


def scalb(x: Column, n: Column) -> Column:
    """x by two to the power of n."""
    return ldexp(x, n)


def scalbln(x: Column, n: Column) -> Column:
    return ldexp(x, trunc(n))


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == INFINITE, F.lit(False))


def is_nan(x: Column) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~is_infinite(x)


def is_normal(x: Column) -> Column:
    """A number that is no zero, subnormal, infinity or NaN."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) >= 2.2250738585072014e-308) & (F.abs(x) < INFINITE), F.lit(False))
