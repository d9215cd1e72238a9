"""Column kernels: numerically safe operations, the error function, counting functions.

All are built-in expressions; under ANSI mode no division by zero is left to the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
KCN_D3, KCN_D4, KCN_EEQ, KCN_EEQ_EN = 16.0, 7.5, 7.5, 2.60
KA, KB, R_SHIFT = 10.0, 20.0, 2.0
CUTOFF_D3, CUTOFF_D4, CUTOFF_EEQ, CUTOFF_GFN2, CN_MAX_EEQ = 25.0, 30.0, 25.0, 25.0, 8.0
D4_K4, D4_K5, D4_K6 = 4.10451, 19.08857, 2 * 11.28174**2

Count = Callable[[Column, Column], Column]


def divide(x: Column, y: Column, eps: float = EPS) -> Column:
    """x / y with eps for y where that is zero."""
    return x / F.when(y != 0, y).otherwise(F.lit(float(eps)))


def reciprocal(x: Column, eps: float = EPS) -> Column:
    """1 / (x + eps)."""
    return F.lit(1.0) / (x + F.lit(float(eps)))


def power(x: Column, exponent: float, eps: float = EPS) -> Column:
    """x to a number: zero (whole exponents) or what is out of the domain gives way to eps."""
    if eps == 0:
        raise ValueError("eps must not be zero")
    e, small = float(exponent), F.lit(float(eps))
    if e.is_integer():
        return F.pow(x, F.lit(e)) if e > 0 else F.pow(F.when(x == 0, small).otherwise(x), F.lit(e))
    return F.pow(F.when((x < 0) if e > 0 else (x <= 0), small).otherwise(x), F.lit(e))


def power_all(x: Column, exponent: Column, plain: Column, eps: float = EPS) -> Column:
    """Column exponent: `plain` tells whether, over the whole table, all exponents are positive and no x negative."""
    return F.pow(F.when(plain | (x > 0), x).otherwise(F.lit(float(eps))), exponent)


def sqrt(x: Column, eps: float = EPS) -> Column:
    if eps < 0:
        raise ValueError("eps must not be negative")
    return F.sqrt(F.greatest(x, F.lit(float(eps))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


# W. J. Cody, Rational Chebyshev approximations for the error function, Math. Comp. 23 (1969)
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(v, top, bottom):
    """(num + K) / (den + L) of the Horner pattern; the last of `top` starts it."""
    num, den = v * F.lit(top[-1]), v
    for k, low in zip(top[:-2], bottom[:-1]):
        num, den = (num + F.lit(k)) * v, (den + F.lit(low)) * v
    return (num + F.lit(top[-2])) / (den + F.lit(bottom[-1]))


def erf(x: Column) -> Column:
    """The error function to 2.2e-16. x should be a plain column: it is used many times."""
    s, y = x * x, F.abs(x)
    v = F.lit(1.0) / F.greatest(s, F.lit(16.0))
    mid = F.lit(1.0) - F.exp(-s) * _ratio(y, _C, _D)
    far = F.lit(1.0) - F.exp(-s) * (F.lit(0.5641895835477563) - v * _ratio(v, _P, _Q)) / F.greatest(y, F.lit(4.0))
    return F.when(y <= 0.46875, x * _ratio(s, _A, _B)).otherwise(F.signum(x) * F.when(y <= 4.0, mid).when(y < 6.0, far).otherwise(F.lit(1.0)))


def exp_count(r: Column, r0: Column, kcn: float = KCN_D3) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-kcn) * (divide(r0, r) - 1.0)))


def erf_count(r: Column, r0: Column, kcn: float = KCN_D4) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(F.lit(-kcn) * (divide(r, r0) - 1.0)))


def gfn2_count(r: Column, r0: Column, ka: float = KA, kb: float = KB, shift: float = R_SHIFT) -> Column:
    return exp_count(r, r0, ka) * exp_count(r, r0 + shift, kb)


def dexp_count(r: Column, r0: Column, kcn: float = KCN_D3) -> Column:
    """Derivative by r. The exponent is bounded where the quotient has long vanished, so it stays finite."""
    e = F.exp(F.least(F.lit(-kcn) * (divide(r0, r) - 1.0), F.lit(300.0)))
    e = F.when(F.lit(-kcn) * (divide(r0, r) - 1.0) < -700.0, F.lit(0.0)).otherwise(e)
    return divide(F.lit(-kcn) * r0 * e, r * r * (e + 1.0) * (e + 1.0))


def derf_count(r: Column, r0: Column, kcn: float = KCN_D4) -> Column:
    return F.lit(-kcn / 1.7724538509055159) / r0 * F.exp(F.lit(-kcn * kcn) * (r - r0) * (r - r0) / (r0 * r0))


def dgfn2_count(r: Column, r0: Column, ka: float = KA, kb: float = KB, shift: float = R_SHIFT) -> Column:
    return dexp_count(r, r0, ka) * exp_count(r, r0 + shift, kb) + exp_count(r, r0, ka) * dexp_count(r, r0 + shift, kb)


def cut(cn: Column, cn_max: float = CN_MAX_EEQ) -> Column:
    """Coordination numbers smoothly bounded by cn_max; above 50 there is no bound."""
    if cn_max > 50:
        return cn
    return F.log1p(F.lit(2.718281828459045**cn_max)) - F.log1p(F.exp(F.lit(float(cn_max)) - cn))
