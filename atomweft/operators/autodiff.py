"""Differentiation of column expressions when the plan is built.

A small symbolic layer: nodes know their derivative and their Column. Derivatives of what
does not depend on a variable are literal zeros, which vanish while building. Of many
derivatives together (`evaluated`) each part is computed once. Opaque Python functions of
columns are differentiated by central differences instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.elements import lookup
from .pairs import needs_grid, pairs, real_atoms, within_grid


class Node:
    def __add__(self, o): return _add(self, _node(o))
    __radd__ = __add__
    def __mul__(self, o): return _mul(self, _node(o))
    __rmul__ = __mul__
    def __neg__(self): return self * -1.0
    def __sub__(self, o): return self + -_node(o)
    def __rsub__(self, o): return _node(o) + -self
    def __truediv__(self, o): return self * Pow(_node(o), -1.0)
    def __rtruediv__(self, o): return _node(o) * Pow(self, -1.0)
    def __pow__(self, e): return Pow(self, float(e))


@dataclass(frozen=True)
class Const(Node):
    value: float
    def column(self): return F.lit(self.value)
    def diff(self, v): return Const(0.0)


@dataclass(frozen=True)
class Var(Node):
    name: str
    def column(self): return F.col(self.name)
    def diff(self, v): return Const(1.0 if v == self.name else 0.0)


@dataclass(frozen=True)
class Add(Node):
    a: Node
    b: Node
    def column(self): return self.a.column() + self.b.column()
    def diff(self, v): return self.a.diff(v) + self.b.diff(v)


@dataclass(frozen=True)
class Mul(Node):
    a: Node
    b: Node
    def column(self): return self.a.column() * self.b.column()
    def diff(self, v): return self.a.diff(v) * self.b + self.a * self.b.diff(v)


@dataclass(frozen=True)
class Pow(Node):
    a: Node
    e: float
    def column(self):
        if self.e == -1.0:
            return F.lit(1.0) / self.a.column()
        return F.sqrt(self.a.column()) if self.e == 0.5 else F.pow(self.a.column(), F.lit(self.e))
    def diff(self, v):
        inner = self.a.diff(v)
        return inner if _zero(inner) else Const(self.e) * Pow(self.a, self.e - 1.0) * inner


#: name -> (Column of a Column, derivative Node of a Node)
_CALLS: dict[str, tuple[Callable, Callable]] = {
    "exp": (F.exp, lambda a: Call("exp", a)),
    "log": (F.log, lambda a: 1.0 / a),
    "log1p": (F.log1p, lambda a: 1.0 / (a + 1.0)),
    "erf": (k.erf, lambda a: Const(1.1283791670955126) * Call("exp", -(a * a))),
    "abs": (F.abs, lambda a: Call("sign", a)),
    "sign": (F.signum, lambda a: Const(0.0)),
    "cos": (F.cos, lambda a: -Call("sin", a)),
    "sin": (F.sin, lambda a: Call("cos", a)),
}


@dataclass(frozen=True)
class Call(Node):
    name: str
    a: Node
    def column(self): return _CALLS[self.name][0](self.a.column())
    def diff(self, v):
        inner = self.a.diff(v)
        return inner if _zero(inner) else _CALLS[self.name][1](self.a) * inner


@dataclass(frozen=True)
class Floor(Node):
    """a, or `low` where a is below it; its derivative is that of a."""

    a: Node
    low: float
    def column(self): return F.when(self.a.column() < self.low, F.lit(self.low)).otherwise(self.a.column())
    def diff(self, v): return self.a.diff(v)


@dataclass(frozen=True)
class When(Node):
    """a where the condition (a Column that is not differentiated) holds, else b."""

    condition: Column
    a: Node
    b: Node
    def column(self): return F.when(self.condition, self.a.column()).otherwise(self.b.column())
    def diff(self, v): return When(self.condition, self.a.diff(v), self.b.diff(v))


def _zero(n: Node) -> bool:
    return isinstance(n, Const) and n.value == 0.0


def _node(x) -> Node:
    return x if isinstance(x, Node) else Const(float(x))


def _add(a: Node, b: Node) -> Node:
    if _zero(a) or _zero(b):
        return b if _zero(a) else a
    return Const(a.value + b.value) if isinstance(a, Const) and isinstance(b, Const) else Add(a, b)


def _mul(a: Node, b: Node) -> Node:
    if _zero(a) or _zero(b):
        return Const(0.0)
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Const) and x.value == 1.0:
            return y
    return Const(a.value * b.value) if isinstance(a, Const) and isinstance(b, Const) else Mul(a, b)


def _positive(n: Node, zero: bool = False) -> bool:
    """Whether a node is known to be above zero (or not below it)."""
    if isinstance(n, (Const, Floor)):
        low = n.value if isinstance(n, Const) else n.low
        return low > 0 or (zero and low == 0)
    if isinstance(n, Add):
        return (_positive(n.a) and _positive(n.b, True)) or (_positive(n.a, True) and _positive(n.b, zero))
    return (isinstance(n, Pow) and _positive(n.a)) or (zero and isinstance(n, Call) and n.name == "exp")


def _product(n: Node, times: int) -> Node:
    half = n if times < 2 else _product(n, times // 2)
    return half if times < 2 else _mul(half, half) if times % 2 == 0 else _mul(_mul(half, half), n)


def _power(a: Node, e: float) -> Node:
    """Small halves of whole powers of what is above zero as roots, quotients and products, which take far less time."""
    if isinstance(a, Pow) and _positive(a.a):
        return _power(a.a, a.e * e)
    if not _positive(a) or e in (0.5, -1.0) or not 0 < abs(e) <= 8 or not (2 * e).is_integer():
        return Pow(a, e)
    root = Pow(a, 0.5)
    if e > 0:
        whole = _product(a, int(e)) if e >= 1 else None
        return whole if e.is_integer() else _mul(whole, root)
    one = Pow(a, -1.0) if e.is_integer() else Pow(root, -1.0)
    return _product(one, int(abs(e) if e.is_integer() else 2 * abs(e)))


class _Graph:
    """Nodes as numbers, equal ones with the same: what each is made of, and how often it is named."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple[Node, list[int]]] = []
        self.named: list[int] = []
        self.seen: dict[int, tuple[Node, int]] = {}

    def add(self, n: Node) -> int:
        if id(n) not in self.seen:
            self.seen[id(n)] = (n, self._number(n))  # the node is kept, so its id stays its own
        return self.seen[id(n)][1]

    def _number(self, n: Node) -> int:
        if isinstance(n, Pow):
            made = _power(n.a, n.e)
            if made != n:
                return self.add(made)
        below = [self.add(c) for c in (getattr(n, "a", None), getattr(n, "b", None)) if isinstance(c, Node)]
        own = [repr(v) if isinstance(v, float) else id(v) if isinstance(v, Column) else v for k, v in vars(n).items() if k not in "ab"]
        key = (type(n), *(sorted(below) if isinstance(n, (Add, Mul)) else below), *own)
        if key not in self.numbers:
            self.numbers[key] = len(self.parts)
            self.parts.append((n, below))
            self.named.append(0)
            for c in below:
                self.named[c] += 2 if isinstance(n, Floor) else 1
        return self.numbers[key]


def evaluated(df: DataFrame, keep: list[str], outputs: dict[str, Node]) -> DataFrame:
    """`keep` and the outputs of a table. What outputs have in common is a column of its own below them, so Spark computes it once a row and not once for each time it is named.

    For some tens of parts: of the hundreds that `gradgradcheck` has Spark makes one method too
    large for the JVM to compile, which took four times as long as a column each.
    """
    graph = _Graph()
    roots = {o: graph.add(n) for o, n in outputs.items()}
    for n in roots.values():
        graph.named[n] += 1
    always, left = set(), list(roots.values())
    while left:  # what is below a condition only may not be computed without it
        at = left.pop()
        if at not in always:
            always.add(at)
            left += [] if isinstance(graph.parts[at][0], When) else graph.parts[at][1]
    depth: dict[int, int] = {}
    stages: dict[int, dict[str, Column]] = {}

    def column(at: int) -> tuple[Column, int]:
        """Of a node, and the stage after which it can be computed."""
        n, below = graph.parts[at]
        shared = graph.named[at] > 1 and bool(below) and at in always
        if shared and at in depth:
            return F.col(f"__n{at}"), depth[at]
        made = [column(c) for c in below]
        c, stage = _over(n, [c for c, _ in made]), max([s for _, s in made], default=0)
        if not shared:
            return c, stage
        depth[at] = stage + 1
        stages.setdefault(stage + 1, {})[f"__n{at}"] = c
        return F.col(f"__n{at}"), stage + 1

    made = {o: column(n)[0] for o, n in roots.items()}
    for stage in sorted(stages):
        df = df.withColumns(stages[stage])
    return df.select(*keep, *[c.alias(o) for o, c in made.items()])


@dataclass(frozen=True)
class _Made(Node):
    """A column in the place of a node."""

    made: Column
    def column(self): return self.made


def _over(n: Node, made: list[Column]) -> Column:
    """The column of a node from those of its parts."""
    return replace(n, **dict(zip("ab", map(_Made, made)))).column() if made else n.column()


def jacobian(outputs: dict[str, Node], by: list[str]) -> dict[str, Column]:
    """d<out>_d<var> -> Column."""
    return {f"d{o}_d{v}": n.diff(v).column() for o, n in outputs.items() for v in by}


def hessian(f: Node, by: list[str]) -> dict[str, Column]:
    """h_<a><b> -> Column, for a <= b in the order given."""
    return {f"h_{a}{b}": f.diff(a).diff(b).column() for n, a in enumerate(by) for b in by[n:]}


def central(df: DataFrame, function: Callable[[DataFrame], DataFrame], column: str, on: list[str], value: str, step: float = 1e-6) -> DataFrame:
    """(f(x + h) - f(x - h)) / 2h of an opaque function of a table, its rows matched by `on`."""
    up, down = (function(df.withColumn(column, F.col(column) + s)).select(*on, F.col(value).alias(n)) for s, n in ((step, "__up"), (-step, "__down")))
    return up.join(down, on).select(*on, ((F.col("__up") - F.col("__down")) / F.lit(2 * step)).alias(value))


def shifted(n: Node, name: str, by: float) -> Node:
    """The expression with a variable moved by a constant."""
    if isinstance(n, Var):
        return n + by if n.name == name else n
    if isinstance(n, (Add, Mul)):
        return type(n)(shifted(n.a, name, by), shifted(n.b, name, by))
    if isinstance(n, Pow):
        return Pow(shifted(n.a, name, by), n.e)
    if isinstance(n, Floor):
        return Floor(shifted(n.a, name, by), n.low)
    if isinstance(n, Call):
        return Call(n.name, shifted(n.a, name, by))
    if isinstance(n, When):
        return When(n.condition, shifted(n.a, name, by), shifted(n.b, name, by))
    return n


AXES = {"dx": "x", "dy": "y", "dz": "z"}


def distance() -> Node:
    """Of a pair, from dx, dy and dz, floored as in `pairs`: it is never zero, nor is what is divided by it an error."""
    return Pow(Floor(Var("dx") * Var("dx") + Var("dy") * Var("dy") + Var("dz") * Var("dz"), k.EPS), 0.5)


def exp_count(r0: Node, kcn: float = k.KCN_D3) -> Node:
    return 1.0 / (1.0 + Call("exp", Const(-kcn) * (r0 / distance() - 1.0)))


def erf_count(r0: Node, kcn: float = k.KCN_D4) -> Node:
    return 0.5 * (1.0 + Call("erf", Const(-kcn) * (distance() / r0 - 1.0)))


def _met(atoms: DataFrame, cutoff: float | None, carried: tuple[str, ...], grid: bool, itself: bool = False) -> DataFrame:
    """Pairs that are within the cutoff; `itself`: also each real atom with itself, wherever it is."""
    if grid:
        both = within_grid(atoms, cutoff, carried)
        return both.unionByName(_alone(atoms, carried)) if itself else both
    both = pairs(atoms, itself, carried)
    return both if cutoff is None else both.filter((F.col("d") <= cutoff) | (F.col("i") == F.col("j")) if itself else F.col("d") <= cutoff)


def _alone(atoms: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Each real atom as a pair with itself, told without its system."""
    own = {"i": "atom_idx", "j": "atom_idx", "zi": "z", "zj": "z"} | {f"{c}_{s}": c for c in carried for s in "ij"}
    zero = [F.lit(0.0).alias(v) for v in AXES]
    return real_atoms(atoms).filter("sys_id IS NOT NULL").select("sys_id", *[F.col(c).alias(n) for n, c in own.items()], *zero, F.sqrt(F.lit(k.EPS)).alias("d"))


def _apart(df: DataFrame, names: list[str], sign: float = 1.0) -> DataFrame:
    """Nothing of an atom with itself."""
    return df.withColumns({n: F.when(F.col("i") != F.col("j"), F.col(n) * F.lit(sign)).otherwise(F.lit(0.0)) for n in names})


def pair_jacobian(atoms: DataFrame, term: Node, cutoff: float | None = None, carried: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """sys_id, i, j, gx, gy, gz: d / d R_j of the sum over j of term(pair), for each atom i, the self term i = j included.

    `term` is in dx, dy, dz and any columns of a pair, also those named here. Pairs beyond the
    cutoff are zero and left out.
    """
    first, grid = {f"g{a}": term.diff(v) for v, a in AXES.items()}, cutoff is not None and needs_grid(atoms)
    made = lambda itself: evaluated(_met(atoms, cutoff, carried, grid, itself).withColumns(columns), ["sys_id", "i", "j"], first)
    own = _apart(made(True), list(first), -1.0).groupBy("sys_id", "i").agg(*[F.sum(n).alias(n) for n in first]).withColumn("j", F.col("i"))
    return made(False).unionByName(own)


def pair_hessian(atoms: DataFrame, term: Node, cutoff: float | None = None, carried: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """sys_id, i, j and the nine second derivatives by R_i and R_j of half the sum of term(pair), which must be the same for (i, j) and (j, i).

    The order of the two derivatives does not matter, so six are computed.
    """
    second = {f"h{AXES[a]}{AXES[b]}": term.diff(a).diff(b) for a in AXES for b in AXES if a <= b}
    blocks = evaluated(_met(atoms, cutoff, carried, cutoff is not None and needs_grid(atoms)).withColumns(columns), ["sys_id", "i", "j"], second)
    off = blocks.select("sys_id", "i", "j", *[(-F.col(n)).alias(n) for n in second])
    six = off.unionByName(blocks.groupBy("sys_id", "i").agg(*[F.sum(n).alias(n) for n in second]).withColumn("j", F.col("i")))
    return six.select("sys_id", "i", "j", *[F.col(f"h{min(a, b)}{max(a, b)}").alias(f"h{a}{b}") for a in "xyz" for b in "xyz"])


def gradcheck(both: DataFrame, term: Node, step: float = 1e-6) -> DataFrame:
    """sys_id, max_error: first derivatives of a pair's term against central differences."""
    errors = [(shifted(term, a, step) - shifted(term, a, -step)).column() / F.lit(2 * step) - term.diff(a).column() for a in AXES]
    return both.groupBy("sys_id").agg(F.max(F.greatest(*[F.abs(e) for e in errors])).alias("max_error"))


def gradgradcheck(both: DataFrame, term: Node, step: float = 1e-5) -> DataFrame:
    """sys_id, max_error: second derivatives of a pair's term against central differences of the first, relative where they exceed one."""
    first = {a: term.diff(a) for a in AXES}
    errors = []
    for a in AXES:
        for b in AXES:
            exact = first[a].diff(b).column()
            numeric = (shifted(first[a], b, step) - shifted(first[a], b, -step)).column() / F.lit(2 * step)
            errors.append(F.abs(numeric - exact) / F.greatest(F.abs(exact), F.lit(1.0)))
    return both.groupBy("sys_id").agg(F.max(F.greatest(*errors)).alias("max_error"))


def cn_d3_jacobian(atoms: DataFrame, cutoff: float | None = k.CUTOFF_D3) -> DataFrame:
    """sys_id, i, j, gx, gy, gz: d CN_i / d R_j, the self term i = j included."""
    return pair_jacobian(atoms.withColumn("r", lookup("r_cov", F.col("z"))), exp_count(Var("r0")), cutoff, ("r",), r0=F.col("r_i") + F.col("r_j"))


def repulsion() -> Node:
    """Zi Zj / d of a pair with `zz`."""
    return Var("zz") / distance()


def enn_hessian(atoms: DataFrame, cutoff: float | None = None) -> DataFrame:
    """sys_id, i, j and the nine second derivatives of the nuclear repulsion by R_i and R_j."""
    return pair_hessian(atoms, repulsion(), cutoff, zz=(F.col("zi") * F.col("zj")).cast("double"))


def gradcheck_cn_d3(atoms: DataFrame, step: float = 1e-6, cutoff: float = k.CUTOFF_D3) -> DataFrame:
    """sys_id, max_error: analytic pair derivatives against central differences of the counting function."""
    both = pairs(atoms.withColumn("r", lookup("r_cov", F.col("z"))), carried=("r",)).filter(F.col("d") <= cutoff).withColumn("r0", F.col("r_i") + F.col("r_j"))
    up, down = (k.exp_count(F.col("d") + s, F.col("r0")) for s in (step, -step))
    error = F.abs((up - down) / F.lit(2 * step) - k.dexp_count(F.col("d"), F.col("r0")))
    return both.groupBy("sys_id").agg(F.max(error).alias("max_error"))
