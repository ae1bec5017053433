"""First-order error propagation for user formulas.

A column ``x`` carries its uncertainty in ``dx``.  A formula is evaluated on
values that know their own partial derivatives, so value and error come out as
two plain Column expressions that Catalyst compiles like any other.
Covariance is ignored: every input counts as independent.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Uncertain:
    """A Column with its partial derivatives by input name."""

    def __init__(self, value: Column, slopes: dict[str, Column] | None = None):
        self.value = value
        self.slopes = slopes or {}

    @staticmethod
    def of(x: "Uncertain | float") -> "Uncertain":
        return x if isinstance(x, Uncertain) else Uncertain(F.lit(float(x)))

    def _chain(self, value: Column, outer: Column) -> "Uncertain":
        return Uncertain(value, {n: outer * s for n, s in self.slopes.items()})

    def _merge(self, other: "Uncertain", value: Column, mine: Column, theirs: Column):
        left = self._chain(value, mine).slopes
        right = other._chain(value, theirs).slopes
        both = {n: left[n] + right[n] for n in left.keys() & right.keys()}
        return Uncertain(value, {**left, **right, **both})

    def __add__(self, other):
        o = Uncertain.of(other)
        return self._merge(o, self.value + o.value, F.lit(1.0), F.lit(1.0))

    def __sub__(self, other):
        o = Uncertain.of(other)
        return self._merge(o, self.value - o.value, F.lit(1.0), F.lit(-1.0))

    def __mul__(self, other):
        o = Uncertain.of(other)
        return self._merge(o, self.value * o.value, o.value, self.value)

    def __truediv__(self, other):
        o = Uncertain.of(other)
        ratio = F.try_divide(self.value, o.value)
        return self._merge(
            o, ratio, F.try_divide(F.lit(1.0), o.value), -F.try_divide(ratio, o.value)
        )

    def __pow__(self, other):
        o = Uncertain.of(other)
        value = F.pow(self.value, o.value)
        base = o.value * F.pow(self.value, o.value - 1)
        # ln of the base is needed only when the exponent itself is uncertain
        exponent = value * F.ln(self.value) if o.slopes else F.lit(0.0)
        return self._merge(o, value, base, exponent)

    def __neg__(self):
        return self._chain(-self.value, F.lit(-1.0))

    def __radd__(self, other):
        return Uncertain.of(other) + self

    def __rsub__(self, other):
        return Uncertain.of(other) - self

    def __rmul__(self, other):
        return Uncertain.of(other) * self

    def __rtruediv__(self, other):
        return Uncertain.of(other) / self

    def __rpow__(self, other):
        return Uncertain.of(other) ** self


def log(x: Uncertain) -> Uncertain:
    return x._chain(F.ln(x.value), F.try_divide(F.lit(1.0), x.value))


def exp(x: Uncertain) -> Uncertain:
    value = F.exp(x.value)
    return x._chain(value, value)


def sqrt(x: Uncertain) -> Uncertain:
    value = F.sqrt(x.value)
    return x._chain(value, F.try_divide(F.lit(0.5), value))


_CALLS = {"log": log, "exp": exp, "sqrt": sqrt}
_BINARY: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.Pow: lambda a, b: a**b,
}


def _names(tree: ast.AST) -> list[str]:
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    return list(dict.fromkeys(found))


def _evaluate(node: ast.AST, inputs: dict[str, Uncertain]) -> Uncertain:
    if isinstance(node, ast.Expression):
        return _evaluate(node.body, inputs)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return Uncertain.of(node.value)
    if isinstance(node, ast.Name):
        return inputs[node.id]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        operand = _evaluate(node.operand, inputs)
        return -operand if isinstance(node.op, ast.USub) else operand
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](
            _evaluate(node.left, inputs), _evaluate(node.right, inputs)
        )
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        if node.func.id in _CALLS and len(node.args) == 1 and not node.keywords:
            return _CALLS[node.func.id](_evaluate(node.args[0], inputs))
    raise ValueError(f"not supported in a formula: {ast.unparse(node)}")


def propagate(
    formula: str, columns: Iterable[str], exact: Iterable[str] = ()
) -> tuple[Column, Column]:
    """Value and error Columns of ``formula`` over the columns of a table.

    Names in ``exact`` need no error column; any other name ``x`` needs ``dx``.
    """
    tree = ast.parse(formula.strip(), mode="eval")
    columns, exact = set(columns), set(exact)
    inputs = {}
    for name in _names(tree):
        if name not in columns:
            raise ValueError(f"no column {name}")
        if name in exact:
            inputs[name] = Uncertain(F.col(name))
        elif f"d{name}" in columns:
            inputs[name] = Uncertain(F.col(name), {name: F.lit(1.0)})
        else:
            raise ValueError(f"no error column d{name}; declare {name} exact?")
    result = _evaluate(tree, inputs)
    terms = [F.pow(F.col(f"d{n}") * s, F.lit(2)) for n, s in result.slopes.items()]
    error = F.sqrt(reduce(lambda a, b: a + b, terms)) if terms else F.lit(0.0)
    return result.value, error


def with_error(
    df: DataFrame, formula: str, exact: Iterable[str] = (), sequential: bool = False
) -> DataFrame:
    """Add ``y`` and ``dy`` from a formula ``"y ~ a / b"``.

    Value and error both see the input row.  With ``sequential`` the error is
    computed after ``y`` is in place, which matters only when ``y`` is also an
    input: its error then sees the new ``y``.
    """
    target, _, body = formula.partition("~")
    target = target.strip()
    if not target.isidentifier() or not body:
        raise ValueError("write the formula as 'y ~ expression'")
    value, error = propagate(body, df.columns, exact)
    if sequential:
        return df.withColumn(target, value).withColumn(f"d{target}", error)
    return df.withColumns({target: value, f"d{target}": error})
