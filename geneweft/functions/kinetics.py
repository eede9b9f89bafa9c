"""Hill terms, effective rates and stimulus waveforms as column expressions."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hill_rep(repressor: Column, kd: Column, n: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(repressor / kd, n))


def hill_act(activator: Column, kd: Column, n: Column) -> Column:
    x = F.pow(activator / kd, n)
    return x / (F.lit(1.0) + x)


def active_repressor(repressor: Column, inducer: Column, kd: Column, n: Column) -> Column:
    """The share of a repressor left active by its inducer."""
    return repressor / (F.lit(1.0) + F.pow(inducer / kd, n))


def free_pool(total: Column, bound: Column) -> Column:
    return total / (F.lit(1.0) + bound)


def transcription(rate: Column, leak: Column, activity: Column, free: Column, km: Column) -> Column:
    return rate * (leak + (F.lit(1.0) - leak) * activity) * (free / (km + free))


def translation(rate: Column, mrna: Column, free: Column, km: Column) -> Column:
    return rate * mrna * (free / (km + free))


def pulse(t: Column, start: Column, duration: Column, amp: Column) -> Column:
    """``amp`` on the closed interval from start to start plus duration, otherwise 0."""
    return F.when((t >= start) & (t <= start + duration), amp).otherwise(F.lit(0.0))


def sine(t: Column, amp: Column, freq: Column) -> Column:
    return amp * (F.lit(1.0) + F.sin(F.lit(2 * math.pi) * freq * t)) / F.lit(2.0)


def stimulus(t: Column, spec: Column) -> Column:
    """Waveform value at ``t`` of a struct (type, start, duration, amp, freq); unknown types give 0."""
    kind = F.coalesce(spec["type"], F.lit("pulse"))
    amp = F.coalesce(spec["amp"], F.lit(1.0))
    return F.when(
        kind == "pulse",
        pulse(t, F.coalesce(spec["start"], F.lit(0.0)), F.coalesce(spec["duration"], F.lit(1000.0)), amp),
    ).when(kind == "sine", sine(t, amp, F.coalesce(spec["freq"], F.lit(0.05)))).otherwise(F.lit(0.0))


CALLS = {
    "abs": F.abs, "cos": F.cos, "exp": F.exp, "floor": F.floor, "greatest": F.greatest, "least": F.least, "ln": F.ln,
    "log10": F.log10, "pow": F.pow, "power": F.pow, "sign": F.signum, "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}
SIGNS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: F.pow,
}


def _value(node: ast.expr, t: Column) -> Column:
    """Column of an arithmetic expression; ValueError for anything else."""
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name) and node.id in ("t", "pi", "e"):
        return {"t": t, "pi": F.lit(math.pi), "e": F.lit(math.e)}[node.id]
    if isinstance(node, ast.BinOp) and type(node.op) in SIGNS:
        return SIGNS[type(node.op)](_value(node.left, t), _value(node.right, t))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _value(node.operand, t)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS and not node.keywords:
        return CALLS[node.func.id](*[_value(a, t) for a in node.args])
    raise ValueError("not an arithmetic expression in t")


def stimulus_expression(spec: str, t: str = "t") -> Column:
    """``"start: expr"``, an arithmetic expression in ``t`` over the column named ``t``; 0 before start.

    ``t``, ``pi``, ``e``, numbers, ``+ - * / **`` and the functions in ``CALLS`` may appear; anything
    else, and what cannot be read, gives 0 throughout.
    """
    head, colon, tail = spec.partition(":")
    try:
        start = float(head) if colon else 0.0
    except ValueError:
        return F.lit(0.0)
    try:
        value = _value(ast.parse((tail if colon else head).strip(), mode="eval").body, F.col(t))
    except (SyntaxError, TypeError, ValueError, RecursionError):
        return F.lit(0.0)
    return F.when(F.col(t) < F.lit(start), F.lit(0.0)).otherwise(value.cast("double"))
