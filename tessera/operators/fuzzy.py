"""Mamdani inference: membership and rule tables compiled to columns, grid defuzzifiers, audits.

Memberships and rule firing are plain column expressions; rules collapse to one
level per output set in Arrow batches. The output curve is max over sets of
min(level, membership) at 501 grid points; a defuzzified value is a ratio of
weighted sums of that curve, taken in Arrow batches with bounded temporaries.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import membership

GRID = 501
#: Rows of a grid temporary: 512 x 501 doubles are 2 MB, which stay in a core's cache.
CHUNK = 512


@dataclass(frozen=True)
class Variable:
    """A variable's range and its sets; three points make a triangle, four a trapezoid."""

    name: str
    lo: float
    hi: float
    sets: Mapping[str, tuple[float, ...]]

    def grid(self) -> np.ndarray:
        return self.lo + np.arange(GRID) * (self.hi - self.lo) / (GRID - 1)

    def curves(self) -> np.ndarray:
        """Memberships of the grid points, a row per set."""
        return np.array([grid_membership(self.grid(), p) for p in self.sets.values()])


@dataclass(frozen=True)
class Rule:
    antecedents: Mapping[str, str]
    output: str
    set: str
    weight: float = 1.0


def grid_membership(x: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    a, b, c, d = p if len(p) == 4 else (p[0], p[1], p[1], p[2])
    up = np.where(x >= b, 1.0, 0.0) if a == b else np.clip((x - a) / (b - a), 0, 1)
    down = np.where(x <= c, 1.0, 0.0) if c == d else np.clip((d - x) / (d - c), 0, 1)
    return np.minimum(up, down)


# --- Fixed values: the six variables of the room controller ---
VARIABLES = (
    Variable("room_temp", 14, 34, {"Cold": (14, 14, 16, 19), "Cool": (17, 19.5, 22), "Comfortable": (20.5, 22.5, 24.5), "Warm": (23, 25.5, 28), "Hot": (26, 29, 34, 34)}),
    Variable("activity", 0, 10, {"Resting": (0, 0, 1.5, 3.5), "Light": (2.5, 5, 7.5), "Active": (6.5, 8.5, 10, 10)}),
    Variable("daylight", 0, 100, {"Dark": (0, 0, 10, 30), "Dim": (20, 45, 70), "Bright": (60, 80, 100, 100)}),
    Variable("preference", -5, 5, {"Cooler": (-5, -5, -3, -1), "Neutral": (-2, 0, 2), "Warmer": (1, 3, 5, 5)}),
    Variable("hvac", -100, 100, {"CoolHigh": (-100, -100, -80, -45), "CoolLow": (-70, -35, 0), "Off": (-15, 0, 15), "HeatLow": (0, 35, 70), "HeatHigh": (45, 80, 100, 100)}),
    Variable("dimmer", 0, 100, {"Off": (0, 0, 5, 20), "Low": (10, 30, 50), "Medium": (40, 60, 80), "High": (70, 88, 100, 100)}),
)
INPUTS = ("room_temp", "activity", "daylight", "preference")
# --- Fixed values: how rules follow from levels ---
BASE = {"Cold": 2, "Cool": 1, "Comfortable": 0, "Warm": -1, "Hot": -2}
BY_ACTIVITY = {"Resting": 1, "Light": 0, "Active": -1}
BY_PREFERENCE = {"Cooler": -1, "Neutral": 0, "Warmer": 1}
NEED, OFFSET = {"Resting": 1, "Light": 2, "Active": 3}, {"Dark": 0, "Dim": 1, "Bright": 2}
OVERRIDE = {("Dim", "Resting"): "Low"}


def room_rules() -> list[Rule]:
    """45 thermal and 9 lighting rules, generated from the levels."""
    heat, light = list(_by_name()["hvac"].sets), list(_by_name()["dimmer"].sets)
    out = []
    for t, a, p in itertools.product(BASE, BY_ACTIVITY, BY_PREFERENCE):
        shift = max(-1, min(1, BY_ACTIVITY[a] + BY_PREFERENCE[p]))
        demand = max(-2, min(2, BASE[t] + shift))
        out.append(Rule({"room_temp": t, "activity": a, "preference": p}, "hvac", heat[demand + 2]))
    for d, a in itertools.product(OFFSET, NEED):
        out.append(Rule({"daylight": d, "activity": a}, "dimmer", OVERRIDE.get((d, a), light[max(0, min(3, NEED[a] - OFFSET[d]))])))
    return out


def _by_name() -> dict[str, Variable]:
    return {v.name: v for v in VARIABLES}


class Controller:
    """Compiled rules; unknown names and empty antecedents are errors at once."""

    def __init__(self, variables: Sequence[Variable] = VARIABLES, rules: Sequence[Rule] | None = None):
        self.variables = {v.name: v for v in variables}
        self.rules = list(rules if rules is not None else room_rules())
        for k, r in enumerate(self.rules):
            if not r.antecedents:
                raise ValueError(f"rule {k} has no antecedents")
            for name, value in (*r.antecedents.items(), (r.output, r.set)):
                if name not in self.variables or value not in self.variables[name].sets:
                    raise ValueError(f"rule {k} names {name} is {value}")
        self.outputs = list(dict.fromkeys(r.output for r in self.rules))
        self.inputs = list(dict.fromkeys(n for r in self.rules for n in r.antecedents))

    def clamped(self, name: str) -> Column:
        v = self.variables[name]
        return F.greatest(F.lit(float(v.lo)), F.least(F.lit(float(v.hi)), F.col(name).cast("double")))

    def memberships(self, df: DataFrame) -> DataFrame:
        """Adds mu_<variable>_<set> of every input."""
        new = {f"mu_{n}_{s}": membership(self.clamped(n), tuple(map(float, p))) for n in self.inputs for s, p in self.variables[n].sets.items()}
        return df.withColumns(new)

    def firing(self) -> list[Column]:
        """One expression per rule: least membership of its antecedents, times its weight."""
        out = []
        for r in self.rules:
            terms = [F.col(f"mu_{n}_{s}") for n, s in r.antecedents.items()]
            out.append((F.least(*terms) if len(terms) > 1 else terms[0]) * r.weight)
        return out

    def levels(self, df: DataFrame) -> DataFrame:
        """Adds alpha_<output>_<set>: rules with one consequent collapse to their greatest firing.

        Taken in Arrow batches: as column expressions all rules make one method of
        more than 8,000 bytes, which the JVM interprets row by row and never compiles.
        """
        mu = list(dict.fromkeys(f"mu_{n}_{s}" for r in self.rules for n, s in r.antecedents.items()))
        new: dict[str, list[tuple[list[int], float]]] = {}
        for o in self.outputs:
            for s in self.variables[o].sets:
                own = [r for r in self.rules if (r.output, r.set) == (o, s)]
                new[f"alpha_{o}_{s}"] = [([mu.index(f"mu_{n}_{x}") for n, x in r.antecedents.items()], r.weight) for r in own]

        @F.pandas_udf(", ".join(f"`{name}` double" for name in new))
        def collapsed(*columns: pd.Series) -> pd.DataFrame:
            values = [c.to_numpy(dtype=float) for c in columns]
            out = {}
            for name, own in new.items():
                fired = [functools.reduce(np.fmin, [values[k] for k in at]) * weight for at, weight in own]
                out[name] = functools.reduce(np.fmax, fired) if fired else np.zeros(len(values[0]))
            return pd.DataFrame(out)

        fired = df.withColumn("__levels", collapsed(*mu))
        return fired.withColumns({name: F.col("__levels")[name] for name in new}).drop("__levels")

    def infer(self, df: DataFrame, method: str = "centroid") -> DataFrame:
        """Adds a column per output; NaN where no rule fires. Null inputs give null levels and NaN."""
        return self.crisp(self.levels(self.memberships(df)), method)

    def crisp(self, df: DataFrame, method: str = "centroid") -> DataFrame:
        """The outputs of a table that has the levels, which go."""
        new = {o: defuzzifier(self.variables[o], method)(*[F.col(f"alpha_{o}_{s}") for s in self.variables[o].sets]) for o in self.outputs}
        drop = [c for c in df.columns if c.startswith(("mu_", "alpha_"))]
        return df.withColumns(new).drop(*drop)

    def sugeno(self, df: DataFrame, constants: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
        """Adds a column per output by weighted averages: rules' firing times the constant of their set, over all firing; null where no rule fires.

        A set's constant is given, or the mean of its parameters. No grid is involved.
        """
        base = self.memberships(df)
        new = {}
        for o in self.outputs:
            value = {s: float((constants or {}).get((o, s), np.mean(p))) for s, p in self.variables[o].sets.items()}
            own = [(f, value[r.set]) for f, r in zip(self.firing(), self.rules, strict=True) if r.output == o]
            top, bottom = sum((f * v for f, v in own), F.lit(0.0)), sum((f for f, _ in own), F.lit(0.0))
            new[o] = F.when(bottom > 0, top / bottom)
        return base.withColumns(new).drop(*[c for c in base.columns if c.startswith("mu_")])

    def trace(self, df: DataFrame, top: int | None = None) -> DataFrame:
        """Adds memberships and levels as structs, the rules that fire (strongest first, at most ``top`` if given) and the outputs."""
        df = self.levels(self.memberships(df))
        active = F.filter(F.array(*(F.struct((-f).alias("minus"), F.lit(k).alias("rule")) for k, f in enumerate(self.firing()))), lambda r: r["minus"] < 0)
        ranked = F.array_sort(active) if top is None else F.slice(F.array_sort(active), 1, top)
        rules = F.transform(ranked, lambda r: F.struct(r["rule"].alias("rule"), (-r["minus"]).alias("strength")))
        mu, alpha = ([c for c in df.columns if c.startswith(p)] for p in ("mu_", "alpha_"))
        df = df.withColumns({"memberships": F.struct(*mu), "levels": F.struct(*alpha), "active": rules})
        new = {o: defuzzifier(self.variables[o], "centroid")(*[F.col(f"alpha_{o}_{s}") for s in self.variables[o].sets]) for o in self.outputs}
        return df.withColumns(new).drop(*mu, *alpha)

    def audit(self, df: DataFrame) -> DataFrame:
        """One row: inputs, undefined outputs, rules that never fire, mean and most active rules."""
        fired = self.levels(self.memberships(df))
        active = sum(((f > 0).cast("int") for f in self.firing()), F.lit(0))
        undefined = F.lit(False)
        for o in self.outputs:
            undefined = undefined | (F.greatest(*[F.col(f"alpha_{o}_{s}") for s in self.variables[o].sets], F.lit(0.0)) <= 0)
        best = [F.max(f).alias(f"r{k}") for k, f in enumerate(self.firing())]
        out = fired.agg(F.count("*").alias("n"), F.count_if(undefined).cast("long").alias("undefined"), F.avg(active).alias("mean_active"), F.max(active).cast("long").alias("max_active"), *best)
        dead = sum(((F.col(f"r{k}") <= 0).cast("int") for k in range(len(self.rules))), F.lit(0))
        return out.select("n", "undefined", dead.cast("long").alias("dead"), "mean_active", "max_active")

    def sql(self, table: str, key: str) -> str:
        """The levels as SQL text over a table that has the inputs."""

        def ramp(x: str, p: tuple[float, ...]) -> str:
            a, b, c, d = map(float, p if len(p) == 4 else (p[0], p[1], p[1], p[2]))
            up = f"WHEN {x} > {a} AND {x} < {b} THEN ({x} - {a}) / ({b} - {a}) " if a < b else ""
            down = f"WHEN {x} > {c} AND {x} < {d} THEN ({d} - {x}) / ({d} - {c}) " if c < d else ""
            return f"CASE WHEN {x} BETWEEN {b} AND {c} THEN 1.0::DOUBLE {up}{down}ELSE 0.0::DOUBLE END"

        clamp = ", ".join(f"greatest({float(self.variables[n].lo)}, least({float(self.variables[n].hi)}, {n}))::DOUBLE AS {n}" for n in self.inputs)
        mu = ", ".join(f"{ramp(n, p)} AS mu_{n}_{s}" for n in self.inputs for s, p in self.variables[n].sets.items())
        fired = [f"least({', '.join(f'mu_{n}_{s}' for n, s in r.antecedents.items())}) * {float(r.weight)}" for r in self.rules]
        alpha = []
        for o in self.outputs:
            for s in self.variables[o].sets:
                own = [fired[k] for k, r in enumerate(self.rules) if (r.output, r.set) == (o, s)]
                alpha.append(f"greatest({', '.join(own)}, 0.0) AS alpha_{o}_{s}")
        return f"SELECT {key}, {', '.join(alpha)} FROM (SELECT *, {mu} FROM (SELECT {key}, {clamp} FROM {table}))"


def _curve(levels: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """The aggregated curve of each row, on the grid; a set only touches the points of its support."""
    out = np.zeros((len(levels), curves.shape[1]))
    for level, curve in zip(levels.T, curves, strict=True):
        support = np.flatnonzero(curve)
        part = slice(support[0], support[-1] + 1)
        np.maximum(out[:, part], np.minimum(level[:, None], curve[part]), out=out[:, part])
    return out


def defuzzify(levels: np.ndarray, v: Variable, method: str = "centroid") -> np.ndarray:
    """Crisp values of rows of levels; NaN where the curve is zero."""
    y, curves = v.grid(), v.curves()
    step = y[1] - y[0]
    if method == "centroid":  # exact moments of the piecewise linear curve
        area, moment = np.full(GRID, step), np.zeros(GRID)
        area[[0, -1]] = step / 2
        moment[:-1] += step / 6 * (2 * y[:-1] + y[1:])
        moment[1:] += step / 6 * (y[:-1] + 2 * y[1:])
    elif method == "discrete":
        area, moment = np.ones(GRID), y
    else:
        area = moment = None
    out = np.full(len(levels), np.nan)
    levels = np.nan_to_num(levels)
    for k in range(0, len(levels), CHUNK):
        f = _curve(levels[k : k + CHUNK], curves)
        some = f.max(axis=1) > 0
        if area is not None:
            sums = f @ np.column_stack([moment, area])
            with np.errstate(invalid="ignore", divide="ignore"):
                out[k : k + CHUNK] = np.where(some, sums[:, 0] / sums[:, 1], np.nan)
        elif method == "bisector":
            cells = (f[:, 1:] + f[:, :-1]) / 2 * step
            cum = np.cumsum(cells, axis=1)
            half = cum[:, -1:] / 2
            at = np.minimum((cum < half).sum(axis=1), GRID - 2)
            r = np.arange(len(f))
            before = cum[r, at] - cells[r, at]
            with np.errstate(invalid="ignore", divide="ignore"):
                out[k : k + CHUNK] = np.where(some, y[at] + step * (half[:, 0] - before) / cells[r, at], np.nan)
        elif method == "mean_of_maximum":
            top = f >= f.max(axis=1, keepdims=True) - 1e-12
            out[k : k + CHUNK] = np.where(some, (top * y).sum(axis=1) / top.sum(axis=1), np.nan)
        else:
            raise ValueError(f"unknown method {method}")
    return out


def defuzzifier(v: Variable, method: str):
    @F.pandas_udf("double")
    def run(*levels: pd.Series) -> pd.Series:
        # rows share few combinations of levels: a curve is made for each of a batch once
        rows = np.nan_to_num(np.column_stack([x.to_numpy(dtype=float) for x in levels])) + 0.0
        _, first, same = np.unique(rows.view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return pd.Series(defuzzify(rows[first], v, method)[same])

    return run


def grid(spark: SparkSession, axes: Mapping[str, tuple[float, float, int]]) -> DataFrame:
    """The product of evenly spaced axes (name -> low, high, points), spread over tasks: a row's number, read digit by digit, says its point on each axis."""
    out, left = spark.range(math.prod(n for _, _, n in axes.values())), F.col("id")
    for name, (lo, hi, n) in reversed(axes.items()):
        points = F.array(*(F.lit(lo + k * (hi - lo) / (n - 1)) for k in range(n)))  # a handful of values
        out = out.withColumn(name, F.get(points, (left % n).cast("int")))
        left = F.floor(left / n)
    return out.select(*axes)


def audit_grid(spark: SparkSession, points: tuple[int, int, int, int] = (21, 15, 15, 15)) -> DataFrame:
    v = _by_name()
    return grid(spark, {n: (float(v[n].lo), float(v[n].hi), k) for n, k in zip(INPUTS, points, strict=True)})


def rule_table(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(rule_id, room_temp, activity, daylight, preference, output, out_set); a null antecedent does not matter."""
    rows = [(k, *(r.antecedents.get(n) for n in INPUTS), r.output, r.set) for k, r in enumerate(rules or room_rules())]
    return spark.createDataFrame(rows, "rule_id int, room_temp string, activity string, daylight string, preference string, output string, out_set string")


def parameters(variables: Sequence[Variable] = VARIABLES) -> np.ndarray:
    """All set parameters in order."""
    return np.array([x for v in variables for p in v.sets.values() for x in p], dtype=float)


def with_parameters(values: np.ndarray, variables: Sequence[Variable] = VARIABLES) -> list[Variable]:
    """Variables rebuilt from parameters; each set's are clipped to the range and sorted."""
    out, at = [], 0
    for v in variables:
        sets = {}
        for s, p in v.sets.items():
            sets[s] = tuple(sorted(float(np.clip(x, v.lo, v.hi)) for x in values[at : at + len(p)]))
            at += len(p)
        out.append(Variable(v.name, v.lo, v.hi, sets))
    return out


def infer_rows(rows: np.ndarray, controller: Controller) -> dict[str, np.ndarray]:
    """The same inference for a small matrix of inputs (columns as INPUTS), for search loops and tests."""
    mu = {}
    for k, n in enumerate(INPUTS):
        v = controller.variables[n]
        x = np.clip(rows[:, k], v.lo, v.hi)
        for s, p in v.sets.items():
            mu[n, s] = grid_membership(x, p)
    out = {}
    for o in controller.outputs:
        sets = list(controller.variables[o].sets)
        levels = np.zeros((len(rows), len(sets)))
        for r in controller.rules:
            if r.output == o:
                fire = np.min([mu[a] for a in r.antecedents.items()], axis=0) * r.weight
                k = sets.index(r.set)
                levels[:, k] = np.maximum(levels[:, k], fire)
        out[o] = defuzzify(levels, controller.variables[o])
    return out


def samples(spark: SparkSession, n: int = 400, noise: float = 0.03, test: float = 0.3, seed: int = 11) -> DataFrame:
    """(id, inputs, hvac, dimmer, is_test): uniform states with the policy's outputs and Gaussian noise.

    Draws are hashes of (seed, id), so partitions and reruns agree; the test rows
    are the first round(n * test) in the order of another hash.
    """
    from ..functions.scalar import policy

    def order(k: int) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("id").cast("string")).cast("binary"))

    def uniform(k: int) -> Column:
        return (F.conv(F.substring(order(k), 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)

    v = _by_name()
    df = spark.range(n).select("id", *((v[name].lo + uniform(k) * (v[name].hi - v[name].lo)).alias(name) for k, name in enumerate(INPUTS)))
    normal = F.sqrt(-2.0 * F.log(uniform(5)))
    outputs = policy(*(F.col(c) for c in INPUTS))
    df = df.withColumn("hvac", outputs[0] + noise * 200 * normal * F.cos(2 * F.pi() * uniform(6))).withColumn("dimmer", outputs[1] + noise * 100 * normal * F.sin(2 * F.pi() * uniform(6)))
    chosen = df.select("id").orderBy(order(9), "id").limit(round(n * test)).withColumn("is_test", F.lit(True))
    return df.join(chosen, "id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
