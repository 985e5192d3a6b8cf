"""Queries on fuzzy inference, error measures and test functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scalar
from ..operators import fuzzy as Z
from ..operators import statistics as S
from ..session import spread, table
from ._base import query

CONTROLLER = Z.Controller()
KEY = "l_orderkey, l_linenumber"
_INPUTS = """inputs AS (SELECT l_orderkey, l_linenumber, 14 + (l_quantity - 1) * 20 / 49 AS room_temp, l_discount * 100 AS activity, l_tax * 1250 AS daylight,
  ((l_suppkey % 11) - 5)::DOUBLE AS preference FROM lineitem)"""
_ALPHA = f"{_INPUTS}, alpha AS ({CONTROLLER.sql('inputs', KEY)})"


def inputs(spark, folder):
    """Controller inputs derived from line items."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey")
    return spread(lines).select(
        "l_orderkey", "l_linenumber", (14 + (F.col("l_quantity") - 1) * 20 / 49).alias("room_temp"), (F.col("l_discount") * 100).alias("activity"),
        (F.col("l_tax") * 1250).alias("daylight"), (F.col("l_suppkey") % 11 - 5).cast("double").alias("preference"),
    )


_LEVELS = [f"alpha_{o}_{s}" for o in CONTROLLER.outputs for s in CONTROLLER.variables[o].sets]


@query(f"WITH {_ALPHA} SELECT {KEY}, {', '.join(f'round({a}, 6) AS {a}' for a in _LEVELS)} FROM alpha")
def fuzzy_alpha(spark, folder):
    """Level of every output set for every line item."""
    out = CONTROLLER.levels(CONTROLLER.memberships(inputs(spark, folder)))
    return out.select("l_orderkey", "l_linenumber", *(F.round(a, 6).alias(a) for a in _LEVELS))


_MU = [f"mu_{n}_{s}" for n in CONTROLLER.inputs for s in CONTROLLER.variables[n].sets]


@query(
    f"WITH {_INPUTS}, mu AS ({CONTROLLER.sql('inputs', KEY).replace('SELECT ' + KEY + ', ' + CONTROLLER.sql('inputs', KEY)[len('SELECT ' + KEY + ', '):].split(' FROM (SELECT *, ')[0], 'SELECT *', 1)}) "
    f"SELECT {', '.join(f'round(sum({m}), 4) AS {m}' for m in _MU)} FROM mu"
)
def fuzzy_memberships(spark, folder):
    """Sums of the memberships in the 14 input sets."""
    return CONTROLLER.memberships(inputs(spark, folder)).agg(*(F.round(F.sum(m), 4).alias(m) for m in _MU))


def _grid_sql(o: str) -> str:
    v = CONTROLLER.variables[o]
    step = (v.hi - v.lo) / 500
    rows = f"SELECT i, {v.lo}::DOUBLE + i * ({v.hi} - {v.lo})::DOUBLE / 500 AS y FROM (SELECT unnest(range(501)) AS i)"
    mus = []
    for s, p in v.sets.items():
        a, b, c, d = map(float, p if len(p) == 4 else (p[0], p[1], p[1], p[2]))
        up = f"WHEN y > {a} AND y < {b} THEN (y - {a}) / ({b} - {a}) " if a < b else ""
        down = f"WHEN y > {c} AND y < {d} THEN ({d} - y) / ({d} - {c}) " if c < d else ""
        mus.append(f"CASE WHEN y BETWEEN {b} AND {c} THEN 1.0::DOUBLE {up}{down}ELSE 0.0::DOUBLE END AS m_{s}")
    h = repr(step)
    area = f"CASE WHEN i IN (0, 500) THEN {h} / 2 ELSE {h} END::DOUBLE AS area"
    moment = f"(CASE WHEN i < 500 THEN {h} / 6 * (3 * y + {h}) ELSE 0 END + CASE WHEN i > 0 THEN {h} / 6 * (3 * y - {h}) ELSE 0 END)::DOUBLE AS moment"
    levels = [f"alpha_{o}_{s}" for s in v.sets]
    f = f"greatest({', '.join(f'least(alpha_{o}_{s}, m_{s})' for s in v.sets)})"
    return f"""{o}_grid AS (SELECT i, y, {", ".join(mus)}, {area}, {moment} FROM ({rows})),
{o}_levels AS (SELECT DISTINCT {", ".join(levels)} FROM alpha),
{o}_crisp AS (SELECT {", ".join(levels)}, sum({f} * moment) / nullif(sum({f} * area), 0) AS {o} FROM {o}_levels, {o}_grid GROUP BY ALL)"""


@query(
    f"""WITH {_ALPHA}, {_grid_sql("hvac")}, {_grid_sql("dimmer")}
SELECT {KEY}, round(hvac, 4) AS hvac, round(dimmer, 4) AS dimmer FROM alpha JOIN hvac_crisp USING ({", ".join(x for x in _LEVELS if "hvac" in x)}) JOIN dimmer_crisp USING ({", ".join(x for x in _LEVELS if "dimmer" in x)})"""
)
def fuzzy_control(spark, folder):
    """Crisp outputs of the 54 rules for every line item."""
    return CONTROLLER.infer(inputs(spark, folder)).select("l_orderkey", "l_linenumber", F.round("hvac", 4).alias("hvac"), F.round("dimmer", 4).alias("dimmer"))


_AXES = ", ".join(
    f"{n}_axis AS (SELECT {float(v.lo)}::DOUBLE + k * ({v.hi} - {v.lo})::DOUBLE / {p - 1} AS {n} FROM (SELECT unnest(range({p})) AS k))"
    for n, p, v in ((n, p, CONTROLLER.variables[n]) for n, p in zip(Z.INPUTS, (21, 15, 15, 15), strict=True))
)
_FIRED = CONTROLLER.sql("grid", "id").split(" FROM (SELECT *, ", 1)[1]


def _rule_sql() -> list[str]:
    return [f"least({', '.join(f'mu_{n}_{s}' for n, s in r.antecedents.items())})" for r in CONTROLLER.rules]


def _methods_sql(o: str) -> str:
    """Extremes of an output by all four defuzzifiers, from its curve at the grid points of each distinct combination of levels."""
    v = CONTROLLER.variables[o]
    levels = [f"alpha_{o}_{s}" for s in v.sets]
    f = f"greatest({', '.join(f'least(alpha_{o}_{s}, m_{s})' for s in v.sets)})"
    h = repr((v.hi - v.lo) / 500)
    return f"""{o}_id AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT {", ".join(levels)} FROM alpha)),
{o}_f AS MATERIALIZED (SELECT id, i, y, area, moment, {f} AS f FROM {o}_id, {o}_grid),
{o}_c AS (SELECT id, i, y, (f + lead(f) OVER w) / 2 * {h} AS cell, sum((f + lead_f) / 2 * {h}) OVER (PARTITION BY id ORDER BY i) AS cum FROM (SELECT *, lead(f) OVER w AS lead_f FROM {o}_f WINDOW w AS (PARTITION BY id ORDER BY i)) WINDOW w AS (PARTITION BY id ORDER BY i)),
{o}_t AS (SELECT id, max(cum) AS total FROM {o}_c GROUP BY id),
{o}_at AS (SELECT id, arg_min(y + {h} * (total / 2 - (cum - cell)) / nullif(cell, 0), i) AS v FROM {o}_c JOIN {o}_t USING (id) WHERE i < 500 AND cum >= total / 2 AND total > 0 GROUP BY id),
{o}_top AS (SELECT id, max(f) AS top FROM {o}_f GROUP BY id),
{o}_all AS (SELECT 'centroid' AS method, sum(f * moment) / nullif(sum(f * area), 0) AS v FROM {o}_f GROUP BY id UNION ALL SELECT 'discrete', sum(f * y) / nullif(sum(f), 0) FROM {o}_f GROUP BY id
  UNION ALL SELECT 'bisector', v FROM {o}_at UNION ALL SELECT 'mean_of_maximum', avg(y) FROM {o}_f JOIN {o}_top USING (id) WHERE top > 0 AND f >= top - 1e-12 GROUP BY id),
{o}_range AS (SELECT method, round(min(v), 4) AS min_{o}, round(max(v), 4) AS max_{o} FROM {o}_all GROUP BY method)"""


_GRID_ALPHA = f"""{_AXES}, states AS (SELECT 0 AS id, * FROM {", ".join(f"{n}_axis" for n in Z.INPUTS)}), alpha AS ({CONTROLLER.sql('states', 'id')})"""


@query(
    f"""WITH {_GRID_ALPHA}, {", ".join(_grid_sql(o).split(f"{chr(10)}{o}_levels")[0].rstrip(",") for o in ("hvac", "dimmer"))}, {_methods_sql("hvac")}, {_methods_sql("dimmer")}
SELECT * FROM hvac_range JOIN dimmer_range USING (method)"""
)
def fuzzy_defuzzifiers(spark, folder):
    """Reachable range of each output by all four defuzzifiers over the whole audit grid."""
    base = CONTROLLER.levels(CONTROLLER.memberships(Z.audit_grid(spark)))
    out = None
    for method in ("centroid", "discrete", "bisector", "mean_of_maximum"):
        part = CONTROLLER.crisp(base, method).agg(
            *(F.round(f(F.nanvl(o, F.lit(None).cast("double"))), 4).alias(f"{n}_{o}") for o in ("hvac", "dimmer") for n, f in (("min", F.min), ("max", F.max)))
        ).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_AXES}, grid AS (SELECT 0 AS id, * FROM {", ".join(f"{n}_axis" for n in Z.INPUTS)}), mu AS (SELECT *, {_FIRED},
r AS (SELECT {", ".join(f"{x} AS r{k}" for k, x in enumerate(_rule_sql()))} FROM mu)
SELECT count(*) AS n, CAST(count_if(greatest({", ".join(f"r{k}" for k in range(45))}) <= 0 OR greatest({", ".join(f"r{k}" for k in range(45, 54))}) <= 0) AS BIGINT) AS undefined,
  CAST({" + ".join(f"(max(r{k}) <= 0)::INT" for k in range(54))} AS BIGINT) AS dead, round(avg({" + ".join(f"(r{k} > 0)::INT" for k in range(54))}), 6) AS mean_active,
  CAST(max({" + ".join(f"(r{k} > 0)::INT" for k in range(54))}) AS BIGINT) AS max_active FROM r"""
)
def fuzzy_audit(spark, folder):
    """Coverage of the rules over a grid of 70,875 states."""
    return CONTROLLER.audit(Z.audit_grid(spark)).withColumn("mean_active", F.round("mean_active", 6))


def _crisp_sql(state: str, key: str) -> str:
    """CTEs for the crisp outputs of a table of inputs with key columns; ends in a table ``crisp``."""
    own = {o: ", ".join(x for x in _LEVELS if f"_{o}_" in x) for o in ("hvac", "dimmer")}
    return f"""alpha AS ({CONTROLLER.sql(state, key)}), {_grid_sql("hvac")}, {_grid_sql("dimmer")},
crisp AS (SELECT {key}, round(hvac, 6) AS hvac, round(dimmer, 6) AS dimmer FROM alpha JOIN hvac_crisp USING ({own["hvac"]}) JOIN dimmer_crisp USING ({own["dimmer"]}))"""


@query(
    f"""WITH state AS (SELECT room_temp AS t, preference AS p, room_temp, preference, 5.0::DOUBLE AS activity, 50.0::DOUBLE AS daylight
  FROM (SELECT 14 + k * 20::DOUBLE / 40 AS room_temp FROM (SELECT unnest(range(41)) AS k)), (SELECT -5 + k * 10::DOUBLE / 20 AS preference FROM (SELECT unnest(range(21)) AS k))),
{_crisp_sql("state", "t, p")} SELECT t AS room_temp, p AS preference, hvac, dimmer FROM crisp"""
)
def fuzzy_surface(spark, folder):
    """Control surface of temperature and preference at fixed activity and daylight."""
    state = Z.grid(spark, {"room_temp": (14.0, 34.0, 41), "preference": (-5.0, 5.0, 21)}).withColumns({"activity": F.lit(5.0), "daylight": F.lit(50.0)})
    return CONTROLLER.infer(state).select("room_temp", "preference", F.round("hvac", 6).alias("hvac"), F.round("dimmer", 6).alias("dimmer"))


#: The middle of each input's range, at which the others stay while one varies.
_MIDDLE = {n: (CONTROLLER.variables[n].lo + CONTROLLER.variables[n].hi) / 2 for n in Z.INPUTS}


@query(
    f"""WITH state AS ({" UNION ALL ".join(f"SELECT '{n}' AS varied, k, " + ", ".join(f"({CONTROLLER.variables[m].lo} + k * ({CONTROLLER.variables[m].hi} - {CONTROLLER.variables[m].lo})::DOUBLE / 100) AS {m}" if m == n else f"{_MIDDLE[m]}::DOUBLE AS {m}" for m in Z.INPUTS) + " FROM (SELECT unnest(range(101)) AS k)" for n in Z.INPUTS)}),
{_crisp_sql("state", "varied, k")} SELECT varied, CAST(k AS BIGINT) AS k, hvac, dimmer FROM crisp"""
)
def fuzzy_response(spark, folder):
    """Response curves: each input over its range in 101 steps, the others at their middle."""
    out = None
    for n in Z.INPUTS:
        v = CONTROLLER.variables[n]
        part = spark.range(101).select(F.lit(n).alias("varied"), F.col("id").alias("k"), *((v.lo + F.col("id") * (v.hi - v.lo) / 100).alias(m) if m == n else F.lit(float(_MIDDLE[m])).alias(m) for m in Z.INPUTS))
        out = part if out is None else out.unionByName(part)
    return CONTROLLER.infer(out).select("varied", "k", F.round("hvac", 6).alias("hvac"), F.round("dimmer", 6).alias("dimmer"))


_STRENGTHS = f"[{', '.join(f'r{k}' for k in range(54))}]"


@query(
    f"""WITH {_INPUTS}, states AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT {", ".join(Z.INPUTS)} FROM inputs)), {_crisp_sql("states", "id")},
clamped AS (SELECT id, {", ".join(f"greatest({float(CONTROLLER.variables[n].lo)}, least({float(CONTROLLER.variables[n].hi)}, {n}))::DOUBLE AS {n}" for n in CONTROLLER.inputs)} FROM states),
grid AS (SELECT * FROM clamped), mu AS (SELECT *, {_FIRED}, r AS (SELECT id, {", ".join(f"{x} AS r{k}" for k, x in enumerate(_rule_sql()))} FROM mu)
SELECT {", ".join(f"round({n}, 6) AS {n}" for n in Z.INPUTS)}, CAST({" + ".join(f"(r{k} > 0)::INT" for k in range(54))} AS INTEGER) AS n_active,
  CAST(list_position({_STRENGTHS}, list_max({_STRENGTHS})) - 1 AS INTEGER) AS strongest, hvac, dimmer FROM states JOIN r USING (id) JOIN crisp USING (id)"""
)
def fuzzy_trace(spark, folder):
    """Active rules and outputs of every line item's distinct state."""
    states = inputs(spark, folder).select(*Z.INPUTS).distinct()
    out = CONTROLLER.trace(states)
    return out.select(
        *(F.round(n, 6).alias(n) for n in Z.INPUTS), F.size("active").alias("n_active"), F.get("active", F.lit(0))["rule"].alias("strongest"),
        F.round("hvac", 6).alias("hvac"), F.round("dimmer", 6).alias("dimmer"),
    )


_DAY = """state AS (SELECT CAST(step AS BIGINT) AS step, 22 - 4 * cos(2 * pi() * (h - 4) / 24) AS room_temp, CASE WHEN h BETWEEN 7 AND 22 THEN 5 + 3 * sin(2 * pi() * h / 6) ELSE 1 END AS activity,
  100 * greatest(0.0, sin(pi() * (h - 6) / 12)) AS daylight, 0.0::DOUBLE AS preference FROM (SELECT unnest(range(288)) AS step, unnest(range(288)) / 12.0::DOUBLE AS h))"""


def _day(spark):
    h = F.col("step") / 12.0
    sun = F.greatest(F.lit(0.0), F.sin(F.pi() * (h - 6) / 12))
    day = spark.range(288).withColumnRenamed("id", "step").withColumns({
        "room_temp": 22 - 4 * F.cos(2 * F.pi() * (h - 4) / 24), "activity": F.when(h.between(7, 22), 5 + 3 * F.sin(2 * F.pi() * h / 6)).otherwise(1.0),
        "daylight": 100 * sun, "preference": F.lit(0.0),
    })
    return CONTROLLER.infer(day).select("step", F.round("hvac", 6).alias("hvac"), F.round("dimmer", 6).alias("dimmer"))


@query(f"WITH {_DAY}, {_crisp_sql('state', 'step')} SELECT step, hvac, dimmer, hvac > 5 AS heats FROM crisp")
def fuzzy_day(spark, folder):
    """A day in 288 steps: outputs, and whether it heats."""
    return _day(spark).withColumn("heats", F.col("hvac") > 5)


@query(
    f"""WITH {_DAY}, {_crisp_sql("state", "step")} SELECT count_if(hvac > 5) * 5 / 60.0::DOUBLE AS heating, count_if(hvac < -5) * 5 / 60.0::DOUBLE AS cooling, count_if(dimmer > 50) * 5 / 60.0::DOUBLE AS bright FROM crisp"""
)
def fuzzy_day_hours(spark, folder):
    """Hours of the day of heating, cooling and bright light."""
    hours = lambda c: F.count_if(c) * 5 / 60.0
    return _day(spark).agg(hours(F.col("hvac") > 5).alias("heating"), hours(F.col("hvac") < -5).alias("cooling"), hours(F.col("dimmer") > 50).alias("bright"))


@query(
    f"""WITH t(room_temp, b) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in Z.BASE.items())}), a(activity, s) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in Z.BY_ACTIVITY.items())}),
p(preference, s) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in Z.BY_PREFERENCE.items())}),
r AS (SELECT room_temp, activity, preference, ['CoolHigh', 'CoolLow', 'Off', 'HeatLow', 'HeatHigh'][greatest(-2, least(2, b + greatest(-1, least(1, a.s + p.s)))) + 3] AS s FROM t, a, p)
SELECT room_temp, preference, max(CASE WHEN activity = 'Resting' THEN s END) AS Resting, max(CASE WHEN activity = 'Light' THEN s END) AS Light, max(CASE WHEN activity = 'Active' THEN s END) AS Active FROM r GROUP BY ALL"""
)
def fuzzy_fam(spark, folder):
    """Thermal rules as a table: temperature and preference by activity."""
    rules = Z.rule_table(spark).where("output = 'hvac'")
    return rules.groupBy("room_temp", "preference").pivot("activity", list(Z.BY_ACTIVITY)).agg(F.first("out_set"))


@query(
    f"""WITH {_INPUTS}, e AS (SELECT greatest(-{scalar.LIMIT}, least({scalar.LIMIT}, {scalar.GAIN} * ({scalar.SETPOINT} + {scalar.PER_ACTIVITY} * activity + {scalar.PER_PREFERENCE} * preference - room_temp))) AS h,
  greatest({scalar.LAMP_LOW}, least({scalar.LAMP_HIGH}, {scalar.LAMP} + {scalar.LAMP_PER_ACTIVITY} * activity - {scalar.CREDIT} * daylight)) AS d, room_temp, daylight FROM inputs),
r AS (SELECT sqrt(avg(pow(CASE WHEN room_temp > 33 THEN 200 ELSE 10 * (24 - room_temp) - h END, 2))) / 200 AS hvac, sqrt(avg(pow(100 - daylight - d, 2))) / 100 AS dimmer FROM e)
SELECT round(hvac, 6) AS hvac, round(dimmer, 6) AS dimmer, round((hvac + dimmer) / 2, 6) AS nrmse FROM r"""
)
def nrmse_vs_policy(spark, folder):
    """Error of a linear guess against the reference policy; where the guess is undefined (NaN) it is charged the span."""
    df = inputs(spark, folder)
    h, d = scalar.policy(*(F.col(c) for c in Z.INPUTS))
    guess = F.when(F.col("room_temp") > 33, F.lit(float("nan"))).otherwise(10 * (24 - F.col("room_temp")))
    out = S.nrmse(df, {"hvac": (guess, h, 200.0), "dimmer": (100 - F.col("daylight"), d, 100.0)})
    return out.select(*(F.round(c, 6).alias(c) for c in ("hvac", "dimmer", "nrmse")))


def _vector(dim: int) -> str:
    return f"list_transform(embedding[1:{dim}], lambda v: v::DOUBLE * 100)"


def _shift(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


@query(
    f"""WITH z AS (SELECT vec_id, list_transform(list_zip({_vector(10)}, {_shift(fixed.SHIFT_ROSENBROCK)}), lambda p: p[1] - p[2] + 1) AS z FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 10), lambda i: 100 * pow(z[i] * z[i] - z[i + 1], 2) + pow(z[i] - 1, 2))) + {fixed.BIAS_ROSENBROCK}, 2) AS value FROM z"""
)
def cec_f6(spark, folder):
    """Shifted Rosenbrock values of scaled vectors, ten dimensions."""
    x = F.transform("embedding", lambda v: v.cast("double") * 100)
    return table(spark, folder, "embeddings").select("vec_id", F.round(scalar.shifted_rosenbrock(x, 10), 2).alias("value"))


@query(
    f"""WITH z AS (SELECT vec_id, list_transform(list_zip({_vector(10).replace("* 100", "* 5")}, {_shift(fixed.SHIFT_RASTRIGIN)}), lambda p: p[1] - p[2]) AS z FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(z, lambda v: v * v - 10 * cos(2 * pi() * v) + 10)) + ({fixed.BIAS_RASTRIGIN}), 4) AS value FROM z"""
)
def cec_f9(spark, folder):
    """Shifted Rastrigin values of scaled vectors, ten dimensions."""
    x = F.transform("embedding", lambda v: v.cast("double") * 5)
    return table(spark, folder, "embeddings").select("vec_id", F.round(scalar.shifted_rastrigin(x, 10), 4).alias("value"))


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, greatest(0, least(255, CAST(round_even((l_quantity - 0.5) / 50 * 255, 0) AS INT))) AS b FROM lineitem)
SELECT b AS code, count(*) AS n, round(0.5 + b * (50.0::DOUBLE / 255), 6) AS decoded FROM e GROUP BY b"""
)
def encoding_cost(spark, folder):
    """Eight-bit fixed point of quantities and back."""
    code = scalar.encode8(F.col("l_quantity"), 0.5, 50.5)
    out = table(spark, folder, "lineitem").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return out.withColumn("decoded", F.round(scalar.decode8(F.col("code"), 0.5, 50.5), 6))


@query(
    f"""WITH {_INPUTS}, clamped AS (SELECT {", ".join(f"greatest({float(CONTROLLER.variables[n].lo)}, least({float(CONTROLLER.variables[n].hi)}, {n}))::DOUBLE AS {n}" for n in CONTROLLER.inputs)} FROM inputs),
grid AS (SELECT 0 AS id, * FROM clamped), mu AS (SELECT *, {_FIRED}, r AS (SELECT {", ".join(f"{x} AS r{k}" for k, x in enumerate(_rule_sql()))} FROM mu)
{" UNION ALL ".join(f"SELECT {k} AS rule, CAST(count_if(r{k} > 0) AS BIGINT) AS fired, round(max(r{k}), 6) AS strongest FROM r" for k in range(54))}"""
)
def fuzzy_rule_firing(spark, folder):
    """How often, and how strongly at most, each rule fires over all line items."""
    fired = CONTROLLER.memberships(inputs(spark, folder))
    each = [F.struct(F.lit(k).alias("rule"), F.count_if(f > 0).cast("long").alias("fired"), F.round(F.max(f), 6).alias("strongest")) for k, f in enumerate(CONTROLLER.firing())]
    return fired.agg(F.array(*each).alias("r")).select(F.inline("r"))


_U = lambda k: f"((CAST('0x' || left(md5('11:{k}:' || id), 10) AS BIGINT) + 0.5) / 1099511627776.0::DOUBLE)"


@query(
    f"""WITH s AS (SELECT id, {", ".join(f"{CONTROLLER.variables[n].lo} + {_U(k)} * ({CONTROLLER.variables[n].hi} - {CONTROLLER.variables[n].lo}) AS {n}" for k, n in enumerate(Z.INPUTS))},
  sqrt(-2 * ln({_U(5)})) AS size, 2 * pi() * {_U(6)} AS angle, row_number() OVER (ORDER BY md5('11:9:' || id), id) <= 120 AS is_test FROM (SELECT unnest(range(400)) AS id))
SELECT CAST(id AS BIGINT) AS id, {", ".join(f"round({n}, 6) AS {n}" for n in Z.INPUTS)}, is_test,
  round(greatest(-{scalar.LIMIT}, least({scalar.LIMIT}, {scalar.GAIN} * ({scalar.SETPOINT} + {scalar.PER_ACTIVITY} * activity + {scalar.PER_PREFERENCE} * preference - room_temp))) + 0.03 * 200 * size * cos(angle), 6) AS hvac,
  round(greatest({scalar.LAMP_LOW}, least({scalar.LAMP_HIGH}, {scalar.LAMP} + {scalar.LAMP_PER_ACTIVITY} * activity - {scalar.CREDIT} * daylight)) + 0.03 * 100 * size * sin(angle), 6) AS dimmer FROM s"""
)
def synthetic_samples(spark, folder):
    """Noisy samples of the policy with a fixed split."""
    out = Z.samples(spark)
    return out.select("id", *(F.round(c, 6).alias(c) for c in (*Z.INPUTS, "hvac", "dimmer")), "is_test")


_EDGES = ((14, 0, 0, -5), (34, 10, 100, 5), (24, 5, 50, 0), (14, 10, 100, 5), (34, 0, 0, -5), (22.5, 0, 0, 0), (22.5, 10, 100, 0), (19, 5, 30, 1), (26, 5, 70, -1))


@query(
    f"""WITH raw(state, {", ".join(Z.INPUTS)}) AS (VALUES {", ".join(f"({k}, {', '.join(map(str, e))})" for k, e in enumerate(_EDGES))}),
plain AS (SELECT state, {", ".join(f"{n}::DOUBLE AS {n}" for n in Z.INPUTS)} FROM raw),
{_crisp_sql("plain", "state")} SELECT state, hvac, dimmer, hvac IS NOT NULL AND dimmer IS NOT NULL AS is_defined FROM crisp"""
)
def fuzzy_edges(spark, folder):
    """Outputs of nine named states at the edges of the ranges."""
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("state"), *(F.lit(float(x)).alias(n) for n, x in zip(Z.INPUTS, e, strict=True))) for k, e in enumerate(_EDGES))))
    out = CONTROLLER.infer(spark.range(1).select(rows)).select("state", F.round("hvac", 6).alias("hvac"), F.round("dimmer", 6).alias("dimmer"))
    return out.withColumn("is_defined", ~F.isnan("hvac") & ~F.isnan("dimmer"))


_COARSE = ", ".join(
    f"{n}_axis AS (SELECT {float(v.lo)}::DOUBLE + k * ({v.hi} - {v.lo})::DOUBLE / {p - 1} AS {n} FROM (SELECT unnest(range({p})) AS k))"
    for n, p, v in ((n, p, CONTROLLER.variables[n]) for n, p in zip(Z.INPUTS, (11, 7, 7, 7), strict=True))
)


@query(
    f"""WITH {_COARSE}, grid AS (SELECT 0 AS id, * FROM {", ".join(f"{n}_axis" for n in Z.INPUTS)}), mu AS (SELECT *, {_FIRED},
r AS (SELECT {", ".join(f"{x} AS r{k}" for k, x in enumerate(_rule_sql()))} FROM mu)
SELECT count(*) AS n, CAST(count_if(greatest({", ".join(f"r{k}" for k in range(45))}) <= 0 OR greatest({", ".join(f"r{k}" for k in range(45, 54))}) <= 0) AS BIGINT) AS undefined,
  CAST({" + ".join(f"(max(r{k}) <= 0)::INT" for k in range(54))} AS BIGINT) AS dead, round(avg({" + ".join(f"(r{k} > 0)::INT" for k in range(54))}), 6) AS mean_active,
  CAST(max({" + ".join(f"(r{k} > 0)::INT" for k in range(54))}) AS BIGINT) AS max_active FROM r"""
)
def fuzzy_coarse_audit(spark, folder):
    """Coverage of the rules over the coarse grid of 3,773 states."""
    return CONTROLLER.audit(Z.audit_grid(spark, (11, 7, 7, 7))).withColumn("mean_active", F.round("mean_active", 6))


@query(
    f"""WITH d(daylight, o) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in Z.OFFSET.items())}), a(activity, n) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in Z.NEED.items())}),
r AS (SELECT daylight, activity, CASE WHEN daylight = 'Dim' AND activity = 'Resting' THEN 'Low' ELSE ['Off', 'Low', 'Medium', 'High'][greatest(0, least(3, n - o)) + 1] END AS s FROM d, a)
SELECT daylight, max(CASE WHEN activity = 'Resting' THEN s END) AS Resting, max(CASE WHEN activity = 'Light' THEN s END) AS Light, max(CASE WHEN activity = 'Active' THEN s END) AS Active FROM r GROUP BY daylight"""
)
def fuzzy_light_fam(spark, folder):
    """Lighting rules as a table: daylight by activity."""
    rules = Z.rule_table(spark).where("output = 'dimmer'")
    return rules.groupBy("daylight").pivot("activity", list(Z.BY_ACTIVITY)).agg(F.first("out_set"))


def _sugeno_sql(o: str) -> str:
    own = [(x, float(sum(CONTROLLER.variables[o].sets[r.set]) / len(CONTROLLER.variables[o].sets[r.set]))) for x, r in zip(_rule_sql(), CONTROLLER.rules, strict=True) if r.output == o]
    return f"round(({' + '.join(f'{x} * {v!r}' for x, v in own)}) / nullif({' + '.join(x for x, _ in own)}, 0), 6) AS {o}"


@query(
    f"""WITH {_COARSE}, grid AS (SELECT row_number() OVER () AS id, * FROM {", ".join(f"{n}_axis" for n in Z.INPUTS)}), mu AS (SELECT *, {_FIRED}
SELECT {", ".join(f"round(g.{n}, 6) AS {n}" for n in Z.INPUTS)}, {_sugeno_sql("hvac")}, {_sugeno_sql("dimmer")} FROM mu JOIN grid g USING (id)""".replace("FROM mu JOIN grid g USING (id)", "FROM mu g")
)
def fuzzy_sugeno(spark, folder):
    """Outputs of the variant with constant consequents over the coarse grid."""
    out = CONTROLLER.sugeno(Z.audit_grid(spark, (11, 7, 7, 7)))
    return out.select(*(F.round(c, 6).alias(c) for c in (*Z.INPUTS, "hvac", "dimmer")))
