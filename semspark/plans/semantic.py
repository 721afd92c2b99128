"""Metrics over tables: a model of entities, dimensions, measures and metrics, compiled to DataFrame operations.

A measure is aggregated at its own table's grain after many-to-one joins along entities, so a join never multiplies
rows; metrics over several tables are aggregated apart and met on their dimensions. Time ranges become half-open
predicates on the raw column, so they reach the scan. Predicate order, pruning and join strategy are left to Catalyst.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """agg: sum, count, count_distinct, avg, min, max, sum_boolean. A filter makes other rows count as nothing (0 for sums)."""

    expr: str
    agg: str = "sum"
    filter: str | None = None

    def column(self) -> Column:
        e = F.expr(self.expr)
        keep = F.expr(self.filter) if self.filter else None
        if self.agg in ("sum", "sum_boolean"):
            e = e.cast("int") if self.agg == "sum_boolean" else e
            return F.sum(e if keep is None else F.when(keep, e).otherwise(F.lit(0)))
        e = e if keep is None else F.when(keep, e)
        return {"count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}[self.agg](e)


@dataclass(frozen=True)
class Table:
    """primary, foreign: entity -> key column. dimensions: name -> expression. time: name -> date or timestamp column."""

    frame: DataFrame
    measures: Mapping[str, Measure] = field(default_factory=dict)
    dimensions: Mapping[str, str] = field(default_factory=dict)
    time: Mapping[str, str] = field(default_factory=dict)
    primary: Mapping[str, str] = field(default_factory=dict)
    foreign: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    """kind: simple (measure), ratio (numerator, denominator), derived (expr over metrics), cumulative (measure, days; None: all time)."""

    kind: str = "simple"
    measure: str | None = None
    filter: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    metrics: tuple[str, ...] = ()
    days: int | None = None


@dataclass(frozen=True)
class Request:
    """Metrics by dimensions (``name`` or ``entity__name``), with filters, an inclusive time range, order and limit."""

    metrics: tuple[str, ...]
    by: tuple[str, ...] = ()
    where: tuple[str, ...] = ()
    time: str | None = None
    start: str | None = None
    end: str | None = None
    grain: str | None = None
    order: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0


OPERATORS = {"eq": "=", "equals": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _literal(value: object) -> str:
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "\\'") + "'"


def filter_text(item: Mapping | str) -> str:
    """A structured filter ({member, operator, values} or ``member:operator:value``) as an expression."""
    if isinstance(item, str):
        member, operator, value = item.split(":", 2)
        item = {"member": member, "operator": operator, "values": value.split(",") if operator in ("in", "between") else [value]}
    values = list(item.get("values") or [item.get("value")])
    member, operator = item.get("member") or item["dimension"], item["operator"]
    if operator == "between":
        return f"{member} BETWEEN {_literal(values[0])} AND {_literal(values[1])}"
    if operator == "in" or operator == "equals" and len(values) > 1:
        return f"{member} IN ({', '.join(map(_literal, values))})"
    return f"{member} {OPERATORS[operator]} {_literal(values[0])}"


def cube_request(query: Mapping) -> Request:
    """A cube query object (measures, dimensions, timeDimensions, filters, order, limit, offset) as a request."""
    times = query.get("timeDimensions") or [{}]
    start, end = (times[0].get("dateRange") or [None, None])[:2]
    order = tuple(("-" if d == "desc" else "") + m for m, d in (query.get("order") or {}).items())
    return Request(tuple(query["measures"]), tuple(query.get("dimensions") or ()), tuple(filter_text(f) for f in query.get("filters") or ()), times[0].get("dimension"), start, end, times[0].get("granularity"), order, query.get("limit", 10000), query.get("offset") or 0)


class SemanticModel:
    def __init__(self, tables: Mapping[str, Table], metrics: Mapping[str, Metric], saved: Mapping[str, Request] | None = None):
        self.tables, self.metrics, self.saved = dict(tables), dict(metrics), dict(saved or {})

    def owner(self, measure: str) -> str:
        return next(n for n, t in self.tables.items() if measure in t.measures)

    def path(self, table: str, entity: str) -> list[tuple[str, str]]:
        """Shortest chain of (entity, table) from ``table`` to the table whose primary entity is ``entity``."""
        todo, seen = deque([(table, [])]), {table}
        while todo:
            at, hops = todo.popleft()
            if hops and hops[-1][0] == entity:
                return hops
            for e in self.tables[at].foreign:
                for n, t in self.tables.items():
                    if e in t.primary and n not in seen:
                        seen.add(n)
                        todo.append((n, [*hops, (e, n)]))
        raise ValueError(f"no way from {table} to {entity}")

    def dimension_names(self, table: str) -> list[str]:
        """All dimensions that rows of ``table`` can be grouped by."""
        out = [*self.tables[table].dimensions, *self.tables[table].time]
        for n, t in self.tables.items():
            for e in t.primary:
                if n != table:
                    try:
                        self.path(table, e)
                    except ValueError:
                        continue
                    out += [f"{e}__{d}" for d in (*t.dimensions, *t.time)]
        return out

    def list_metrics(self) -> dict[str, list[str]]:
        return {m: self.dimension_names(self.owner(self._measures(m)[0])) for m in self.metrics}

    def _measures(self, metric: str) -> list[str]:
        m = self.metrics[metric]
        parts = [p for p in (m.numerator, m.denominator) if p] + list(m.metrics)
        return [m.measure] if m.measure else [x for p in parts for x in self._measures(p)]

    def _rows(self, table: str, names: set[str], text: str) -> DataFrame:
        """Rows of a table with its dimensions and those of reached tables that ``names`` or ``text`` mention."""
        t = self.tables[table]
        rows = t.frame.withColumns({n: F.expr(e) for n, e in {**t.dimensions, **t.time}.items() if e != n})
        wanted: dict[str, set[str]] = {}
        for full in self.dimension_names(table):
            if "__" in full and (full in names or full in text):
                entity, _, name = full.partition("__")
                wanted.setdefault(entity, set()).add(name)
        joined: set[str] = set()
        for entity in wanted:
            at, prefix = table, ""
            for e, n in self.path(table, entity):
                target = self.tables[n]
                key = f"_key_{e}"
                if e not in joined:
                    joined.add(e)
                    own = {f"{e}__{d}": F.expr(x) for d, x in {**target.dimensions, **target.time}.items()}
                    keys = {f"_{e}_{f}": F.col(c) for f, c in target.foreign.items()}
                    right = target.frame.select(F.col(target.primary[e]).alias(key), *[c.alias(k) for k, c in {**own, **keys}.items()])
                    left = F.col(self.tables[at].foreign[e]) if not prefix else F.col(f"_{prefix}_{e}")
                    rows = rows.join(right, left == F.col(key), "left")
                at, prefix = n, e
        return rows

    def _aggregate(self, table: str, pairs: dict[tuple[str, str | None], str], r: Request, extra: dict[str, str | None]) -> DataFrame:
        """One row per dimensions with a column for each (measure, metric filter)."""
        text = " ".join([*r.where, *(f or "" for _, f in pairs), *(f or "" for f in extra.values())])
        rows = self._rows(table, {*r.by, r.time or ""}, text)
        if r.time and r.start:
            rows = rows.filter(F.col(r.time) >= F.lit(r.start).cast("date"))
        if r.time and r.end:
            rows = rows.filter(F.col(r.time) < F.date_add(F.lit(r.end).cast("date"), 1))
        for w in r.where:
            rows = rows.filter(F.expr(w))
        aggs = []
        for (measure, keep), name in pairs.items():
            m = self.tables[table].measures[measure]
            if keep:  # of a metric, not of the measure: rows outside do not count at all
                base = Measure(f"CASE WHEN {keep} THEN {m.expr} END", m.agg, m.filter)
                aggs.append(base.column().alias(name))
            else:
                aggs.append(m.column().alias(name))
        return rows.groupBy(*self._keys(r)).agg(*aggs)

    def _keys(self, r: Request) -> list[Column]:
        keys = [F.col(b) for b in r.by]
        if r.grain:
            keys.append(F.trunc(F.col(r.time).cast("date"), r.grain).alias("metric_time") if r.grain != "day" else F.col(r.time).cast("date").alias("metric_time"))
        return keys

    def query(self, request: Request | str) -> DataFrame:
        r = self.saved[request] if isinstance(request, str) else request
        keys = [*r.by, *(["metric_time"] if r.grain else [])]
        wanted: dict[str, dict[tuple[str, str | None], str]] = {}

        def need(metric: str) -> None:
            m = self.metrics[metric]
            if m.measure:
                wanted.setdefault(self.owner(m.measure), {})[m.measure, m.filter] = metric
            for p in [x for x in (m.numerator, m.denominator) if x] + list(m.metrics):
                need(p)

        for m in r.metrics:
            need(m)
        parts = [self._aggregate(t, pairs, r, {}) for t, pairs in wanted.items()]

        def meet(a: DataFrame, b: DataFrame) -> DataFrame:
            if not keys:
                return a.crossJoin(b)  # two single rows
            right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
            both = a.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), "full")
            return both.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys}).drop(*[f"_r_{k}" for k in keys])

        out = reduce(meet, parts)
        for m in self._in_order(r.metrics):
            x = self.metrics[m]
            if x.kind == "ratio":
                out = out.withColumn(m, F.try_divide(F.col(x.numerator).cast("double"), F.col(x.denominator).cast("double")))
            elif x.kind == "derived":
                out = out.withColumn(m, F.expr(x.expr))
            elif x.kind == "cumulative":
                out = self._cumulative(out, m, x, r)
        out = out.select(*keys, *r.metrics)
        if r.order:
            out = out.orderBy(*[F.col(o.lstrip("-")).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in r.order])
        if r.offset:
            out = out.offset(r.offset)
        return out.limit(r.limit) if r.limit is not None else out

    def _in_order(self, metrics: tuple[str, ...]) -> list[str]:
        out: list[str] = []
        for m in metrics:
            x = self.metrics[m]
            out += [p for p in self._in_order(tuple(p for p in (x.numerator, x.denominator, *x.metrics) if p)) if p not in out]
            if m not in out:
                out.append(m)
        return out

    def _cumulative(self, daily: DataFrame, name: str, m: Metric, r: Request) -> DataFrame:
        """Over a spine from the first to the last day of the data; days without rows carry on."""
        if r.grain != "day":
            raise ValueError("a cumulative metric needs the grain day")
        others = [F.col(b) for b in r.by]
        ends = daily.agg(F.min("metric_time").alias("lo"), F.max("metric_time").alias("hi"))
        days = F.explode(F.sequence("lo", "hi")).alias("_day")
        own = {b: f"_g{i}" for i, b in enumerate(r.by)}
        if r.by:  # the one row of ends beside each group
            groups = daily.select(*[F.col(b).alias(g) for b, g in own.items()]).distinct()
            spine = groups.join(F.broadcast(ends), F.lit(True)).select(*own.values(), days)
        else:
            spine = ends.select(days)
        on = [F.col("_day") == F.col("metric_time"), *[F.col(g).eqNullSafe(F.col(b)) for b, g in own.items()]]
        full = spine.join(daily, on, "left").withColumns({"metric_time": F.col("_day"), **{b: F.col(g) for b, g in own.items()}}).drop("_day", *own.values())
        w = W.partitionBy(*others).orderBy("metric_time")
        w = w.rowsBetween(W.unboundedPreceding if m.days is None else 1 - m.days, 0)
        return full.withColumn(name, F.coalesce(F.sum(name).over(w), F.lit(0)))

    def validate(self) -> dict[str, str]:
        """Name -> message for every measure, dimension and metric that Spark can't resolve; no data is read."""
        bad: dict[str, str] = {}
        for n, t in self.tables.items():
            for d, e in {**t.dimensions, **t.time}.items():
                self._try(bad, f"{n}.{d}", lambda t=t, e=e: t.frame.select(F.expr(e)).schema)
            for d, x in t.measures.items():
                self._try(bad, f"{n}.{d}", lambda t=t, x=x: t.frame.agg(x.column()).schema)
        for m in self.metrics:
            grain = {"grain": "day", "time": next(iter(self.tables[self.owner(self._measures(m)[0])].time), None)} if self.metrics[m].kind == "cumulative" else {}
            self._try(bad, m, lambda m=m, grain=grain: self.query(Request((m,), **grain)).schema)
        return bad

    @staticmethod
    def _try(bad: dict[str, str], name: str, f) -> None:  # noqa: ANN001
        try:
            f()
        except Exception as e:  # noqa: BLE001
            bad[name] = str(e).splitlines()[0]

    def explain(self, request: Request | str) -> str:
        """The plan of a request without running it."""
        return self.query(request)._jdf.queryExecution().toString()
