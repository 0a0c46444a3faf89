"""Expressions to DataFrame plans and, for comparison, to SQL text.

Conditions on columns become filters, so they reach the scan. Among the outermost conjuncts a
lone tag term is a semi join and its negation an anti join. Tag terms anywhere else are
gathered in one pass over the tags as flags of each path, which are never null, so that NOT
means the same as NOT EXISTS. Ratings and colours are compared without a guard against null,
dates and numbers with one; negation shows the difference, and it is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.plans import expressions as E
from shoebox.plans.parser import parse


def column(expression: E.Expression, flags: dict[E.Expression, Column] | None = None) -> Column:
    """The condition as a Column; flags has the tag terms."""
    x, again = expression, lambda e: column(e, flags)
    if isinstance(x, E.And):
        return again(x.left) & again(x.right)
    if isinstance(x, E.Or):
        return again(x.left) | again(x.right)
    if isinstance(x, E.Not):
        return ~again(x.expr)
    if isinstance(x, E.Rating):
        return _compared(F.col("rating"), x.op, x.value)
    if isinstance(x, E.MediaType):
        return F.col("media_type") == x.value
    if isinstance(x, E.ColorLabel):
        label = x.value.strip().lower()
        return F.col("color_label").isNull() if label == "none" else F.col("color_label") == label
    if isinstance(x, E.HasGeo):
        return F.col("gps_lat").isNotNull() if x.present else F.col("gps_lat").isNull()
    if isinstance(x, E.DateRange):
        c = F.col(E.DATE_COLUMNS[x.field])
        found = c.isNotNull()
        found = found if x.start is None else found & (c >= F.lit(x.start))
        return found if x.end is None else found & (c <= F.lit(x.end))
    if isinstance(x, E.Number):
        c = F.col(E.NUMBER_COLUMNS[x.field])
        return c.isNotNull() & _compared(c, x.op, x.value)
    if isinstance(x, E.HasNamespace) and x.namespace is E.ANY:
        return F.lit(True)
    return flags[x]


def _compared(c: Column, op: str, value: int) -> Column:
    return {"gte": c >= F.lit(value), "lte": c <= F.lit(value), "eq": c == F.lit(value)}[op]


def _tagged(term: E.Expression) -> Column:
    """The rows of the tags that satisfy a tag term."""
    if isinstance(term, E.HasNamespace):
        return F.col("namespace") == term.namespace
    found = F.col("tag") == term.value
    return found if term.namespace is E.ANY else (F.col("namespace") == term.namespace) & found


def _conjuncts(expression: E.Expression) -> list[E.Expression]:
    return _conjuncts(expression.left) + _conjuncts(expression.right) if isinstance(expression, E.And) else [expression]


def apply(media: DataFrame, tags: DataFrame, expression: E.Expression | str) -> DataFrame:
    """The rows of media that satisfy the filter; blank text keeps all."""
    if isinstance(expression, str):
        if not expression.strip():
            return media
        expression = parse(expression)
    nested = []
    for part in _conjuncts(expression):
        bare = part.expr if isinstance(part, E.Not) else part
        if not E.terms(part):
            media = media.filter(column(part))
        elif bare in E.terms(part):
            media = media.join(tags.filter(_tagged(bare)).select("path"), "path", "left_anti" if part is not bare else "left_semi")
        else:
            nested.append(part)
    if not nested:
        return media
    known = sorted({t for part in nested for t in E.terms(part)}, key=repr)
    wanted = tags.filter(_any([_tagged(t) for t in known]))
    flags = wanted.groupBy("path").agg(*[F.max(_tagged(t)).alias(f"__has_{k}") for k, t in enumerate(known)])
    kept = media.columns
    found = media.join(flags, "path", "left")
    has = {t: F.coalesce(F.col(f"__has_{k}"), F.lit(False)) for k, t in enumerate(known)}
    for part in nested:
        found = found.filter(column(part, has))
    return found.select(*kept)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def sql(expression: E.Expression, media: str = "m", tags: str = "tags") -> str:
    """The condition as SQL over an alias of media, with EXISTS for tag terms."""
    x, again = expression, lambda e: sql(e, media, tags)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    if isinstance(x, (E.And, E.Or)):
        return f"({again(x.left)} {'AND' if isinstance(x, E.And) else 'OR'} {again(x.right)})"
    if isinstance(x, E.Not):
        return f"(NOT {again(x.expr)})"
    if isinstance(x, E.Rating):
        return f"{media}.rating {E.COMPARISONS[x.op]} {x.value}"
    if isinstance(x, E.MediaType):
        return f"{media}.media_type = {quoted(x.value)}"
    if isinstance(x, E.ColorLabel):
        label = x.value.strip().lower()
        return f"{media}.color_label IS NULL" if label == "none" else f"{media}.color_label = {quoted(label)}"
    if isinstance(x, E.HasGeo):
        return f"{media}.gps_lat IS {'NOT ' if x.present else ''}NULL"
    if isinstance(x, E.DateRange):
        c = f"{media}.{E.DATE_COLUMNS[x.field]}"
        return "(" + " AND ".join([f"{c} IS NOT NULL", *([f"{c} >= {x.start}"] if x.start is not None else []), *([f"{c} <= {x.end}"] if x.end is not None else [])]) + ")"
    if isinstance(x, E.Number):
        c = f"{media}.{E.NUMBER_COLUMNS[x.field]}"
        return f"({c} IS NOT NULL AND {c} {E.COMPARISONS[x.op]} {x.value})"
    if isinstance(x, E.HasNamespace):
        return "(1 = 1)" if x.namespace is E.ANY else f"EXISTS (SELECT 1 FROM {tags} t WHERE t.path = {media}.path AND t.namespace = {quoted(x.namespace)})"
    space = "" if x.namespace is E.ANY else f" AND t.namespace = {quoted(x.namespace)}"
    return f"EXISTS (SELECT 1 FROM {tags} t WHERE t.path = {media}.path{space} AND t.tag = {quoted(x.value)})"
