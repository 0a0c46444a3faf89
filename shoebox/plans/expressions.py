"""The filter language's expressions, which can be written as JSON objects tagged by type."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the language: wire names of operators, fields and their columns.
COMPARISONS = {"gte": ">=", "lte": "<=", "eq": "="}
DATE_COLUMNS = {"taken": "date_taken", "added": "date_added", "viewed": "last_viewed"}
NUMBER_COLUMNS = {"width": "width", "height": "height", "file_size": "file_size"}
MEDIA_TYPES = ("image", "video", "gif")
ANY = None


class Expression:
    """A condition on a file."""

    kind = ""

    def to_json(self) -> dict:
        out = {"type": self.kind}
        for name, value in vars(self).items():
            out[name] = value.to_json() if isinstance(value, Expression) else value
        return out

    def sole_set(self) -> str | None:
        """The set that a lone set term names; only then is a view in the set's order."""
        return None


@dataclass(frozen=True)
class Tag(Expression):
    """namespace: user, set, plugin.<name>, or ANY."""

    namespace: str | None
    value: str
    kind = "tag"

    def sole_set(self) -> str | None:
        return self.value if self.namespace == "set" else None


@dataclass(frozen=True)
class HasNamespace(Expression):
    namespace: str | None
    kind = "has_namespace"


@dataclass(frozen=True)
class Rating(Expression):
    op: str
    value: int
    kind = "rating"


@dataclass(frozen=True)
class MediaType(Expression):
    value: str
    kind = "media_type"


@dataclass(frozen=True)
class ColorLabel(Expression):
    value: str
    kind = "color_label"


@dataclass(frozen=True)
class HasGeo(Expression):
    present: bool
    kind = "has_geo"


@dataclass(frozen=True)
class DateRange(Expression):
    """Seconds since 1970, both ends included; either may be open."""

    field: str
    start: int | None
    end: int | None
    kind = "date_range"


@dataclass(frozen=True)
class Number(Expression):
    field: str
    op: str
    value: int
    kind = "numeric"


@dataclass(frozen=True)
class And(Expression):
    left: Expression
    right: Expression
    kind = "and"


@dataclass(frozen=True)
class Or(Expression):
    left: Expression
    right: Expression
    kind = "or"


@dataclass(frozen=True)
class Not(Expression):
    expr: Expression
    kind = "not"


_KINDS = {c.kind: c for c in (Tag, HasNamespace, Rating, MediaType, ColorLabel, HasGeo, DateRange, Number, And, Or, Not)}


def from_json(value: dict) -> Expression:
    """The expression that to_json wrote; ValueError for anything else."""
    fields = dict(value)
    kind = _KINDS.get(fields.pop("type", None))
    if kind is None:
        raise ValueError(f"no such expression: {value!r}")
    try:
        found = kind(**{k: from_json(v) if isinstance(v, dict) else v for k, v in fields.items()})
    except TypeError as e:
        raise ValueError(str(e)) from e
    op = getattr(found, "op", "eq")
    if op not in COMPARISONS:
        raise ValueError(f"no such comparison: {op}")
    return found


def terms(expression: Expression) -> set[Expression]:
    """The different conditions on tags inside an expression, but those that always hold."""
    if isinstance(expression, (And, Or)):
        return terms(expression.left) | terms(expression.right)
    if isinstance(expression, Not):
        return terms(expression.expr)
    if isinstance(expression, Tag) or isinstance(expression, HasNamespace) and expression.namespace is not ANY:
        return {expression}
    return set()
