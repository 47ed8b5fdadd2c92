"""Specifications: which coefficient each column gets, as projected design columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from numbers import Number

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_SAME, ALL_DIFF = "all_same", "all_diff"


@dataclass(frozen=True)
class Term:
    """One coefficient: a column, for some alternatives or (None) for all."""

    name: str
    column: str
    alternatives: tuple | None

    def expression(self, alt_id: str) -> Column:
        value = F.col(f"`{self.column}`").cast("double")
        if self.alternatives is None:
            return value
        return F.when(F.col(f"`{alt_id}`").isin(list(self.alternatives)), value).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Design:
    """All terms, in the order of the parameters, and the alternatives they were bound to."""

    terms: tuple[Term, ...]
    alternatives: tuple = field(default=())

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def columns(self, alt_id: str) -> list[Column]:
        """A column x0, x1, ... per term: one projection, no row moves."""
        return [t.expression(alt_id).alias(f"x{i}") for i, t in enumerate(self.terms)]

    def index(self, alt_id: str, beta: Iterable[float]) -> Column:
        """The systematic utility for fixed coefficients."""
        total = F.lit(0.0)
        for term, b in zip(self.terms, beta, strict=True):
            total = total + term.expression(alt_id) * F.lit(float(b))
        return total


def groups_of(value, alternatives: list) -> list[tuple | None]:
    """A specification's value as alternatives per coefficient; ValueError if it is not one."""
    if value == ALL_SAME:
        return [None]
    if value == ALL_DIFF:
        return [(a,) for a in alternatives]
    if isinstance(value, (str, Mapping)) or not isinstance(value, Iterable):
        raise ValueError(f"a specification is 'all_same', 'all_diff' or a list, not {value!r}")
    out = []
    for item in value:
        if isinstance(item, Iterable) and not isinstance(item, str):
            group = tuple(item)
            if any(isinstance(x, Iterable) and not isinstance(x, str) for x in group):
                raise ValueError("a specification nests two levels at most")
        else:
            group = (item,)
        if unknown := [x for x in group if x not in alternatives]:
            raise ValueError(f"not among the alternatives: {unknown}")
        out.append(group)
    return out


def bind(specification: Mapping, alternatives: Iterable, names: Mapping | None = None) -> Design:
    """The design for sorted ``alternatives``, with default names where none are given.

    Default names are the column's own for a shared coefficient and ``column_group`` else.
    """
    if not isinstance(specification, Mapping):
        raise TypeError("the specification must be a mapping")
    alternatives = sorted(alternatives)
    if names is not None:
        check_names(names, specification, len(alternatives))
    terms = []
    for column, value in specification.items():
        groups = groups_of(value, alternatives)
        if names is not None:
            given = [names[column]] if isinstance(names[column], str) else list(names[column])
        else:
            given = [
                column if g is None else f"{column}_{g[0] if len(g) == 1 and (value == ALL_DIFF or isinstance(item, Number)) else list(g)}"
                for g, item in zip(groups, value if not isinstance(value, str) else groups)
            ]
        terms += [Term(n, column, g) for n, g in zip(given, groups, strict=True)]
    return Design(tuple(terms), tuple(alternatives))


def check_names(names: Mapping, specification: Mapping, n_alternatives: int) -> None:
    """Names must have the specification's keys, and as many strings as each has coefficients."""
    if set(names) != set(specification):
        raise ValueError("names and specification must have the same keys")
    for column, value in specification.items():
        given = names[column]
        if value == ALL_SAME:
            if not isinstance(given, str):
                raise ValueError(f"{column}: one name is needed")
            continue
        wanted = n_alternatives if value == ALL_DIFF else len(list(value))
        if isinstance(given, str) or len(given) != wanted or not all(isinstance(x, str) for x in given):
            raise ValueError(f"{column}: {wanted} names are needed")


def with_intercept(df: DataFrame, specification: Mapping) -> DataFrame:
    """Adds ``intercept`` = 1.0 if the specification asks for it and there is none."""
    name = "intercept"
    wanted = name in specification and name not in df.columns
    return df.withColumn(name, F.lit(1.0)) if wanted else df


def positions(wanted: Iterable[str], names: list[str]) -> list[int]:
    return [names.index(n) for n in wanted]


@dataclass(frozen=True)
class Layout:
    """The parameter vector: nests, shapes, intercepts, index (and sigmas at its end)."""

    nests: int = 0
    shapes: int = 0
    intercepts: int = 0
    index: int = 0
    sigmas: int = 0

    @property
    def size(self) -> int:
        return self.nests + self.shapes + self.intercepts + self.index + self.sigmas

    def split(self, theta):
        """(nests, shapes, intercepts, index) - the parts that are absent are None."""
        bounds, out, at = (self.nests, self.shapes, self.intercepts), [], 0
        for n in bounds:
            out.append(theta[at : at + n] if n else None)
            at += n
        return (*out, theta[at:])

    def for_prediction(self, theta) -> list:
        """[index, intercepts, shapes, nests]; from replicates (R x params), params x R each."""
        parts = self.split(theta.T if getattr(theta, "ndim", 1) == 2 else theta)
        return list(reversed(parts))


def nest_of(nests: Mapping[str, Iterable], alt_id: str) -> Column:
    """The number (from 0, in the mapping's order) of the nest that holds the row's alternative."""
    out = None
    for i, members in enumerate(nests.values()):
        hit = F.col(f"`{alt_id}`").isin(list(members))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out
