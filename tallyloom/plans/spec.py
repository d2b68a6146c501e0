"""The query language: ``relations|predicates|selections``.

    relations  := id (" " id)*                 binding i is the i-th id
    predicates := predicate ("&" predicate)*   column op constant, or column = column
    selections := column (" " column)*         each stands for its sum
    column     := binding "." position         op is <, > or =

Columns compare unsigned; a comparison other than = between columns is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

U64 = 1 << 64
_COLUMN = re.compile(r"(\d+)\.(\d+)")
_PREDICATE = re.compile(r"(\d+\.\d+)\s*([<>=])\s*(\d+\.\d+|\d+)")


class QueryError(ValueError):
    """The text isn't a query, or not one that can be answered."""


@dataclass(frozen=True, order=True)
class Col:
    binding: int
    position: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.position}"


@dataclass(frozen=True, order=True)
class Filter:
    col: Col
    op: str
    value: int

    def __str__(self) -> str:
        return f"{self.col}{self.op}{self.value}"


@dataclass(frozen=True, order=True)
class Join:
    left: Col
    right: Col

    def __str__(self) -> str:
        return f"{self.left}={self.right}"


@dataclass(frozen=True)
class QuerySpec:
    relations: tuple[int, ...]
    joins: tuple[Join, ...]
    filters: tuple[Filter, ...]
    selections: tuple[Col, ...]

    def to_text(self) -> str:
        """The query text: joins first, then filters."""
        return "|".join((" ".join(map(str, self.relations)), "&".join(map(str, (*self.joins, *self.filters))), " ".join(map(str, self.selections))))

    def to_sql(self, aliases: bool = False, cast: str | None = None) -> str:
        """``SELECT SUM("0".c1), ... FROM r0 "0", ... WHERE ...;`` - with ``aliases`` the sums are named s0, s1, ..."""

        def column(c: Col) -> str:
            return f'"{c.binding}".c{c.position}'

        def total(k: int, c: Col) -> str:
            out = f"SUM({column(c)})"
            out = f"CAST({out} AS {cast})" if cast else out
            return f"{out} AS s{k}" if aliases else out

        where = [f"{column(j.left)}={column(j.right)}" for j in self.joins] + [f"{column(f.col)}{f.op}{f.value}" for f in self.filters]
        text = "SELECT " + ", ".join(total(k, c) for k, c in enumerate(self.selections))
        text += " FROM " + ", ".join(f'r{r} "{b}"' for b, r in enumerate(self.relations))
        return text + (" WHERE " + " and ".join(where) if where else "") + ";"

    def check(self, width_of: Callable[[int], int] | None = None) -> None:
        """Raise :class:`QueryError` unless every column exists and the bindings hang together."""
        if not self.relations:
            raise QueryError("no relation")
        if not self.selections:
            raise QueryError("no selection")
        used = [*self.selections, *(f.col for f in self.filters), *(c for j in self.joins for c in (j.left, j.right))]
        for c in used:
            if c.binding >= len(self.relations):
                raise QueryError(f"{c}: there are {len(self.relations)} bindings")
            if width_of is not None and c.position >= width_of(self.relations[c.binding]):
                raise QueryError(f"{c}: relation {self.relations[c.binding]} has no such column")
        reached, grew = {0}, True
        while grew:
            grew = False
            for j in self.joins:
                ends = {j.left.binding, j.right.binding}
                if ends & reached and not ends <= reached:
                    reached |= ends
                    grew = True
        if len(reached) < len(self.relations):
            raise QueryError("the join graph is not connected; cross products are not answered")


def parse_column(text: str) -> Col:
    m = _COLUMN.fullmatch(text.strip())
    if m is None:
        raise QueryError(f"not a column: {text!r}")
    return Col(int(m[1]), int(m[2]))


def parse_predicates(text: str) -> tuple[list[Join], list[Filter]]:
    joins, filters = [], []
    for part in filter(None, (p.strip() for p in text.split("&"))):
        m = _PREDICATE.fullmatch(part)
        if m is None:
            raise QueryError(f"not a predicate: {part!r}")
        left = parse_column(m[1])
        if "." not in m[3]:
            if int(m[3]) >= U64:
                raise QueryError(f"{m[3]} is not an unsigned 64-bit number")
            filters.append(Filter(left, m[2], int(m[3])))
        elif m[2] != "=":
            raise QueryError(f"columns can only be compared for equality: {part!r}")
        else:
            joins.append(Join(left, parse_column(m[3])))
    return joins, filters


def parse_query(line: str) -> QuerySpec:
    """Parse one line; structure only - :meth:`QuerySpec.check` looks at the meaning."""
    parts = line.strip().split("|")
    if len(parts) != 3:
        raise QueryError(f"a query has three parts, this has {len(parts)}: {line!r}")
    try:
        relations = tuple(int(x) for x in parts[0].split())
    except ValueError:
        raise QueryError(f"not relation ids: {parts[0]!r}") from None
    joins, filters = parse_predicates(parts[1])
    return QuerySpec(relations, tuple(joins), tuple(filters), tuple(parse_column(x) for x in parts[2].split()))
