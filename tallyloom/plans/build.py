"""DataFrame plans for a query: join everything, or aggregate along the join tree."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import prod, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unsigned import times, total, wide, wrap
from .normalize import Classes, normalize
from .order import order_bindings
from .spec import Col, QuerySpec

LONG_LIMIT = 1 << 63
BROADCAST_BYTES = 64 << 20


def named(c: Col) -> str:
    return f"t{c.binding}_c{c.position}"


def _literal(value: int) -> Column:
    return F.lit(value) if value < LONG_LIMIT else F.expr(f"CAST({value} AS DECIMAL(20,0))")


def scan(spec: QuerySpec, catalog, binding: int, classes: Classes) -> DataFrame:
    """A binding's used columns under unique names, filtered; equalities inside the binding are filters."""
    used = {c for c in (*spec.selections, *(f.col for f in spec.filters), *(x for j in spec.joins for x in (j.left, j.right))) if c.binding == binding}
    df = catalog.frame(spec.relations[binding], sorted({c.position for c in used})).select(*[F.col(f"c{c.position}").alias(named(c)) for c in sorted(used)])
    for f in spec.filters:
        if f.col.binding == binding:
            c, v = F.col(named(f.col)), _literal(f.value)
            df = df.where(c < v if f.op == "<" else c > v if f.op == ">" else c == v)
    for members in classes.members().values():
        own = [c for c in members if c.binding == binding]
        for c in own[1:]:
            df = df.where(F.col(named(own[0])) == F.col(named(c)))
    return df


def _small(spec: QuerySpec, catalog, c: Col, rows: int) -> bool:
    known = catalog.range_of(spec.relations[c.binding], c.position)
    return known is not None and known[1] * rows < LONG_LIMIT


def rows_bound(spec: QuerySpec, catalog, classes: Classes, subset: frozenset[int] | None = None) -> int:
    """An upper bound of the rows that the bindings in ``subset`` (all, if None) join to.

    A row of one relation fixes a row of another where they join by a unique
    column of the other's.  The bound is the least product of rows over sets of
    bindings that fix all others; beyond 12 bindings, of the set left when each
    binding that another one fixes is taken out in turn.
    """
    subset = subset or frozenset(range(len(spec.relations)))
    stats = {b: catalog.statistics(spec.relations[b]) for b in subset}
    fixes: dict[int, set[int]] = {b: set() for b in subset}  # b -> bindings that one row of b fixes
    for members in classes.members().values():
        for c in members:
            if c.binding in subset and stats[c.binding].unique[c.position]:
                for x in members:
                    if x.binding in subset and x.binding != c.binding:
                        fixes[x.binding].add(c.binding)

    def covers(chosen: tuple[int, ...] | set[int]) -> bool:
        seen, todo = set(chosen), list(chosen)
        while todo:
            for x in fixes[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return len(seen) == len(subset)

    size = lambda chosen: prod(max(stats[b].rows, 1) for b in chosen)
    if len(subset) > 12:
        chosen = set(subset)
        for b in sorted(subset, key=lambda b: -stats[b].rows):
            if covers(chosen - {b}):
                chosen.remove(b)
        return size(chosen)
    return min(size(chosen) for k in range(1, len(subset) + 1) for chosen in combinations(sorted(subset), k) if covers(chosen))


def _fits(spec: QuerySpec, catalog, classes: Classes, subset: frozenset[int], k: int | None = None) -> bool:
    """Whether the count, or selection k's sum, over the subset's joined rows is below 2^63."""
    rows = rows_bound(spec, catalog, classes, subset)
    return rows < LONG_LIMIT and (k is None or _small(spec, catalog, spec.selections[k], rows))


def _sum(c: Column, small: bool) -> Column:
    """The sum of longs as a long where ``small``, else of decimals modulo 2^64."""
    return F.sum(c) if small else wrap(F.sum(c.cast("decimal(28,0)")))


def _counted_scan(spec: QuerySpec, catalog, b: int, classes: Classes) -> tuple[DataFrame, dict[str, bool]]:
    """A binding's scan with n = 1 and s_k its selections, and which of these are longs."""
    mine = [k for k, c in enumerate(spec.selections) if c.binding == b]
    longs = {"n": True} | {f"s{k}": _fits(spec, catalog, classes, frozenset([b]), k) for k in mine}
    columns = [F.col(named(spec.selections[k])) for k in mine]
    sums = [(c.cast("long") if longs[f"s{k}"] else wide(c)).alias(f"s{k}") for k, c in zip(mine, columns)]
    return scan(spec, catalog, b, classes).select("*", F.lit(1).cast("long").alias("n"), *sums), longs


def _products(spec: QuerySpec, catalog, classes: Classes, covered: frozenset[int], longs: dict[str, bool], theirs: dict[str, bool], other: Column) -> tuple[list[Column], dict[str, bool]]:
    """n and sums of rows (n, s, ...) joined with rows (``other``, s', ...): n*n', s*n' and n*s'; and which are longs over ``covered``."""

    def times_(a: Column, b: Column, small: bool, are_longs: bool) -> Column:
        return a * b if small and are_longs else times(a, b).cast("long") if small else times(a, b)

    count, sums = F.col("n"), [c for c in theirs if c != "n"]
    now = {"n": _fits(spec, catalog, classes, covered)} | {s: _fits(spec, catalog, classes, covered, int(s[1:])) for s in [*longs, *sums] if s != "n"}
    out = [times_(count, other, now["n"], longs["n"] and theirs["n"]).alias("n")]
    out += [times_(F.col(s), other, now[s], longs[s] and theirs["n"]).alias(s) for s in longs if s != "n"]
    out += [times_(F.col(s), count, now[s], theirs[s] and longs["n"]).alias(s) for s in sums]
    return out, now


def _multiplies(spec: QuerySpec, catalog, classes: Classes, subset: frozenset[int]) -> bool:
    """Whether unique columns leave it open that the subset joins to over twice the rows it has."""
    return rows_bound(spec, catalog, classes, subset) > 2 * sum(catalog.statistics(spec.relations[b]).rows for b in subset)


def _hinted(right: DataFrame, spec: QuerySpec, catalog, b: int, hint: str | None, width: int) -> DataFrame:
    small = hint != "broadcast" or 8 * width * catalog.statistics(spec.relations[b]).rows <= BROADCAST_BYTES
    return right.hint(hint) if hint and small else right


def naive(spec: QuerySpec, catalog, order: list[int] | None = None, hint: str | None = None) -> DataFrame:
    """Joins in a connected order, then the sums: one row s0, s1, ...

    Where a join of the order could multiply rows, rows are joined as counts and
    sums a key (:func:`summed`).  A broadcast hint is given only to sides of at
    most ``BROADCAST_BYTES`` before their filters, so it can't outgrow the
    executors; beyond, the engine chooses.
    """
    classes = Classes(spec.joins)
    order = order or order_bindings(spec, catalog)
    if any(_multiplies(spec, catalog, classes, frozenset(order[:k])) for k in range(2, len(order) + 1)):
        return summed(spec, catalog, order, hint)
    df = scan(spec, catalog, order[0], classes)
    joined = {order[0]}
    for b in order[1:]:
        right = scan(spec, catalog, b, classes)
        on = []
        for members in classes.members().values():
            left = next((c for c in members if c.binding in joined), None)
            here = next((c for c in members if c.binding == b), None)
            if left is not None and here is not None:
                on.append(F.col(named(left)) == F.col(named(here)))
        df = df.join(_hinted(right, spec, catalog, b, hint, len(right.columns)), on, "inner")
        joined.add(b)
    rows = rows_bound(spec, catalog, classes)
    return df.agg(*[total(F.col(named(c)), _small(spec, catalog, c, rows)).alias(f"s{k}") for k, c in enumerate(spec.selections)])


def summed(spec: QuerySpec, catalog, order: list[int], hint: str | None = None) -> DataFrame:
    """The joins of an order over rows that stand for a count and sums; the join graph may be cyclic.

    Before a join that could multiply, both sides are summed up by the columns
    that this join or a later one compares, so that equal keys meet once.  Only
    where both sides keep further columns for later joins can it still multiply.
    """
    classes = Classes(spec.joins)
    shared = {r: m for r, m in classes.members().items() if len({c.binding for c in m}) > 1}

    def by_key(df: DataFrame, keys: dict[Col, str], longs: dict[str, bool]) -> DataFrame:
        return df.groupBy(*keys.values()).agg(*[_sum(F.col(c), small).alias(c) for c, small in longs.items()])

    df, longs, keys = None, {}, {}
    covered: frozenset[int] = frozenset()
    for b in order:
        right, theirs = _counted_scan(spec, catalog, b, classes)
        own = {r: named(next(c for c in m if c.binding == b)) for r, m in shared.items() if any(c.binding == b for c in m)}
        covered |= {b}
        if df is None:
            df, longs, keys = right, theirs, own
            continue
        width = len(right.columns)
        unique = catalog.statistics(spec.relations[b]).unique
        fixed = any(unique[c.position] for r in keys if r in own for c in shared[r] if c.binding == b)  # a row meets one of b at most
        if not fixed and _multiplies(spec, catalog, classes, covered):
            df, right = by_key(df, keys, longs), by_key(right, own, theirs)
        on = [F.col(keys[r]) == F.col(own[r]) for r in keys if r in own]
        df = df.join(_hinted(right.withColumnRenamed("n", "n_right"), spec, catalog, b, hint, width), on, "inner")
        keys = {r: c for r, c in (own | keys).items() if any(c.binding not in covered for c in shared[r])}
        products, longs = _products(spec, catalog, classes, covered, longs, theirs, F.col("n_right"))
        df = df.select(*keys.values(), *products)
    return df.agg(*[_sum(F.col(f"s{k}"), longs[f"s{k}"]).alias(f"s{k}") for k in range(len(spec.selections))])


@dataclass
class Tree:
    root: int
    children: dict[int, list[int]]


def join_tree(spec: QuerySpec, classes: Classes, root: int) -> Tree | None:
    """A join tree over the classes that join bindings (ears are removed until the root is left), or None for a cyclic graph."""
    shared = {r for r, m in classes.members().items() if len({c.binding for c in m}) > 1}
    edges = {b: {classes.find(c) for m in classes.members().values() for c in m if c.binding == b} & shared for b in range(len(spec.relations))}
    parent: dict[int, int] = {}
    alive = set(edges)
    while len(alive) > 1:
        for b in sorted(alive - {root}):
            others = alive - {b}
            common = edges[b] & set().union(*(edges[o] for o in others))
            host = next((o for o in sorted(others, key=lambda o: o != root) if common <= edges[o]), None)
            if host is not None:
                parent[b] = host
                alive.remove(b)
                break
        else:
            return None
    children: dict[int, list[int]] = {b: [] for b in edges}
    for b, p in parent.items():
        children[p].append(b)
    return Tree(root, children)


def factorized(spec: QuerySpec, catalog) -> DataFrame | None:
    """Sums without the joined rows: each subtree sends its parent, per key, a count and partial sums.

    With n the number of joined rows a row stands for and s_k the sum of
    selection k over them, joining a message (n', s') makes n*n', s_k*n' and
    n*s'.  A count or sum over a set of bindings is a long where the rows that
    they join to, times the column's maximum, stay below 2^63, else a decimal
    modulo 2^64.  None where the join graph is cyclic.
    """
    classes = Classes(spec.joins)
    stats = [catalog.statistics(r) for r in spec.relations]
    root = max(range(len(stats)), key=lambda b: stats[b].rows)
    tree = join_tree(spec, classes, root)
    if tree is None:
        return None

    def visit(b: int, parent: int | None) -> tuple[DataFrame, frozenset[int], dict[str, bool], list[Col]]:
        """(rows, bindings in them, whether each of n, s0, ... is a long, keys upward)."""
        mine = [k for k, c in enumerate(spec.selections) if c.binding == b]
        own_keys = {root_: next(c for c in m if c.binding == b) for root_, m in classes.members().items() if any(c.binding == b for c in m)}
        up = [r for r, c in own_keys.items() if any(x.binding == parent for x in classes.members()[r])] if parent is not None else []
        covered = frozenset([b])
        df, longs = _counted_scan(spec, catalog, b, classes)
        ready = _stored_message(spec, catalog, b, classes, mine, own_keys, up) if parent is not None and not tree.children[b] and all(longs.values()) else None
        if ready is not None:
            return ready, covered, longs, up
        for child in tree.children[b]:
            message, below, theirs, keys = visit(child, b)
            on = [F.col(named(own_keys[r])) == F.col(f"m{child}_{i}") for i, r in enumerate(keys)]
            df = df.join(message, on, "inner")
            covered |= below
            sums = [c for c in theirs if c != "n"]
            rest = [c for c in df.columns if c not in longs and c not in sums and not c.startswith(f"m{child}_")]
            products, now = _products(spec, catalog, classes, covered, longs, theirs, F.col(f"m{child}_n"))
            df, longs = df.select(*rest, *products), now
        if parent is None:
            return df, covered, longs, []
        keys = [F.col(named(own_keys[r])).alias(f"m{b}_{i}") for i, r in enumerate(up)]
        # a message's sums are over the same bindings, so they are longs where their summands are
        grouped = df.groupBy(*keys).agg(*[_sum(F.col(c), small).alias(f"m{b}_n" if c == "n" else c) for c, small in longs.items()])
        return grouped, covered, longs, up

    df, covered, longs, _ = visit(root, None)
    return df.agg(*[_sum(F.col(f"s{k}"), longs[f"s{k}"]).alias(f"s{k}") for k in range(len(spec.selections))])


def _stored_message(spec: QuerySpec, catalog, b: int, classes: Classes, mine: list[int], own_keys: dict[Col, Col], up: list[Col]) -> DataFrame | None:
    """A leaf's message from the catalog's stored counts and sums per key, where it keeps them and nothing filters the leaf."""
    filtered = any(f.col.binding == b for f in spec.filters) or any(sum(c.binding == b for c in m) > 1 for m in classes.members().values())
    if filtered or len(up) != 1 or len(own_keys) != 1:
        return None
    stored = catalog.aggregated(spec.relations[b], own_keys[up[0]].position)
    if stored is None:
        return None
    return stored.select(F.col("key").alias(f"m{b}_0"), F.col("n").alias(f"m{b}_n"), *[F.col(f"sum_c{spec.selections[k].position}").alias(f"s{k}") for k in mine])


def worth_factorizing(spec: QuerySpec, catalog) -> bool:
    """Whether two joined sides may join to over twice the rows they have.

    Joined rows are at most the root of the product of both sides' sums of
    squared rows a key, which a skewed key drives up whatever the mean is.  The
    squares are counted once a column, and only where neither side is unique.
    """
    classes = Classes(spec.joins)
    for members in classes.members().values():
        many = [c for c in members if not catalog.statistics(spec.relations[c.binding]).unique[c.position]]
        for x, y in combinations(many, 2):
            if x.binding != y.binding:
                joined = sqrt(catalog.squares(spec.relations[x.binding], x.position)) * sqrt(catalog.squares(spec.relations[y.binding], y.position))
                if joined > 2 * (catalog.statistics(spec.relations[x.binding]).rows + catalog.statistics(spec.relations[y.binding]).rows):
                    return True
    return False


def plan_query(spec: QuerySpec, catalog, strategy: str = "auto", rewrite: bool = True, hint: str | None = None) -> DataFrame:
    """One row with s0, s1, ... in the order of the selections; all null exactly where the join is empty.

    strategy: auto, naive or factorized (which falls back to naive on cyclic graphs).
    """
    spec.check(catalog.width)
    found = normalize(spec, catalog) if rewrite else normalize(spec, None, ranges=False, domains=False, eliminate=False, canonical=False)
    inner = found.spec
    if found.impossible:
        df = catalog.spark.range(0).agg(*[F.sum("id").alias(f"s{k}") for k in range(len(inner.selections))])
    else:
        df = None
        if strategy == "factorized" or strategy == "auto" and hint is None and worth_factorizing(inner, catalog):
            df = factorized(inner, catalog)
        if df is None:
            df = naive(inner, catalog, hint=hint)
    return df.select(*[F.col(f"s{at}").alias(f"s{k}") for k, at in enumerate(found.answers)])
