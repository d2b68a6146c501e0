"""What a query becomes: its rewritten form, join order, strategy and estimates, as text or as a graph."""

from __future__ import annotations

from .build import Tree, join_tree, plan_query, rows_bound, worth_factorizing
from .normalize import Classes, normalize
from .order import estimate_rows, joined_rows, order_bindings
from .spec import QuerySpec


def explain(spec: QuerySpec, catalog, physical: bool = False) -> str:
    """Lines that tell the plan; with ``physical``, also the engine's plan."""
    spec.check(catalog.width)
    found = normalize(spec, catalog)
    inner = found.spec
    lines = [f"query      {spec.to_text()}", f"rewritten  {inner.to_text()}"]
    if found.dropped:
        lines.append(f"dropped    bindings {found.dropped}: foreign keys contained in their keys")
    if found.impossible:
        lines.append("impossible: the filters leave no row")
    else:
        rows = estimate_rows(inner, catalog)
        order = order_bindings(inner, catalog)
        lines.append(f"strategy   {'sums along the join tree' if worth_factorizing(inner, catalog) and join_tree(inner, Classes(inner.joins), 0) else 'joins, then sums'}")
        for k, b in enumerate(order):
            lines.append(f"  {'scan' if not k else 'join'} r{inner.relations[b]} as {b}: {rows[b]:.0f} rows, together {joined_rows(inner, catalog, frozenset(order[: k + 1]), rows):.0f}")
        lines.append(f"at most    {rows_bound(inner, catalog, Classes(inner.joins))} joined rows")
    if physical:
        lines.append(plan_query(spec, catalog)._jdf.queryExecution().toString())
    return "\n".join(lines)


def to_dot(spec: QuerySpec, catalog) -> str:
    """The join tree (or, where the joins are cyclic, the join graph) in the DOT language."""
    classes = Classes(spec.joins)
    lines = ["graph query {"]
    for b, r in enumerate(spec.relations):
        filters = " ".join(str(f) for f in spec.filters if f.col.binding == b)
        lines.append(f'  b{b} [label="{b}: r{r}{" | " + filters if filters else ""}"];')
    tree: Tree | None = join_tree(spec, classes, max(range(len(spec.relations)), key=lambda b: catalog.statistics(spec.relations[b]).rows))
    if tree is None:
        lines += [f'  b{j.left.binding} -- b{j.right.binding} [label="{j}"];' for j in spec.joins if j.left.binding != j.right.binding]
    else:
        for parent, children in tree.children.items():
            for child in children:
                keys = [f"{x}={y}" for m in classes.members().values() for x in m[:] if x.binding == parent for y in m if y.binding == child]
                lines.append(f'  b{parent} -- b{child} [label="{keys[0]}"];')
    return "\n".join([*lines, "}"])
