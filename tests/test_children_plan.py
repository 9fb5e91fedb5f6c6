"""First children by number: they are not sorted for an aggregation before they are shuffled."""

import contextlib
import io

from lexgrove.operators import tree


def test_numbered_children_are_sorted_once_where_they_meet(spark):
    rows = [(d, 1 + 10 * p + i, p, "Item", str(i % 4), f"{d}-{p}-{i}") for d in (1, 2) for p in range(6) for i in range(9)]
    nodes = spark.createDataFrame(rows, "doc_id long, begin long, parent long, tag string, num string, content string")
    asked = [(d, p, n) for d in (1, 2, 3) for p in (0, 3, 9) for n in (0, 2, 7, None)] * 2
    parents = spark.createDataFrame(asked, "doc_id long, begin long, n int")
    found = tree.children(nodes, parents, "Item", "n", first=True)
    got = sorted(((r.doc_id, r.begin, r.n, r.child and r.child.content) for r in found.collect()), key=str)
    assert got == sorted(((d, p, n, f"{d}-{p}-{n}" if d < 3 and p < 9 and n in (0, 2) else None) for d, p, n in asked), key=str)
    each = tree.children(nodes, parents, "Item", "n")
    assert each.columns == ["doc_id", "begin", "n", "child"] and each.count() == 2 * (2 * 2 * (3 + 2))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        tree.children(nodes, parents, "Item", "n", first=True).explain()
    lines = out.getvalue().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|()0123456789"))
    deals = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(_k" in line and "_n" in line]
    assert len(deals) == 1
    below = lines[deals[0] + 1 :]
    inside = [line for i, line in enumerate(below) if all(depth(x) > depth(lines[deals[0]]) for x in below[: i + 1])]
    assert not any("Aggregate" in line or "Sort " in line for line in inside)
