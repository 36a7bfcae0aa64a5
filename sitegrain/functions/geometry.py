"""Polygon expressions over ``rings array<array<struct<x,y>>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_edges(rings: Column) -> Column:
    """Edges of all rings; ``px`` is the smallest x of the edge before it in its ring."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def edge(a: Column, i: Column) -> Column:
            after, before = F.get(ring, (i + 1) % n), F.get(ring, (i + n - 1) % n)
            return F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"),
                F.least(before["x"], a["x"]).alias("px"),
            )

        return F.transform(ring, edge)

    return F.flatten(F.transform(rings, of_ring))


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges a ray from the point towards larger x crosses."""
    return F.size(
        F.filter(
            edges,
            lambda e: ((e["y1"] > y) != (e["y2"] > y))
            & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
        )
    )


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Ray-cast parity over all rings, so holes count as outside."""
    return (_crossings(edges, x, y) % 2) == 1


def covers_from(edges: Column, ends: Column, odd: Column, x: Column, y: Column) -> Column:
    """The same parity from the edges of the point's cell: ``odd`` and ``ends`` stand for all edges beyond it."""
    above = F.size(F.filter(ends, lambda end: end > y))
    return ((_crossings(edges, x, y) + above) % 2 == 1) != odd
