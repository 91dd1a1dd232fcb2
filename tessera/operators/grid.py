"""A grid of cells of several widths, found from the envelopes' extremes and counts, and the listing of envelopes in it.

Cells are as wide as a power of ``STEP``: the lowest hold the median envelope twice over, and those above are each STEP times as wide. An
envelope's own level is the lowest whose cells aren't narrower than it, so it covers at most 4 of them, however large it is. A pair meets at the higher of its own levels, in the
cell that holds the lower left corner of what the envelopes share. So a row is listed at its own level and, above it, only at levels that rows of the
other layer have as theirs.

Unbounded envelopes are listed as if they ended where the finite coordinates of both layers end. That changes no pair: clamping keeps order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 4
BROAD = 64
AXES = "xy"
ENVELOPE = ("xmin", "ymin", "xmax", "ymax")


@dataclass
class Shape:
    cells: list[float]  # widths of the levels' cells, ascending; the last isn't narrower than any envelope
    own: dict[str, set[int]]  # levels that rows of a side may have as their own
    low: dict[str, float] = field(default_factory=lambda: {a: -math.inf for a in AXES})  # where finite coordinates begin and end
    high: dict[str, float] = field(default_factory=lambda: {a: math.inf for a in AXES})
    broad: float | None = None  # envelopes at least so wide are held against the whole other layer

    def above(self, side: str) -> list[int]:
        """Levels above their own at which rows of a side are listed."""
        return sorted(self.own["right" if side == "left" else "left"])


def width(prefix: str = "") -> str:
    """An envelope's width, the longer of its sides, in SQL."""
    return f"greatest({prefix}xmax - {prefix}xmin, {prefix}ymax - {prefix}ymin)"


def _number(x: float) -> str:
    return f"double('{'-' * (x < 0)}infinity')" if math.isinf(x) else f"double('{x!r}')"


def _numbers(xs: list[float]) -> str:
    return f"cast(array({', '.join(map(_number, xs))}) as array<double>)"


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each side and power of STEP that widths have, with the exact extremes: partial sums, of four columns."""
    both = left.selectExpr("'left' as side", *ENVELOPE).unionAll(right.selectExpr("'right' as side", *ENVELOPE))
    known = both.selectExpr("*", "greatest(abs(xmin), abs(xmax), abs(ymin), abs(ymax)) < double('infinity') as bounded")
    sized = known.selectExpr("*", f"if(bounded, {width()}, null) as w", f"if(bounded and {width()} > 0 and {width()} < double('infinity'), ceil(log({width()}) / {math.log(STEP)}D), null) as power")
    finite = lambda c: f"if(abs({c}) < double('infinity'), {c}, null)"
    ends = [F.expr(f"{f}({pick}({finite(a + 'min')}, {finite(a + 'max')})) as {a}{name}") for a in AXES for f, pick, name in (("min", "least", "low"), ("max", "greatest", "high"))]
    return sized.groupBy("side", "power", "bounded").agg(F.expr("count(*) as n"), F.expr("min(w) as least"), F.expr("max(w) as most"), *ends)


def _cell_for(w: float) -> float:
    """The narrowest power of STEP that isn't narrower."""
    if w <= 0 or not math.isfinite(w):
        return 1.0 if w <= 0 else math.inf
    p = math.floor(math.log(w, STEP)) - 1
    while float(STEP) ** p < w:
        p += 1
        if p * math.log2(STEP) > 1023:
            return math.inf
    return float(STEP) ** p


def find(left: DataFrame, right: DataFrame, cell: float | None = None, most_broad: int = BROAD) -> Shape | None:
    """The shape for two layers; ``cell``, if given, is the width of the lowest cells. None where a layer is empty."""
    rows = summary(left, right).collect()  # a row for each power of STEP and side
    if {r["side"] for r in rows} != {"left", "right"}:
        return None
    known = [(r["power"] is not None, r["least"] or 0.0, r["most"] or 0.0, r["n"], r["side"]) for r in rows if r["bounded"]]
    free = {r["side"]: r["n"] for r in rows if not r["bounded"]}
    low = {a: min((r[f"{a}low"] for r in rows if r[f"{a}low"] is not None), default=0.0) for a in AXES}
    high = {a: max((r[f"{a}high"] for r in rows if r[f"{a}high"] is not None), default=0.0) for a in AXES}
    extent = [high[a] - low[a] for a in AXES]
    known.sort(key=lambda k: k[2])
    n, below, median = sum(k[3] for k in known), 0, 0.0
    for k in known:
        below += k[3]
        if 2 * below >= n:
            median = (k[1] + min(k[2], 2**1020)) / 2
            break
    if cell is None:
        wanted = 2 * median if median > 0 else math.sqrt(max(extent[0], 0) * max(extent[1], 0) / max(n, 1)) or max(extent) / max(n, 1) or 1.0
        farthest = max(abs(x) for ends in (low, high) for x in ends.values())
        cell = _cell_for(max(wanted, farthest / 2**50))  # numbers of cells are exact
    widest = max([*(k[2] for k in known), *(extent if free else [])], default=0.0)
    cells = [cell]
    while cells[-1] < widest:
        cells.append(cells[-1] * STEP)
    own: dict[str, set[int]] = {}
    for side in ("left", "right"):
        # those between the least and the most width of each power; clamped rows may have any
        own[side] = set(range(len(cells))) if side in free else {x for _, least, most, _, s in known if s == side for x in range(bisect_left(cells, least), bisect_left(cells, most) + 1)}
    broad, few = None, sum(free.values())
    for _, least, _, count, _ in reversed(known):
        few += count
        if few > most_broad or bisect_left(cells, least) < 2:
            break
        broad = least
    if broad is not None:
        first = bisect_left(cells, broad)
        own = {side: {x for x in found if x <= first} for side, found in own.items()}
    kept = sorted(own["left"] | own["right"])  # levels between that no row has are left out
    own = {side: {kept.index(x) for x in found} for side, found in own.items()}
    return Shape([cells[x] for x in kept] or cells, own, low, high, broad)


def for_any(layer: DataFrame, cell: float | None = None) -> Shape | None:
    """A shape for rows on the left that aren't known yet: they may have any level, up to cells as wide as the layer's extent, where they are clamped."""
    shape = find(layer, layer, cell, most_broad=0)
    if shape is None:
        return None
    while shape.cells[-1] < max(shape.high[a] - shape.low[a] for a in AXES):
        shape.cells.append(shape.cells[-1] * STEP)
    shape.own["left"] = set(range(len(shape.cells)))
    return shape


def within(value: str, axis: str, shape: Shape) -> str:
    """A coordinate, clamped to where finite ones are."""
    return f"least(greatest({value}, {_number(shape.low[axis])}), {_number(shape.high[axis])})"


def level(prefix: str, shape: Shape) -> str:
    sides = [f"{within(f'{prefix}{a}max', a, shape)} - {within(f'{prefix}{a}min', a, shape)}" for a in AXES]
    return f"size(filter({_numbers(shape.cells[:-1])}, c -> c < greatest({', '.join(sides)})))"


def cell_of(value: str, at: str, shape: Shape) -> str:
    return f"floor(({value}) / element_at({_numbers(shape.cells)}, {at} + 1))"


def listed(rows: DataFrame, prefix: str, side: str, shape: Shape) -> DataFrame:
    """Rows with their own level, once for each cell at each level that they are met at."""
    own = f"__{prefix}level"
    above = f"cast(array({', '.join(map(str, shape.above(side)))}) as array<int>)"
    out = rows.selectExpr("*", f"{level(prefix, shape)} as {own}").selectExpr("*", f"explode(array_prepend(filter({above}, x -> x > {own}), {own})) as __level")
    for axis in AXES:
        low, high = (cell_of(within(f"{prefix}{axis}{end}", axis, shape), "__level", shape) for end in ("min", "max"))
        out = out.selectExpr("*", f"explode(sequence({low}, {high})) as __c{axis}")
    return out


def met_once(shape: Shape) -> str:
    """Whether a listed pair stands at the higher of its levels and in the cell of its corner."""
    corners = [within(f"greatest(left_{a}min, right_{a}min)", a, shape) for a in AXES]
    at = [f"__c{a} = {cell_of(corner, '__level', shape)}" for a, corner in zip(AXES, corners, strict=True)]
    return " and ".join(["__level = greatest(__left_level, __right_level)", *at])
