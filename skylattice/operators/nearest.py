"""Nearest neighbours without a reach, by a pyramid of cells that both sides descend together.

Every level quarters the cells of the one above (halves them at an odd last one); one cell holds everything at the top. A pair of cells, one of
each side, is between a least and a greatest distance apart, whole numbers of cells. A cell of the left side keeps
the pairs whose least distance is not beyond the smallest greatest distance of its pairs, and hands them to its
occupied children, so a handful of pairs stay for each cell at every level, wherever the sides lie. At the bottom
points meet the points of the pairs' cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points that a point of the right side finds in its own cell at the bottom, about, and levels at most.
CROWD, LEVELS = 4, 30


def nearest(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """left's distinct positions, by the first names of on, with `distance`, the least Euclidean distance to a position of
    right, by the second names. Positions with a null coordinate on either side do not count; without any of right, none come out.

    The cells' width is halved until few positions share a cell where most positions are, so crowds are told apart
    as well as lone positions; a query makes one small row of bounds and one of occupancy for each try."""
    mine, theirs = [a for a, _ in on], [b for _, b in on]
    a = left.select(*mine).dropna().distinct()
    b = right.select(*theirs).dropna().distinct()
    sides = [df.agg(*(f(c).cast("double").alias(f"{n}{k}") for k, c in enumerate(names) for n, f in (("low", F.min), ("high", F.max)))).first() for df, names in ((a, mine), (b, theirs))]
    if sides[0]["low0"] is None or sides[1]["low0"] is None:
        return a.limit(0).withColumn("distance", F.lit(0.0))
    low = [min(s[f"low{k}"] for s in sides) for k in range(len(on))]
    extent = max(max(s[f"high{k}"] for s in sides) - low[k] for k in range(len(on)))
    levels = depth(b, theirs, low, extent)
    width = extent / 2**levels * (1 + 1e-9) or 1.0

    def placed(df: DataFrame, names: list[str], side: str) -> DataFrame:
        return df.withColumns({f"{side}{k}": F.floor((F.col(c) - F.lit(low[k])) / width).cast("long") for k, c in enumerate(names)})

    a, b = placed(a, mine, "__q"), placed(b, theirs, "__o")
    q, o = ([f"__{s}{k}" for k in range(len(on))] for s in "qo")
    pairs = a.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(c) for c in (*q, *o)))
    above = levels
    while above:
        level = max(0, above - 2)
        for df, side in ((a, q), (b, o)):
            children = df.select(*(F.shiftright(c, level).alias(c) for c in side)).distinct().withColumns({f"{c}_up": F.shiftright(c, above - level) for c in side})
            pairs = pairs.withColumnsRenamed({c: f"{c}_up" for c in side}).join(children, [f"{c}_up" for c in side]).drop(*(f"{c}_up" for c in side))
        apart = [F.abs(F.col(x) - F.col(y)) for x, y in zip(q, o, strict=True)]
        least = sum((F.greatest(d - 1, F.lit(0)) * F.greatest(d - 1, F.lit(0)) for d in apart), F.lit(0))
        most = sum(((d + 1) * (d + 1) for d in apart), F.lit(0))
        pairs = pairs.withColumns({"__least": least, "__most": F.min(most).over(Window.partitionBy(*q))}).where("__least <= __most").drop("__least", "__most")
        above = level
    # Cells get their points first, so the left side is shuffled once and multiplied only where it is aggregated.
    held = pairs.join(b.withColumnsRenamed({c: f"__{c}" for c in theirs}), o).drop(*o)
    met = a.join(held, q)
    square = sum((F.pow(F.col(x) - F.col(f"__{y}"), 2) for x, y in on), F.lit(0.0))
    return met.groupBy(*mine).agg(F.sqrt(F.min(square)).alias("distance"))


def depth(positions: DataFrame, names: list[str], low: list[float], extent: float) -> int:
    """Levels below the top at which a position shares its cell with about CROWD others, or LEVELS."""
    if not extent:
        return 0
    n = positions.count()
    level = min(LEVELS, max(1, math.ceil(math.log2(max(2.0, n / CROWD)) / len(names))))
    while level < LEVELS:
        width = extent / 2**level * (1 + 1e-9)
        cells = positions.groupBy(*(F.floor((F.col(c) - F.lit(low[k])) / width).alias(f"c{k}") for k, c in enumerate(names))).count()
        if cells.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] <= 2 * CROWD:
            break
        level += 1
    return level
