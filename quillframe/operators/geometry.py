"""Drawings of a page: greedy groups by distance, and the checkboxes among them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, small, written

POINTS_PER_CM = 72 / 2.54


def grouped(drawings: DataFrame, page: list[str], index: str, threshold: float = 10.0) -> DataFrame:
    """page, index, x, y, segments to page, group_no, members, x, y (means), segments (sum); drawings without a centre have no group.

    In order of the index, a drawing joins the first group whose first drawing is within the threshold, or begins one. The fold is over one page's drawings.
    """
    items = F.array_sort(F.collect_list(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.col(index).alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("segments").cast("long").alias("segments")))))
    state = "struct<leaders:array<struct<x:double,y:double>>,out:array<struct<group_no:int,i:bigint,x:double,y:double,segments:bigint>>>"
    zero = F.from_json(F.lit('{"leaders":[],"out":[]}'), state)

    def step(acc, d):
        near = F.transform(acc["leaders"], lambda q: F.sqrt((q["x"] - d["x"]) * (q["x"] - d["x"]) + (q["y"] - d["y"]) * (q["y"] - d["y"])) <= threshold)
        at = F.array_position(near, True).cast("int")
        number = F.when(at > 0, at).otherwise(F.size(acc["leaders"]) + 1)
        leaders = F.when(at > 0, acc["leaders"]).otherwise(F.concat(acc["leaders"], F.array(F.struct(d["x"].alias("x"), d["y"].alias("y")))))
        row = F.struct(number.alias("group_no"), d["i"].cast("long").alias("i"), d["x"].alias("x"), d["y"].alias("y"), d["segments"].alias("segments"))
        return F.struct(leaders.alias("leaders"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

    rows = drawings.groupBy(*page).agg(F.aggregate(items, zero, step, lambda acc: acc["out"]).alias("out"))
    members = rows.select(*page, F.explode("out").alias("d")).select(*page, "d.*")
    return members.groupBy(*page, "group_no").agg(F.array_sort(F.collect_list("i")).alias("members"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("segments").alias("segments"))


def checkbox_mark(width, height, segments, low: float = 0.25, high: float = 0.5):
    """`[X]` or `[ ]` for a small square (low to high cm) with or without two line segments; null for other shapes."""
    small = lambda v: (v >= low * POINTS_PER_CM) & (v <= high * POINTS_PER_CM)
    return F.when(small(width) & small(height), F.when(segments >= 2, F.lit("[X]")).otherwise(F.lit("[ ]")))


def _cells(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with cx, cy: cells whose diagonal is the threshold, so that all that is in one cell is within it, and what is within it at most two cells away."""
    at = lambda c: F.floor(F.col(c).cast("double") / (threshold / math.sqrt(2) * (1 - 1e-9)))
    return rows.withColumns({"cx": at("x"), "cy": at("y")})


def _around(rows: DataFrame, page: list[str]) -> DataFrame:
    """A row for each of the 25 cells that a row's reach can touch."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    return rows.withColumn("__s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("__s.a"), "cy": F.col("cy") + F.col("__s.b")}).drop("__s")


def claimed(drawings: DataFrame, page: list[str], index: str, threshold: float = 10.0) -> DataFrame:
    """page, index, x, y, segments, leader (index of the group's first drawing), group_no: the groups of grouped(), a row a drawing, with no task that sees a page's square.

    In order of the index, a drawing that no earlier one has claimed leads a group and claims what is within the threshold. So a leader is a drawing
    without an earlier leader in reach, and each other one belongs to its earliest leader. Drawings go to cells in which all are in reach of each other: a cell has
    one leader at most. Round by round, a cell's earliest open drawing leads if it is the earliest of all the cells around; what leaders reach is closed.
    Every round is a grouped minimum and joins on cells with one row a cell, however many drawings a cell has. There are as many rounds as the longest chain of ever later
    cells. Drawings without a centre are in no group; rows that repeat an index count each, in order of (index, x, y).
    """
    keys = [*page, "cx", "cy"]
    rows = drawings.where("x is not null and y is not null and not isnan(cast(x as double)) and not isnan(cast(y as double))")
    rows = _cells(rows.select(*page, F.col(index).cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("segments").cast("long").alias("segments")), threshold)
    rows = written(rows, "drawings")
    point = F.struct("i", "x", "y")
    reach = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])) <= threshold

    def by_cell(leaders: DataFrame) -> DataFrame:
        return _around(leaders, page).groupBy(*keys).agg(F.collect_list("first").alias("near"))  # 25 leaders at most

    open_, leaders, left = rows, None, not rows.isEmpty()
    while left:
        first = open_.groupBy(*keys).agg(F.min(point).alias("first"))
        low = _around(first, page).groupBy(*keys).agg(F.min("first").alias("low"))
        new = written(first.join(low, keys).where("first = low").drop("low"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        closed = open_.join(small(by_cell(new)), keys, "left")
        open_ = written(closed.where(~F.coalesce(F.exists("near", lambda q: reach(q, point)), F.lit(False))).drop("near"), "open")
        left = not open_.isEmpty()
    if leaders is None:
        return rows.select(*page, F.col("i").alias(index), "x", "y", "segments", F.col("i").alias("leader"), F.col("i").alias("group_no"))
    order = numbered(leaders.select(*page, "first.i", F.col("first.x").alias("lx"), F.col("first.y").alias("ly")), page, ["i", "lx", "ly"], "n")
    order = order.select(*page, F.struct("i", F.col("lx").alias("x"), F.col("ly").alias("y")).alias("own"), (F.col("n") + 1).alias("group_no"))
    held = rows.join(by_cell(leaders), keys).withColumn("own", F.array_min(F.filter("near", lambda q: reach(q, point))))
    return held.join(small(order), [*page, "own"]).select(*page, F.col("i").alias(index), "x", "y", "segments", F.col("own.i").alias("leader"), "group_no")


def small_square(width, height, low: float = 0.25, high: float = 0.5):
    """Sides that differ by two points at most, the longer one over low and under high centimetres."""
    size = F.greatest(width, height) * 0.03528
    return F.coalesce((F.abs(width - height) <= 2) & (size > low) & (size < high), F.lit(False))


def checkboxes(drawings: DataFrame, page: list[str], index: str, threshold: float = 10.0, groups: DataFrame | None = None) -> DataFrame:
    """page, index, mark, x, y: for each drawing that is a small square (width, height) `[X]` where its group has two line segments or more, else `[ ]`, at the group's mean, five points up. groups: what claimed() gives for them, if it is known."""
    squares = drawings.where(small_square(F.col("width"), F.col("height"))).select(*page, index)
    groups = claimed(drawings, page, index, threshold) if groups is None else groups
    sums = groups.groupBy(*page, "group_no").agg(F.sum("segments").alias("segments"), F.avg("x").alias("x"), (F.avg("y") - 5).alias("y"))
    mine = groups.select(*page, index, "group_no").join(squares, [*page, index], "left_semi").join(sums, [*page, "group_no"])
    return mine.select(*page, index, F.when(F.col("segments") >= 2, F.lit("[X]")).otherwise(F.lit("[ ]")).alias("mark"), "x", "y")
