"""River-network operators by pointer doubling.

A network is an edge table `(cell_id, down_id)`, `down_id` NULL at a pit. A path of length L takes
about log2(L) rounds. Each round is one join (and one aggregate), written to the shared folder
before the next. Two rules keep hot outlets harmless: rows that have reached their root leave the
join, so no outlet collects its whole basin as join partners; sums are grouped by target before
they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.operators.keyed import lookup, row_index_by_block, running_by_block, tasks_for, with_group
from hydroloom.session import cut_lineage, drop_path

MAX_ROUNDS = 64  # paths of up to 2**64 cells; a loop that needs more raises

# Keypad direction codes by row and column step; 5 is a pit, 0 is missing.
UP_CODES, DOWN_CODES = (7, 8, 9), (1, 2, 3)
RIGHT_CODES, LEFT_CODES = (3, 6, 9), (1, 4, 7)
DIAGONAL_CODES = (1, 3, 7, 9)
DIAGONAL = 1.414214


def row_step(code: Column) -> Column:
    return F.when(code.isin(*UP_CODES), -1).when(code.isin(*DOWN_CODES), 1).otherwise(0)


def col_step(code: Column) -> Column:
    return F.when(code.isin(*RIGHT_CODES), 1).when(code.isin(*LEFT_CODES), -1).otherwise(0)


def downstream_step(df: DataFrame, cellsize: float = 1.0) -> DataFrame:
    """Row, column and coordinates of the next cell by direction code."""
    dr, dc = row_step(F.col("code")), col_step(F.col("code"))
    out = df.withColumn("down_row", F.col("row") + dr).withColumn("down_col", F.col("col") + dc)
    if "lat" in df.columns:
        out = out.withColumn("down_lat", F.col("lat") - dr * cellsize).withColumn("down_lon", F.col("lon") + dc * cellsize)
    return out


def ldd_edges(codes: DataFrame) -> DataFrame:
    """Edges of a code map. Codes 0, 5 and above 9 have no next cell; nor have cells that point
    outside the grid or to a cell that is absent or missing."""
    code = F.when(F.col("code").between(1, 9), F.col("code")).otherwise(0)
    here = downstream_step(codes.withColumn("code", code))
    there = codes.filter(F.col("code").between(1, 9)).select(
        F.col("cell_id").alias("down_id"), F.col("row").alias("down_row"), F.col("col").alias("down_col")
    )
    moving = here.filter((F.col("code") != 0) & (F.col("code") != 5))
    still = here.filter((F.col("code") == 0) | (F.col("code") == 5))
    return (
        moving.join(there, ["down_row", "down_col"], "left").select("cell_id", "down_id")
        .unionByName(still.select("cell_id", F.lit(None).cast("long").alias("down_id")))
    )


def _cut_and_count(df: DataFrame, label: str, active: Column, before: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Write a round and count, in the same job, the rows that need another one; the table of the round before goes."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count_if(active).alias("active")), label, before)
    return table, seen.get["active"]


def upstream_accumulate(ldd: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of each weight over all cells upstream of a cell, itself included.

    After round k a cell holds the sum over paths shorter than 2**k and points 2**k cells down.
    """
    state = ldd.join(weights.select("cell_id", *columns), "cell_id", "left").select(
        "cell_id", F.col("down_id").alias("ptr"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns]
    )
    left = None
    for _ in range(MAX_ROUNDS):
        gain = (
            state.filter(F.col("ptr").isNotNull())
            .groupBy(F.col("ptr").alias("cell_id"))
            .agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        )
        jump = state.select(F.col("cell_id").alias("ptr"), F.col("ptr").alias("_next"))
        moved = state.filter(F.col("ptr").isNotNull()).join(jump, "ptr", "left").select("cell_id", F.col("_next").alias("ptr"), *columns)
        grown = moved.unionByName(state.filter(F.col("ptr").isNull())).join(gain, "cell_id", "left")
        state, active = _cut_and_count(
            grown.select("cell_id", "ptr", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in columns]),
            "accumulate", F.col("ptr").isNotNull(), state,
        )
        if active == 0:
            break
        if active == left:  # while paths still drain, every round ends some
            raise ValueError("the network has a cycle; run ldd_repair first")
        left = active
    else:
        raise RuntimeError("accumulation did not end")
    return state.select("cell_id", *columns)


def upstream_one(ldd: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """Sum of a weight over the direct upstream neighbours, 0 without any."""
    total = (
        ldd.filter(F.col("down_id").isNotNull())
        .join(weights.select("cell_id", column), "cell_id")
        .groupBy(F.col("down_id").alias("cell_id"))
        .agg(F.sum(column).alias("_sum"))
    )
    return ldd.select("cell_id").join(total, "cell_id", "left").select(
        "cell_id", F.coalesce("_sum", F.lit(0.0)).alias(column)
    )


def downstream_one(ldd: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """Value of the next cell, the own value at a pit."""
    own = ldd.join(weights.select("cell_id", column), "cell_id")
    below = weights.select(F.col("cell_id").alias("down_id"), F.col(column).alias("_below"))
    inner = own.filter(F.col("down_id").isNotNull()).join(below, "down_id", "left")
    return inner.select("cell_id", F.coalesce("_below", column).alias(column)).unionByName(
        own.filter(F.col("down_id").isNull()).select("cell_id", column)
    )


def root_of(ldd: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(cell_id, root_id, distance): first root on the way down, steps to it.

    Roots are the pits and, if given, the cells of `roots`. Cells that lead into a cycle and never
    reach a root get NULL.
    """
    start = ldd
    if roots is not None:
        mark = roots.select("cell_id").distinct().withColumn("_root", F.lit(True))
        start = ldd.join(mark, "cell_id", "left").withColumn(
            "down_id", F.when(F.col("_root").isNull(), F.col("down_id"))
        )
    state = start.select(
        "cell_id", F.coalesce("down_id", "cell_id").alias("ptr"),
        F.col("down_id").isNull().alias("done"), F.when(F.col("down_id").isNull(), 0).otherwise(1).cast("long").alias("distance"),
    )
    left = None
    for _ in range(MAX_ROUNDS):
        jump = state.select(
            F.col("cell_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"), F.col("distance").alias("_far")
        )
        moved = state.filter(~F.col("done")).join(jump, "ptr").select(
            "cell_id", F.col("_ptr").alias("ptr"), F.col("_done").alias("done"), (F.col("distance") + F.col("_far")).alias("distance")
        )
        state, active = _cut_and_count(moved.unionByName(state.filter("done")), "root", ~F.col("done"), state)
        if active in (0, left):  # while paths still drain, every round ends some
            break
        left = active
    else:
        raise RuntimeError("the search for roots did not end")
    return state.select(
        "cell_id", F.when(F.col("done"), F.col("ptr")).alias("root_id"), F.when(F.col("done"), F.col("distance")).alias("distance")
    )


def basin_label(ldd: DataFrame) -> DataFrame:
    """Basin number of each cell, counted from 1 in the order of the pits; NULL for cells that lead into a cycle."""
    root = root_of(ldd)
    pits = ldd.filter(F.col("down_id").isNull()).select(F.col("cell_id").alias("root_id"))
    number = row_index_by_block(pits, [], "root_id", F.expr("root_id div 100000"), "basin")
    return root.join(number, "root_id", "left").select("cell_id", F.col("basin").cast("long").alias("basin"))


def topological_level(ldd: DataFrame) -> DataFrame:
    """Steps to the pit; descending order visits upstream cells first."""
    return root_of(ldd).select("cell_id", F.col("distance").alias("level"))


def representatives(gauge: DataFrame) -> DataFrame:
    """(gauge_id, rep_id): the smallest gauge on the cell of each gauge. Operators work on representatives."""
    one = gauge.groupBy("cell_id").agg(F.min("gauge_id").alias("rep_id"))
    return gauge.join(one, "cell_id").select("gauge_id", "rep_id")


def for_all_gauges(per_gauge: DataFrame, gauge: DataFrame) -> DataFrame:
    """Rows of representatives handed to every gauge on their cell."""
    own = per_gauge.withColumnRenamed("gauge_id", "rep_id")
    return representatives(gauge).join(own, "rep_id").select(*per_gauge.columns)


def subcatchment(ldd: DataFrame, gauge: DataFrame) -> DataFrame:
    """(cell_id, gauge_id) of the nearest gauge at or below each cell; cells without one are absent.

    Of gauges that share a cell the smallest id stands for all; `for_all_gauges` gives the others their rows.
    """
    one = gauge.groupBy("cell_id").agg(F.min("gauge_id").alias("gauge_id"))
    root = root_of(ldd, one)
    return root.join(one.select(F.col("cell_id").alias("root_id"), "gauge_id"), "root_id").select("cell_id", "gauge_id")


def gauge_tree(ldd: DataFrame, gauge: DataFrame, nearest: DataFrame) -> DataFrame:
    """(gauge_id, parent_id) of each representative: the next gauge further down, NULL for the lowest."""
    one = gauge.groupBy("cell_id").agg(F.min("gauge_id").alias("gauge_id"))
    below = one.join(ldd, "cell_id", "left").select("gauge_id", F.col("down_id").alias("cell_id"))
    return below.join(nearest.withColumnRenamed("gauge_id", "parent_id"), "cell_id", "left").select("gauge_id", "parent_id")


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def down_tree(tree: DataFrame, values: DataFrame, folds: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Fold (sum, min or max) of `values(gauge_id, keys, columns)` over each gauge and all gauges above it.

    After round k a gauge holds its own value and those less than 2**k steps above it: each round hands the values to the
    gauge 2**k steps below and folds. So values are written about log2(depth) times, never once per pair of gauges. Each
    round is dealt over tasks by the rows it holds, at most twice those of the round before. Values whose `keys` have few
    rows each are dealt by `keys` once and stay there for all rounds (`_down_by_keys`).
    """
    aggs = [_FOLDS[how](c).alias(c) for c, how in folds.items()]
    held = values.select("gauge_id", *keys, *folds).groupBy("gauge_id", *keys).agg(*aggs)
    step, active = _cut_and_count(tree.select("gauge_id", F.col("parent_id").alias("ptr")), "tree", F.col("ptr").isNotNull())
    if active == 0:
        return held
    held, rows = _cut_and_count(held, "tree-values", F.lit(True))
    if keys:
        largest = held.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        repeated = step.groupBy("gauge_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        # A task holds several groups, else they would be dealt unevenly; a gauge that comes twice gives its values twice.
        if tasks_for(KEY_GROUPS * largest) == 1 and not repeated:
            return _down_by_keys(step, held, rows, aggs, list(folds), keys)
    for _ in range(MAX_ROUNDS):
        if active == 0:
            return held
        given = held.join(step.filter(F.col("ptr").isNotNull()), "gauge_id").select(F.col("ptr").alias("gauge_id"), *keys, *folds)
        both = held.unionByName(given).repartition(tasks_for(2 * rows), "gauge_id", *keys)
        held, rows = _cut_and_count(both.groupBy("gauge_id", *keys).agg(*aggs), "tree-values", F.lit(True), held)
        jump = step.select(F.col("gauge_id").alias("ptr"), F.col("ptr").alias("_next"))
        step, active = _cut_and_count(
            step.join(jump, "ptr", "left").select("gauge_id", F.col("_next").alias("ptr")), "tree", F.col("ptr").isNotNull(), step
        )
    raise RuntimeError("the gauge tree has a cycle")


KEY_GROUPS = 4  # least number of key groups in a task of `_down_by_keys`
KEY_GROWTH = 8  # rows that a value is counted as there, since it goes to several gauges


def _down_by_keys(step: DataFrame, held: DataFrame, rows: int, aggs: list[Column], columns: list[str], keys: list[str]) -> DataFrame:
    """`down_tree` without a shuffle or a table for each round: the way down changes the gauge of a value and never its `keys`.

    Only the steps are doubled in tables, one row a gauge. A round hands the values to one, two and three steps of
    its length, so the next one is four times as long.
    """
    held = held.repartition(tasks_for(KEY_GROWTH * rows), *keys)
    for _ in range(MAX_ROUNDS // 2):
        one = step.filter("ptr is not null").select("gauge_id", F.col("ptr").alias("p1"))
        two = cut_lineage(one.join(one.select(F.col("gauge_id").alias("p1"), F.col("p1").alias("p2")), "p1", "left"), "tree")
        beyond = two.select(F.col("gauge_id").alias("p2"), F.col("p1").alias("p3"), F.col("p2").alias("ptr"))
        four, active = _cut_and_count(two.join(beyond, "p2", "left"), "tree", F.col("ptr").isNotNull(), two)
        below = F.array_compact(F.array("p1", "p2", "p3"))
        given = lookup(held, four, ["gauge_id"], ["p1", "p2", "p3"], how="left").select(
            F.explode(F.concat(F.array("gauge_id"), below)).alias("gauge_id"), *keys, *columns
        )
        held = given.groupBy("gauge_id", *keys).agg(*aggs)
        if active == 0:
            return held
        step = four.select("gauge_id", "ptr")
    raise RuntimeError("the gauge tree has a cycle")


def tree_roots(tree: DataFrame) -> DataFrame:
    """(gauge_id, lowest_id, depth): the most downstream gauge of each, and how many gauges lie on the way, both included."""
    root = root_of(tree.select(F.col("gauge_id").alias("cell_id"), F.col("parent_id").alias("down_id")))
    return root.select(F.col("cell_id").alias("gauge_id"), F.col("root_id").alias("lowest_id"), (F.col("distance") + 1).alias("depth"))


def gauge_intervals(tree: DataFrame) -> DataFrame:
    """(gauge_id, enter, leave): numbers of an Euler tour of the gauge trees.

    `enter` counts the gauges from 0, a gauge before those above it, so a gauge and all above it hold the numbers `enter` to
    `leave`: a basin is a range of numbers. One row a gauge, however deep the trees are: sizes come up by `down_tree`, and a
    gauge's number is the sum, over itself and the gauges below, of one and the sizes of the neighbours before it.
    """
    sizes = cut_lineage(down_tree(tree, tree.select("gauge_id", F.lit(1).cast("long").alias("size")), {"size": "sum"}), "tree-sizes")
    placed = tree.join(sizes, "gauge_id")
    before = running_by_block(placed, ["parent_id"], "gauge_id", F.expr("gauge_id div 100000"), {"upto": ("sum", F.col("size"))})
    enter = _path_sums(tree, before.select("gauge_id", (F.col("upto") - F.col("size") + 1).alias("extra")))
    first = (F.col("extra") - 1).alias("enter")
    return enter.join(sizes, "gauge_id").select("gauge_id", first, (F.col("extra") + F.col("size") - 2).alias("leave"))


TOUR_BLOCK = 4096  # numbers a row lists at once


def gauge_closure(tree: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(gauge_id, below_id): every gauge with itself and all gauges below it.

    Nothing of that size is written: a gauge's range of tour numbers is listed, in blocks, and joined by number, so the pairs
    arise where they are asked for, and a filter on `below_id` leaves the ranges of the chosen gauges only.
    """
    tour = cut_lineage(gauge_intervals(tree), "tour") if intervals is None else intervals
    block = F.explode(F.sequence("enter", "leave", F.lit(TOUR_BLOCK).cast("long"))).alias("_from")
    blocks = tour.select(F.col("gauge_id").alias("below_id"), block, "leave")
    numbers = blocks.select("below_id", F.explode(F.sequence("_from", F.least(F.col("leave"), F.col("_from") + (TOUR_BLOCK - 1)))).alias("enter"))
    return numbers.join(tour.select("gauge_id", "enter"), "enter").select("gauge_id", "below_id")


def gauge_membership(nearest: DataFrame, closure: DataFrame, gauge: DataFrame) -> DataFrame:
    """All (cell_id, gauge_id) with the gauge at or below the cell; the result itself holds every pair."""
    pairs = nearest.join(closure, "gauge_id").select("cell_id", F.col("below_id").alias("gauge_id"))
    return for_all_gauges(pairs, gauge)


def catchment(nearest: DataFrame, tree: DataFrame) -> DataFrame:
    """Label by the most downstream gauge on the flow path (the smallest id of those on its cell)."""
    return nearest.join(tree_roots(tree), "gauge_id").select("cell_id", F.col("lowest_id").alias("gauge_id"))


def interstation_regions(ldd: DataFrame, nearest: DataFrame) -> DataFrame:
    """Nearest gauge as region number, 0 outside all basins (gauge ids count from 1)."""
    return ldd.select("cell_id").join(nearest, "cell_id", "left").select(
        "cell_id", F.coalesce("gauge_id", F.lit(0)).alias("region")
    )


def sampling_frequency(ldd: DataFrame, nearest: DataFrame, tree: DataFrame, gauge: DataFrame) -> DataFrame:
    """How many gauge basins hold a cell: all gauges on the cells of the tree path below its nearest gauge."""
    shared = representatives(gauge).groupBy(F.col("rep_id").alias("gauge_id")).agg(F.count("*").alias("extra"))
    roots = tree_roots(tree)
    several = shared.filter("extra > 1")
    if several.limit(1).count() == 0:
        depth = roots.select("gauge_id", F.col("depth").alias("frequency"))
    else:
        # Depth counts cells with gauges; gauges beyond the first of a cell are summed down the path to the root.
        depth = _path_sums(tree, shared).withColumnRenamed("extra", "frequency")
    inside = nearest.join(depth, "gauge_id")
    return ldd.select("cell_id").join(inside.select("cell_id", "frequency"), "cell_id", "left").na.fill(0, ["frequency"])


def _path_sums(tree: DataFrame, values: DataFrame) -> DataFrame:
    """Sum of `values(gauge_id, extra)` over each gauge and all gauges below it, by doubling."""
    state = tree.join(values, "gauge_id", "left").select("gauge_id", F.col("parent_id").alias("ptr"), F.coalesce("extra", F.lit(0)).alias("extra"))
    state, active = _cut_and_count(state, "path", F.col("ptr").isNotNull())
    for _ in range(MAX_ROUNDS):
        if active == 0:
            return state.select("gauge_id", "extra")
        jump = state.select(F.col("gauge_id").alias("ptr"), F.col("ptr").alias("_next"), F.col("extra").alias("_more"))
        moved = state.join(jump, "ptr", "left").select(
            "gauge_id", F.col("_next").alias("ptr"), (F.col("extra") + F.coalesce("_more", F.lit(0))).alias("extra")
        )
        state, active = _cut_and_count(moved, "path", F.col("ptr").isNotNull(), state)
    raise RuntimeError("the gauge tree has a cycle")


def catchment_area_cells(nearest: DataFrame, tree: DataFrame, gauge: DataFrame) -> DataFrame:
    """Number of cells in each gauge's basin."""
    local = nearest.groupBy("gauge_id").agg(F.count("*").alias("n_cells"))
    return for_all_gauges(down_tree(tree, local, {"n_cells": "sum"}), gauge)


def direct_links(tree: DataFrame, gauge: DataFrame) -> DataFrame:
    """(gauge_id, inflow_id): gauges whose next gauge further down is `gauge_id`; gauges on one cell share both roles."""
    links = tree.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("gauge_id"), F.col("gauge_id").alias("_inflow"))
    inflow = representatives(gauge).select(F.col("rep_id").alias("_inflow"), F.col("gauge_id").alias("inflow_id"))
    return for_all_gauges(links.join(inflow, "_inflow").select("gauge_id", "inflow_id"), gauge)


def link_lists(tree: DataFrame, gauge: DataFrame) -> DataFrame:
    """Per gauge the count and the space-separated ids of its direct inflows."""
    lists = direct_links(tree, gauge).groupBy("gauge_id").agg(
        F.count("*").alias("inflow"), F.array_join(F.transform(F.array_sort(F.collect_list("inflow_id")), lambda x: x.cast("string")), " ").alias("inflow_ids")
    )
    return gauge.select("gauge_id").join(lists, "gauge_id", "left").select(
        "gauge_id", F.coalesce("inflow", F.lit(0)).alias("inflow"), F.coalesce("inflow_ids", F.lit("")).alias("inflow_ids")
    )


def down_powers(ldd: DataFrame, steps: int, known: list[DataFrame] | None = None) -> list[DataFrame]:
    """Tables (cell_id, ahead_id): the cell 1, 2, 4, ... steps below, as far as paths of `steps` need them; rows end at a pit.

    Each is joined from the one before, starting behind the `known` ones. Kept with a network they serve every walk, as each
    costs one row a cell.
    """
    tables = list(known or [ldd.filter(F.col("down_id").isNotNull()).select("cell_id", F.col("down_id").alias("ahead_id"))])
    while 2 ** len(tables) <= steps:
        last = tables[-1]
        next_ = last.select(F.col("cell_id").alias("ahead_id"), F.col("ahead_id").alias("_far"))
        tables.append(cut_lineage(last.join(next_, "ahead_id").select("cell_id", F.col("_far").alias("ahead_id")), "down-power"))
    return tables


def walk_downstream(ldd: DataFrame, starts: DataFrame, steps: int, powers: list[DataFrame] | None = None) -> DataFrame:
    """(start_id, step, cell_id) for the next `steps` cells below each start, shorter at a pit.

    Round k adds to every cell known so far the one 2**k further down, so a thousand steps are ten joins.
    """
    walk = starts.select("start_id", F.lit(0).alias("step"), "cell_id")
    for k, table in enumerate(down_powers(ldd, steps) if powers is None else powers):
        reach = 2**k
        further = walk.filter(F.col("step") + reach <= steps).join(table, "cell_id").select(
            "start_id", (F.col("step") + reach).cast("int").alias("step"), F.col("ahead_id").alias("cell_id")
        )
        walk = cut_lineage(walk.unionByName(further), "walk", walk)
    return walk.filter("step > 0").select("start_id", "step", "cell_id")


def distinct_inlet_cells(ldd: DataFrame, links: DataFrame, gauge: DataFrame) -> DataFrame:
    """Inlet cell of each inflow: the first cell below its gauge that no earlier inflow took.

    Inflows of a gauge that stand on one cell are ranked by id: the first stays, and the one with r before it moves r cells
    on at once, since those r fill at least r cells from there. So no inflow passes its place, and where no two agree,
    each has the place that serving them one by one would give it. Ten thousand inflows on one cell take two rounds, each
    with a join per power of two of the farthest move; only inflows that push each other on one by one take a round each.
    An inflow whose path ends before a free cell keeps its row, with a NULL cell and the number of cells it tried.
    Tables of cells are shuffled: numbers in order pack so well that their files would pass for tables small enough to send around.
    """
    edges = ldd.select("cell_id", "down_id")
    cells = edges.count()
    starts = links.join(gauge.select(F.col("gauge_id").alias("inflow_id"), F.col("cell_id").alias("start_id")).hint("merge"), "inflow_id")
    first = starts.join(edges.withColumnRenamed("cell_id", "start_id").hint("merge"), "start_id", "left").select(
        "gauge_id", "inflow_id", "start_id", F.lit(1).cast("long").alias("step"), F.col("down_id").alias("cell_id")
    )
    state, powers = cut_lineage(first, "inlet"), None
    try:
        while True:
            # Inflows without a cell are done; among the others the rank is a count by blocks of ids, so no task holds a cell's inflows.
            ranked = row_index_by_block(
                state.filter("cell_id is not null"), ["gauge_id", "cell_id"], "inflow_id", F.expr("inflow_id div 100000"), "rank"
            ).withColumn("move", F.col("rank") - 1).drop("rank")
            seen = Observation()
            watched = ranked.unionByName(state.filter("cell_id is null").withColumn("move", F.lit(0).cast("long"))).observe(
                seen, F.max("move").alias("move"), F.max(F.when(F.col("cell_id").isNotNull(), F.col("step"))).alias("step"),
                F.count_if(F.col("cell_id").isNull()).alias("lost"),
            )
            state = cut_lineage(watched, "inlet", state)
            found = seen.get
            if not found["move"]:
                break
            if found["step"] > cells:
                raise ValueError("an inflow runs in a cycle; run ldd_repair first")
            powers = down_powers(ldd, found["move"], powers)
            moved = state.withColumn("step", F.col("step") + F.col("move"))
            for k, table in enumerate(powers[: found["move"].bit_length()]):
                here = F.col("move").bitwiseAND(F.lit(2**k)) > 0
                ahead = table.select(F.col("cell_id").alias("_from"), "ahead_id").hint("merge")
                moved = moved.join(ahead, here & (F.col("cell_id") == F.col("_from")), "left").withColumn(
                    "cell_id", F.when(here, F.col("ahead_id")).otherwise(F.col("cell_id"))
                ).drop("_from", "ahead_id")
            state = cut_lineage(moved.drop("move"), "inlet", state)
    finally:
        for table in (powers or [])[1:]:
            drop_path(table.sparkSession, table._scratch_path)
    step = F.col("step")
    if found["lost"]:
        length = root_of(ldd).select(F.col("cell_id").alias("start_id"), "distance")
        state = state.join(length, "start_id", "left")
        step = F.when(F.col("cell_id").isNull(), F.coalesce("distance", F.lit(0))).otherwise(step)
    return state.select("gauge_id", "inflow_id", step.cast("int").alias("step"), "cell_id")


def ldd_repair(edges: DataFrame) -> DataFrame:
    """Edges with every cycle cut: (cell_id, down_id, cut).

    A cycle is cut at the last cell met by a walk that starts at the smallest cell leading into it:
    the predecessor, on the cycle, of the cell where that walk enters.
    """
    edges = cut_lineage(edges, "edges")
    state = edges.filter(F.col("down_id").isNotNull()).select(
        "cell_id", F.col("down_id").alias("ptr"), F.least("cell_id", "down_id").alias("low"), F.lit(True).alias("changed")
    )
    alive = ends = -1
    for _ in range(MAX_ROUNDS):
        # Whole basins point at the few cells of a cycle: the distinct pointers meet their cells, and the result, one row per
        # pointer in a table of its own, is handed back by a join that adaptive execution can broadcast or split.
        here = state.select(F.col("cell_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
        jump = cut_lineage(here.join(state.select("ptr").distinct(), "ptr"), "cycle-jump")
        # Paths that end at a pit drop out; what stays leads into a cycle.
        moved = state.join(jump, "ptr").select(
            "cell_id", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("changed")
        )
        seen = Observation()
        counted = moved.observe(seen, F.count(F.lit(1)).alias("alive"), F.count_if("changed").alias("changed"))
        state = cut_lineage(counted, "cycle", state)
        drop_path(state.sparkSession, jump._scratch_path)
        now = seen.get
        if now["alive"] == 0:
            return edges.select("cell_id", "down_id", F.lit(False).alias("cut"))
        if now["alive"] == alive and now["changed"] == 0:
            # No path drains any more and every minimum is final. The cells still pointed at are
            # the cycles as soon as their number stands still.
            before, ends = ends, state.select("ptr").distinct().count()
            if ends == before:
                break
        alive = now["alive"]
    else:
        raise RuntimeError("the search for cycles did not end")
    on_cycle = state.select(F.col("ptr").alias("cell_id")).distinct()
    cycle = state.join(on_cycle, "cell_id", "left_semi").select("cell_id", F.col("low").alias("cycle_id"))
    stuck = state.join(cycle.withColumnRenamed("cell_id", "ptr"), "ptr").select("cell_id", "cycle_id")
    first = stuck.groupBy("cycle_id").agg(F.min("cell_id").alias("cell_id"))
    stuck_edges = edges.join(state.select("cell_id"), "cell_id", "left_semi")
    entry = root_of(stuck_edges, cycle).join(first, "cell_id", "left_semi").select(F.col("root_id").alias("down_id"))
    cut = (
        edges.join(cycle.select("cell_id"), "cell_id", "left_semi")
        .join(entry, "down_id", "left_semi").select("cell_id", F.lit(True).alias("cut"))
    )
    return edges.join(cut, "cell_id", "left").select(
        "cell_id", F.when(F.col("cut").isNull(), F.col("down_id")).alias("down_id"), F.coalesce("cut", F.lit(False)).alias("cut")
    )


def largest_upstream(cells: DataFrame, group: str, size: str = "ups") -> DataFrame:
    """Rows whose upstream size is the largest of their group; group 0 is none."""
    inside = cells.filter(F.col(group) > 0)
    return with_group(inside, [group], _max=F.max(size)).filter(F.col(size) == F.col("_max")).drop("_max")


def waterbody_outlet(ldd: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body cells that drain to their outlet, outlets).

    Outlets are the cells with the largest upstream count of a body. Body cells whose nearest
    outlet is another body's are dropped, then outlets are found again.
    """
    ups = upstream_accumulate(ldd, ldd.select("cell_id", F.lit(1.0).alias("ups")), ["ups"])
    cells = cut_lineage(bodies.select("cell_id", "body").filter(F.col("body") > 0).join(ups, "cell_id"), "bodies")
    outlets = largest_upstream(cells, "body").select(F.col("body").alias("gauge_id"), "cell_id")
    nearest = subcatchment(ldd, outlets)
    kept = cells.join(nearest, "cell_id").filter(F.col("gauge_id") == F.col("body")).drop("gauge_id")
    kept = cut_lineage(kept, "bodies")
    return kept.select("cell_id", "body"), largest_upstream(kept, "body").select("body", "cell_id")


def cut_network_at_bodies(ldd: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every cell of a water body becomes a pit."""
    inside = bodies.filter(F.col("body") > 0).select("cell_id", F.lit(True).alias("_in"))
    return ldd.join(inside, "cell_id", "left").select(
        "cell_id", F.when(F.col("_in").isNull(), F.col("down_id")).alias("down_id")
    )


def buffer_zone(bodies: DataFrame, size: int) -> DataFrame:
    """Water bodies grown by a rectangle of `size` cells; the smallest id wins, own cells keep theirs.

    The least id around a cell is a least over rows of the least over columns: two sliding windows along single grid lines,
    over the box of the cells, where absent ones count as without a body. Rows do not grow with `size`.
    """
    box = bodies.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    near = F.lit(None).cast("long").alias("_near")
    if box[0] is None:
        around = bodies.select("row", "col", near)
    else:
        row0, row1, col0, col1 = box
        width = col1 - col0 + 1
        dense = bodies.sparkSession.range((row1 - row0 + 1) * width).select(
            (F.lit(row0) + F.expr(f"id div {width}")).alias("row"), (F.lit(col0) + F.col("id") % width).alias("col")
        )
        own = bodies.filter(F.col("body") > 0).groupBy("row", "col").agg(F.min("body").alias("_own"))
        before, behind = size // 2, (size - 1) // 2  # an even size reaches one cell further down and right
        down = W.partitionBy("col").orderBy("row").rowsBetween(-before, behind)
        right = W.partitionBy("row").orderBy("col").rowsBetween(-before, behind)
        lines = dense.join(own, ["row", "col"], "left").withColumn("_line", F.min("_own").over(down))
        around = lines.withColumn("_near", F.min("_line").over(right)).select("row", "col", "_near")
    return bodies.join(around, ["row", "col"], "left").select(
        "cell_id", "row", "col", F.when(F.col("body") > 0, F.col("body")).otherwise(F.coalesce("_near", F.lit(0))).alias("buffer")
    )


def mask_from_point(ldd: DataFrame, cell: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Basins of points and the smallest box around each: (cell_id, gauge_id), (gauge_id, box)."""
    nearest = subcatchment(ldd, points)
    tree = cut_lineage(gauge_tree(ldd, points, nearest), "point-tree")
    box = nearest.join(cell, "cell_id").groupBy("gauge_id").agg(
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )
    whole = down_tree(tree, box, {"row0": "min", "row1": "max", "col0": "min", "col1": "max"})
    return gauge_membership(nearest, gauge_closure(tree), points), for_all_gauges(whole, points)


def flow_distance_factor(code: Column, length: Column) -> Column:
    """Cell length along the flow: longer on diagonals."""
    return F.when(code.isin(*DIAGONAL_CODES), DIAGONAL * length).otherwise(length)


def lake_inflow_sum(ldd: DataFrame, flows: DataFrame, cell: DataFrame, bodies: DataFrame, outlets: DataFrame) -> DataFrame:
    """Inflow of each water body at its outlet: upstream discharge x 86400 + runoff x area.

    `flows(cell_id, date, discharge, runoff)` is read once: every cell has the roles it plays for a body. Of several outlets the
    one with the smallest cell id carries the volume.
    """
    body = bodies.filter(F.col("body") > 0).select("cell_id", "body")
    into = (
        ldd.filter(F.col("down_id").isNotNull()).join(body.withColumnRenamed("cell_id", "down_id"), "down_id")
        .select("cell_id", "body", F.lit(86400.0).alias("by_discharge"), F.lit(0.0).alias("by_runoff"))
    )
    local = body.join(cell.select("cell_id", "area"), "cell_id").select("cell_id", "body", F.lit(0.0).alias("by_discharge"), F.col("area").cast("double").alias("by_runoff"))
    roles = into.unionByName(local).groupBy("cell_id", "body").agg(F.sum("by_discharge").alias("by_discharge"), F.sum("by_runoff").alias("by_runoff"))
    # A role without weight takes no part, so that a missing runoff does not hide a discharge.
    parts = [F.when(F.col(f"by_{c}") > 0, F.coalesce(F.col(c) * F.col(f"by_{c}"), F.lit(0.0))).otherwise(0.0) for c in ("discharge", "runoff")]
    known = [F.when((F.col(f"by_{c}") > 0) & F.col(c).isNotNull(), True) for c in ("discharge", "runoff")]
    volume = F.when(F.coalesce(*known), parts[0] + parts[1])
    total = flows.join(roles, "cell_id").groupBy("body", "date").agg(F.sum(volume).alias("inflow"))
    one = outlets.groupBy("body").agg(F.min("cell_id").alias("outlet_id"))
    return total.join(one, "body")
