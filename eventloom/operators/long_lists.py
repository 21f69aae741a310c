"""Greedy packing of ordered lines into messages, for lists of any length.

A line costs ``more`` characters where it goes on a message and ``open`` where it begins one. So the line that begins
the next message follows from running lengths alone: it is the first whose running length exceeds that of the
beginning line by more than what is left. These pointers are found in blocks of lines; the pointers that leave a
block are doubled (a jump of jumps) until the chain from the first line is known at every block. No list is one row
or one task: lines are numbered by ranges, and only numbers go to the tasks that follow pointers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resolve import checkpointed

AGAIN = " <i>(devam)</i>"
#: Lengths of a message in a block of lines.
BLOCK = 64


def _pointers(rows: pd.DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and for each the position that begins the next message."""
    pos, end, cost = rows["pos"].to_numpy(), (rows["before"] + rows["more"]).to_numpy(), rows["open"].to_numpy()
    over = np.searchsorted(end, end + limit - cost, side="right")
    reach = np.where(over < len(pos), pos[np.minimum(over, len(pos) - 1)], pos[-1] + 1)
    return pos, np.maximum(reach, pos + 1)


def _with_start(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in order; before the first line of a list stands its header, at position 0."""
    rows = rows.sort_values("pos", ignore_index=True)
    if rows["pos"].iloc[0] != 1:
        return rows
    first = rows.iloc[:1].assign(pos=0, before=0, more=0, open=rows["header_length"].iloc[0])
    return pd.concat([first, rows], ignore_index=True)


def _ways_out(limit: int, size: int):
    def ways(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _with_start(rows)
        block = int(rows["at_block"].iloc[0])
        inside = int((rows["block"] == block).sum())
        pos, reach = _pointers(rows, limit)
        out, passed = reach[:inside].tolist(), [1] * inside
        for i in range(inside - 1, -1, -1):
            j = out[i] - int(pos[0])
            if j < inside:
                out[i], passed[i] = out[j], passed[j] + 1
        began = rows["before"].to_numpy()[:inside] < block * size + limit
        began[:1] = True
        if block == 0:
            began[1:] = False
        k = np.flatnonzero(began)
        return pd.DataFrame({"k": rows["k"].iloc[0], "block": block, "node": pos[k], "out": np.array(out, "int64")[k], "passed": np.array(passed, "int64")[k]})

    return ways


def _cuts(limit: int):
    def cuts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _with_start(rows)
        pos, reach = _pointers(rows, limit)
        at, found = int(rows["node"].iloc[0]), []
        while at <= pos[-1]:
            found.append(at)
            at = int(reach[at - pos[0]])
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "block": [rows["block"].iloc[0]], "n": [rows["n"].iloc[0]], "cuts": [found]})

    return cuts


def _numbered(rows: DataFrame, key: str, order: list[str], line: Column, heading: Column, header: Column) -> DataFrame:
    """Lines with position, costs and running length, counted range by range."""
    given = rows.select(
        F.to_json(F.struct(F.col(key).alias("key"))).alias("k"), F.col(key).alias("key"), F.struct(*order, line.alias("__line")).alias("o"),
        F.coalesce(line, F.lit("")).alias("line"), F.coalesce(heading, F.lit("")).alias("heading"), F.coalesce(header, F.lit("")).alias("header"),
    )
    placed = checkpointed(given.repartitionByRange("k", "o").withColumn("part", F.spark_partition_id()), "lines")
    here, parts = Window.partitionBy("k", "part").orderBy("o"), Window.partitionBy("k").orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("rows"), F.max_by("heading", "o").alias("last"))
    ends = ends.select("k", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.lag("last").over(parts).alias("last_before"))
    lined = placed.withColumns({"__at": F.row_number().over(here), "__above": F.lag("heading").over(here)}).join(ends, ["k", "part"])
    fresh = (F.col("heading") != "") & (F.col("heading") != F.coalesce("__above", "last_before", F.lit("")))
    again = F.concat("header", F.lit(AGAIN), F.when(fresh, F.concat(F.lit("\n\n"), "heading")).when(F.col("heading") != "", F.concat(F.lit("\n\n"), "heading", F.lit(AGAIN))).otherwise(""))
    texts = lined.select(
        "k", "key", "part", (F.col("rows_before") + F.col("__at")).alias("pos"), "header",
        F.concat(F.when(fresh, F.concat(F.lit("\n\n"), "heading")).otherwise(""), F.lit("\n"), "line").alias("goes_on"), F.concat(again, F.lit("\n"), "line").alias("begins"),
    ).withColumns({"more": F.length("goes_on").cast("long"), "open": F.length("begins").cast("long"), "header_length": F.length("header").cast("long")})
    numbered = checkpointed(texts.withColumn("local", F.sum("more").over(Window.partitionBy("k", "part").orderBy("pos"))), "lengths")
    sums = numbered.groupBy("k", "part").agg(F.sum("more").alias("__sum"))
    sums = sums.select("k", "part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return numbered.join(sums, ["k", "part"]).withColumn("before", F.col("__before") + F.col("local") - F.col("more")).drop("part", "local", "__before")


def _reached(edges: DataFrame) -> DataFrame:
    """(k, node, n): where the chain from node 0 enters each block, and the messages before; the last node lies behind the list."""
    last = edges.agg(F.max("block")).first()[0]
    if last is None:
        return edges.select("k", "node", F.col("passed").alias("n"))
    jump = edges.select("k", "node", "out", "passed")
    ladder = [jump]
    for _ in range(1, (int(last) + 1).bit_length()):
        then = jump.select("k", F.col("node").alias("out"), F.col("out").alias("__out"), F.col("passed").alias("__passed"))
        jump = checkpointed(jump.join(then, ["k", "out"]).select("k", "node", F.col("__out").alias("out"), (F.col("passed") + F.col("__passed")).alias("passed")), "jumps")
        ladder.append(jump)
    reached = edges.filter("node = 0").select("k", "node", F.lit(0).cast("long").alias("n"))
    for jump in reversed(ladder):
        reached = checkpointed(reached.unionByName(reached.join(jump, ["k", "node"]).select("k", F.col("out").alias("node"), (F.col("n") + F.col("passed")).alias("n"))), "reached")
    return reached


def packed(rows: DataFrame, key: str, order: list[str], line: Column, heading: Column, header: Column, limit: int, block: int = BLOCK) -> DataFrame:
    """(key, n, message): the lines of each key in ``order`` (ties by line), in messages of at most ``limit`` characters, n from 1.

    A heading other than that of the line above goes before its line with a blank line between; a message that goes on
    repeats header and heading with a mark. A line that does not fit even alone makes a longer message; callers cut lines.
    A null line, heading or header is empty, a null key is a key, an empty table gives no messages. A header that leaves
    no room for the first line is a message of its own.
    """
    size = block * limit
    lines = _numbered(rows, key, order, line, heading, header).withColumn("block", F.expr(f"before div {size}"))
    numbers = lines.select("k", "pos", "before", "more", "open", "header_length", "block")
    # the lines that a pointer from the block before may reach
    near = (F.col("block") > 0) & (F.col("before") - F.col("block") * size < limit)
    spread = numbers.withColumn("at_block", F.explode(F.when(near, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    edges = checkpointed(spread.groupBy("k", "at_block").applyInPandas(_ways_out(limit, size), "k string, block long, node long, out long, passed long"), "pointers")
    reached = _reached(edges)
    entered = reached.join(edges.select("k", "node", "block"), ["k", "node"])
    cuts = numbers.join(entered, ["k", "block"]).groupBy("k", "block").applyInPandas(_cuts(limit), "k string, block long, n long, cuts array<long>")
    ends = reached.groupBy("k").agg(F.max("n").alias("__all"))
    passed = F.col("n") - 1 + F.size(F.filter("cuts", lambda c: c <= F.col("pos")))
    told = lines.join(cuts, ["k", "block"], "left").join(ends, "k").withColumn("n", F.coalesce(F.when(F.col("n").isNotNull(), passed), F.col("__all") - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "goes_on"))), lambda x: x["goes_on"]), "")
    first = F.min_by(F.struct("pos", "header", "goes_on", "begins"), "pos")
    whole = told.groupBy("k", "n").agg(F.first("key").alias("__key"), first.alias("f"), text.alias("t"))
    message = F.when(F.col("n") == 0, F.concat("f.header", "t")).otherwise(F.concat("f.begins", F.substr("t", F.length("f.goes_on") + 1)))
    alone = (F.col("n") == 1) & (F.col("f.pos") == 1)
    each = F.when(alone, F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("f.header").alias("message")), F.struct(F.lit(2).cast("long").alias("n"), message.alias("message"))))
    each = each.otherwise(F.array(F.struct((F.col("n") + 1).cast("long").alias("n"), message.alias("message"))))
    return whole.select(F.col("__key").alias(key), F.inline(each))
