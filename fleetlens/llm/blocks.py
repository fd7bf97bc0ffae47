"""Pairwise work inside groups of any size: groups are cut into blocks, and each pair of blocks is a task's unit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_block_pairs(rows: DataFrame, group: str, member: str, size: Column, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: ``unit`` (one pair), ``side`` (0 or 1) and ``same`` (a block with
    itself). A group of at most ``block`` members is one unit; a larger one repeats each row once per block."""
    blocks = F.ceil(size / F.lit(block)).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (dealt.withColumn("unit", F.xxhash64(group, low, high)).withColumn("side", (F.col("_own") != low).cast("int"))
            .withColumn("same", F.col("_own") == F.col("_other")).drop("_blocks", "_own", "_other"))


def units(batches: Iterator[pa.RecordBatch], name: str = "unit") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Complete runs of equal ``name`` from sorted batches: a table and the run borders in it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(name).to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))  # the last run may go on
        if held and (cut or held[-1].column(name)[-1].as_py() != unit[0]):
            table = pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            yield table, borders(table.column(name).to_numpy())
            held = []
        elif cut:
            table = pa.Table.from_batches([batch.slice(0, cut)])
            yield table, borders(unit[:cut])
        held.append(batch.slice(cut))
    if held:
        table = pa.Table.from_batches(held)
        yield table, borders(table.column(name).to_numpy())


def borders(unit: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])


def over_units(rows: DataFrame, work: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """Bring each unit together and run ``work`` over the units of a partition."""
    # no number of partitions: adaptive execution joins small ones and keeps at least one per core
    dealt = rows.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lambda batches: work(units(batches)), schema)


def fixed_width(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as (rows, width) bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, width)


class Forest:
    """Union-find over a few rows; says which links joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def roots(self) -> np.ndarray:
        """The root of every row."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
