"""Dealing rows out to tiles, and reading them back one meeting of tiles after the other.

Rows of one block are compared with each other. A block too large for one task is cut into tiles by population count
of the fingerprint (and by a hash of the row); two tiles meet in a unit of their own where their counts differ by no
more than the radius, so that every pair that can be within it meets in exactly one unit or more, and no task holds more than two
tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, large: DataFrame, radius: int, key: str) -> DataFrame:
    """``rows`` (block: long, fp: long, ``key`` and others) with columns unit, side and two, dealt and sorted by unit.

    ``large``: (block, salts) of the blocks to be cut, few of them. two tells that two different tiles meet, side
    which of them a row belongs to. Units whose hashes collide by chance are compared together, which does no harm.
    """
    # a wide radius skips few counts: wider tiles then keep the number of meetings of a row small
    width = 1 if radius < 8 else 16
    salts, ones = F.col("salts"), F.floor(F.bit_count("fp") / width).cast("int")
    reach = (radius + width - 1) // width
    own = ones * salts + F.pmod(F.xxhash64(key), salts).cast("int")
    others = F.flatten(F.transform(
        F.sequence(F.greatest(F.lit(0), ones - reach), F.least(F.lit(64 // width), ones + reach)),
        lambda n: F.transform(F.sequence(F.lit(0), salts - 1), lambda s: n * salts + s),
    ))
    whole = F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(-1).alias("mine")))
    meetings = F.when(salts.isNull(), whole).otherwise(F.transform(
        others, lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high"), own.alias("mine"))
    ))
    return (
        rows.join(large, "block", "left").withColumn("m", F.explode(meetings))
        .withColumns({
            "unit": F.xxhash64("block", "m.low", "m.high"), "side": (F.col("m.mine") != F.col("m.low")).cast("int"),
            "two": F.col("m.low") != F.col("m.high"),
        })
        .drop("block", "salts", "m").repartition("unit").sortWithinPartitions("unit", "side", key)
    )


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold units whole, of batches sorted by unit."""
    held: list[pa.RecordBatch] = []
    unit_held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        cut = int(np.count_nonzero(unit != unit[-1]))
        if held and (cut or unit_held != unit[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        unit_held = unit[-1]
    if held:
        yield pa.Table.from_batches(held)


def bounds(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    return starts, np.append(starts[1:], len(unit))


def row_forest(fp: np.ndarray, split: int | None, radius: int, also) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``fp``, or (split) between its two parts.

    A link is a pair within ``radius`` bits for which ``also(i, columns)`` holds too; pairs that are connected
    already are not asked for.
    """
    m, out = len(fp), []
    label = np.arange(m)
    count = np.bitwise_count(fp).astype(np.int64)
    for i in range(m - 1 if split is None else split):
        at = i + 1 if split is None else split
        near = np.abs(count[at:] - count[i]) <= radius
        near &= (np.bitwise_count(fp[at:] ^ fp[i]) <= radius) & (label[at:] != label[i])
        columns = np.flatnonzero(near) + at
        if len(columns):
            columns = columns[also(i, columns)]
        while len(columns):
            c = int(columns[0])
            out.append((i, c))
            label[label == label[c]] = label[i]
            columns = columns[label[columns] != label[i]]
    return out
