"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into virtual partitions by a hash. How many rows of each partition go to
each cell (a shard, or a slice of a shard) is drawn exactly, from the multivariate
hypergeometric law that a uniform permutation would follow. Then: permute within the
partition, cut it by the drawn counts, exchange, and permute within the cell. Cell
sizes are known before any row moves, so a row's slot in its shard is its cell's
start plus its rank in the cell, and no shard has to be sorted in one task.

Everything on rows is a DataFrame operation. The driver sees one count a partition.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINE = 2048


@dataclass(frozen=True)
class Sharding:
    """``shards`` whose row counts differ by one at most; ``cell_rows`` in a sort at most.

    Cells and partitions are at most 2,048 each, so the matrix has a fixed bound.
    """

    shards: int = 40
    cell_rows: int = 1_000_000
    seed: int = 20240229


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad`` without replacement.

    Inversion outwards from the mode: exact up to rounding of the probabilities, for
    any size, in about as many steps as the standard deviation.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))

    def lf(n: int) -> float:
        return math.lgamma(n + 1)

    at_mode = math.exp(lf(good) - lf(mode) - lf(good - mode) + lf(bad) - lf(drawn - mode) - lf(bad - drawn + mode) - lf(total) + lf(drawn) + lf(total - drawn))
    u = rng.random() - at_mode
    if u < 0:
        return mode
    up, p_up, down, p_down = mode, at_mode, mode, at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def matrix(rng: random.Random, sources: list[int], targets: list[int]) -> list[list[int]]:
    """Rows from each source to each target: margins exact, law that of a uniform permutation."""
    room, out = list(targets), []
    for n in sources:
        row, rest, left = [], sum(room), n
        for k, r in enumerate(room):
            got = hypergeometric(rng, r, rest - r, left) if left else 0
            rest, left = rest - r, left - got
            room[k] = r - got
            row.append(got)
        out.append(row)
    return out


def shard(rows: DataFrame, identity: list[str], p: Sharding = Sharding()) -> DataFrame:
    """``rows`` with shard (from 0) and slot (from 0, gapless in the shard).

    ``identity`` names columns that tell rows apart; rows equal in all of them may
    take each other's places. The result depends on the rows and the seed alone, not
    on how Spark splits the input. Nulls are values like others. Columns named shard,
    slot or starting with ``__s_`` are replaced. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", *[c for c in rows.columns if c.startswith("__s_")])
    ids = [F.col(f"`{c}`") for c in identity]
    marked = rows.withColumn("__s_u", F.xxhash64(F.lit(p.seed), *ids))
    fine = F.pmod("__s_u", F.lit(FINE)).cast("int")
    counts = {r[0]: r[1] for r in marked.groupBy(fine.alias("f")).count().collect()}
    total = sum(counts.values())
    sources = 1
    while sources < FINE and total > sources * p.cell_rows // 8:
        sources *= 2
    sources = max(sources, 64)
    per = [0] * sources
    for f, n in counts.items():
        per[f % sources] += n
    sizes = [(k + 1) * total // p.shards - k * total // p.shards for k in range(p.shards)]
    slices = max(1, min(FINE // p.shards, -(-max(sizes) // p.cell_rows)))
    cells = [((i + 1) * n // slices - i * n // slices, k, i * n // slices) for k, n in enumerate(sizes) for i in range(slices)]
    drawn = matrix(random.Random(p.seed), per, [c[0] for c in cells])
    ends = []
    for row in drawn:
        at, own = 0, []
        for n in row:
            at += n
            own.append(at)
        ends.append(own)
    table = spark.createDataFrame(list(enumerate(ends)), "__s_p int, __s_ends array<long>")
    where = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(at).cast("long").alias("start")) for _, k, at in cells])
    inner = Window.partitionBy("__s_p").orderBy("__s_u", *ids)
    own = marked.withColumn("__s_p", F.pmod("__s_u", F.lit(sources)).cast("int")).withColumn("__s_r", F.row_number().over(inner) - 1)
    # The rank's cell: how many cells end at or before it. 64 to 2,048 rows of at most 2,048 numbers.
    sent = own.join(F.broadcast(table), "__s_p").withColumn("__s_c", F.size(F.filter("__s_ends", lambda e: e <= F.col("__s_r"))))
    again = Window.partitionBy("__s_c").orderBy(F.xxhash64(F.lit(p.seed + 1), "__s_u"), *ids)
    put = sent.withColumn("__s_q", F.row_number().over(again) - 1).withColumn("__s_w", F.element_at(where, F.col("__s_c") + 1))
    out = put.withColumn("shard", F.col("__s_w.shard").cast("int")).withColumn("slot", F.col("__s_w.start") + F.col("__s_q"))
    return out.drop(*[c for c in out.columns if c.startswith("__s_")])
