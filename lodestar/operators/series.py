"""Ordered-series operators with a window form: rates, change detection, de-flapping, quotas, decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import accepted, clamped, finite, running, window


def rolling_extremes(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Smallest and largest of the last ``n`` finite values; a value that is not finite takes no place."""
    ok = df.where(finite(F.col(value)))
    w = window(by, order).rowsBetween(1 - n, 0)
    return ok.withColumn("rolling_min", F.min(value).over(w)).withColumn("rolling_max", F.max(value).over(w))


def counter_rate(df: DataFrame, by: list[str], arrival: list[str], at_ns: str, total: str, width: int = 64) -> DataFrame:
    """Increase and rate a second of a counter of ``width`` bits, between accepted readings.

    A fall is a wrap where the implied increase is at most half the range, else a reset,
    whose increase is null. Width 64 never wraps. Totals beyond the width are dropped.
    """
    size = F.lit(str(2**width)).cast("decimal(20,0)")
    t = F.col(total).cast("decimal(20,0)")
    ok = df.where(t.isNotNull() & (t >= 0) & (t < size))
    last = F.max(at_ns).over(window(by, arrival).rowsBetween(Window.unboundedPreceding, -1))
    ok = ok.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(at_ns) > F.col("__last"))).drop("__last")
    w = window(by, arrival)
    d = (t - F.lag(t).over(w)).cast("decimal(38,0)")
    wrapped = d + size.cast("decimal(38,0)")
    step = F.when(d >= 0, d)
    if width < 64:
        step = step.when(wrapped <= F.lit(str(2 ** (width - 1))).cast("decimal(38,0)"), wrapped)
    ok = ok.withColumn("increase", step).withColumn("gap_ns", F.col(at_ns) - F.lag(at_ns).over(w))
    return ok.withColumn("rate", F.col("increase").cast("double") / (F.col("gap_ns") / 1e9))


def peak(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str) -> DataFrame:
    """Largest value and when it was first reached."""
    ok = df.where(finite(F.col(value)))
    key = F.struct(-F.col(value), *[F.col(c) for c in arrival])
    return ok.groupBy(*by).agg(F.max(value).alias("peak"), F.min_by(at, key).alias("peak_at"))


def intervals(df: DataFrame, by: list[str], arrival: list[str], at_ns: str) -> DataFrame:
    """Gaps between readings that move time forward: count, last, smallest, largest and truncated mean."""
    last = F.max(at_ns).over(window(by, arrival).rowsBetween(Window.unboundedPreceding, -1))
    ok = df.where(F.col(at_ns).isNotNull()).withColumn("__last", last).where(F.col("__last").isNull() | (F.col(at_ns) > F.col("__last")))
    gap = F.col(at_ns) - F.col("__last")
    rows = ok.withColumn("__gap", gap)
    total = F.sum(F.col("__gap").cast("decimal(38,0)"))
    order = F.struct(*[F.col(c) for c in arrival])
    return rows.groupBy(*by).agg(F.count("__gap").alias("gaps"), F.max_by("__gap", order).alias("last_gap"), F.min("__gap").alias("min_gap"), F.max("__gap").alias("max_gap"), F.floor(total / F.nullif(F.count("__gap"), F.lit(0))).cast("long").alias("mean_gap"))


def two_sided(up: Column, down: Column, limit: float) -> Column:
    """``up``, ``down`` or ``none``: the larger excess over ``limit`` wins, ties go up."""
    return F.when((up > limit) & (up >= down), "up").when(down > limit, "down").otherwise("none")


def cusum(df: DataFrame, by: list[str], order: list[str], value: str, target: float, slack: float, limit: float) -> DataFrame:
    """Two-sided cumulative sums: s_up, s_down, signal, and rows since the signalling sum was last zero."""
    ok = df.where(finite(F.col(value)))
    r = running(by, order)
    i = F.row_number().over(window(by, order))
    ok = ok.withColumn("__i", i).withColumn("__u", F.sum(F.col(value) - target - slack).over(r)).withColumn("__d", F.sum(target - slack - F.col(value)).over(r))
    ok = ok.withColumn("s_up", F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(r))).withColumn("s_down", F.col("__d") - F.least(F.lit(0.0), F.min("__d").over(r)))
    ok = ok.withColumn("signal", two_sided(F.col("s_up"), F.col("s_down"), limit))
    for side in ("up", "down"):
        zero = F.max(F.when(F.col(f"s_{side}") == 0, F.col("__i"))).over(r)
        ok = ok.withColumn(f"__z{side}", F.col("__i") - F.coalesce(zero, F.lit(0)))
    since = F.when(F.col("s_up") >= F.col("s_down"), F.col("__zup")).otherwise(F.col("__zdown"))
    return ok.withColumn("since", since.cast("long")).drop("__i", "__u", "__d", "__zup", "__zdown")


def page_hinkley(df: DataFrame, by: list[str], order: list[str], value: str, delta: float, limit: float) -> DataFrame:
    """Excess of the summed distance from the running mean over its extreme, both ways."""
    ok = df.where(finite(F.col(value)))
    r = running(by, order)
    ok = ok.withColumn("__m", F.avg(value).over(r))
    ok = ok.withColumn("__u", F.sum(F.col(value) - F.col("__m") - delta).over(r)).withColumn("__d", F.sum(F.col(value) - F.col("__m") + delta).over(r))
    ok = ok.withColumn("up", F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(r))).withColumn("down", F.greatest(F.lit(0.0), F.max("__d").over(r)) - F.col("__d"))
    return ok.withColumn("signal", two_sided(F.col("up"), F.col("down"), limit)).drop("__m", "__u", "__d")


def _latched(value: str, on: float, off: float, by: list[str], order: list[str], low: bool = False) -> Column:
    x = F.col(value)
    decided = F.when((x <= on) if low else (x >= on), 1).when((x >= off) if low else (x <= off), 0)
    return F.coalesce(F.last(decided, ignorenulls=True).over(running(by, order)), F.lit(0))


def hysteresis(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str, on: float, off: float, low: bool = False) -> DataFrame:
    """On from ``on``, off from ``off``, unchanged between; with the number of changes so far."""
    ok = accepted(df, by, arrival, at, value).withColumn("active", _latched(value, on, off, by, arrival, low) == 1)
    change = (F.col("active") != F.coalesce(F.lag("active").over(window(by, arrival)), F.lit(False))).cast("long")
    return ok.withColumn("__c", change).withColumn("transitions", F.sum("__c").over(running(by, arrival))).drop("__c")


def band(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str, edges: list[tuple[float, float]]) -> DataFrame:
    """Level: how many (on, off) edges are on."""
    ok = accepted(df, by, arrival, at, value)
    total = sum((_latched(value, a, b, by, arrival) for a, b in edges), F.lit(0))
    return ok.withColumn("level", total)


def debounce(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str, condition: Column, on: tuple[int, int], off: tuple[int, int]) -> DataFrame:
    """Follows ``condition`` once it held for (time, readings); separate for on and off."""
    ok = accepted(df, by, arrival, at, value).withColumn("__c", condition)
    w, r = window(by, arrival), running(by, arrival)
    new = (F.col("__c") != F.coalesce(F.lag("__c").over(w), F.lit(False))).cast("int")
    ok = ok.withColumn("__new", new).withColumn("__run", F.sum("__new").over(r))
    inner = Window.partitionBy(*by, "__run").orderBy(*arrival)
    ok = ok.withColumn("__k", F.row_number().over(inner)).withColumn("__t", F.col(at) - F.first(at).over(inner))
    done = F.when(F.col("__c"), (F.col("__k") >= max(1, on[1])) & (F.col("__t") >= on[0])).otherwise((F.col("__k") >= max(1, off[1])) & (F.col("__t") >= off[0]))
    state = F.last(F.when(done, F.col("__c")), ignorenulls=True).over(r)
    return ok.withColumn("active", F.coalesce(state, F.lit(False))).drop("__c", "__new", "__run", "__k", "__t")


def n_of_m(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str, level: float, need: int, size: int, low: bool = False) -> DataFrame:
    """On while ``need`` or more of the last ``size`` readings reach ``level``."""
    ok = accepted(df, by, arrival, at, value)
    hit = ((F.col(value) <= level) if low else (F.col(value) >= level)).cast("int")
    return ok.withColumn("__h", hit).withColumn("active", F.sum("__h").over(window(by, arrival).rowsBetween(1 - size, 0)) >= need).drop("__h")


def quota(df: DataFrame, by: list[str], arrival: list[str], at: str, limit: int, length: int, origin: int = 0) -> DataFrame:
    """The first ``limit`` actions of each aligned window of ``length`` are allowed; late ones count at the latest time."""
    rows = df.withColumn("__t", clamped(by, arrival, at)).withColumn("window_index", F.floor((F.col("__t") - origin) / length).cast("long"))
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(*by, "window_index").orderBy(*arrival)) <= limit).drop("__t")


def backoff(df: DataFrame, failures: str, base: int, cap: int) -> DataFrame:
    """Ceiling of the wait after ``failures`` failures: base * 2**failures, at most ``cap``."""
    n = F.least(F.col(failures), F.lit(62))
    wide = F.lit(base).cast("decimal(38,0)") * F.pow(F.lit(2.0), n).cast("decimal(20,0)")
    return df.withColumn("wait", F.least(F.lit(cap).cast("decimal(38,0)"), wide).cast("long"))


def classical_decomposition(df: DataFrame, by: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """Centred moving average, phase means about 0, and what is left; the ends hold the nearest average."""
    w = window(by, order)
    h = period // 2
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    if period % 2:
        ma = F.avg(value).over(w.rowsBetween(-h, h))
    else:
        ma = (F.sum(value).over(w.rowsBetween(-h, h - 1)) + 0.5 * (F.lead(value, h).over(w) - F.lag(value, h).over(w))) / period
    rows = rows.withColumn("__ma", F.when((F.col("__i") >= h) & (F.col("__i") < F.col("__n") - h), ma))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("trend", F.coalesce("__ma", F.when(F.col("__i") < h, F.first("__ma", ignorenulls=True).over(whole)).otherwise(F.last("__ma", ignorenulls=True).over(whole))))
    rows = rows.withColumn("__p", F.col("__i") % period).withColumn("__x", F.when(F.col("__ma").isNotNull(), F.col(value) - F.col("__ma")))
    phase = rows.groupBy(*by, "__p").agg(F.avg("__x").alias("__s"))
    phase = phase.withColumn("seasonal", F.col("__s") - F.avg("__s").over(Window.partitionBy(*by))).drop("__s")
    out = rows.join(phase, [*by, "__p"])
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("__i", "__n", "__ma", "__p", "__x")


def chain_faults(df: DataFrame, by: list[str], seq: str, domain: str, root: str = "") -> DataFrame:
    """The first broken link of each chain of (seq, prev, hash, body), if any: seq and fault.

    ``altered``: the hash is not that of prev and body. Else, if prev is not the hash
    before: ``reordered`` where another link of the chain has that hash, or ``replaced``.
    """
    rows = df.withColumn("__own", link_hash(F.col("prev"), F.col("body"), domain)).withColumn("__was", F.lag("hash", 1, root).over(window(by, [seq])))
    held = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("hash").alias("__h"), F.col(seq).alias("__s"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    bad = rows.where((F.col("hash") != F.col("__own")) | (F.col("prev") != F.col("__was")))
    cond = (F.col("prev") == F.col("__h")) & (F.col(seq) != F.col("__s"))
    for c in on:
        cond &= c
    known = bad.join(held, cond, "left_semi").select(*by, seq).withColumn("__known", F.lit(True))
    marked = bad.join(known, [*by, seq], "left")
    fault = F.when(F.col("hash") != F.col("__own"), "altered").when(F.col("__known"), "reordered").otherwise("replaced")
    return marked.withColumn("fault", fault).groupBy(*by).agg(F.min(seq).alias(seq), F.min_by("fault", seq).alias("fault"))


def link_hash(prev: Column, body: Column, domain: str) -> Column:
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(F.lit(domain).cast("binary"), prev.cast("binary"), zero, body.cast("binary")), 256)


def chain_seal(df: DataFrame, by: list[str], seq: str, body: str, domain: str, root: str = "") -> DataFrame:
    """(seq, prev, hash, body) of each chain, sealed in order. A chain is one fold: each hash needs the one before.

    Rows are sorted within the partition of their chain and streamed with one running
    hash, so the length of a chain is not held in memory. A null body has no hash, and
    the link after it starts from ``root``.
    """
    rows = df.select(*by, F.col(seq).cast("bigint").alias(seq), F.col(body).cast("binary").alias("body"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    head = domain.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, root
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(len(by))]
            keys = [tuple("NaN" if x != x else x for x in k) for k in zip(*cols, strict=True)] if by else [()] * batch.num_rows
            prevs, hashes = [], []
            for k, x in zip(keys, batch.column(len(by) + 1).to_pylist(), strict=True):
                if k != key:
                    key, last = k, root
                own = None if x is None else hashlib.sha256(b"%b%b\0%b" % (head, last.encode(), x)).hexdigest()
                prevs.append(last)
                hashes.append(own)
                last = root if own is None else own
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prevs, pa.string()), pa.array(hashes, pa.string()), batch.columns[-1]], [*batch.schema.names[:-1], "prev", "hash", "body"])

    dealt = rows.repartition(*[F.col(c) for c in by]) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, seq, "body").mapInArrow(run, f"{kinds}, prev string, hash string, body binary")
