"""Channels in parts: windows run within a part, and only the rows about the parts' ends are brought together.

A part is what shares a value of ``chunk``, any number that grows with
row_idx; a task sorts parts, never a whole channel.  A part gives its sums and
its first and last rows; the rows that look over an end are evaluated again
among those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHANNEL_KEY

PART_KEY = (*CHANNEL_KEY, "chunk")
#: Row numbers of a part where the source doesn't name parts: 2**17.
BITS = 17

MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def parted(samples: DataFrame) -> DataFrame:
    return samples if "chunk" in samples.columns else samples.withColumn("chunk", F.shiftright("row_idx", BITS))


def over(*keys: str, order: str = "row_idx") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"


def among(k: int, w: str) -> Column:
    """Whether so many rows (before if negative) lie on this side within the window."""
    return F.expr(f"{'lag' if k < 0 else 'lead'}(1, {abs(k)}) {w}").isNotNull()


def two_values(v: str = "v") -> dict[str, Callable[[], Column]]:
    """Columns of a part's rows that tell whether a channel has two values: least, greatest, and whether a row has neither."""
    whole = Window.partitionBy(*PART_KEY)
    low, high = F.min(v).over(whole), F.max(v).over(whole)
    return {"_low": low + 0.0, "_high": high + 0.0, "_other": ((F.col(v) != low) & (F.col(v) != high)).cast("int")}


def is_switch() -> Column:
    ends = F.array_distinct(F.concat(F.collect_set("_low"), F.collect_set("_high")))
    return (F.coalesce(F.max("_other"), F.lit(0)) == 0) & (F.size(ends) == 2)


def by_parts(samples: DataFrame, values: Callable[[str], dict[str, tuple[Column, Column]]], edge: Callable[[str], Column], merged: dict[str, tuple[str, Column]], by: str | None = None, carry: tuple[str, ...] = (), whole: dict[str, Column] | None = None, moments: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose merge over a channel is the channel's: keys, by, the merged columns, moments of columns (n_, mean_, var_, min_, max_), those of ``whole``.

    values: of a window, each column and when its neighbours are within the
    window.  merged: how a column's rows merge (sum, max, min) and the column
    of a row.  edge: of a window, the rows to keep for others.  ``whole`` are
    columns that don't look at neighbours and need no second evaluation.
    """
    w = over(*PART_KEY)
    base = parted(samples)
    for k, c in (whole or {}).items():
        base = base.withColumn(k, c)
    made = values(w)
    rows = base.withColumns({"_edge": edge(w), "_pos": F.expr(f"row_number() {w}")} | {f"_ok_{k}": ok for k, (_, ok) in made.items()} | {f"_at_{k}": c for k, (c, _) in made.items()})
    rows = rows.withColumns({k: F.when(F.col(f"_ok_{k}"), F.col(f"_at_{k}")) for k in made})
    keep = ("row_idx", "t", "v", *carry, *[f"_ok_{k}" for k in made])
    # an end's row is there twice: once in its part's sums, once as itself; no list, so the aggregate is one of hashes
    rows = rows.withColumn("_end", F.explode(F.when(F.col("_edge"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    mine, its = (lambda c: F.when(~F.col("_end"), c)), (lambda c: F.when(F.col("_end"), c))
    stats = [c for m in moments for c in (F.count(mine(F.col(m))).alias(f"n_{m}"), F.avg(mine(F.col(m))).alias(f"mean_{m}"), F.var_pop(mine(F.col(m))).alias(f"var_{m}"), F.min(mine(F.col(m))).alias(f"min_{m}"), F.max(mine(F.col(m))).alias(f"max_{m}"))]
    sums = [MERGE[how](mine(c)).alias(k) for k, (how, c) in merged.items()]
    fixed = [MERGE[how](mine(F.col(k))).alias(k) for k, how in (("_low", "min"), ("_high", "max"), ("_other", "max")) if whole and k in whole]
    groups = [its(F.col("_pos")).alias("_pos"), *([mine(F.col(by)).alias(by)] if by else [])]
    flat = rows.groupBy(*PART_KEY, "_end", *groups).agg(*sums, *stats, *fixed, *[F.max(its(F.col(k))).alias(k) for k in keep])
    flat = flat.withColumns({f"_part_{k}": F.col(k) for k in [*merged, *[c for m in moments for c in (f"n_{m}", f"mean_{m}", f"var_{m}", f"min_{m}", f"max_{m}")]]})
    again = values(over(*CHANNEL_KEY, "_end", order="chunk, _pos"))
    flat = flat.withColumns({f"_at_{k}": c for k, (c, _) in again.items()})
    # only what was not ready within its part counts at the edges
    flat = flat.withColumns({k: F.when(F.col("_end") & ~F.col(f"_ok_{k}"), F.col(f"_at_{k}")) for k in made if k != by} | ({f"_by_{by}": F.when(F.col("_end"), F.when(~F.col(f"_ok_{by}"), F.col(f"_at_{by}"))).otherwise(F.col(by))} if by else {}))
    if by:
        flat = flat.withColumn(by, F.col(f"_by_{by}"))
    one = {k: F.when(F.col("_end"), c if _neighbours(k, merged) else F.lit(None)).otherwise(F.col(f"_part_{k}")) for k, (_, c) in merged.items()}
    for m in moments:
        x = F.col(m)
        at = {"n": x.isNotNull().cast("bigint"), "mean": x, "var": F.when(x.isNotNull(), 0.0), "min": x, "max": x} if m in made else dict.fromkeys(("n", "mean", "var", "min", "max"), F.lit(None))
        one |= {f"{n}_{m}": F.when(F.col("_end"), c).otherwise(F.col(f"_part_{n}_{m}")) for n, c in at.items()}
    ends = [F.when(~F.col("_end"), F.col(k)).alias(k) for k in ("_low", "_high", "_other") if whole and k in whole]
    return flat.select(*CHANNEL_KEY, "_end", "row_idx", "v", *carry, *([by] if by else []), *[c.alias(k) for k, c in one.items()], *ends)


def _neighbours(name: str, merged: dict) -> bool:
    """Columns whose name ends in _ are of the row alone: merged within the parts only."""
    return not name.endswith("_")


def with_median(rows: DataFrame, keys: tuple[str, ...], x: str, weight: str, name: str) -> DataFrame:
    """Adds the two middle values of x by weight over the keys, on the rows that hold them: name_lo, name_hi; a task sorts values, it keeps no list."""
    counted = F.when(F.col(x).isNotNull(), F.coalesce(F.col(weight), F.lit(0))).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    rows = rows.withColumn("_w", counted).withColumns({"_upto": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(Window.partitionBy(*keys))})
    holds = lambda p: F.when((F.col("_upto") - F.col("_w") <= p) & (p < F.col("_upto")), F.col(x))
    return rows.withColumns({f"{name}_lo": holds(F.floor((F.col("_all") - 1) / 2)), f"{name}_hi": holds(F.floor(F.col("_all") / 2))}).drop("_w", "_upto", "_all")


def with_mean(rows: DataFrame, m: str) -> DataFrame:
    """Adds a channel's mean of a column of moments."""
    key = Window.partitionBy(*CHANNEL_KEY)
    return rows.withColumn(f"all_{m}", F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")).over(key) / F.nullif(F.sum(f"n_{m}").over(key), F.lit(0)))


def variance(m: str, sample: bool) -> Column:
    """The aggregate of moments: exactly 0 where all values are one; null where there are too few."""
    n = F.sum(f"n_{m}")
    squares = F.when(F.min(f"min_{m}") == F.max(f"max_{m}"), F.min(f"min_{m}") - F.min(f"min_{m}")).otherwise(F.sum(F.col(f"n_{m}") * (F.col(f"var_{m}") + (F.col(f"mean_{m}") - F.col(f"all_{m}")) ** 2)))
    return F.when(n > (1 if sample else 0), squares / (n - (1 if sample else 0)))
