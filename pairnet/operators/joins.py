"""Join helpers.

A broadcast hint is given only to a side whose size has been checked: a
table that has been materialised in the shared folder and counted. Above
the limit the join stays a shuffle join (sort-merge, with AQE's skew
split). Global scalars (a mean, a maximum) are not joined at all: the
one-row aggregate runs once and its values enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairnet.session import checkpoint

#: Rows a lookup table may have to be broadcast (override with the session
#: conf ``pairnet.broadcast.maxRows``). Two short strings per row: about
#: 100 MB of hashed relation at the limit.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
#: Bytes of its files, however few its rows are.
MAX_BROADCAST_BYTES = 128 << 20


def max_broadcast_rows(df: DataFrame) -> int:
    try:
        v = df.sparkSession.conf.get("pairnet.broadcast.maxRows")
    except Exception:  # noqa: BLE001 - unset key
        v = None
    return int(v) if v else DEFAULT_MAX_BROADCAST_ROWS


def materialised(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` written once (it is usually read more than once), and whether it
    is small enough to be broadcast: at most ``max_rows`` rows, counted."""
    limit = max_rows if max_rows is not None else max_broadcast_rows(df)
    m = checkpoint(df)
    # The written files' size by the plan's statistics, next to the row count.
    size = int(str(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return m, size <= MAX_BROADCAST_BYTES and m.count() <= limit


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Materialise ``df`` once, count it, and hint a broadcast only if it has
    at most ``max_rows`` rows."""
    m, small = materialised(df, max_rows)
    return F.broadcast(m) if small else m


#: Hubs that ``hub_keys`` looks for at most, and the keys its sketch counts.
HUBS, TRACKED = 256, 10_000


def hub_keys(df: DataFrame, keys: list[str]) -> list:
    """Values of the columns ``keys`` (one domain) that hold more than half
    of a shuffle partition's fair share of the rows each, by one counted
    sketch (bounded; a miss or a value too many changes a plan, no result)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = df.select(F.explode(F.array(*[F.col(k) for k in keys])).alias("key")).where(F.col("key").isNotNull()) \
        .agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", F.col("key"), F.lit(HUBS), F.lit(TRACKED)).alias("top")).first()
    return [t["item"] for t in one["top"] or [] if 2 * parts * t["count"] > one["n"]]


def split_lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, hubs: list) -> DataFrame:
    """Inner join of ``df`` with a lookup table too large to broadcast: rows
    with a hub as their key meet the hubs' rows of the table, broadcast if
    these are few when counted; only the others are shuffled. ``df`` is read
    twice, so it should be a written table."""
    cond = F.col(key) == F.col(table_key)
    if not hubs:
        return df.join(table, cond, "inner")
    is_hub = F.col(key).isin(hubs)
    own = checked_broadcast(table.where(F.col(table_key).isin(hubs)))
    return df.where(is_hub).join(own, cond, "inner").unionByName(df.where(~is_hub).join(table, cond, "inner"))


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The values of a global aggregate (exactly one row) as typed literals.

    The aggregate runs once (partial aggregates on the executors, one row to
    the driver); the main plan then holds constants: no join, no shuffle of
    the big side, and arithmetic on them is folded at planning time. (A
    scalar subquery referenced many times inside one expression is planned
    once per reference.)"""
    row = one_row.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema.fields}
