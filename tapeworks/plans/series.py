"""Ordered work on series of any length.

A window partitioned by the series key alone puts a whole series into one task,
which fails as soon as one symbol or run holds a large share of the rows.  The
helpers here cut every series into chunks of the ordering column, work inside
``(key, chunk)`` and carry a one-row summary per chunk to the chunks after it.
The only thing ordered by key alone is that table of chunk summaries.

The rows are shuffled once, by ``(key, chunk)``.  The summaries of plain numbering
and running aggregates come from a second, column-pruned pass that is combined
on the map side; an operator that needs several passes over the same columns
shares the one shuffle between them (:func:`chunked`, :func:`summarize`).

Ordering columns are integral and not null (bar start, step, position); where a
series is unique in its ordering column, a chunk of width ``w`` holds at most
``w`` rows, however long the series is.  A null key or ordering raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.workers import shared_folder

CHUNK = 65_536
UNBOUNDED = Window.unboundedPreceding


def with_chunk(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Add ``_chunk``.  A null key or ordering is an error, for a later join on the
    keys would lose its row.  The null filters are what that join would infer;
    stated here they are the same in every plan over the rows, which lets Spark
    reuse whatever shuffle lies below."""
    types = dict(df.withColumn("_chunk", chunk).dtypes)

    def given(value: Column, name: str) -> Column:
        missing = F.raise_error(F.lit(f"null in {name}: a series needs keys and an ordering")).cast(types[name])
        return F.when(value.isNull(), missing).otherwise(value)

    rows = df.withColumns({**{k: given(F.col(k), k) for k in keys}, "_chunk": given(chunk, "_chunk")})
    for c in [*keys, "_chunk"]:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def chunked(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows with ``_chunk``, shuffled by ``(key, _chunk)``."""
    return with_chunk(df, keys, chunk).repartition(*[F.col(k) for k in keys], F.col("_chunk"))


def summarize(rows: DataFrame, part: list[str], aggregates: list[Column], columns: list[str]) -> DataFrame:
    """One row per ``part`` of a :func:`chunked` table holding just ``columns``.

    Its plan also reads all of ``columns`` (a cheap hash, kept by :func:`attach`),
    so that column pruning leaves the shuffle below it identical to the one that
    feeds the rows themselves, and Spark runs that shuffle once for both.
    """
    return rows.groupBy(part).agg(*aggregates, F.bit_xor(F.xxhash64(*columns)).alias("_touch"))


def attach(rows: DataFrame, summary: DataFrame, part: list[str]) -> DataFrame:
    """Join a summary back to its rows on the partitioning both already have."""
    return rows.join(summary, part).where(F.col("_touch").isNotNull()).drop("_touch")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: str | list[Column],
    width: int = CHUNK,
    name: str = "rn",
    total: str | None = None,
    chunk: Column | None = None,
    scalars: dict[str, Column] | None = None,
) -> DataFrame:
    """1-based position of each row in its series, and optionally the series length.

    ``chunk`` replaces ``order div width`` where the ordering is not one integral
    column; it has to be monotone in the ordering.  ``scalars`` are scalar
    subqueries to add as columns; they are evaluated on the small table of chunk
    offsets, so that expressions over them do not repeat the subquery.
    """
    part = [*keys, "_chunk"]
    sort = [F.col(order)] if isinstance(order, str) else order
    rows = with_chunk(df, keys, floor_div(F.col(order), width) if chunk is None else chunk)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(keys).orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
    carried = [F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")]
    if total:
        carried.append(F.sum("_size").over(Window.partitionBy(keys)).alias(total))
    carried += [c.alias(n) for n, c in (scalars or {}).items()]
    local = F.row_number().over(Window.partitionBy(part).orderBy(*sort))
    return (
        rows.withColumn("_local", local)
        .join(sizes.select(*part, *carried), part)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_local", "_before")
    )


@dataclass(frozen=True)
class Fold:
    """A running aggregate: kind is sum, count, max, min, last or product.

    ``last`` skips nulls.  With ``inclusive=False`` the current row is left out;
    with ``reverse=True`` the series is read from its end.
    """

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


_PLAIN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "product": F.product}


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "product":
        return F.coalesce(local, F.lit(1.0)) * F.coalesce(carry, F.lit(1.0))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def running(
    df: DataFrame, keys: list[str], order: str, folds: dict[str, Fold], width: int = CHUNK
) -> DataFrame:
    """Add one running aggregate per entry of ``folds``, in order of ``order``.

    Forward and reverse folds share the shuffle and the table of chunk summaries.
    """
    part = [*keys, "_chunk"]
    values = [f.value.alias(f"_v_{n}") for n, f in folds.items()]
    rows = with_chunk(df, keys, floor_div(F.col(order), width)).select("*", *values)

    def total(name: str, fold: Fold) -> Column:
        v = F.col(f"_v_{name}")
        if fold.kind == "last":
            pick = F.min_by if fold.reverse else F.max_by
            return pick(v, F.when(v.isNotNull(), F.col(order)))
        return _PLAIN[fold.kind](v)

    totals = rows.groupBy(part).agg(*[total(n, f).alias(f"_t_{n}") for n, f in folds.items()])

    def sort(column: str, fold: Fold) -> Column:
        return F.col(column).desc() if fold.reverse else F.col(column).asc()

    def carry(name: str, fold: Fold) -> Column:
        earlier = Window.partitionBy(keys).orderBy(sort("_chunk", fold)).rowsBetween(UNBOUNDED, -1)
        t = F.col(f"_t_{name}")
        if fold.kind == "last":
            return F.last(t, True).over(earlier)
        return (F.sum if fold.kind == "count" else _PLAIN[fold.kind])(t).over(earlier)

    carried = totals.select(*part, *[carry(n, f).alias(f"_c_{n}") for n, f in folds.items()])

    def local(name: str, fold: Fold) -> Column:
        inside = Window.partitionBy(part).orderBy(sort(order, fold))
        v = F.col(f"_v_{name}")
        frame = inside.rowsBetween(UNBOUNDED, 0 if fold.inclusive else -1)
        return (F.last(v, True) if fold.kind == "last" else _PLAIN[fold.kind](v)).over(frame)

    scanned = rows.select("*", *[local(n, f).alias(f"_l_{n}") for n, f in folds.items()])
    merged = [
        _merge(f.kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, f in folds.items()
    ]
    kept = [c for c in df.columns if c not in folds]
    return scanned.join(carried, part).select(*kept, *merged)


def with_halo(df: DataFrame, position: str, size: int, halo: int) -> DataFrame:
    """Blocks of ``size`` positions, each preceded by copies of the last ``halo`` before it.

    Adds ``_block`` and ``_halo``; work on ``(key, _block)`` and keep the rows
    where ``_halo`` is false.  A rolling frame of up to ``halo + 1`` positions
    is then complete for every kept row.
    """
    if halo > size:
        raise ValueError("the halo must not exceed the block size")
    own = floor_div(F.col(position), size)
    late = F.pmod(F.col(position), F.lit(size)) >= size - halo
    blocks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_halo", F.col("_block") != own)


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    salt_on: list[str],
    rank: str | None = None,
    salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows per key in a total order.

    The rows of a key are first cut to ``k`` within each of ``salts`` shares, so
    the last step sees at most ``salts * k`` rows of any key.  There are as many shares
    as shuffle partitions, at least 32, if not given.
    """
    salts = salts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name = rank or "_rank"
    shares = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = shares.withColumn(name, F.row_number().over(first)).where(F.col(name) <= k)
    last = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    best = cut.drop(name, "_salt").withColumn(name, F.row_number().over(last))
    best = best.where(F.col(name) <= k)
    return best if rank else best.drop(name)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a long plan with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, or else the warehouse.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
