"""Ordered work inside keys of any size.

A window over `partitionBy(key)` puts a whole key into one task. That is fine until one series
holds a large part of the data. `Ordered` first counts rows per key (one narrow, map-side
combined pass). Keys below the limit stay whole. The rows of larger keys are range partitioned
by (key, order), which gives chunks of about equal row counts however the times are spread, and
the chunk number is pinned by a checkpoint. Every operation then runs a window per (key, chunk)
and adds what has to be carried over from earlier chunks, which is a table of one row per chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.plans.durable import pinned

# Largest number of rows of one key that a single task is asked to order.
MAX_ROWS = 4_000_000

# Rows a task is asked to sort by key; more rows make more tasks.
TASK_ROWS = 200_000

_CHUNK = "_chunk"


def _shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks to sort so many rows by key: the session's number when one task could hold them all, else another one.

    AQE merges partitions of the session's number by their compressed size, so that a task would get many more rows than it can hold.
    """
    each, usual = int(df.sparkSession.conf.get("chronotag.taskRows", str(TASK_ROWS))), _shuffle_tasks(df)
    many = max(usual, -(-rows // each))
    return many + 1 if rows > each and many == usual else many


def max_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("chronotag.maxRowsPerKey", str(MAX_ROWS)))


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than `limit` rows: at most rows/limit of them, so safe to broadcast."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)


class Ordered:
    """Rows of `df` in `order` inside each of `keys`.

    Operations return a new Ordered with extra columns; `done()` gives the DataFrame. `order`
    must be a total order inside a key (end it with an id when times can repeat). Rows per key
    are counted in `counted`, by default `df` itself; give it a cheaper table with at least as
    many rows per key when `df` takes work to compute.
    """

    def __init__(self, df: DataFrame, keys, order, limit: int | None = None, counted: DataFrame | None = None):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)
        self.split = False
        limit = limit or max_rows(df)
        counted = df if counted is None else counted
        hot = hot_keys(counted, self.keys, limit)
        facts = counted.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > limit, F.col("_n"))).alias("hot")).first()
        total = facts["hot"]
        self.tasks, self.loose = tasks_for(df, facts["rows"] or 0), False
        if total:
            self.split = True
            hot = F.broadcast(pinned(hot.select(*[F.col(k).alias(f"_h_{k}") for k in self.keys])))
            on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in self.keys])
            cold = df.join(hot, on, "left_anti").withColumn(_CHUNK, F.lit(0))
            parts = -(-total // limit) * 2
            warm = pinned(df.join(hot, on, "left_semi")
                          .repartitionByRange(parts, *self.keys, *self.order)
                          .withColumn(_CHUNK, F.spark_partition_id() + 1))
            df = cold.unionByName(warm)
        elif self.tasks > _shuffle_tasks(df):
            # the session's number of partitions would make tasks that grow with the table
            df = df.repartition(self.tasks, *self.keys)
        self.df = df

    @staticmethod
    def whole(df: DataFrame, keys, order) -> "Ordered":
        """For rows known to be few per key: no counting, no chunks."""
        out = object.__new__(Ordered)
        out.keys = [keys] if isinstance(keys, str) else list(keys)
        out.order = [order] if isinstance(order, str) else list(order)
        out.split, out.df, out.tasks, out.loose = False, df, _shuffle_tasks(df), False
        return out

    def like(self, df: DataFrame, keys, order) -> "Ordered":
        """Order a table derived from this one: whole keys when this one's keys were whole."""
        return Ordered(df, keys, order) if self.split else Ordered.whole(df, keys, order)

    # -- plumbing --

    def _next(self, df: DataFrame) -> "Ordered":
        out = object.__new__(Ordered)
        out.keys, out.order, out.split, out.df, out.tasks, out.loose = self.keys, self.order, self.split, df, self.tasks, self.loose
        return out

    def from_python(self, df: DataFrame) -> "Ordered":
        """Rows that came back from Python, which Spark does not know to be by key any more."""
        out = self._next(df)
        out.loose = True
        return out

    def _placed(self) -> "Ordered":
        """This table by key, in as many tasks as its rows ask for."""
        if not self.loose:
            return self
        many = not self.split and self.tasks != _shuffle_tasks(self.df)
        out = self._next(self.df.repartition(self.tasks, *self.keys) if many else self.df)
        out.loose = False
        return out

    def _parts(self) -> list[str]:
        return self.keys + ([_CHUNK] if self.split else [])

    def window(self, descending: bool = False):
        """The window inside one chunk (the whole key when nothing is split)."""
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self._parts()).orderBy(*order)

    def _chunks(self, descending: bool):
        return Window.partitionBy(*self.keys).orderBy(F.col(_CHUNK).desc() if descending else F.col(_CHUNK))

    def _join(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        # One row per chunk, so it is broadcast. It is pinned because it is computed from the very
        # rows it is joined to: unpinned, every further operation would double the plan.
        carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in self._parts()],
                             *[c for c in carry.columns if c not in self._parts()])
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self._parts()]
        return df.join(F.broadcast(pinned(carry)), on, "left").drop(*[f"_k_{k}" for k in self._parts()])

    def select(self, *cols) -> "Ordered":
        named = {c for c in cols if isinstance(c, str)}
        keep = [c for c in self._parts() if c not in named]
        return self._next(self.df.select(*keep, *cols))

    def with_columns(self, **cols: Column) -> "Ordered":
        return self._next(self.df.withColumns(cols))

    def where(self, cond) -> "Ordered":
        """Drop rows; the rest keep their chunks."""
        return self._next(self.df.where(cond))

    def drop(self, *cols) -> "Ordered":
        return self._next(self.df.drop(*cols))

    def pinned(self) -> "Ordered":
        """The same rows, computed once and kept in the checkpoint folder."""
        return self._next(pinned(self.df))

    def done(self) -> DataFrame:
        return self.df.drop(_CHUNK)

    # -- neighbours --

    def lag(self, n: int = 1, **outs: Column) -> "Ordered":
        return self._shift(n, False, outs)

    def lead(self, n: int = 1, **outs: Column) -> "Ordered":
        return self._shift(n, True, outs)

    def _tails(self, df: DataFrame, n: int, descending: bool, cols: list[str]) -> DataFrame:
        """Per chunk the n rows before it, nearest first, as `__carry`."""
        back = F.row_number().over(self.window(not descending))
        tail = (df.where(F.col(_CHUNK) > 0).withColumn("__back", back).where(F.col("__back") <= n)
                .groupBy(*self._parts())
                .agg(F.sort_array(F.collect_list(F.struct("__back", F.struct(*cols).alias("row")))).alias("__tail")))
        # every chunk holds at least one row, so n rows are found in the n chunks before
        earlier = self._chunks(descending).rowsBetween(-n, -1)
        carry = F.flatten(F.reverse(F.collect_list("__tail").over(earlier)))
        return tail.withColumn("__carry", F.transform(F.slice(carry, 1, n), lambda t: t["row"])).drop("__tail")

    def _shift(self, n: int, descending: bool, outs: dict) -> "Ordered":
        self = self._placed()
        w = self.window(descending)
        if not self.split:
            return self._next(self.df.withColumns({o: F.lag(c, n).over(w) for o, c in outs.items()}))
        kept = [f"__v_{o}" for o in outs]
        df = self.df.withColumns(dict(zip(kept, outs.values())))
        tails = self._tails(df, n, descending, kept)
        df = df.withColumns({"__rn": F.row_number().over(w), **{o: F.lag(f"__v_{o}", n).over(w) for o in outs}})
        df = self._join(df, tails)
        borrowed = F.get(F.col("__carry"), F.lit(n) - F.col("__rn"))
        df = df.withColumns({o: F.when(F.col("__rn") > n, F.col(o)).otherwise(borrowed[f"__v_{o}"]) for o in outs})
        return self._next(df.drop("__rn", "__carry", *kept))

    def last_rows(self, n: int, **outs) -> "Ordered":
        """Aggregates over the row and the n-1 rows before it, e.g. mean=F.avg('x')."""
        self = self._placed()
        frame = self.window().rowsBetween(-(n - 1), 0)
        if not self.split:
            return self._next(self.df.withColumns({o: c.over(frame) for o, c in outs.items()}))
        cols = [c for c in self.df.columns if c not in self._parts()]
        tails = self._tails(self.df, n - 1, False, cols)
        copies = tails.select(*self._parts(), F.explode("__carry").alias("r")).select(
            *self._parts(), *[F.col(f"r.`{c}`").alias(c) for c in cols], F.lit(False).alias("_own"))
        both = self.df.withColumn("_own", F.lit(True)).unionByName(pinned(copies))
        return self._next(both.withColumns({o: c.over(frame) for o, c in outs.items()}).where("_own").drop("_own"))

    def regroup(self, *extra: str) -> "Ordered":
        """Use more key columns; they must be constant over runs of neighbouring rows."""
        out = self._next(self.df)
        out.keys = self.keys + list(extra)
        return out

    # -- fills and running aggregates --

    def fill_forward(self, inclusive: bool = True, **outs: Column) -> "Ordered":
        """Last non-null value at or before the row (before it when not inclusive)."""
        return self._running(outs, F.last, F.last, lambda a, b: F.coalesce(b, a), inclusive, False)

    def fill_backward(self, inclusive: bool = True, **outs: Column) -> "Ordered":
        """First non-null value at or after the row."""
        return self._running(outs, F.last, F.last, lambda a, b: F.coalesce(b, a), inclusive, True)

    def running_sum(self, inclusive: bool = True, **outs: Column) -> "Ordered":
        def plus(a, b):
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        return self._running(outs, F.sum, F.sum, plus, inclusive, False)

    def running_max(self, inclusive: bool = True, **outs: Column) -> "Ordered":
        return self._running(outs, F.max, F.max, F.greatest, inclusive, False)

    def running_min(self, inclusive: bool = True, **outs: Column) -> "Ordered":
        return self._running(outs, F.min, F.min, F.least, inclusive, False)

    def row_number(self, out: str) -> "Ordered":
        return self.running_sum(**{out: F.lit(1).cast("bigint")})

    def _running(self, outs, inner, outer, combine, inclusive, descending) -> "Ordered":
        self = self._placed()
        frame = self.window(descending).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

        def call(fn, col):
            return fn(col, ignorenulls=True) if fn is F.last else fn(col)

        if not self.split:
            return self._next(self.df.withColumns({o: call(inner, c).over(frame) for o, c in outs.items()}))
        df = self.df.withColumns({f"__v_{o}": c for o, c in outs.items()})
        hot = df.where(F.col(_CHUNK) > 0)
        if inner is F.last:
            # a plain last() has no order in a group, so the chunk's newest non-null row is taken
            # (nulls are skipped because max_by ignores a null ordering)
            pick = F.min_by if descending else F.max_by
            totals = hot.groupBy(*self._parts()).agg(*[
                pick(F.col(f"__v_{o}"), F.when(F.col(f"__v_{o}").isNotNull(), F.struct(*self.order))).alias(f"__t_{o}")
                for o in outs])
        else:
            totals = hot.groupBy(*self._parts()).agg(*[inner(f"__v_{o}").alias(f"__t_{o}") for o in outs])
        earlier = self._chunks(descending).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumns({f"__t_{o}": call(outer, F.col(f"__t_{o}")).over(earlier) for o in outs})
        df = df.withColumns({o: call(inner, F.col(f"__v_{o}")).over(frame) for o in outs})
        df = self._join(df, carry)
        df = df.withColumns({o: combine(F.col(f"__t_{o}"), F.col(o)) for o in outs})
        return self._next(df.drop(*[f"__v_{o}" for o in outs], *[f"__t_{o}" for o in outs]))

