"""Long series cut into blocks: moving frames, recursions, running extremes and run lengths without a task that holds a whole key.

numbered() gives each row its place in its key's series and a block of SIZE
places. haloed() lends each block the rows before it that a frame reaches back
to, so that plain window functions over (key, block) are right for the block's
own rows. What comes from further back - a recursion's value, an extreme, a
run - reaches a block through one summary row of each block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.cuts import cut

#: Rows of a block. (1 / 2) ** SIZE and its inverse are doubles of full precision, which recursive() needs.
SIZE = 500
#: Summaries that one step of carried() goes through.
TURN = 500


def time_block(df: DataFrame, order: str) -> Column:
    """A coarse part of the order column, to number rows by: about three years of dates, a day of timestamps, 4096 of a number."""
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / 1024)
    return F.floor(F.unix_timestamp(order) / 86400) if kind.startswith("timestamp") else F.floor(F.col(order) / 4096)


def numbered(df: DataFrame, key: str = "symbol", order: str = "date", block: Column | None = None) -> DataFrame:
    """Adds __i, the row's place in its key's series from 0, and __p, its block.

    Rows are ranked inside time blocks, whose counts give the offsets; the
    order must tell a key's rows apart. Null keys are one key; null orders come
    first. Rows that have their places already keep them.
    """
    if "__i" in df.columns:
        return df
    df = cut(df, "series").withColumn("__t", block if block is not None else time_block(df, order))
    counts = df.groupBy(key, "__t").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("__key"), F.col("__t").alias("__u"), F.coalesce(before, F.lit(0)).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(key, "__t").orderBy(order)) - 1
    out = df.withColumn("__i", rank.cast("bigint")).join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__t").eqNullSafe(F.col("__u")))
    out = out.withColumn("__i", F.col("__i") + F.col("__n"))
    return out.withColumn("__p", F.floor(F.col("__i") / SIZE)).drop("__t", "__key", "__u", "__n")


def haloed(df: DataFrame, back: int) -> DataFrame:
    """numbered() rows with copies of each block's last `back` places in the blocks after it that reach them; __own tells the block's own rows."""
    last = F.floor((F.col("__i") + back) / SIZE)
    blocks = F.sequence(F.col("__p"), last)
    return df.withColumn("__q", F.explode(blocks)).withColumns({"__own": F.col("__q") == F.col("__p"), "__p": F.col("__q")}).drop("__q")


def own(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own")


def plain(df: DataFrame) -> DataFrame:
    """Without the helper columns."""
    return df.drop("__i", "__p")


def window(key: str = "symbol"):
    return Window.partitionBy(key, "__p").orderBy("__i")


def carried(summary: DataFrame, key: str, turn: int | None = TURN) -> DataFrame:
    """(key, __p, __v): what comes into each block, for summaries (key, __p, a, c) whose blocks map v to a v + c, arrays by place; zeros come into the first.

    Maps compose: TURN summaries become one of a coarser block, what comes into
    these is found first, and each turn is gone through from there. A key's
    coarser blocks, one for TURN * SIZE of its rows, are one task's.
    """
    step = lambda v, x: F.zip_with(F.zip_with(x["a"], v, lambda a, u: a * u), x["c"], lambda u, c: u + c)
    of = F.floor(F.col("__p") / turn) if turn else F.lit(0).cast("bigint")
    turns = summary.groupBy(key, of.alias("__turn")).agg(F.array_sort(F.collect_list(F.struct("__p", "a", "c"))).alias("all"))
    first = F.transform(F.col("all")[0]["a"], lambda a: a * 0)
    if turn:
        ones = F.transform(F.col("all")[0]["a"], lambda a: a * 0 + 1)
        scale = F.aggregate("all", ones, lambda v, x: F.zip_with(x["a"], v, lambda a, u: a * u))
        coarse = turns.select(key, F.col("__turn").alias("__p"), scale.alias("a"), F.aggregate("all", first, step).alias("c"))
        into = carried(coarse, key, None).select(F.col(key).alias("__key"), F.col("__p").alias("__into"), "__v")
        turns = turns.join(into, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__turn") == F.col("__into")))
        first = F.col("__v")
    start = F.struct(first.alias("v"), F.array().cast("array<struct<__p:bigint,__v:array<double>>>").alias("out"))
    gone = F.aggregate(
        "all",
        start,
        lambda s, x: F.struct(step(s["v"], x).alias("v"), F.concat(s["out"], F.array(F.struct(x["__p"].alias("__p"), s["v"].alias("__v")))).alias("out")),
        lambda s: s["out"],
    )
    return turns.select(key, F.explode(gone).alias("x")).select(key, "x.__p", "x.__v")


def _with_carried(df: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    into = carried(summary, key).select(F.col(key).alias("__key"), F.col("__p").alias("__into"), "__v")
    return df.join(into, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__into"))).drop("__key", "__into")


def recursive(df: DataFrame, sources: dict[str, tuple[str, int]], key: str = "symbol") -> DataFrame:
    """Wilder smoothing of columns of numbered() rows, new name to (source, n): the mean of the first n values that are not null, then v + (x - v) / n; a null keeps v.

    Each row maps v to a v + b, so a block's rows are a weighted running sum and
    its whole effect is one map; carried() composes these. Each source is null
    until it has n values.
    """
    w = window(key)
    upto, names = w.rowsBetween(Window.unboundedPreceding, 0), list(sources)
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    df = cut(df, "blocks")
    # first the number of values before each block, and the mean of the first n of all
    df = df.withColumns({f"__c{j}": F.count(F.when(there(c), 1)).over(upto) for j, (c, _) in enumerate(sources.values())})
    each = df.groupBy(key, "__p").agg(*[F.count(F.when(there(c), 1)).alias(f"__n{j}") for j, (c, _) in enumerate(sources.values())])
    past = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col(key).alias("__key"), F.col("__p").alias("__into"), *[F.coalesce(F.sum(f"__n{j}").over(past), F.lit(0)).alias(f"__n{j}") for j in range(len(names))])
    df = df.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__into"))).drop("__key", "__into")
    df = df.withColumns({f"__c{j}": F.col(f"__c{j}") + F.col(f"__n{j}") for j in range(len(names))}).drop(*[f"__n{j}" for j in range(len(names))])
    seeds = [F.sum(F.when(there(c) & (F.col(f"__c{j}") <= n), F.col(c)) / n).alias(f"__s{j}") for j, (c, n) in enumerate(sources.values())]
    most = max((n for _, n in sources.values()), default=0)
    few = df.where(F.least(*[F.col(f"__c{j}") for j in range(len(names))], F.lit(most)) <= most) if names else df
    seeds = few.groupBy(key).agg(*seeds).withColumnRenamed(key, "__key")
    df = df.join(seeds, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    # then each row's part: the mean at the n-th value, x / n after it; weighted by the decay since the block's first row
    made, sums = {}, {}
    for j, (c, n) in enumerate(sources.values()):
        after = there(c) & (F.col(f"__c{j}") > n)
        made[f"__m{j}"] = F.count(F.when(after, 1)).over(upto)
    df = df.withColumns(made)
    for j, (c, n) in enumerate(sources.values()):
        a, k = 1 - 1 / n, F.col(f"__m{j}")
        at = there(c) & (F.col(f"__c{j}") == n)
        part = F.when(at, F.col(f"__s{j}")).when(there(c) & (F.col(f"__c{j}") > n), F.col(c) / n / F.pow(F.lit(a), k) if n > 1 else F.lit(0.0)).otherwise(0.0)
        sums[f"__b{j}"] = F.sum(part).over(upto)
    df = df.withColumns(sums)
    ends = F.max_by(F.struct(*[F.struct(F.pow(F.lit(1 - 1 / n), F.col(f"__m{j}")).alias("a"), (F.pow(F.lit(1 - 1 / n), F.col(f"__m{j}")) * F.col(f"__b{j}")).alias("c")).alias(f"e{j}") for j, (_, n) in enumerate(sources.values())]), "__i")
    summary = df.groupBy(key, "__p").agg(ends.alias("e"))
    summary = summary.select(key, "__p", *[F.array(*[F.col(f"e.e{j}.{f}") for j in range(len(names))]).alias(f) for f in ("a", "c")])
    df = _with_carried(df, summary, key)
    out = {}
    for j, (new, (c, n)) in enumerate(sources.items()):
        value = F.pow(F.lit(1 - 1 / n), F.col(f"__m{j}")) * (F.col("__v")[j] + F.col(f"__b{j}"))
        if n == 1:
            value = F.col(f"__x{j}")
        out[new] = F.when(F.col(f"__c{j}") >= n, value)
    if any(n == 1 for _, n in sources.values()):  # no memory: the last value that is not null
        lasts = {f"__x{j}": F.when(there(c), F.col(c)) for j, (c, n) in enumerate(sources.values()) if n == 1}
        df = last_known(df.withColumns(lasts), list(lasts), key)
    return df.withColumns(out).drop("__v", *[f"__{x}{j}" for j in range(len(names)) for x in "csmbx"])


def last_known(df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """Columns of numbered() rows with each null replaced by the last value before it."""
    w = window(key).rowsBetween(Window.unboundedPreceding, 0)
    each = df.groupBy(key, "__p").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__i"))).alias(c) for c in columns])
    past = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col(key).alias("__key"), F.col("__p").alias("__into"), *[F.last(c, ignorenulls=True).over(past).alias(f"__past_{c}") for c in columns])
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    df = df.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__into")))
    return df.withColumns({c: F.coalesce(c, f"__past_{c}") for c in columns}).drop("__key", "__into", *[f"__past_{c}" for c in columns])


def record_before(df: DataFrame, source: str, name: str, key: str = "symbol", floor: float = 0.0) -> DataFrame:
    """The largest value of `source` in all rows before, `floor` at first: the running extreme of the block, and the largest of the blocks before."""
    each = df.groupBy(key, "__p").agg(F.max(source).alias("__most"))
    past = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col(key).alias("__key"), F.col("__p").alias("__into"), F.max("__most").over(past).alias("__most"))
    df = df.withColumn(name, F.max(source).over(window(key).rowsBetween(Window.unboundedPreceding, -1)))
    df = df.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__into")))
    return df.withColumn(name, F.greatest(F.lit(floor), F.coalesce(name, F.lit(floor)), F.coalesce("__most", F.lit(floor)))).drop("__key", "__into", "__most")


def run_lengths(df: DataFrame, state: str, name: str, key: str = "symbol") -> DataFrame:
    """Rows since `state` last changed, 1 for the row of the change; a null is a state of its own."""
    df = haloed(df, 1)
    w = window(key)
    first = F.col("__i") == 0
    df = own(df.withColumn("__new", first | ~F.col(state).eqNullSafe(F.lag(state).over(w))))
    since = F.max(F.when(F.col("__new"), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__since", since)
    last = df.groupBy(key, "__p").agg(F.max("__since").alias("s"), F.max("__i").alias("z"), F.count("*").alias("n"))
    # a block with a change hands on its last run, one without adds its rows to what comes in
    one = lambda c: F.array(c.cast("double"))
    summary = last.select(key, "__p", one(F.when(F.col("s").isNull(), 1).otherwise(0)).alias("a"), one(F.coalesce(F.col("z") - F.col("s") + 1, F.col("n"))).alias("c"))
    df = _with_carried(df, summary, key)
    length = F.coalesce(F.col("__i") - F.col("__since") + 1, F.col("__i") - F.col("__p") * SIZE + 1 + F.col("__v")[0].cast("bigint"))
    return df.withColumn(name, length.cast("bigint")).drop("__new", "__since", "__v")
