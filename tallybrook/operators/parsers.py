"""Parsers of log lines into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Facility names by number, and severities of syslog and logcat levels.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SYSLOG = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
LOGCAT = {"V": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "A": "FATAL", "S": "INFO"}
LINE_LIMIT = 256 * 1024


def lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines without trailing white space; blank and overlong ones go."""
    text = F.rtrim(F.col(column))
    return df.withColumn(column, text).filter((F.octet_length(column) > 0) & (F.octet_length(column) <= LINE_LIMIT))


def syslog(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds facility, severity, host, app, message. A line without priority is INFO, user, with the whole line as its message."""
    pri = F.expr(f"try_cast(regexp_extract({column}, '^<([0-9]{{1,3}})>', 1) as int)")
    rest = F.regexp_replace(F.regexp_replace(F.col(column), r"^<[0-9]{1,3}>", ""), r"^[0-9]. ?", "")
    stamped = r"^[A-Z][a-z]{2} +[0-9]+ [0-9:]{8} "
    body = F.regexp_replace(rest, stamped, "")
    head = r"^(\S+) ([^:\[\s]+)(?:\[[0-9]*\])?:? ?(.*)$"
    ok = F.col("pri").isNotNull() & F.col("__b").rlike(head)
    part = lambda i: F.when(ok, F.regexp_extract("__b", head, i))
    out = df.withColumn("pri", pri).withColumn("__b", body)
    out = out.withColumn("facility", F.when(F.col("pri").isNull(), F.lit("user")).otherwise(F.coalesce(F.get(F.array(*map(F.lit, FACILITIES)), F.shiftright("pri", 3)), F.lit("unknown"))))
    out = out.withColumn("severity", F.when(F.col("pri").isNull(), F.lit("INFO")).otherwise(F.get(F.array(*map(F.lit, SYSLOG)), F.col("pri").bitwiseAND(7))))
    return out.withColumn("host", part(1)).withColumn("app", part(2)).withColumn("message", F.coalesce(part(3), F.when(F.col("pri").isNotNull(), F.col("__b")).otherwise(F.col(column)))).drop("__b")


def logcat(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds level, severity, tag, pid, tid, message of 'threadtime' and 'brief' lines; other lines are INFO with the whole line."""
    full = r"^[0-9-]{5,10} [0-9:.]+ +([0-9]+) +([0-9]+) ([VDIWEFAS]) ([^:]*?) *: ?(.*)$"
    brief = r"^([VDIWEFAS])/([^(]*?) *\( *([0-9]+)\): ?(.*)$"
    c = F.col(column)
    pick = lambda i, j: F.when(c.rlike(full), F.regexp_extract(c, full, i)).when(c.rlike(brief), F.regexp_extract(c, brief, j))
    names = F.create_map(*[F.lit(x) for kv in LOGCAT.items() for x in kv])
    out = df.withColumn("level", pick(3, 1)).withColumn("tag", pick(4, 2)).withColumn("pid", pick(1, 3).cast("int"))
    out = out.withColumn("tid", F.when(c.rlike(full), F.regexp_extract(c, full, 2)).cast("int")).withColumn("message", F.coalesce(pick(5, 4), c))
    return out.withColumn("severity", F.coalesce(F.try_element_at(names, F.col("level")), F.lit("INFO")))


def typed(kind: Column, text: Column) -> Column:
    """A plugin attribute's value: (string, int, list) by its kind; a bad integer is 0, a list is split at commas."""
    return F.struct(
        F.when(kind == "string", text).alias("string_value"),
        F.when(kind == "int", F.coalesce(text.try_cast("long"), F.lit(0))).alias("int_value"),
        F.when(kind == "array", F.split(text, ",")).alias("list_value"),
    )


#: Rows that a time range of a trace aims at.
RANGE_ROWS = 10_000
#: Snapshots of all traces that every task may hold, and gaps between them that a bin of time may meet.
POINTS, PER_BIN = 100_000, 64
#: Gaps between snapshots under 2^45 ns (9.7 hours), in which the clocks drift by under 2^34, are divided in 64 bits; others as decimals, at several times the cost.
GAP_BITS, DRIFT_BITS = 45, 34


def unix_ns(df: DataFrame, clock: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``unix_ns`` of a trace time from snapshots (trace, ts, unix): linear between two, with slope 1 outside. Divides toward zero.

    Each row takes the last snapshot up to it and the first one from it on; snapshots without time or value count for nothing. Up to ``POINTS``
    snapshots go to every task, where rows find theirs by bins of time and aren't shuffled; more of them, or crowded bins, are ordered with the rows.
    """
    points = clock.filter("ts is not null and unix is not null").groupBy("trace", F.col("ts").alias("__t")).agg(F.min("unix").alias("__least"), F.max("unix").alias("__most"))
    rows = df.withColumn("__t", F.col(ts))
    found = _by_bins(rows, points) if points.count() <= POINTS else None
    found = _by_order(rows, points) if found is None else found
    at, gap, gain = "(__t - __a.t)", "(__z.t - __a.t)", "(__z.u - __a.u)"
    long = F.expr(f"cast((cast({at} as decimal(38,0)) * cast({gain} as decimal(19,0))) div cast({gap} as decimal(19,0)) as bigint)")
    between = F.col("__a.u") + F.when(F.expr(f"{gap} < {1 << GAP_BITS} and abs({gain} % {gap}) < {1 << DRIFT_BITS}"), _share(at, gap, gain)).otherwise(long)
    value = F.when(F.col("__a").isNull(), F.expr("__z.u - (__z.t - __t)")).when(F.col("__z").isNull() | (F.expr("__z.t = __a.t")), F.expr("__a.u + (__t - __a.t)")).otherwise(between)
    return found.withColumn("unix_ns", F.greatest(value, F.lit(0))).select(*df.columns, "unix_ns")


def _share(at: str, gap: str, gain: str) -> Column:
    """``at * gain div gap`` for 0 <= at < gap in 64 bits: what ``gain`` has over whole gaps is divided in two steps, the high bits of ``at`` first."""
    low = 62 - GAP_BITS  # what a step leaves is under a gap, so it can be moved up by so many bits
    high = f"(shiftright({at}, {low}) * ({gain} % {gap}))"
    return F.expr(f"{at} * ({gain} div {gap}) + ({high} div {gap}) * {1 << low}L + (({high} % {gap}) * {1 << low}L + ({at} & {(1 << low) - 1}L) * ({gain} % {gap})) div {gap}")


def _by_bins(rows: DataFrame, points: DataFrame) -> DataFrame | None:
    """``rows`` with their snapshots ``__a`` and ``__z`` (t, u) out of gaps between snapshots, sent to every task by bin; None where a bin meets too many."""
    span = (F.max("__t").cast("double") - F.min("__t").cast("double")) / F.count(F.lit(1))
    bins = points.groupBy(F.col("trace").alias("__trace")).agg(F.min("__t").cast("double").alias("__low"), F.when(span > 0, span).otherwise(1.0).alias("__width"), F.count(F.lit(1)).alias("__n"))

    def bin_of(t: str) -> Column:
        """From -1 before the first snapshot to the trace's number of snapshots; never falls as the time rises."""
        at = F.floor((F.col(t).cast("double") - F.col("__low")) / F.col("__width"))
        return F.when(F.col(t).isNotNull(), F.greatest(F.lit(-1), F.least("__n", at)))

    before, after = F.struct(F.col("__t").alias("t"), F.col("__most").alias("u")), F.struct(F.col("__t").alias("t"), F.col("__least").alias("u"))
    gaps = points.select("trace", before.alias("__a"), F.lead(after).over(Window.partitionBy("trace").orderBy("__t")).alias("__z"))
    gaps = gaps.unionByName(points.groupBy("trace").agg(F.min(after).alias("__z")), allowMissingColumns=True)
    met = F.sequence(F.coalesce(bin_of("__a.t"), F.lit(-1).cast("long")), F.coalesce(bin_of("__z.t"), "__n"))
    gaps = gaps.join(F.broadcast(bins), F.col("trace").eqNullSafe(F.col("__trace"))).select("__trace", "__a", "__z", F.explode(met).alias("__bin"))
    if (gaps.groupBy("__trace", "__bin").count().agg(F.max("count")).first()[0] or 0) > PER_BIN:
        return None
    rows = rows.join(F.broadcast(bins), F.col("trace").eqNullSafe(F.col("__trace")), "left").withColumn("__at", bin_of("__t")).drop("__trace", "__low", "__width", "__n")
    within = F.expr("(__a is null or __t >= __a.t) and (__z is null or __t < __z.t)")
    return rows.join(F.broadcast(gaps), F.col("trace").eqNullSafe(F.col("__trace")) & (F.col("__at") == F.col("__bin")) & within, "left")


def _by_order(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The same with snapshots and rows ordered together within ranges of time of a trace.

    A range's neighbours hand over what it has none of, so a long trace is spread over many tasks.
    """
    both = rows.withColumn("__row", F.lit(1)).unionByName(points.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    low, high, n = both.agg(F.min("__t"), F.max("__t"), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n // RANGE_ROWS) + 1)
    point = lambda u: F.when(F.col("__row") == 0, F.struct(F.col("__t").alias("t"), F.col(u).alias("u")))
    both = both.withColumn("__r", F.expr(f"(__t - {low or 0}L) div {width}L")).withColumn("__p", point("__most")).withColumn("__q", point("__least"))
    edges = both.groupBy("trace", "__r").agg(F.min("__q").alias("first"), F.max("__p").alias("last"))
    line = Window.partitionBy("trace")
    known = lambda c, order: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(F.col("trace").alias("__trace"), F.col("__r").alias("__range"), known("last", line.orderBy("__r")).alias("__before"), known("first", line.orderBy(F.col("__r").desc())).alias("__after"))
    own = Window.partitionBy("trace", "__r")
    seen = lambda c, order: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__a", seen("__p", own.orderBy("__t", "__row"))).withColumn("__z", seen("__q", own.orderBy(F.col("__t").desc(), "__row"))).filter("__row = 1")
    both = both.join(edges, F.col("trace").eqNullSafe(F.col("__trace")) & F.col("__r").eqNullSafe(F.col("__range")))
    return both.withColumn("__a", F.coalesce("__a", "__before")).withColumn("__z", F.coalesce("__z", "__after"))


def generated(spark: SparkSession, rows: int = 25_000) -> DataFrame:
    """Synthetic log rows: severity and body size cycle with the sequence number."""
    from tallybrook.functions.severity import CLASSES

    seq = F.col("id")
    size = F.when(seq % 100 == 0, 2048).when(seq % 10 == 0, 512).otherwise(64)
    return spark.range(rows).select(
        seq.alias("seq"),
        F.get(F.array(*map(F.lit, CLASSES)), (seq % len(CLASSES)).cast("int")).alias("severity_text"),
        size.cast("int").alias("size"),
        F.rpad(F.concat(F.lit("event "), seq.cast("string"), F.lit(" ")), size, ".").alias("body"),
    )
