"""Joins by time: as-of, validity, fallback, cascade, spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundtrace.sources.scratch import written


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, values: list[str], max_days: int | None = None, lag_days: int = 0, forward: bool = False) -> DataFrame:
    """Add ``matched`` and ``values`` of the latest right row at or before each left date, or the first after it.

    ``lag_days`` moves the right dates later by so many days before they are compared; a match more than ``max_days``
    away (in the right's own dates) is none. Both sides are shuffled by key once and sorted; of right rows of one key
    and date the one with the largest values is taken. Left rows all stay.
    """
    packed = F.struct(F.col(right_date).alias("at"), *values)
    l_ = left.select(*keys, F.col(left_date).alias("_d"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(packed.alias("r")).schema["r"].dataType).alias("_r"))
    r_ = right.select(*keys, F.date_add(right_date, lag_days).alias("_d"), F.lit(2 if forward else 0).alias("_side"), F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"), packed.alias("_r"))
    order = W.partitionBy(*keys)
    if forward:  # strictly after: rows of the same date sort behind it going backwards
        both = l_.withColumn("_side", F.lit(0)).union(r_.withColumn("_side", F.lit(1)))
        w = order.orderBy(F.desc("_d"), "_side", "_r").rowsBetween(W.unboundedPreceding, -1)
        found = F.last("_r", ignorenulls=True).over(w)
        same = F.when(found["at"] > F.col("_d"), found)
    else:
        both = l_.union(r_)
        found = F.last("_r", ignorenulls=True).over(order.orderBy("_d", "_side", "_r").rowsBetween(W.unboundedPreceding, 0))
        same = found
    hit = both.withColumn("_m", same).where("_l is not null")
    near = F.lit(True) if max_days is None else F.abs(F.datediff(F.col("_m.at"), F.col("_d"))) <= max_days
    return hit.select("_l.*", F.when(near, F.col("_m.at")).alias("matched"), *[F.when(near, F.col(f"_m.{v}")).alias(v) for v in values])


def validity(left: DataFrame, right: DataFrame, key: str, date: str, begin: str, end: str) -> DataFrame:
    """Left join on key where the date lies in [begin, end], an open end included. Intervals must not overlap."""
    r = right.withColumnRenamed(key, f"_{key}")
    return left.join(r, (F.col(key) == F.col(f"_{key}")) & (F.col(date) >= F.col(begin)) & (F.col(end).isNull() | (F.col(date) <= F.col(end))), "left").drop(f"_{key}")


def fund_panel(tables: dict[str, DataFrame], years: tuple[int | None, int | None] = (None, None), objective: tuple[str, str] = ("B", "Balanced")) -> DataFrame:
    """A row for each monthly return with what is known of its fund then, for funds of an objective (code or name, trimmed) and a span of years.

    ``tables``: returns (fund, caldt, ...), nav and tna (fund, caldt, ...), header (fund, portfolio, ...), fees and style (fund, begdt, enddt,
    ...; valid from begdt to enddt, which may be open), flows (portfolio, trans_dt, ...; of the same month) and dividends (fund, caldt, ...).
    Each may be missing for a row, but for the style that is asked for. Several dividends, flows or validities give several rows.
    """
    valid = lambda t: F.col("caldt").between(F.col(f"{t}.begdt"), F.coalesce(f"{t}.enddt", F.lit("9999-12-31").cast("date")))
    low, high = years
    out = tables["returns"]
    if low is not None:
        out = out.where(F.year("caldt") >= low)
    if high is not None:
        out = out.where(F.year("caldt") <= high)
    for t in ("nav", "tna", "dividends"):
        out = out.join(tables[t], ["fund", "caldt"], "left")
    out = out.join(tables["header"], "fund", "left").withColumn("_month", F.year("caldt") * 12 + F.month("caldt"))
    style = tables["style"].where((F.trim("objective_code") == objective[0]) | (F.trim("objective_name") == objective[1]))
    for t, df, how in (("fees", tables["fees"], "left"), ("style", style, "inner")):
        out = out.alias("r").join(df.alias(t), (F.col("r.fund") == F.col(f"{t}.fund")) & valid(t), how).select("r.*", *[F.col(f"{t}.{c}") for c in df.columns if c not in ("fund", "begdt", "enddt")])
    flows = tables["flows"].withColumn("_month", F.year("trans_dt") * 12 + F.month("trans_dt"))
    return out.join(flows, ["portfolio", "_month"], "left").drop("_month")


def overlapping(intervals: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of the same key has ended; empty in sound data."""
    before = F.max(F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31")))).over(W.partitionBy(key).orderBy(begin, end).rowsBetween(W.unboundedPreceding, -1))
    return intervals.withColumn("_before", before).where(F.col("_before") >= F.col(begin)).drop("_before")


def fallback(left: DataFrame, right: DataFrame, key: str, year: str, values: list[str], offsets: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """Add values of the first of year + offset that the right table has, and ``offset``. What answers a year is looked up by key and year."""
    each = right.select(F.col(key).alias("_k"), F.col(year).alias("_ry"), *values, F.posexplode(F.array(*map(F.lit, offsets))).alias("_nth", "offset"))
    answers = each.groupBy("_k", (F.col("_ry") - F.col("offset")).alias("_y")).agg(F.min_by(F.struct("offset", *values), "_nth").alias("_v"))
    return left.join(answers, (F.col(key) == F.col("_k")) & (F.col(year) == F.col("_y")), "left").select(*left.columns, "_v.*")


def spine_state(events: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """State of every entity strictly before each event date: n, mean, std, least of its earlier values.

    Prefix sums per entity, then the dates that fall between two of its rows; only dates with events are kept.
    """
    daily = events.groupBy(entity, date).agg(F.avg(value).alias("v"))
    w = W.partitionBy(entity).orderBy(date)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    prefix = daily.select(
        entity, F.col(date).alias("_from"), F.lead(date).over(w).alias("_to"), F.count("v").over(upto).alias("n"),
        F.avg("v").over(upto).alias("mean"), F.stddev_samp("v").over(upto).alias("std"), F.min("v").over(upto).alias("least"),
    )
    return at_dates(prefix, events.select(date).distinct(), "_from", "_to", date)


def at_dates(intervals: DataFrame, dates: DataFrame, begin: str, end: str, date: str) -> DataFrame:
    """Each interval with the dates after its begin and up to its end, an open end included; begin and end go.

    An equi join by month: an interval stands under each month that it touches, up to the last date of all, and a date
    under its own.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = dates.agg(F.max(date).alias("_last"))
    spans = intervals.join(F.broadcast(last), F.lit(True)).where(F.col(begin) < F.col("_last"))  # one row
    spans = spans.withColumn("_month", F.explode(F.sequence(month(begin), month(F.least(F.coalesce(end, "_last"), "_last")))))
    met = spans.join(dates.withColumn("_month", month(date)), "_month")
    return met.where((F.col(begin) < F.col(date)) & (F.col(end).isNull() | (F.col(end) >= F.col(date)))).drop("_month", "_last", begin, end)


#: Letters of a gram of the name index.
GRAM = 4


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of names (_k as _s and _l) of which the first is in the second, by an index of grams.

    A name of at least ``GRAM`` letters is looked up under one gram of its own, the one that fewest long names have: a name that holds
    it holds all its grams. Shorter names are looked up whole among the grams of their length. Candidates are then
    checked letter by letter. Grams of long names that no short name asks for are left out before the join.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n) if isinstance(n, int) else n)))
    own = short.select(F.col("_k").alias("_s"), F.length("_k").alias("_n"))
    asked = own.select("_s", F.when(F.col("_n") >= GRAM, F.lit(GRAM)).otherwise(F.col("_n")).alias("_size"))
    asked = asked.select("_s", F.explode(grams(F.col("_s"), F.col("_size"))).alias("_g"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: n <= F.length("_k"))
    held = long.select(F.col("_k").alias("_l"), F.explode(F.flatten(F.transform(sizes, lambda n: grams(F.col("_k"), n)))).alias("_g"))
    common = held.groupBy("_g").agg(F.count("*").alias("_c"))
    # a gram that no long name has ends the search for its name: the count is 0
    rarest = asked.join(common, "_g", "left").groupBy("_s").agg(F.min_by(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g")), F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_r"))
    keys = rarest.where("_r.c > 0").select("_s", F.col("_r.g").alias("_g"))
    return keys.join(held, "_g").where(F.col("_l").contains(F.col("_s"))).select("_s", "_l")


def containment(names: DataFrame, entries: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct names: equal when normalised; only names without an equal one by containment either way.

    Containment is found by grams of the distinct normalised names, so no name meets all others. Names that are
    empty when normalised match nothing loosely; null names match nothing.
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    left = names.select(a).distinct().withColumn("_ka", key(a))
    right = entries.select(b).distinct().withColumn("_kb", key(b))
    exact = left.join(right, F.col("_ka") == F.col("_kb"))
    rest = left.join(exact.select(a).distinct(), a, "left_anti").where("_ka != ''")
    mine, theirs = rest.select(F.col("_ka").alias("_k")).distinct(), right.where("_kb != ''").select(F.col("_kb").alias("_k")).distinct()
    inside, outside = _within(mine, theirs), _within(theirs, mine)
    pairs = inside.select(F.col("_s").alias("_ka"), F.col("_l").alias("_kb")).union(outside.select(F.col("_l").alias("_ka"), F.col("_s").alias("_kb"))).distinct()
    loose = rest.join(pairs, "_ka").join(right, "_kb")
    return exact.select(a, b, F.lit("exact").alias("how")).union(loose.select(a, b, F.lit("contains").alias("how")))


def event_evidence(events: DataFrame, event: str, sources: dict[str, tuple[DataFrame, list[str], Column, Column]], records: bool = True, separator: str | None = None) -> DataFrame:
    """What several sources say about each event: event, for each source its ordered records (JSON) and their names, and evidence (JSON of all).

    A source is a table, the columns by which it belongs to an event, a number that orders its records and the text that
    names one. The records of a source are gathered once for each of its keys, in order of number (nulls first), then name, then
    record, and the lists are joined to the events, of which each has one row: what many events share is not spread out before. Sources
    with fewer key columns than others are written and joined last, so that their lists are not shuffled with the events; events that share
    such a list are dealt to the same tasks, so that a file by columns holds it once.
    Events without records have empty lists. Without ``records`` there are only names; with a ``separator`` they are one text for each source,
    beside their number (``n_`` and the source), made once for each key.
    """
    finest = max(len(keys) for _, keys, _, _ in sources.values())
    out = events.select(event, *dict.fromkeys(k for _, keys, _, _ in sources.values() for k in keys if k != event))
    shared: list[str] = []
    for source, (rows, keys, rank, name) in sorted(sources.items(), key=lambda s: -len(s[1][1])):
        own = rows.select(*keys, rank.cast("double").alias("rank"), name.cast("string").alias("name"), *([F.to_json(F.struct(*rows.columns)).alias("record")] if records else []))
        lists = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own.columns[len(keys) :]))).alias("_l"))
        fields = {source: _field("record")} if records else {}
        fields |= {f"{source}_names": _field("name")} if separator is None else {f"n_{source}": F.size("_l").cast("long"), f"{source}_names": F.array_join(_field("name"), separator)}
        lists = lists.select(*keys, *[c.alias(n) for n, c in fields.items()])
        if len(keys) < finest:
            lists = written(lists, source)
            if not shared:
                shared = keys
                out = _dealt_together(out, keys, event, lists.count())
        out = out.join(lists, keys, "left")
    empty = {"array": F.array().cast("array<string>"), "string": F.lit(""), "bigint": F.lit(0).cast("long")}
    names = [n for s in sources for n in (s, f"n_{s}", f"{s}_names") if n in out.columns and n not in events.columns]
    kinds = dict(out.select(*names).dtypes)
    out = out.select(event, *[F.coalesce(n, empty[kinds[n].split("<")[0]]).alias(n) for n in names])
    return out.withColumn("evidence", F.to_json(F.struct(*sources))) if records else out


def _field(name: str) -> Column:
    return F.transform("_l", lambda x: x[name])


def _dealt_together(events: DataFrame, keys: list[str], event: str, n_keys: int) -> DataFrame:
    """Events dealt by key, the events of one key to as many tasks as it takes to use all."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, n // max(1, n_keys))
    return events.repartition(n, *keys, F.pmod(F.xxhash64(event), F.lit(each)))


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two sets, with the group A, B or A&B."""
    x, y = (d.select(key).distinct().withColumn(f"_{n}", F.lit(True)) for d, n in ((a, "a"), (b, "b")))
    group = F.when(F.col("_a") & F.col("_b"), "A&B").when(F.col("_a"), "A").otherwise("B")
    return x.join(y, key, "full").select(key, group.alias("group"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
