r"""Times as text in mixed forms, brought to UTC.

Forms are told apart by one pattern. What is left open is settled by Spark jobs:

* Dates with slashes that could be read in two orders follow the votes of their source: of those that can be read in one order only. Votes are
  counted by source and joined with salts, so a hot source is many tasks.
* Wall times meet the offset of their zone in a sweep: markers of all offset changes of a zone lie with the wall times in one order of zone and time,
  cut into ranges. Within a range the last marker is carried forward; a range begins with what the ranges before it end with (a row for each
  range and zone). So a zone or a source that holds most rows is spread over ranges, and nothing but these small rows passes a border.

A change of offset marks the wall time from which it holds and the one until which wall times are not settled: between the two the clock skips (gap)
or repeats (overlap). Both take the offset after the change and are `ambiguous`.

Defined results: a null or empty raw is bad. Without an offset in the text, a null or unknown zone makes a stamp bad, though the order of its date still votes,
as it tells how its source writes. A null source is a source of its own. Rows that repeat give a row and a vote each. An empty table gives an empty
result. Columns other than stamp_id, source, zone and raw are ignored. Two changes of one zone never overlap in its wall times.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from itertools import pairwise
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = " \t\n\x0b\f\r"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
EPOCH_RE = r"\A[0-9]{10}([0-9]{3})?\z"
STAMP_RE = (
    r"\A(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})"
    rf"|([0-9]{{2}})\x20({'|'.join(MONTHS)})\x20(20[0-9]{{2}})|([0-9]{{2}})/([0-9]{{2}})/(20[0-9]{{2}}))"
    r"(?:[T\x20]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
)
#: The groups of the pattern by meaning: the groups of other forms are empty, so they can stand side by side.
FIELDS = {"y": "$1$4$9$12$15", "mo": "$2$5$8$11", "d": "$3$6$7$10", "first": "$13", "second": "$14", "h": "$16", "mi": "$17", "s": "$18", "half": "$19", "zoned": "$20"}
#: A date in two orders goes by its source's votes if one side has more than MAJORITY times the other's.
MAJORITY = 1
SALTS = 16
MICROS = 1_000_000
#: A change of offset: the offset after it, until when wall times are not settled, whether the clock skips.
CHANGE = "offset long, until long, skips boolean"


def days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date of three numbers; null if there is no such date."""
    in_year = (m >= 1) & (m <= 12)
    in_month = in_year & (d >= 1) & F.when(in_year, d <= F.day(F.last_day(F.make_date(y, m, F.lit(1)))))
    return F.when(in_month, F.unix_date(F.make_date(y, m, d)).cast("long"))


def parse(stamps: DataFrame) -> DataFrame:
    """stamps (stamp_id, source, zone, raw) with what their text says by itself: epoch (microseconds), day_first and month_first (days of the date in
    either order, equal where there is one), seconds (of the day), shift (the text's own offset in seconds)."""
    raw = F.btrim(F.col("raw").cast("string"), F.lit(SPACE))
    parts = F.split(F.regexp_replace(raw, STAMP_RE, "|".join(FIELDS.values())), r"\|")
    t = stamps.select("stamp_id", "source", "zone", raw.alias("raw"), F.when(raw.rlike(STAMP_RE), parts).alias("parts"))
    text = {name: F.nullif(F.col("parts")[k], F.lit("")) for k, name in enumerate(FIELDS)}
    t = t.select("stamp_id", "source", "zone", "raw", *[text[name].alias(name) for name in FIELDS])
    number = {name: F.col(name).cast("int") for name in ("y", "d", "first", "second", "h", "mi", "s")}
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("mo")).cast("int")
    month = F.when(F.col("mo").rlike("[0-9]"), F.col("mo").try_cast("int")).otherwise(named)
    y, slashed = number["y"], F.col("first").isNotNull()
    hour = F.when(F.col("half").isNull(), F.when(number["h"] <= 23, number["h"])).when(number["h"].between(1, 12), number["h"] % 12 + F.when(F.col("half") == "PM", 12).otherwise(0))
    seconds = F.when(F.col("h").isNull(), F.lit(0)).when((number["mi"] <= 59) & (F.coalesce(number["s"], F.lit(0)) <= 59), hour * 3600 + number["mi"] * 60 + F.coalesce(number["s"], F.lit(0)))
    away, minutes = F.substring("zoned", 2, 2).try_cast("int"), F.right(F.col("zoned"), F.lit(2)).try_cast("int")
    sign = F.when(F.substring("zoned", 1, 1) == "-", -1).otherwise(1)
    shift = F.when(F.col("zoned") == "Z", F.lit(0)).when((away <= 14) & (minutes <= 59), sign * (away * 3600 + minutes * 60))
    possible = seconds.isNotNull() & (F.col("zoned").isNull() | shift.isNotNull())
    return t.select(
        "stamp_id", "source", "zone",
        F.when(F.col("raw").rlike(EPOCH_RE), F.col("raw").try_cast("long") * F.when(F.length("raw") == 10, MICROS).otherwise(MICROS // 1000)).alias("epoch"),
        F.when(possible, F.when(slashed, days(y, number["second"], number["first"])).otherwise(days(y, month, number["d"]))).alias("day_first"),
        F.when(possible, F.when(slashed, days(y, number["first"], number["second"])).otherwise(days(y, month, number["d"]))).alias("month_first"),
        seconds.cast("long").alias("seconds"), shift.cast("long").alias("shift"),
    )


def settle(parsed: DataFrame, majority: float = MAJORITY, salts: int = SALTS) -> DataFrame:
    """parsed with the date chosen: stamp_id, zone, epoch, wall (seconds since 1970 on the zone's clock, or by `shift`), shift, rule, contested."""
    either = F.col("day_first").isNotNull() & F.col("month_first").isNotNull()
    contested = F.coalesce(either & (F.col("day_first") != F.col("month_first")), F.lit(False))
    votes = parsed.where(F.col("day_first").isNotNull() != F.col("month_first").isNotNull()).groupBy(F.col("source").alias("voter")).agg(
        F.count("day_first").alias("for_day"), F.count("month_first").alias("for_month"))
    spread = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    asked = parsed.where(contested).withColumn("its_salt", F.pmod(F.xxhash64("stamp_id", "day_first", "seconds"), F.lit(salts)).cast("int"))
    voted = asked.join(spread, F.col("source").eqNullSafe(F.col("voter")) & (F.col("its_salt") == F.col("salt")), "left")
    day, month = F.coalesce("for_day", F.lit(0)), F.coalesce("for_month", F.lit(0))
    by_month, by_day = month > day * majority, day > month * majority
    chosen = voted.withColumn("rule", F.when(by_month | by_day, "votes").otherwise("default")).withColumn("date", F.when(by_month & ~by_day, F.col("month_first")).otherwise(F.col("day_first")))
    date = F.coalesce("day_first", "month_first")
    rest = parsed.where(~contested).withColumn("rule", F.when(F.col("epoch").isNotNull(), "epoch").when(date.isNull(), "bad").otherwise("plain")).withColumn("date", date)
    names = ["stamp_id", "zone", "epoch", (F.col("date") * 86400 + F.col("seconds")).alias("wall"), "shift", "rule"]
    return rest.select(*names, F.lit(False).alias("contested")).unionAll(chosen.select(*names, F.lit(True).alias("contested")))


def changes(zone: str, first: int = 1999, last: int = 2101) -> list[tuple[int, int, int, bool]]:
    """Changes of a zone's offset between two years as (wall time from which it holds, offset, wall time until which wall times are not settled, whether
    the clock skips), led by the offset at the start; empty for a name that is no zone's."""
    try:
        where = ZoneInfo(zone)
    except (KeyError, OSError, ValueError):
        return []

    def offset(at: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)).astimezone(where).utcoffset().total_seconds())

    probes = range(*(int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (first, last)), 86400)
    out = [(-(2**40), offset(probes[0]), -(2**40), False)]
    for (low, before), (high, after) in pairwise((at, offset(at)) for at in probes):
        if before != after:
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if offset(mid) == after else (mid, high)
            out.append((high + min(before, after), after, high + max(before, after), after > before))
    return out


def markers(zones: DataFrame) -> DataFrame:
    """The changes of each zone of a table of different zones, at most some hundred a zone."""
    import pyarrow as pa

    def kernel(batches):
        for batch in batches:
            rows = [(zone, *change) for zone in batch.column(0).to_pylist() if zone for change in changes(zone)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["zone", "wall", "offset", "until", "skips"])

    return zones.mapInArrow(kernel, f"zone string, wall long, {CHANGE}")


def sweep(walls: DataFrame, parts: int | None = None) -> DataFrame:
    """walls (zone, wall and others) with the offset that holds there and its state: plain, gap, overlap, or null for an unknown zone."""
    spark = walls.sparkSession
    others = [c for c in walls.columns if c not in ("zone", "wall")]
    carried = F.struct(*others).alias("carried")
    rows = walls.select("zone", "wall", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<{CHANGE}>").alias("change"), carried)
    marks = markers(walls.select("zone").distinct()).select("zone", "wall", F.lit(0).alias("kind"), F.struct("offset", "until", "skips").alias("change"), F.lit(None).cast(rows.schema["carried"].dataType).alias("carried"))
    order = ["zone", "wall", "kind", *[F.col(f"carried.{c}") for c in others]]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.unionAll(marks).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    events = materialize(ranged, "sweep")
    ends = events.groupBy("part", "zone").agg(F.max(F.when(F.col("kind") == 0, F.struct("wall", "change")))["change"].alias("ends_with"))
    before = Window.partitionBy("zone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("part", "zone", F.last("ends_with", ignorenulls=True).over(before).alias("begins_with")).hint("merge")
    within = Window.partitionBy("part", "zone").orderBy("wall", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = events.withColumn("own", F.last("change", ignorenulls=True).over(within)).where("kind = 1").alias("e").join(
        carry.alias("c"), (F.col("e.part") == F.col("c.part")) & F.col("e.zone").eqNullSafe(F.col("c.zone")))
    holds = filled.select("e.zone", "e.wall", "carried.*", F.coalesce("own", "begins_with").alias("holds"))
    state = F.when(F.col("holds").isNull(), F.lit(None)).when(F.col("wall") >= F.col("holds.until"), "plain").when(F.col("holds.skips"), "gap").otherwise("overlap")
    return holds.select("zone", "wall", *others, F.col("holds.offset").alias("offset"), state.alias("state"))


def normalise(stamps: DataFrame, majority: float = MAJORITY) -> DataFrame:
    """stamps (stamp_id, source, zone, raw) as stamp_id, utc_us, rule, ambiguous, offset (seconds, that of the text or of the zone; null for epochs)."""
    settled = settle(materialize(parse(stamps), "stamps"), majority)
    on_clock = F.coalesce(F.col("wall").isNotNull() & F.col("shift").isNull() & F.col("epoch").isNull(), F.lit(False))
    direct = settled.where(~on_clock).select(
        "stamp_id", F.coalesce(F.col("epoch"), (F.col("wall") - F.col("shift")) * MICROS).alias("utc_us"), "rule", F.col("contested").alias("ambiguous"), F.col("shift").alias("offset"))
    swept = sweep(settled.where(on_clock).select("zone", "wall", "stamp_id", "rule", "contested"))
    known = F.col("state").isNotNull()
    from_clock = swept.select(
        "stamp_id", F.when(known, (F.col("wall") - F.col("offset")) * MICROS).alias("utc_us"), F.when(known, F.col("rule")).otherwise("bad").alias("rule"),
        F.coalesce(F.col("contested") & known | (F.col("state") != "plain"), F.lit(False)).alias("ambiguous"), "offset")
    return direct.unionAll(from_clock)


def op12_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


DATE_SQL = rf"20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|20[0-9]{{6}}|[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}|[0-9]{{2}}\x20(?:{'|'.join(MONTHS)})\x2020[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}"
TIME_SQL = r"[T\x20]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?"
SQL = rf"""
WITH a AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM stamps),
b AS (SELECT *, regexp_extract(raw, '\A({DATE_SQL})(?:{TIME_SQL})?\z', 1) AS dp,
  [{", ".join(rf"regexp_extract(raw, '\A(?:{DATE_SQL}){TIME_SQL}\z', {k})" for k in range(1, 6))}] AS g FROM a),
c AS (SELECT *, dp <> '' AS matched, CASE WHEN dp LIKE '20__-%' OR length(dp) = 8 THEN left(dp, 4) ELSE right(dp, 4) END AS y, dp LIKE '%/%' AS slashed,
  CASE WHEN dp LIKE '____-%' THEN substr(dp, 6, 2) WHEN length(dp) = 8 THEN substr(dp, 5, 2) WHEN length(dp) = 11 THEN lpad(list_position([{", ".join(f"'{m}'" for m in MONTHS)}], substr(dp, 4, 3))::VARCHAR, 2, '0') ELSE substr(dp, 4, 2) END AS mo,
  CASE WHEN dp LIKE '____-%' THEN substr(dp, 9, 2) WHEN length(dp) = 8 THEN substr(dp, 7, 2) ELSE left(dp, 2) END AS d,
  try_cast(nullif(g[1], '') AS INTEGER) AS h, try_cast(nullif(g[2], '') AS INTEGER) AS mi, coalesce(try_cast(nullif(g[3], '') AS INTEGER), 0) AS s, g[4] AS half, g[5] AS zoned FROM b),
d AS (SELECT *, CASE WHEN h IS NULL THEN 0 WHEN mi > 59 OR s > 59 THEN NULL WHEN half = '' AND h < 24 THEN h * 3600 + mi * 60 + s
    WHEN half <> '' AND h BETWEEN 1 AND 12 THEN (h % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END) * 3600 + mi * 60 + s END AS seconds,
  CASE WHEN zoned = 'Z' THEN 0 WHEN zoned <> '' AND substr(zoned, 2, 2)::INT <= 14 AND right(zoned, 2)::INT <= 59
    THEN (CASE left(zoned, 1) WHEN '-' THEN -1 ELSE 1 END) * (substr(zoned, 2, 2)::INT * 3600 + right(zoned, 2)::INT * 60) END AS shift FROM c),
e AS (SELECT *, matched AND seconds IS NOT NULL AND (zoned = '' OR shift IS NOT NULL) AS possible FROM d),
f AS (SELECT *, CASE WHEN possible THEN try_cast(y || '-' || mo || '-' || d AS DATE) END AS by_day,
  CASE WHEN possible THEN try_cast(CASE WHEN slashed THEN y || '-' || d || '-' || mo ELSE y || '-' || mo || '-' || d END AS DATE) END AS by_month FROM e),
v AS (SELECT source, count(by_day) AS for_day, count(by_month) AS for_month FROM f WHERE (by_day IS NULL) <> (by_month IS NULL) GROUP BY source),
i AS (SELECT f.*, coalesce(by_day <> by_month, false) AS contested, coalesce(for_day, 0) AS for_day, coalesce(for_month, 0) AS for_month FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source),
j AS (SELECT *, CASE WHEN regexp_matches(raw, '{EPOCH_RE}') THEN raw::BIGINT * (CASE length(raw) WHEN 10 THEN 1000000 ELSE 1000 END) END AS epoch,
  CASE WHEN contested AND for_month > for_day THEN by_month ELSE coalesce(by_day, by_month) END AS chosen FROM i),
k AS (SELECT *, CASE WHEN chosen IS NOT NULL THEN epoch(chosen)::BIGINT + seconds END AS wall FROM j),
l AS (SELECT *, CASE WHEN wall IS NOT NULL AND shift IS NULL AND epoch IS NULL THEN wall END AS clock FROM k),
m AS (SELECT *, epoch(timezone(zone, to_timestamp(clock - 86400)))::BIGINT - (clock - 86400) AS o1, epoch(timezone(zone, to_timestamp(clock + 86400)))::BIGINT - (clock + 86400) AS o2 FROM l),
n AS (SELECT *, epoch(timezone(zone, to_timestamp(clock - o1)))::BIGINT = clock AS fits1, epoch(timezone(zone, to_timestamp(clock - o2)))::BIGINT = clock AS fits2 FROM m)
SELECT stamp_id,
  CASE WHEN epoch IS NOT NULL THEN epoch WHEN shift IS NOT NULL THEN (wall - shift) * 1000000 WHEN clock IS NOT NULL THEN (clock - CASE WHEN fits1 AND NOT fits2 THEN o1 ELSE o2 END) * 1000000 END AS utc_us,
  CASE WHEN epoch IS NOT NULL THEN 'epoch' WHEN wall IS NULL OR (clock IS NOT NULL AND o2 IS NULL) THEN 'bad' WHEN NOT contested THEN 'plain' WHEN for_day <> for_month THEN 'votes' ELSE 'default' END AS rule,
  wall IS NOT NULL AND (clock IS NULL OR o2 IS NOT NULL) AND (contested OR coalesce(o1 <> o2 AND fits1 = fits2, false)) AS ambiguous
FROM n
"""
