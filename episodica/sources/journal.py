"""Reading, loading and exporting journals as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import parse_flag, parse_moment, parse_number

#: Fixed header words of the two dialects, lower-cased, ё as е.
HEADERS = {
    "ид_события": "journal_id", "ид события": "journal_id", "ид записи журнала": "journal_id",
    "ид_канала_данных": "channel_id", "ид канала данных": "channel_id",
    "дата": "day", "дата записи": "day", "время": "time", "тревожное": "is_alarm",
    "значение_датчика": "value", "значение датчика": "value", "текущее значение": "value", "ид типа канала данных": "channel_type",
}
FIELDS = ("journal_id", "channel_id", "day", "time", "is_alarm", "value")
REQUIRED = ("journal_id", "channel_id", "day")


def map_headers(names: list[str]) -> dict[str, str]:
    """Column -> field; empty and unnamed columns are left out; an unknown header or a missing required one is an error."""
    out = {}
    for n in names:
        key = n.strip().lower().replace("ё", "е").replace("\n", " ")
        if key in HEADERS:
            out[n] = HEADERS[key]
        elif key and not key.startswith(("unnamed", "_c")):
            raise ValueError(f"unknown column header: {n!r}")
    if missing := sorted(set(REQUIRED) - set(out.values())):
        raise ValueError(f"required columns are missing: {missing}")
    return out


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-text rows of one or many CSV files in the library's field names, with the file each came from."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    fields = map_headers(raw.columns)
    known = [F.col(f"`{c}`").alias(f) for c, f in fields.items() if f in FIELDS]
    rest = [F.lit(None).cast("string").alias(f) for f in FIELDS if f not in fields.values()]
    return raw.select(*known, *rest, F.input_file_name().alias("file"))


def validate(rows: DataFrame, zone: str = "Europe/Moscow") -> DataFrame:
    """Parsed columns and ``reject``: null for good rows, else the first reason that applies."""
    ident = lambda c: F.when(F.trim(c).rlike(r"^\d{1,18}$"), F.trim(c).cast("long"))
    flag_given = F.coalesce(F.trim("is_alarm"), F.lit("")) != ""
    header = F.lower(F.translate(F.trim("journal_id"), "Ё", "Е")).isin(*HEADERS)
    out = rows.select(
        "*", ident(F.col("journal_id")).alias("_j"), ident(F.col("channel_id")).alias("_c"), parse_moment(F.col("day"), F.col("time"), zone).alias("read_time"), parse_flag(F.col("is_alarm")).alias("_a")
    )
    reject = (
        F.when(header, "repeated header")
        .when(F.col("journal_id").isNull() | F.col("channel_id").isNull() | F.col("day").isNull(), "short row")
        .when(F.col("_j").isNull() | F.col("_c").isNull(), "id is no number")
        .when(F.col("read_time").isNull(), "time not parsed")
        .when(flag_given & F.col("_a").isNull(), "flag not parsed")
    )
    return out.select(
        F.col("_j").alias("journal_id"), "read_time", F.col("_c").cast("int").alias("channel_id"), F.coalesce("_a", F.lit(False)).alias("is_alarm"),
        F.col("value").alias("value_text"), parse_number(F.col("value")).alias("value_num"), *[c for c in ("file",) if c in rows.columns], reject.alias("reject"),
    )


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.where("reject is null").drop("reject")


def reject_counts(validated: DataFrame) -> DataFrame:
    return validated.where("reject is not null").groupBy("reject").agg(F.count("*").alias("rows"))


def read_years(spark: SparkSession, path: str, ts_from: str | None = None, ts_to: str | None = None, time: str = "ts") -> DataFrame:
    """A Parquet journal partitioned by ``year``: bounds, both inclusive, prune folders by year and rows by pushed-down filters."""
    out = spark.read.parquet(path)
    if ts_from:
        out = out.where((F.col("year") >= int(ts_from[:4])) & (F.col(time) >= F.lit(ts_from).cast("timestamp")))
    if ts_to:
        out = out.where((F.col("year") <= int(ts_to[:4])) & (F.col(time) <= F.lit(ts_to).cast("timestamp")))
    return out


def load_new(rows: DataFrame, target: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, stub channels to add, counters) of an idempotent load.

    Keys (journal_id, read_time) that the target holds or that repeat are skipped; unknown channels become
    inactive stubs; the section comes from the channel.
    """
    keys = ["journal_id", "read_time"]
    once = rows.dropDuplicates(keys)
    fresh = once.join(target.select(*keys), keys, "left_anti").join(channels.select("channel_id", "section_id"), "channel_id", "left")
    stubs = rows.select("channel_id").distinct().join(channels.select("channel_id"), "channel_id", "left_anti").select("channel_id", F.lit(True).alias("is_stub"), F.lit(False).alias("is_active"))
    counters = rows.agg(F.count("*").alias("planned")).join(fresh.agg(F.count("*").alias("loaded"))).withColumn("skipped", F.col("planned") - F.col("loaded"))
    return fresh, stubs, counters


def control_totals(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(check, expected, actual, ok): rows of each table against a number; 0 marks a table that must be empty."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("check"), F.lit(expected[name]).cast("long").alias("expected"), "actual")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def load_report(validated: DataFrame) -> DataFrame:
    """By file: rows planned, loaded and failed, the reasons, first and last day."""
    by = validated.groupBy("file").agg(
        F.count("*").alias("planned"), F.count_if(F.col("reject").isNull()).alias("loaded"), F.count("reject").alias("failed"), F.array_sort(F.collect_set("reject")).alias("reasons"),
        F.min(F.to_date("read_time")).alias("first_day"), F.max(F.to_date("read_time")).alias("last_day"),
    )
    return by


def invalid_channels(validated: DataFrame, reasons: tuple[str, ...] = ("time not parsed", "flag not parsed")) -> DataFrame:
    """(file, channel_id, reject, rows) of rows that a channel wrote badly; rows without a channel number are in the file's report alone."""
    bad = validated.where(F.col("channel_id").isNotNull() & F.col("reject").isin(*reasons))
    return bad.groupBy("file", "channel_id", "reject").agg(F.count("*").alias("rows"))


def write_sorted(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", files: int | None = None) -> None:
    """Range-partitioned and sorted files, so that readers can skip by min and max."""
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    writer = dealt.sortWithinPartitions(*by).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace only the days that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_xml(df: DataFrame, path: str, row_tag: str = "row") -> None:
    """XML with a nil element for null, and no control characters, which XML forbids."""
    text = [F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*text).write.mode("overwrite").format("xml").option("rowTag", row_tag).option("nullValue", "nil").save(path)


def latest_weather(old: DataFrame, fresh: DataFrame, cut: Column) -> DataFrame:
    """Hourly upsert: hours after the cut are dropped, nulls stay, the last write of (observed_at, is_forecast, source) wins."""
    both = old.unionByName(fresh.where(F.col("observed_at") <= cut), allowMissingColumns=True)
    w = Window.partitionBy("observed_at", "is_forecast", "source").orderBy(F.col("fetched_at").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unpack_hours(rows: DataFrame, json_col: str, fields: list[str]) -> DataFrame:
    """One row per hour of a JSON of parallel arrays {time: [...], field: [...]}."""
    schema = "struct<time:array<string>," + ",".join(f"{f}:array<double>" for f in fields) + ">"
    parsed = rows.withColumn("_h", F.from_json(json_col, schema))
    zipped = F.explode(F.arrays_zip("_h.time", *[f"_h.{f}" for f in fields])).alias("h")
    return parsed.select(*rows.columns, zipped).select(*rows.columns, F.to_timestamp("h.time").alias("observed_at"), *[F.col(f"h.{f}").alias(f) for f in fields]).drop(json_col)


def missing_hours(rows: DataFrame, first: Column, days: int, time: str = "observed_at") -> DataFrame:
    """Hours without a row, of days x 24 expected."""
    every = rows.sparkSession.range(days * 24).select(F.timestamp_add("HOUR", F.col("id"), first).alias("hour"))
    return every.join(rows.select(F.date_trunc("hour", time).alias("hour")).distinct(), "hour", "left_anti")


def section_directory(channels: DataFrame) -> DataFrame:
    """(section_id, collector, picket, kinds) with sorted distinct kinds; a section without collector is an error."""
    out = channels.where("section_id is not null").groupBy("section_id").agg(F.min("collector").alias("collector"), F.min("picket").alias("picket"), F.array_sort(F.collect_set("sensor_kind")).alias("kinds"))
    missing = [r.section_id for r in out.where("collector is null").select("section_id").limit(5).collect()]
    if missing:
        raise ValueError(f"sections without collector: {missing}")
    return out
