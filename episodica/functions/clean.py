"""Cleaning and classifying expressions: every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed words for true and false.
TRUE_WORDS = ("t", "true", "1", "да", "истина")
FALSE_WORDS = ("f", "false", "0", "нет", "ложь")

#: Fixed pairs of letters that look alike, Latin to Cyrillic.
LATIN, CYRILLIC = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"

#: Fixed dictionary of value words to categories.
VALUE_CATEGORIES = {
    "fault": ("Неисправен", "Много неисправных"),
    "loss": ("Неопределен", "Не определено"),
    "power": ("Обесточен", "Есть питание", "Питание от сети", "Питание от батареи"),
    "battery": ("Неисправность батареи", "Батарея разряжена"),
    "event": ("Обнаружено движение", "Обнаружен дым", "Затоплен", "Обнаружен газ", "Вызов", "Разговор", "Рычаг сдернут", "Температура ниже 3ºC", "Температура выше 40ºC"),
    "normal": ("Движения нет", "Норма", "Дыма нет", "Рычаг норма", "В норме от +3 до +40", "Устройства на объекте исправны", "Работают все насосы в АНС"),
    "state": ("Включен", "Выключен", "Не замкнут"),
    "guard": ("На охране", "Снят с охраны"),
    "service": ("Устройство выключено",),
}
PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
TIME_WORD = r"^\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d$"


def parse_flag(text: Column) -> Column:
    """Words for true and false, any case, trimmed; everything else is null."""
    key = F.lower(F.trim(text.cast("string")))
    return F.when(key.isin(*TRUE_WORDS), True).when(key.isin(*FALSE_WORDS), False)


def parse_number(text: Column) -> Column:
    """A plain decimal, comma or point; states, markers, 'nan', 'inf', '1_0' and '1d' are null."""
    key = F.regexp_replace(F.trim(text.cast("string")), ",", ".")
    return F.when(key.rlike(PLAIN_NUMBER), key.try_cast("double"))


def parse_moment(day: Column, time: Column, zone: str = "Europe/Moscow") -> Column:
    """ISO day and time in ``zone`` as a UTC timestamp; a missing time is midnight; the unparsable is null."""
    clock = F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit("00:00:00"))
    full = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    iso = F.trim(day).rlike(r"^\d{4}-\d{2}-\d{2}$") & full.rlike(r"^\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$")
    return F.to_utc_timestamp(F.when(iso, F.try_to_timestamp(F.concat_ws(" ", F.trim(day), full))), zone)


def kind_key(name: Column) -> Column:
    """Comparison key of a kind's name: spaces collapsed, look-alikes made Cyrillic, lower case, ё as е."""
    squeezed = F.regexp_replace(F.trim(name), r"\s+", " ")
    return F.translate(F.lower(F.translate(squeezed, LATIN, CYRILLIC)), "ё", "е")


def canonical_kind(df: DataFrame, col: str, kinds: DataFrame, kind_col: str, into: str) -> DataFrame:
    """Add ``into``: the dictionary's spelling of ``col``, null where the dictionary has none."""
    names = kinds.select(kind_key(F.col(kind_col)).alias("_key"), F.col(kind_col).alias(into)).dropDuplicates(["_key"])
    return df.withColumn("_key", kind_key(F.col(col))).join(names, "_key", "left").drop("_key")


def collector_of(tag: Column) -> Column:
    return F.nullif(F.trim(F.split_part(tag, F.lit("-"), F.lit(1))), F.lit(""))


def picket_of(name: Column) -> Column:
    """First picket number of a name; a narrow second form has no letters before the number."""
    first = F.regexp_extract(name, r"(?iu)ПК\s*(\d+)", 1)
    second = F.regexp_extract(name, r"(?iu)(?<!\w)АВ\s+(\d+)\s*\+\s*\d", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).try_cast("int")


def section_key(tag: Column, name: Column) -> Column:
    collector, picket = collector_of(tag), picket_of(name)
    return F.when(collector.isNotNull() & picket.isNotNull(), F.concat_ws(":", collector, picket))


def location_kind(tag: Column, name: Column, object_kind: Column) -> Column:
    zone = F.coalesce(tag, F.lit("")).rlike(r"\.4096\.|-g\d+\.$") | F.coalesce(name, F.lit("")).rlike(r"^\[?Охранная зона")
    return F.when(section_key(tag, name).isNotNull(), "section").when(zone, "zone").when(object_kind == "controlHouse", "building").otherwise("unknown")


def linear_metres(name: Column) -> Column:
    """Picket times ten metres, plus the offset where one is given."""
    pattern = r"(?iu)ПК\s*(\d+)\s*\+\s*(\d+(?:[.,]\d+)?)"
    picket, offset = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.regexp_extract(name, pattern, 2)
    bare = F.nullif(F.regexp_extract(name, r"(?iu)ПК\s*(\d+)", 1), F.lit(""))
    return F.coalesce(picket.try_cast("int") * 10 + F.regexp_replace(offset, ",", ".").try_cast("double"), bare.try_cast("int") * 10.0)


def value_category(value: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Category of a value word; then timestamp, numeric or unknown by form; null is unknown."""
    out = None
    for category, names in (words or VALUE_CATEGORIES).items():
        out = F.when(value.isin(*names), category) if out is None else out.when(value.isin(*names), category)
    form = F.when(value.rlike(TIME_WORD), "timestamp").when(value.rlike(PLAIN_NUMBER), "numeric").otherwise("unknown")
    return F.coalesce(out, form)


def unknown_values(df: DataFrame, col: str, words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(value, rows) of values that no category holds, null among them."""
    return df.where(value_category(F.col(col), words) == "unknown").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("rows"))


def methane_quality(text: Column) -> Column:
    """valid in [0, 15], negative, above, nonfinite or text."""
    key = F.lower(F.trim(text))
    number = parse_number(text)
    odd = key.rlike(r"^[+-]?(?:nan|inf|infinity)$")
    return F.when(odd, "nonfinite").when(number.isNull(), "text").when(number < 0, "negative").when(number > 15, "above").otherwise("valid")


def state_kind(text: Column, fault: tuple[str, ...], off: tuple[str, ...], ok: tuple[str, ...]) -> Column:
    """Class of a state by the first group of words of which it holds one: fault, off, ok, else other."""
    key = F.lower(text)
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(key, w))
    return F.when(holds(fault), "fault").when(holds(off), "off").when(holds(ok), "ok").otherwise("other")


def criticality_class(df: DataFrame, by: list[str], system: str, high: tuple[str, ...], middle: tuple[str, ...]) -> DataFrame:
    """A where a section has a system of ``high``, B of ``middle``, else C."""
    has = lambda s: F.bool_or(F.coalesce(F.col(system).isin(*s), F.lit(False)))
    return df.groupBy(*by).agg(F.when(has(high), "A").when(has(middle), "B").otherwise("C").alias("criticality"))


def setpoint_state(value: Column, low: Column, high: Column, direction: Column, inclusive: Column) -> Column:
    """True where a value breaks its set point: above_bad, below_bad or outside normal_range."""
    above = F.when(inclusive, value >= high).otherwise(value > high)
    below = F.when(inclusive, value <= low).otherwise(value < low)
    return F.when(direction == "above_bad", above).when(direction == "below_bad", below).when(direction == "normal_range", above | below)


def gas_scale(value: Column, low: Column, high: Column, top: Column) -> list[Column]:
    """zone, position in percent within 0 to 100, and the side on which the value leaves the scale."""
    zone = F.when(value.isNull(), "none").when(value < low, "below").when(value > high, "above").otherwise("between")
    position = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value / top * 100))
    side = F.when(value < 0, "low").when(value > top, "high")
    return [zone.alias("zone"), position.alias("position"), side.alias("off_scale")]


def in_window(moment: Column, from_day: str | None, to_day: str | None, zone: str = "UTC") -> Column:
    """Half-open [from, to + 1 day) in ``zone``; a bound of None doesn't filter."""
    keep = F.lit(True)
    if from_day:
        keep = keep & (moment >= F.to_utc_timestamp(F.lit(from_day).cast("timestamp"), zone))
    if to_day:
        keep = keep & (moment < F.to_utc_timestamp(F.date_add(F.lit(to_day).cast("date"), 1).cast("timestamp"), zone))
    return keep
