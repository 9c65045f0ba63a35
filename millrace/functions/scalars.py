"""Column functions: typing of dirty text, business days, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_amount(col: Column) -> Column:
    """Text to money; thousands separators are dropped, anything unreadable is null."""
    return F.replace(col, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def to_ts(col: Column) -> Column:
    return F.try_to_timestamp(col)


def to_bool(col: Column) -> Column:
    return col == "True"


def normalize_description(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(col), r"\s+", " "))


def add_business_days(date_col: Column, n: Column) -> Column:
    """n weekdays after a date; a weekend start is first moved to Monday.  No holidays."""
    start = F.date_add(date_col, F.when(F.weekday(date_col) == 5, 2).when(F.weekday(date_col) == 6, 1).otherwise(0))
    return F.date_add(start, (n + 2 * F.floor((F.weekday(start) + n) / 5)).cast("int"))


def expiry_date(accrued_on: Column, years: int = 2, month: int = 2, day: int = 5) -> Column:
    return F.make_date(F.year(accrued_on) + years, F.lit(month), F.lit(day))


def merge_wait_over(merged_since: Column, on: Column, months: int = 12) -> Column:
    return merged_since.isNull() | (F.add_months(merged_since, months) <= on)


def reason_prefix(reason: Column) -> Column:
    return F.split(reason, r"\(")[0]


def text_to_price(text: Column) -> Column:
    """A price read from a display: blanks dropped, unreadable marks or two points give null."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.when(~bare.contains("?") & (F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) < 2), bare.try_cast("double"))


def place_decimal(text: Column, only_if_unparsed: bool = True) -> Column:
    """Struct text, changed: four bare digits become two and two."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    moved = (F.length(digits) == 4) & ~text.contains(".")
    if only_if_unparsed:
        moved = moved & text_to_price(text).isNull()
    return F.struct(F.when(moved, F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 2))).otherwise(text).alias("text"), moved.alias("changed"))


def price_reading(text: Column, confidence: Column, doubt: float = 0.85) -> Column:
    """Struct price, confidence: the text as it stands, else with its decimal point put back, which is trusted less."""
    placed = place_decimal(text)
    return F.struct(text_to_price(placed["text"]).alias("price"), F.when(placed["changed"], confidence * doubt).otherwise(confidence).alias("confidence"))


def expand_abbreviations(text: Column, rules: dict[str, str]) -> Column:
    """Every blank-separated word that has a long form gets it."""
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def file_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def fraction_to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Bounding box of four fractions to whole pixels, cut off and not rounded; null stays null."""
    pixel = lambda i, size: (F.get(box, i) * size).cast("int")
    return F.when(box.isNotNull(), F.struct(pixel(0, width).alias("x0"), pixel(1, height).alias("y0"), pixel(2, width).alias("x1"), pixel(3, height).alias("y1")))
