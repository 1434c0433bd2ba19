"""Text functions (FN-12 to FN-17, FN-21, EX-12, EX-15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, MONTHS

BLANKS = " \t\n\r"


#: The codecs that are tried, in this order.
CODECS = ("utf_8", "latin_1", "utf_16")


def codec_stack() -> Column:
    """SO-3: the codecs as the list that is consumed from its end."""
    return F.reverse(F.array(*[F.lit(c) for c in CODECS]))


def decode(body: Column, charset: Column | None = None) -> Column:
    """FN-12, page by page: UTF-8 where the bytes are valid, else Latin-1, which never fails. A charset that the server names goes first."""
    latin1 = F.decode(body, "ISO-8859-1")
    utf8 = F.try_validate_utf8(body.cast("string"))
    plain = F.coalesce(utf8, latin1)
    if charset is None:
        return plain
    return F.when(F.lower(charset).isin("iso-8859-1", "latin-1", "latin_1", "latin1"), latin1).otherwise(plain)


def decode_site(df: DataFrame, body: str = "body", base: str = "base", seq: str = "seq") -> DataFrame:
    """FN-12 with the codec that stays: from a site's first page that isn't UTF-8 on, its pages are read as Latin-1. Adds text, codec."""
    bad = F.max((~F.coalesce(F.is_valid_utf8(F.col(body).cast("string")), F.lit(True))).cast("int")).over(Window.partitionBy(base).orderBy(seq))
    marked = df.withColumn("_bad", bad)
    latin1 = F.col("_bad") == 1
    text = F.when(latin1, F.decode(F.col(body), "ISO-8859-1")).otherwise(F.col(body).cast("string"))
    return marked.withColumn("text", text).withColumn("codec", F.when(latin1, "latin_1").otherwise("utf_8")).drop("_bad")


def stringify(x: Column) -> Column:
    """FN-13: null as the empty string."""
    return F.coalesce(x, F.lit(""))


def trim_blanks(x: Column) -> Column:
    """FN-14."""
    return F.btrim(x, F.lit(BLANKS))


def robots_meta(x: Column) -> Column:
    """FN-15."""
    return F.lower(F.coalesce(x, F.lit("")))


def followable(robots: Column) -> Column:
    """FN-16: only the word nofollow counts, so "none" is followable."""
    return ~F.contains(robots_meta(robots), F.lit("nofollow"))


def archivable(robots: Column) -> Column:
    """FN-17."""
    return ~robots_meta(robots).rlike("noarchive|nosnippet|noindex")


def datetime_strings(text: Column, distance: int = DEFAULT.date_time_distance) -> Column:
    """EX-12: array of strings that look like a date and a time. The class's >-_ is a range, as published pages rely on."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,4}[T\s,.;:|<>-_]{0," + str(distance) + r"}[0-9]{1,2}:[0-9]{1,2}"), F.lit(0))


def _parser(fuzzy: bool):
    def run(text: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(x: str | None):
            try:
                return parser.parse(x, dayfirst=True, fuzzy=fuzzy).replace(tzinfo=None) if x else None
            except (ValueError, OverflowError):
                return None

        return pd.Series([one(x) for x in text], dtype="datetime64[us]")

    return F.pandas_udf(run, "timestamp_ntz")


def parse_datetime(text: Column, fuzzy: bool = False) -> Column:
    """FN-21: day first, even in ISO order; null where it can't be read."""
    return _parser(fuzzy)(text)


def datetimes(text: Column) -> Column:
    """EX-12 and FN-21: to be exploded; strings that don't parse are dropped later by the null test."""
    return datetime_strings(text)


def month_number(name: Column) -> Column:
    """EX-15: the number of a Dutch month."""
    pairs = [F.lit(x) for item in MONTHS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name)))
