"""Tolerant timestamp parsing and UTC normalization of text. Sessions run with time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Strptime directives and the pattern letters Spark reads them with
# (between other digits, two-digit fields need the doubled letter).
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "M",
    "%d": "d",
    "%H": "H",
    "%I": "h",
    "%M": "m",
    "%S": "s",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "D",
    "%z": "[XXX][xx]",
    "%Z": "VV",
    "%%": "%",
}
_DIGIT_FIELDS = {"%Y", "%y", "%m", "%d", "%H", "%I", "%M", "%S", "%f", "%j"}

# A date must lead the text; otherwise Spark would accept a bare year.
DATE_SHAPE = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"
# A zone ends the text: an offset after a time of day, a Z, UTC or GMT, or a name with an area.
# A zone that is recognised but cannot be read makes the whole value unreadable.
OFFSET_TAIL = r"[+-]\d{2}(:?\d{2})?$"
TIMED_OFFSET = r"(:\d{2}(\.\d+)?|[Tt ]\d{1,2})\s*[+-]\d{2}:?\d{2}$|:\d{2}(\.\d+)?\s*[+-]\d{2}$"
ZONE_NAME = r"[A-Za-z][A-Za-z_]*(/[A-Za-z0-9_+-]+)+$"
UNIVERSAL = r"(?i)\d\s*(UTC?|GMT)([+-]\d{1,2}(:?\d{2})?)?$"


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format into a Spark datetime pattern."""
    tokens: list[str] = []
    i = 0
    while i < len(fmt):
        size = 2 if fmt[i] == "%" else 1
        tokens.append(fmt[i : i + size])
        i += size
    pattern = ""
    literal = ""
    for at, token in enumerate(tokens):
        if len(token) == 1 and token.isalpha():
            literal += token
            continue
        if literal:
            pattern, literal = f"{pattern}'{literal}'", ""
        if not token.startswith("%"):
            pattern += "''" if token == "'" else token
            continue
        if token not in DIRECTIVES:
            raise ValueError(f"unsupported timestamp directive {token!r}")
        letters = DIRECTIVES[token]
        touching = {tokens[j] for j in (at - 1, at + 1) if 0 <= j < len(tokens)}
        if len(letters) == 1 and token in _DIGIT_FIELDS and touching & _DIGIT_FIELDS:
            letters *= 3 if token == "%j" else 2
        pattern += letters
    return f"{pattern}'{literal}'" if literal else pattern


def _dashed(text: Column) -> Column:
    """Dates written with slashes, in the form the cast reads."""
    slashed = r"^(\s*\d{4})/(\d{1,2})/(\d{1,2})"
    return F.when(text.contains("/"), F.regexp_replace(text, slashed, "$1-$2-$3")).otherwise(text)


def parse_local(text: Column, fmt: str | None = None) -> Column:
    """Timestamp as written, without a zone; NULL when it cannot be read."""
    if fmt is not None:
        return F.try_to_timestamp(text, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")
    return F.when(text.rlike(DATE_SHAPE), _dashed(text).try_cast("timestamp_ntz"))


def is_aware(text: Column) -> Column:
    """Does the text carry its own zone? Short tests come first, so that most rows stop early."""
    trimmed = F.trim(text)
    offset = F.right(trimmed, F.lit(6)).rlike(OFFSET_TAIL) & trimmed.rlike(TIMED_OFFSET)
    named = trimmed.contains("/") & trimmed.rlike(ZONE_NAME)
    letters = trimmed.rlike("[TtCc]") & trimmed.rlike(UNIVERSAL)
    return trimmed.endswith("Z") | trimmed.endswith("z") | offset | named | letters


def parse_utc(text: Column, source_timezone: str, fmt: str | None = None) -> Column:
    """UTC fields: a zone in the text wins, other values are read in the source zone."""
    if fmt is None:
        instant = F.when(text.rlike(DATE_SHAPE), _dashed(text).try_cast("timestamp"))
    else:
        instant = F.try_to_timestamp(text, F.lit(spark_pattern(fmt)))
    local = parse_local(text, fmt)
    shifted = F.to_utc_timestamp(local.cast("timestamp"), source_timezone)
    return F.when(is_aware(text), instant).otherwise(shifted).cast("timestamp_ntz")


def in_zone(utc: Column, zone: str) -> Column:
    """Display text of a UTC timestamp in another zone."""
    local = F.from_utc_timestamp(utc.cast("timestamp"), zone)
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.when(utc.isNotNull(), F.lit(zone)))


def check_timezone(spark: SparkSession, zone: str) -> None:
    """Reject a zone name that is not an IANA zone before it is saved."""
    probe = spark.range(1).select(
        F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit("2026-01-01").cast("timestamp_ntz"))
    )
    try:
        probe.first()
    except Exception as error:
        raise ValueError(f"unknown time zone {zone!r}") from error


def check_format(spark: SparkSession, fmt: str) -> None:
    """Reject a format that Spark cannot use before it is saved."""
    pattern = spark_pattern(fmt)
    try:
        spark.range(1).select(F.try_to_timestamp(F.lit("x"), F.lit(pattern))).first()
    except Exception as error:
        raise ValueError(f"unusable timestamp format {fmt!r}") from error
