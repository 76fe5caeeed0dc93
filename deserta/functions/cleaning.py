"""Cleaning and coercion expressions (D1, D4-D9). All return Columns; nothing runs in Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _to_double(text: Column) -> Column:
    # ANSI mode throws on cast('NA' as double); try_cast gives NULL like the non-ANSI cast the source relied on.
    return text.try_cast("double")


def clean_survey_number(col) -> Column:
    """Survey text -> double.

    ``(12.3)`` (an estimate) -> 12.3; ``*`` (suppressed) -> NULL; otherwise spaces removed and cast.
    The ``*`` test is on the untrimmed value, so `` * `` falls through to the cast, which also gives NULL.
    Apply to string columns only: comparing a double column with '*' raises under ANSI mode.
    """
    c = _c(col)
    trimmed = F.trim(c)
    return (
        F.when(trimmed.rlike(r"^\(.*\)$"), _to_double(F.regexp_replace(trimmed, r"[() ]", "")))
        .when(c == F.lit("*"), F.lit(None).cast("double"))
        .otherwise(_to_double(F.regexp_replace(trimmed, " ", "")))
    )


def normalize_key(col, mode: str = "upper") -> Column:
    """Join-key normalisation.

    ``upper``: UPPER(TRIM(x)) (spaces only, like SQL TRIM); ``trim``: TRIM only, case-sensitive;
    ``js``: strip all leading/trailing whitespace (tabs, newlines) like a script-side trim.
    """
    c = _c(col)
    if mode == "upper":
        return F.upper(F.trim(c))
    if mode == "trim":
        return F.trim(c)
    if mode == "js":
        return F.regexp_replace(c, r"^\s+|\s+$", "")
    raise ValueError(f"unknown key mode {mode!r}")


# Fixed value: what counts as a number in text (no "1d", "NaN" or "Infinity").
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def numeric_text(col) -> Column:
    """The cell's text where it is written as a number, else NULL."""
    text = _c(col).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def coerce_number_sql(name: str, default: float | None = 0.0) -> str:
    """SQL text of ``coerce_number`` for a column name."""
    text = f"cast(`{name}` AS STRING)"
    parsed = f"CASE WHEN rlike({text}, r'{NUMBER_PATTERN}') THEN try_cast(trim({text}) AS DOUBLE) END"
    finite = f"CASE WHEN abs({parsed}) < double('inf') THEN {parsed} END"
    return finite if default is None else f"coalesce({finite}, CAST({float(default)!r} AS DOUBLE))"


def coerce_number(col, default: float | None = 0.0) -> Column:
    """Finite number from a number-or-string cell; blank, malformed, NaN and +-inf give ``default``.
    For a column name the expression is built from SQL text in one call."""
    if isinstance(col, str):
        return F.expr(coerce_number_sql(col, default))
    parsed = finite_or_null(numeric_text(col).try_cast("double"))
    return F.coalesce(parsed, F.lit(default).cast("double")) if default is not None else parsed


def coerce_string_sql(name: str) -> str:
    return f"coalesce(regexp_replace(cast(`{name}` AS STRING), '^\\\\s+|\\\\s+$', ''), '')"


def coerce_string(col) -> Column:
    """Trimmed text (all whitespace) or ''."""
    if isinstance(col, str):
        return F.expr(coerce_string_sql(col))
    return F.coalesce(normalize_key(col.cast("string"), "js"), F.lit(""))


def coordinate(col, limit: float) -> Column:
    """D7 helper: a latitude (``limit`` 90) or longitude (180) text or number as double; NULL when missing, 'NA',
    malformed, not finite or out of range."""
    degrees = numeric_text(col).try_cast("double")
    return F.when(F.abs(degrees) <= F.lit(float(limit)), degrees)


def null_default(col, default: str) -> Column:
    """NULL text -> a default word ('unknown', 'none')."""
    return F.coalesce(_c(col), F.lit(default))


# ---- D9 display labels -------------------------------------------------------------------------------------------

def snake_label(col) -> Column:
    """``snake_case`` -> parts with an upper-cased first letter joined by spaces (rest kept); NULL/'' -> 'Unknown'."""
    c = _c(col)
    parts = F.transform(F.split(c, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(F.array_join(parts, " "))


def short_label(col, max_len: int = 28, keep: int = 25) -> Column:
    """Collapse whitespace runs to one space and trim; longer than ``max_len`` -> first ``keep`` chars + '...'."""
    text = F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s+", " "))
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def list_preview(col, n: int = 3, max_chars: int = 180) -> Column:
    """Preview of a text field: a JSON list shows its first ``n`` items joined by ', '; other text is cut to
    ``max_chars`` characters with '...' appended; NULL or '' -> ''."""
    c = F.coalesce(_c(col), F.lit(""))
    as_list = F.from_json(c, "array<string>")
    listed = F.array_join(F.slice(as_list, 1, n), ", ")
    plain = F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("..."))).otherwise(c)
    return F.when(F.trim(c).startswith("[") & as_list.isNotNull(), listed).otherwise(plain)
