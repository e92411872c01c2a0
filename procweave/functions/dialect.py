"""Functions of T-SQL and PL/SQL as Spark column expressions, for rewriting procedures by hand.

Where the dialects differ from Spark the docstring says how: Oracle takes '' for null, SUBSTR and INSTR take negative
positions, and DECODE finds null equal to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isnull(value: Column, default: Column) -> Column:
    """T-SQL ISNULL(a, b), Oracle NVL(a, b)."""
    return F.coalesce(value, default)


def nvl2(value: Column, if_set: Column, if_null: Column) -> Column:
    return F.when(value.isNotNull(), if_set).otherwise(if_null)


def decode(value: Column, *pairs: Column) -> Column:
    """Oracle DECODE(value, s1, r1, ..., [default]); null matches null."""
    default = pairs[-1] if len(pairs) % 2 else F.lit(None)
    found = default
    for search, result in reversed(list(zip(pairs[0::2], pairs[1::2], strict=False))):
        found = F.when(value.eqNullSafe(search), result).otherwise(found)
    return found


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def eomonth(value: Column, months: int = 0) -> Column:
    """The last day of the month, at midnight: later times of that day are after it."""
    return F.last_day(F.add_months(value, months))


def trunc_date(value: Column, unit: str = "DD") -> Column:
    """Oracle TRUNC(date [, unit])."""
    return F.date_trunc(unit, value)


#: Date pattern elements of Oracle and of Spark.
DATE_PATTERN = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss"}


def date_pattern(oracle: str) -> str:
    """Translate an Oracle date pattern; longer elements first, so that none is cut in two."""
    out, at = "", 0
    names = sorted(DATE_PATTERN, key=len, reverse=True)
    while at < len(oracle):
        name = next((n for n in names if oracle.upper().startswith(n, at)), None)
        out += DATE_PATTERN[name] if name else oracle[at]
        at += len(name) if name else 1
    return out


def to_date(value: Column, pattern: str) -> Column:
    return F.to_timestamp(value, date_pattern(pattern))


def to_char(value: Column, pattern: str) -> Column:
    return F.date_format(value, date_pattern(pattern))


def substr(value: Column, start: int, length: int | None = None) -> Column:
    """Oracle SUBSTR: position 0 counts as 1, negative positions count from the end; null if the result is empty."""
    begin = F.lit(1 if start == 0 else start)
    cut = F.substr(value, begin) if length is None else F.substr(value, begin, F.lit(length))
    kept = cut if start >= 0 else F.when(F.length(value) >= -start, cut)
    return F.nullif(kept, F.lit(""))


def instr(value: Column, wanted: str, start: int = 1) -> Column:
    """The position of wanted at or after start, 0 if there is none."""
    return F.locate(wanted, value, start)


def to_number(value: Column) -> Column:
    """Null where the text is no number, as ON CONVERSION ERROR does."""
    return value.try_cast("decimal(38,10)")


def concat(*parts: Column) -> Column:
    """Oracle ||: null counts as the empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def plus(*parts: Column) -> Column:
    """T-SQL + on texts: null if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def snake_case(name: Column) -> Column:
    """OrderItems becomes order_items."""
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def pascal_case(name: Column, keep_tail: bool = True) -> Column:
    """order_items becomes OrderItems; without keep_tail the rest of each word is lower-cased (the coded behaviour)."""
    words = F.filter(F.split(F.replace(name, F.lit("-"), F.lit("_")), "_"), lambda w: w != "")

    def capital(w):
        rest = F.substr(w, F.lit(2))
        return F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), rest if keep_tail else F.lower(rest))

    return F.array_join(F.transform(words, capital), "")


def camel_case(name: Column, keep_tail: bool = True) -> Column:
    pascal = pascal_case(name, keep_tail)
    return F.concat(F.lower(F.substr(pascal, F.lit(1), F.lit(1))), F.substr(pascal, F.lit(2)))


def service_stem(name: Column) -> Column:
    """A procedure's name without its customary prefix."""
    return F.regexp_replace(name, "^(?i)(sp_|usp_|proc_)", "")
