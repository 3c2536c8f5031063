"""Typed views of a cell: numbers, wall-clock times, digests, quoted names."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T


def quote_name(name: str) -> str:
    """SQL reference to a top-level column, whatever characters its name holds."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def normalize(df: DataFrame) -> DataFrame:
    """Turn NaN into null in float and double columns, so that missing has one spelling."""
    floating = (T.FloatType, T.DoubleType)
    if not any(isinstance(f.dataType, floating) for f in df.schema.fields):
        return df
    return df.selectExpr(
        *[
            f"nanvl({c}, CAST(NULL AS {f.dataType.simpleString()})) AS {c}"
            if isinstance(f.dataType, floating)
            else c
            for f in df.schema.fields
            for c in [quote_name(f.name)]
        ]
    )


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def round1(x: float) -> float:
    """One decimal, ties away from zero: the same doubles as :func:`round1_sql`."""
    return math.floor(x * 10 + 0.5) / 10


def round1_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 10e0 + 0.5e0) AS DOUBLE) / 10e0"


def as_number(c: str, data_type: T.DataType) -> str:
    """Double view of a cell; what cannot be read as a number becomes null."""
    if is_numeric(data_type):
        return f"CAST({c} AS DOUBLE)"
    if not is_string(data_type):
        return "CAST(NULL AS DOUBLE)"
    # "1d" and "1f" are Java literals, not numbers in data.
    text = rf"CASE WHEN NOT {c} RLIKE r'[0-9.][dDfF]\s*$' THEN {c} END"
    return f"nanvl(try_cast({text} AS DOUBLE), CAST(NULL AS DOUBLE))"


_FIRST_TIME = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"
_LAST_TIME = "TIMESTAMP_NTZ'9999-12-31 23:59:59.999999'"
_MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
# The forms of written dates as one pattern; its groups are, by form: day or month, separator, month
# or day, year (twice) | year, separator, month, day | year, month, day | day, name, year | name, day,
# year, what follows of all these | ISO text and what follows.
_DATE_FORMS = (
    r"(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})|(\d{1,2})\.(\d{1,2})\.(\d{4})"
    r"|(\d{4})([/.])(\d{1,2})\9(\d{1,2})|((?:19|20)\d\d)(\d\d)(\d\d)"
    rf"|(\d{{1,2}})[ -]({_MONTHS})\.?,?[ -]+(\d{{4}})|({_MONTHS})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})"
)
_DATE = rf"(?i)^\s*(?:(?:{_DATE_FORMS})((?:[T ].*)?)\s*|(?!0+[-/]\d+[-/])(\d{{1,4}}-\d[\d-]*)([\s\S]*))$"
_MATCHED = "\x01"  # stands first where the pattern matched
# year | day or month | month or day | month | its name | day | ISO text | what follows
_DATE_PARTS = f"{_MATCHED}|$4$7$8$12$17$20|$1$5|$3$6|$10$13|$16$18|$11$14$15$19|$22|$21$23"
_CLOCK = r"(?i)^.*?[T ]\s*(\d{1,2})(:\d.*?)\s*(?:([ap])\.?m\.?)?\s*$"
_ISO_TIME = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?$"
# Long texts and words are told apart by their first characters, before the forms are tried.
_LOOKS_DATED = rf"(?i)^\s*(?:\d{{1,8}}(?:\D|$)|(?:{_MONTHS})\.? +\d)"
_BOTH_ORDERS = "STRUCT<month_first: TIMESTAMP_NTZ, day_first: TIMESTAMP_NTZ>"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _twice(x: str) -> str:
    return f"named_struct('month_first', {x}, 'day_first', {x})"


def written_time(c: str) -> str:
    """The time written in a text cell, ``STRUCT<month_first, day_first>``, by one match of one pattern.

    Texts may be ISO, ``y/m/d``, ``y.m.d``, ``yyyymmdd``, ``5 Jan 2024``, ``Jan 5, 2024``, and two numbers
    and a year with slashes, dashes or dots, where the two readings differ; two-digit years (not with dots)
    are 1969 to 2068.  A time may follow, with AM or PM; its offset from UTC is left out.  A bare ``75001`` is a
    postcode, not a year.
    """
    year = "CASE WHEN length(f[1]) != 2 THEN f[1] WHEN f[1] < '69' THEN concat('20', f[1]) ELSE concat('19', f[1]) END"
    month = f"IF(f[5] = '', f[4], CAST((instr('{_MONTH_STARTS}', lower(left(f[5], 3))) + 2) DIV 3 AS STRING))"
    hour = "CASE lower(k[3]) WHEN 'p' THEN CAST(CAST(k[1] AS INT) % 12 + 12 AS STRING) WHEN 'a' THEN CAST(CAST(k[1] AS INT) % 12 AS STRING) ELSE k[1] END"
    parts_of_clock = f"split(regexp_replace(f[8], r'{_CLOCK}', '{_MATCHED}|$1|$2|$3'), r'\\|')"
    clock = _let(parts_of_clock, "k", f"IF(k[0] = '{_MATCHED}' AND size(k) = 4, concat(' ', {hour}, k[2]), '')")

    def time(*numbers: str) -> str:
        return f"try_cast(concat_ws('-', {', '.join(numbers)}) || t AS TIMESTAMP_NTZ)"

    plain = f"CASE WHEN f[7] != '' THEN try_cast(f[7] || t AS TIMESTAMP_NTZ) ELSE {time(year, month, 'f[6]')} END"
    two = f"named_struct('month_first', {time(year, 'f[2]', 'f[3]')}, 'day_first', {time(year, 'f[3]', 'f[2]')})"
    either = f"IF(f[2] != '', {two}, {_let(plain, 'x', _twice('x'))})"
    timed = _let(f"IF(f[8] = '', '', {clock})", "t", either)
    parts = f"split(regexp_replace({c}, r'{_DATE}', '{_DATE_PARTS}'), r'\\|', 9)"
    read = _let(parts, "f", f"IF(f[0] = '{_MATCHED}', {timed}, NULL)")
    iso = _let(f"try_cast({c} AS TIMESTAMP_NTZ)", "x", _twice("x"))
    return f"CAST(CASE WHEN {c} RLIKE r'{_ISO_TIME}' THEN {iso} WHEN {c} RLIKE r'{_LOOKS_DATED}' THEN {read} END AS {_BOTH_ORDERS})"


def as_wall_time(c: str, data_type: T.DataType, day_first: bool = False) -> str:
    """TIMESTAMP_NTZ view of a cell; unreadable values and years past 9999 become null.

    Texts are read by :func:`written_time`.
    """
    if is_temporal(data_type):
        wall = f"CAST({c} AS TIMESTAMP_NTZ)"
        return f"CASE WHEN {wall} BETWEEN {_FIRST_TIME} AND {_LAST_TIME} THEN {wall} END"
    if not is_string(data_type):
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    return f"({written_time(c)}).{'day_first' if day_first else 'month_first'}"


def with_written_times(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the :func:`written_time` of the named text columns, and where each is found.

    As columns of their own they are parsed once a cell, however many aggregates use them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    prefix = "__written_"
    while any(n.startswith(prefix) for n in types):
        prefix += "_"
    texts = [n for n in dict.fromkeys(names) if n in types and is_string(types[n])]
    at = {n: f"`{prefix}{i}`" for i, n in enumerate(texts)}
    if not at:
        return df, at
    return df.selectExpr("*", *[f"{written_time(quote_name(n))} AS {t}" for n, t in at.items()]), at


def day_comes_first(written: str) -> str:
    """Aggregate: more cells of a column can be read only with the day first than only with the month first."""
    day, month = f"{written}.day_first", f"{written}.month_first"
    return f"count_if({month} IS NULL AND {day} IS NOT NULL) > count_if({day} IS NULL AND {month} IS NOT NULL)"


def of_times(aggregate: str, c: str, data_type: T.DataType, written: str | None = None) -> str:
    """An aggregate over the times of a column, ``{0}`` in ``aggregate``.

    In a text column the order of day and month is that of most cells that can be read in one order only,
    so a stray cell of the other order costs that cell.  ``written`` is where its times are found
    (:func:`with_written_times`).
    """
    if not is_string(data_type):
        return aggregate.format(as_wall_time(c, data_type))
    written = written or f"({written_time(c)})"
    first, second = (aggregate.format(f"{written}.{order}") for order in ("day_first", "month_first"))
    return f"CASE WHEN {day_comes_first(written)} THEN {first} ELSE {second} END"


# ------------------------------------------------------------------ digests

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EIGHT_BYTES = (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.CalendarIntervalType)
_JSON_OPTIONS = (
    "map('ignoreNullFields', 'false',"
    " 'timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS',"
    " 'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
)


def digest(c: str, data_type: T.DataType) -> tuple[str, str]:
    """128-bit key of a cell as two BIGINT fragments; equal cells have equal keys.

    Integers are their own key, and values of 8 bytes need one fragment.  Others are hashed with two seeds: two of n distinct
    values share a key with probability about n^2 / 2^129 (1.5e-15 for 10^12 values), and a
    long text costs 16 bytes in a shuffle.  The key of a null cell means nothing.
    """
    if isinstance(data_type, _INTEGRAL):
        return f"CAST({c} AS BIGINT)", "0L"
    inputs = _hash_inputs(c, data_type)
    if isinstance(data_type, _EIGHT_BYTES):
        return f"xxhash64({inputs})", "0L"  # this hash tells all values of 8 bytes apart
    return f"xxhash64(1, {inputs})", f"xxhash64(2, {inputs})"


def packed(c: str, data_type: T.DataType) -> tuple[str, str, str]:
    """Key of a cell as (word, kind, bit): up to 64 neighbouring values share a word and kind, each with its bit.

    Numbers with an order of their own are split so: integers, dates, times (by whole days, else whole
    seconds, else microseconds), and doubles with at most two decimals, each of which is told apart from
    all other values of its column.  ``bit_or`` of the bits counts the distinct values of a word, so a
    dense column needs a 64th of the records and a sparse one no more than one a value.  All others have their
    :func:`digest` and one bit.
    """
    if isinstance(data_type, _INTEGRAL):
        return _word(f"CAST({c} AS BIGINT)", 0)
    if isinstance(data_type, T.DateType):
        return _word(f"CAST(unix_date({c}) AS BIGINT)", 0)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        micros = f"unix_micros({c})" if isinstance(data_type, T.TimestampType) else f"timestampdiff(MICROSECOND, {zero}, {c})"
        kinds = [(f"{micros} % {unit} = 0", _word(f"({micros} DIV {unit})", kind)) for kind, unit in ((1, 86_400_000_000), (2, 1_000_000))]
        return _first_that_fits(kinds, _word(micros, 0))
    if isinstance(data_type, T.DoubleType):
        cents = f"rint({c} * 100)"
        fits = f"abs({c}) < 1e15 AND {cents} / 100 = {c}"
        return _first_that_fits([(fits, _word(f"CAST({cents} AS BIGINT)", 1))], (*digest(c, data_type), "1L"))
    return *digest(c, data_type), "1L"


def _word(x: str, kind: int) -> tuple[str, str, str]:
    return f"shiftright({x}, 6)", f"{kind}L", f"shiftleft(1L, CAST({x} & 63 AS INT))"


def _first_that_fits(kinds: list[tuple[str, tuple[str, str, str]]], other: tuple[str, str, str]) -> tuple[str, str, str]:
    parts = []
    for i in range(3):
        whens = " ".join(f"WHEN {fits} THEN {key[i]}" for fits, key in kinds)
        parts.append(f"CASE {whens} ELSE {other[i]} END")
    return tuple(parts)


def row_digest(keys: list[tuple[str, str, str]]) -> tuple[str, str]:
    """Key of a whole row from (cell, high, low) references to its cells and their keys.

    Spark hashes skip nulls, so a null flag goes in before each key.
    """
    chain = ", ".join(f"{cell} IS NULL, {high}, {low}" for cell, high, low in keys)
    return f"xxhash64(1, {chain})", f"xxhash64(2, {chain})"


def _hash_inputs(c: str, data_type: T.DataType) -> str:
    """Hash arguments that tell two values of a type apart.

    Hashes skip nulls and array bounds: arrays add their size and null flags, and deeper
    nesting goes through JSON text.
    """
    if isinstance(data_type, T.CalendarIntervalType):
        return f"CAST({c} AS STRING)"  # its hash leaves out the days
    if isinstance(data_type, T.ArrayType) and not isinstance(data_type.elementType, _NESTED):
        flags = f", transform({c}, e -> e IS NULL)" if data_type.containsNull else ""
        return f"size({c}){flags}, {c}"
    if isinstance(data_type, T.VariantType):
        return f"to_json({c})"
    if isinstance(data_type, _NESTED):
        return f"to_json(named_struct('v', {_canonical(c, data_type)}), {_JSON_OPTIONS})"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"{c} + 0e0"  # -0.0 equals 0.0
    return c


def _canonical(c: str, data_type: T.DataType, depth: int = 0) -> str:
    """Rewrite maps as sorted entry arrays and variants as JSON text, at any depth."""
    e = f"e{depth}"
    if isinstance(data_type, T.MapType):
        key = _canonical(f"{e}.key", data_type.keyType, depth + 1)
        value = _canonical(f"{e}.value", data_type.valueType, depth + 1)
        entry = f"named_struct('k', {key}, 'v', {value})"
        return f"array_sort(transform(map_entries({c}), {e} -> {entry}))"
    if isinstance(data_type, T.ArrayType):
        return f"transform({c}, {e} -> {_canonical(e, data_type.elementType, depth + 1)})"
    if isinstance(data_type, T.StructType) and data_type.fields:
        fields = ", ".join(
            f"{sql_text(f.name)}, "
            + _canonical(f"{c}.{quote_name(f.name)}", f.dataType, depth + 1)
            for f in data_type.fields
        )
        return f"CASE WHEN {c} IS NOT NULL THEN named_struct({fields}) END"
    if isinstance(data_type, T.VariantType):
        return f"to_json({c})"
    if isinstance(data_type, T.CalendarIntervalType):
        return f"CAST({c} AS STRING)"
    return c
