"""Text, date, code and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_decimals(number: Column) -> Column:
    """Digits after the point of a number as text, without trailing zeros; none counts 0."""
    return F.length(F.regexp_replace(F.coalesce(F.split_part(number, F.lit("."), F.lit(2)), F.lit("")), "0+$", ""))


def range_mid(text: Column) -> Column:
    """The middle of a range as text: '5-15' 10, '<1' half, '>95-100' 97.5, '>75%' halfway to 100, 'trace', 'tr' and 'few' 0.25, a number itself."""
    t = F.lower(F.regexp_replace(text, "[% ]", ""))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+\.?\d*)"), F.lit(1)), lambda x: x.cast("double"))
    first, second = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    return (
        F.when(t.isin("trace", "tr", "few"), F.lit(0.25))
        .when(t.startswith("<"), first / 2)
        .when(second.isNotNull(), (first + second) / 2)
        .when(t.startswith(">"), (first + 100) / 2)
        .otherwise(first)
    )


def normalised(name: Column) -> Column:
    """Lower case, the marks [provisional] and (provisional) dropped, and then all but letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\[provisional\]|\(provisional\)", ""), "[^a-z0-9]", "")


def padded_id(parts: list[Column], widths: list[int], sep: str = "_") -> Column:
    """Numbers as one id, each with leading zeros up to its width; longer ones stay whole."""
    padded = [F.when(F.length(c.cast("string")) >= w, c.cast("string")).otherwise(F.lpad(c.cast("string"), w, "0")) for c, w in zip(parts, widths, strict=True)]
    return F.when(F.forall(F.array(*padded), lambda x: x.isNotNull()), F.concat_ws(sep, *padded))


def tag(name: Column) -> Column:
    """A name fit for a file or column: each run of characters other than letters, digits, _ . - as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\w.-]+", "_"), "^_+|_+$", "")


def genus(name: Column) -> Column:
    """The first word of a scientific name."""
    return F.nullif(F.split_part(F.trim(name), F.lit(" "), F.lit(1)), F.lit(""))


def date_of(text: Column) -> Column:
    """The day of a date or time as text in UTC; null where it is none."""
    return F.coalesce(F.try_to_timestamp(text).cast("date"), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))


def clipped_year(year: Column, first: int, last: int) -> Column:
    """A year, rounded half to even, within the years that there is data of."""
    return F.when(year.isNotNull(), F.least(F.greatest(F.bround(year.cast("double")), F.lit(first)), F.lit(last))).cast("int")


def year_fraction(day: Column) -> Column:
    """A date as a fraction of its year, at most 1."""
    return F.when(day.isNotNull(), F.least((F.dayofyear(day) - 1) / 365.0, F.lit(1.0)))


def plausible_date(day: Column, first: int = 1975, last: int = 2025) -> tuple[Column, Column]:
    """(the date, or null if its year is out of bounds; whether it was)."""
    bad = F.coalesce(~F.year(day).between(first, last), F.lit(False))
    return F.when(~bad, day), bad


def batched_code(batch: Column, code: Column, depth: int) -> Column:
    """A curve code of 3 * depth bits behind its batch number, so that one sort orders batches first."""
    return F.shiftleft(batch.cast("long"), 3 * depth).bitwiseOR(code)


def unbatched_code(code: Column, depth: int) -> tuple[Column, Column]:
    return F.shiftright(code, 3 * depth), code.bitwiseAND((1 << 3 * depth) - 1)


def number_in(text: Column) -> Column:
    """The first number in a text such as '20 m'."""
    return F.regexp_extract(text, r"(-?\d+\.?\d*)", 1).try_cast("double")


def distinct_flags(flags: Column) -> Column:
    """A ';' list without empty or repeated entries, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(flags, ";"), lambda x: F.trim(x)), lambda x: x != "")), ";")


def collection_year(start: Column, end: Column, name: Column) -> Column:
    """Of the start, else the end, else the name's last four characters."""
    return F.coalesce(F.year(start), F.year(end), F.right(name, F.lit(4)).try_cast("int"))


def leaf_on(start: Column, end: Column) -> Column:
    """True if all months touched are June to September, false if all are December to March, else null."""
    months = F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH")), F.month)
    return F.when(F.forall(months, lambda m: m.isin(6, 7, 8, 9)), True).when(F.forall(months, lambda m: m.isin(12, 1, 2, 3)), False)


def gps_seconds(time: Column, leap: int = 18) -> Column:
    """Adjusted GPS seconds of a time: seconds since 1970 and leap seconds, less 10**9."""
    return F.floor(F.unix_micros(time) / 1_000_000) - 1_000_000_000 + leap


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three numbers below 2**16: bit i of x at 3i + 2, of y at 3i + 1, of z at 3i."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(0xFFFF)
        for shift, mask in ((16, 0x00FF0000FF0000FF), (8, 0x00F00F00F00F00F), (4, 0x30C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def unmorton(code: Column) -> tuple[Column, Column, Column]:
    """The three numbers of a Morton code."""

    def gather(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(0x1249249249249249).cast("long"))
        for shift, mask in ((2, 0x30C30C30C30C30C3), (4, 0x00F00F00F00F00F), (8, 0x00FF0000FF0000FF), (16, 0xFFFF)):
            v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return gather(F.shiftright(code, 2)), gather(F.shiftright(code, 1)), gather(code)


def dequantised(v: Column, nodata: int = -128) -> Column:
    """(v / 127.5)^2 with v's sign; nodata is null."""
    return F.when(v != nodata, F.signum(v) * F.pow(v / 127.5, F.lit(2)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its norm; null if that is zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def md5_uniform(key: Column) -> Column:
    """A number in [0, 1) from a text: the first 13 hexadecimal digits of its MD5, over 2**52."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation as an aggregate; null where either side does not vary, which is no error."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))
