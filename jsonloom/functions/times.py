"""Times: seconds since 1970 in UTC, and broken-down times, arrays of year, month from 0, day, hour, minute, second with its
fraction, weekday from Sunday and day of the year from 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.values import let

#: Directives of a date as Spark's datetime patterns.
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "j": "DDD", "a": "E", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM", "y": "yy", "F": "yyyy-MM-dd", "D": "MM/dd/yy"}
#: Directives that stand for several others.
LONG = {"T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d", "D": "%m/%d/%y", "c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "r": "%I:%M:%S %p"}
#: What directives read, as regular expressions with one group each.
READS = {"Y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"\s*(\d{1,2})", "e": r"\s*(\d{1,2})", "H": r"\s*(\d{1,2})", "k": r"\s*(\d{1,2})", "I": r"\s*(\d{1,2})", "l": r"\s*(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "j": r"(\d{1,3})", "y": r"(\d{2})", "p": r"([AaPp][Mm])",
         "a": r"([A-Za-z]{3,})", "A": r"([A-Za-z]{3,})", "b": r"([A-Za-z]{3,})", "B": r"([A-Za-z]{3,})", "h": r"([A-Za-z]{3,})", "Z": r"([A-Za-z]+)", "z": r"([+-]\d{2}:?\d{2}|Z)", "s": r"(-?\d+)", "%": "(%)"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def epoch() -> Column:
    return F.lit("1970-01-01").cast("date")


def seconds(t: Column) -> Column:
    """A timestamp without zone as seconds since 1970, whatever the session's time zone."""
    span = t.cast("timestamp_ntz") - epoch().cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), span)
    return part("DAY").cast("double") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND").cast("double")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date whose month may be out of range."""
    year, month = year + F.floor((month - 1) / 12), F.pmod(month - 1, F.lit(12)) + 1
    return F.datediff(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1


def mktime(broken: Column) -> Column:
    """Seconds of a broken-down time; fractions are cut, days and times out of range carry over. The results -1 and -2 stand for
    failures and raise."""
    return let(let(broken, _mktime), lambda found: F.when(found.isin(-1, -2), F.raise_error(F.lit("invalid gmtime representation")).cast("bigint")).otherwise(found))


def _mktime(broken: Column) -> Column:
    at = lambda i: F.coalesce(F.get(broken, F.lit(i)), F.lit(0)).cast("bigint")
    return days_from_civil(at(0), at(1) + 1, F.when(F.size(broken) > 2, at(2)).otherwise(F.lit(1))) * 86400 + at(3) * 3600 + at(4) * 60 + at(5)


def gmtime(s: Column) -> Column:
    """The broken-down time of seconds; the whole part goes toward zero, the fraction is that above the floor."""
    return let(s.cast("double"), _gmtime)


def _gmtime(s: Column) -> Column:
    whole = F.when(s < 0, F.ceil(s)).otherwise(F.floor(s))
    date = F.date_add(epoch(), F.floor(whole / 86400).cast("int"))
    return let(F.struct(date.alias("date"), F.pmod(whole, F.lit(86400)).alias("rest"), (s - F.floor(s)).alias("part")), _broken)


def _broken(t: Column) -> Column:
    date, rest = t["date"], t["rest"]
    parts = [F.year(date), F.month(date) - 1, F.dayofmonth(date), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60 + t["part"], F.dayofweek(date) - 1, F.dayofyear(date) - 1]
    return F.array(*[p.cast("double") for p in parts])


def strftime(s: Column, form: str) -> Column:
    """Seconds by a format of the directives in PATTERNS, H I M S p T R, and e k l s u w C V G U W n t Z z c x X r and %%. Flags of
    %-d and %_d kind leave out the padding or pad with spaces. The session's time zone plays no part."""
    whole = F.floor(s.cast("double"))
    day, rest = F.date_add(epoch(), F.floor(whole / 86400).cast("int")), F.pmod(whole, F.lit(86400))
    hour, hour12 = F.floor(rest / 3600), F.pmod(F.floor(rest / 3600) + 11, F.lit(12)) + 1
    numbers = {
        "H": (hour, 2, "0"), "I": (hour12, 2, "0"), "M": (F.floor(rest % 3600 / 60), 2, "0"), "S": (rest % 60, 2, "0"), "e": (F.dayofmonth(day), 2, " "), "k": (hour, 2, " "), "l": (hour12, 2, " "), "C": (F.floor(F.year(day) / 100), 2, "0"), "V": (F.weekofyear(day), 2, "0"),
        "U": (F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7), 2, "0"), "W": (F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7), 2, "0"), "m": (F.month(day), 2, "0"), "d": (F.dayofmonth(day), 2, "0"), "j": (F.dayofyear(day), 3, "0"),
        "s": (whole, 1, ""), "u": (F.weekday(day) + 1, 1, ""), "w": (F.dayofweek(day) - 1, 1, ""), "G": (F.extract(F.lit("YEAROFWEEK"), day), 1, ""),
    }
    texts = {"n": F.lit("\n"), "t": F.lit("\t"), "%": F.lit("%"), "Z": F.lit("UTC"), "z": F.lit("+0000"), "p": F.when(hour < 12, "AM").otherwise("PM"), "P": F.when(hour < 12, "am").otherwise("pm")}
    out: list[Column] = []
    for text, flag, directive in re.findall(r"([^%]+)|%([-_0]?)(.)", form, re.S):
        if text:
            out.append(F.lit(text))
        elif directive in numbers:
            number, width, pad = numbers[directive]
            pad = {"_": " ", "0": "0"}.get(flag, pad)
            shown = number.cast("string")
            out.append(shown if flag == "-" or not pad else F.lpad(shown, width, pad))
        elif directive in texts:
            out.append(texts[directive])
        elif directive in LONG:
            out.append(strftime(s, LONG[directive]))
        elif directive in PATTERNS:
            out.append(F.date_format(day, PATTERNS[directive]))
        else:
            raise ValueError(f"%{directive} is not supported")
    return F.concat(*out) if out else F.lit("")


def strptime(text: Column, form: str) -> Column:
    """A text by a format of the directives in READS and LONG, n, t and white space (any, or none) as a broken-down time; raises
    where it doesn't match. Weekday names and zones are read and left aside."""
    for short, long in LONG.items():
        form = form.replace(f"%{short}", long)
    pattern, at = "", {}
    for plain, directive in re.findall(r"([^%]+)|%(.)", form, re.S):
        if plain or directive in "nt":
            pattern += "".join(r"\s*" if re.match(r"\s", x) else re.escape(x) for x in re.findall(r"\s+|[^\s]", plain or " "))
        elif directive in READS:
            at[directive] = len(at) + 1
            pattern += READS[directive]
        else:
            raise ValueError(f"%{directive} is not supported")
    pattern = f"^{pattern}$"
    if not at:
        raise ValueError("the format has no directive")
    parts = F.when(text.isNull() | F.regexp_like(text, F.lit(pattern)), F.struct(*[F.regexp_extract(text, pattern, i).alias(f"d{i}") for i in at.values()]))

    def broken(p: Column) -> Column:
        read = lambda *names: next((p[f"d{at[n]}"] for n in names if n in at), None)
        number = lambda default, *names: F.lit(default).cast("bigint") if read(*names) is None else read(*names).cast("bigint")
        if "s" in at:
            return number(0, "s")
        year = F.when(number(0, "y") < 69, 2000).otherwise(1900) + number(0, "y") if "y" in at else number(1900, "Y")
        month = number(1, "m") - 1
        if (name := read("b", "B", "h")) is not None:
            month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))) - 1
        hour = number(0, "H", "k")
        if "I" in at or "l" in at:
            hour = number(0, "I", "l") % 12 + (F.lit(0) if read("p") is None else F.when(F.lower(read("p")) == "pm", 12).otherwise(0))
        days = (F.lit(0), number(1, "j")) if "j" in at else (month, number(1, "d", "e"))
        return let(F.array(*[x.cast("bigint") for x in (year, *days, hour, number(0, "M"), number(0, "S"))]), _mktime)

    found = let(parts, lambda p: F.when(p.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("date does not match format: "), text)).cast("bigint")).otherwise(broken(p)))
    return gmtime(F.when(text.isNotNull(), found))


def todate(s: Column) -> Column:
    return strftime(s, "%Y-%m-%dT%H:%M:%SZ")


def fromdate(text: Column) -> Column:
    """Seconds of an ISO 8601 text like 2015-03-05T23:51:47Z."""
    return seconds(F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("bigint")


def now() -> Column:
    """Seconds since 1970, the same for all rows of a query."""
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)


def localtime(s: Column, zone: str) -> Column:
    """gmtime() of the clock in a time zone."""
    return gmtime(local_seconds(s, zone))


def local_seconds(s: Column, zone: str) -> Column:
    """Seconds as a clock in a time zone shows them."""
    whole = F.floor(s.cast("double"))
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_seconds(whole), zone)) / F.lit(1e6) + (s - whole)


def strflocaltime(s: Column, form: str, zone: str) -> Column:
    return strftime(local_seconds(s, zone), form)
