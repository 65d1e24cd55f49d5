"""The @formats: values as CSV, TSV, HTML, URI, shell and Base64 text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.values import let, number_text

#: What HTML and TSV text is escaped with, in this order.
HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")]
TSV = [("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")]


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def html(s: Column) -> Column:
    return _replaced(s, HTML)


def uri(s: Column) -> Column:
    """Everything but letters, digits and -_.~ as %XX."""
    return _replaced(F.url_encode(s), [("+", "%20"), ("*", "%2A"), ("%7E", "~")])


def urid(s: Column) -> Column:
    """%XX decoded; a plus sign stays. Raises on a bad escape."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def shell(s: Column) -> Column:
    """A string in single quotes."""
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def shell_line(values: Column) -> Column:
    """Strings in single quotes with spaces between."""
    return F.array_join(F.transform(values, shell), " ")


def base64(s: Column) -> Column:
    return F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit(""))


def base64d(s: Column) -> Column:
    """Decoded up to the first =; missing padding is accepted and bad UTF-8 is replaced. Other characters than those of the alphabet,
    and one character left over, are errors."""

    def decoded(text: Column) -> Column:
        size = F.length(text)
        # bytes are missing where white space was skipped
        good = lambda found: (size % 4 != 1) & (F.octet_length(found) == F.floor(size * 3 / 4))
        error = F.raise_error(F.concat(F.lit("string ("), text, F.lit(") is not valid base64 data"))).cast("string")
        padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-size, F.lit(4))))
        return let(F.try_to_binary(padded, F.lit("base64")), lambda found: F.when(text.isNull() | F.coalesce(good(found), F.lit(False)), F.make_valid_utf8(found.cast("string"))).otherwise(error))

    return let(F.substring_index(s, "=", 1), decoded)


def csv_cell(x: Column, kind: str) -> Column:
    """A cell: strings in double quotes, null and NaN empty."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    shown = F.when(F.isnan(x.cast("double")), "").otherwise(number_text(x)) if kind == "number" else x.cast("string")
    return F.when(x.isNull(), "").otherwise(shown)


def tsv_cell(x: Column, kind: str) -> Column:
    return F.coalesce(_replaced(x, TSV), F.lit("")) if kind == "string" else csv_cell(x, kind)


def csv(cells: list[tuple[Column, str]]) -> Column:
    """A row of (column, kind) cells; kinds as in csv_cell()."""
    return F.concat_ws(",", *[csv_cell(x, kind) for x, kind in cells])


def tsv(cells: list[tuple[Column, str]]) -> Column:
    return F.concat_ws("\t", *[tsv_cell(x, kind) for x, kind in cells])


def interpolated(parts: list[str | Column], form=lambda x: x) -> Column:
    """Literal text and values in turn, each value put through a format first."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else form(p) for p in parts])
