"""Lenient conversions, ids in names, dates, windows of pages: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.text import strip, text_of


def number(c: Column) -> Column:
    """M1: text to double with comma or point; blank or bad text is 0."""
    t = F.regexp_replace(strip(text_of(c.cast("string"))), ",", ".")
    return F.coalesce(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")), F.lit(0.0))


def whole(c: Column) -> Column:
    """M2: the number cut to an integer."""
    return number(c).cast("bigint")


def stamp(c: Column) -> Column:
    """M3: text of the fixed format to a timestamp, else null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def duration(seconds: Column) -> Column:
    """M4: HH:MM:SS with unbounded hours; 'n/d' for none."""
    s = F.floor(seconds)
    return F.when(seconds.isNull(), "n/d").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def cost(tokens: Column, per_thousand: Column) -> Column:
    """M5: price of tokens at a rate per thousand."""
    return F.round(tokens / 1000 * per_thousand, 6)


def average(total: Column, count: Column) -> Column:
    """M6: mean that takes a count of 0 as 1; not rounded."""
    return total / F.greatest(count, F.lit(1))


def page_window(total: Column, head: int | Column, tail: int | Column) -> Column:
    """M8: 0-based pages: all, or the first ``head`` and the last ``tail``."""
    head = F.lit(head) if isinstance(head, int) else head
    tail = F.lit(tail) if isinstance(tail, int) else tail
    n = F.coalesce(total, F.lit(0)).cast("int")
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    return F.when(n <= head + tail, upto(zero, n)).otherwise(F.concat(upto(zero, head), upto(F.greatest(n - tail, head), n)))


def first_pages(total: Column, most: int) -> Column:
    """M9: the first pages alone, for a switched-off window."""
    n = F.least(F.coalesce(total, F.lit(0)).cast("int"), F.lit(most))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def effective_test_share(rows: int, classes: int, share: float = 0.25) -> float:
    """The share, raised so that the test set holds a row of each class."""
    return classes / rows if rows and round(rows * share) < classes else share


def stem(name: Column) -> Column:
    """A file name without its folder and last extension."""
    return F.regexp_replace(F.regexp_replace(text_of(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def name_number(name: Column) -> Column:
    """The first number in a file's name, null if none."""
    return F.regexp_extract(F.regexp_replace(F.lower(stem(name)), " ", ""), r"(\d+)", 1).try_cast("bigint")


def act_number(name: Column) -> Column:
    """The number of a name that is nothing but 'atto' and a number."""
    return F.regexp_extract(strip(F.lower(stem(name))), r"(?U)^atto\s*[_\-\s]*([0-9]+)\s*$", 1).try_cast("bigint")


def natural_key(name: Column) -> list[Column]:
    """Order of names: numbered ones by number then text, others by text."""
    n = name_number(name)
    return [n.isNull(), n, F.regexp_replace(F.lower(stem(name)), " ", "")]


def padded_id(id_: Column, name: Column | None = None) -> Column:
    """The first digits of an id to four places or more; else of the file's name."""
    n = F.regexp_extract(text_of(id_), r"(\d+)", 1).try_cast("bigint")
    n = n if name is None else F.coalesce(n, name_number(name))
    return F.when(n.isNull(), "").otherwise(F.format_string("%04d", n))


def id_digits(id_: Column) -> Column:
    """P20: the first digits of an id as they stand, '' if none."""
    return F.regexp_extract(text_of(id_), r"(\d+)", 1)


def id_order(id_: Column) -> list[Column]:
    """Ids by their number, those without by text."""
    n = id_digits(id_).try_cast("bigint")
    return [n.isNull(), n, id_]


def file_uri(path: Column) -> Column:
    """File URI of an absolute path: every byte but letters, digits, '/',
    '.', '-', '_' and '~' is escaped, accents as their UTF-8 bytes."""
    # Of those, form encoding keeps '*', escapes '/' and '~', and makes blanks '+'.
    c = F.url_encode(path)
    for code, sign in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return F.concat(F.lit("file://"), c)


def experiment(name: Column) -> Column:
    """Struct of modello and pipeline of '<modello>_pipeline_<A|B>', else nulls."""
    pat = r"^(.+)_pipeline_([AB])$"
    part = lambda i: F.nullif(F.regexp_extract(name, pat, i), F.lit(""))
    return F.struct(part(1).alias("modello"), part(2).alias("pipeline"))
