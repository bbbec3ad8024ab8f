"""Text expressions on columns: cleaning, quality, blocks, truncation. No UDFs.

Patterns that name word, digit or space classes carry ``(?U)`` so that they see letters
with accents and no-break spaces as such. Null text counts as empty unless said else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that speak for an act's text.
KEYWORDS = (
    "delibera",
    "deliberazione",
    "determina",
    "determinazione",
    "decreto",
    "ordinanza",
    "regolamento",
    "statuto",
    "accordo",
    "convenzione",
    "oggetto",
    "visto",
    "considerato",
    "ritenuto",
)
# Patterns of blocks that are surely noise, of blocks worth keeping, and
# of blocks that the filtering variant discards.
NOISE = (
    r"firma digitale",
    r"documento firmato digitalmente",
    r"certificat[oa] di pubblicazione",
    r"relata di pubblicazione",
    r"attestazione di esecutivit",
    r"copia conforme",
    r"hash",
    r"impronta",
    r"segnatura",
    r"protocollo informatico",
    r"codice verific",
    r"pagina \d+ di \d+",
)
USEFUL = (
    r"\boggetto\b",
    r"\bpremess[oa]\b",
    r"\bvisto\b",
    r"\bconsiderato\b",
    r"\britenuto\b",
    r"\bdelibera\b",
    r"\bdeliberazione\b",
    r"\bdetermina\b",
    r"\bdeterminazione\b",
    r"\bdecreto\b",
    r"\bordinanza\b",
    r"\bdecreta\b",
    r"\bordina\b",
    r"\bart\.\b",
    r"\barticolo\b",
    r"\bgiunta comunale\b",
    r"\bconsiglio comunale\b",
    r"\bregolamento\b",
    r"\bstatuto\b",
    r"\bente\b",
    r"\bnumero\b",
    r"\bdata\b",
)
DISCARD = (
    r"certificat[oa] di pubblicazione",
    r"relata di pubblicazione",
    r"attestazione di esecutivit",
    r"firma digitale",
    r"documento firmato digitalmente",
    r"copia conforme",
    r"codice verific",
    r"impronta",
    r"hash",
    r"pagina \d+ di \d+",
)
# Line ends beside \n and \r at which Python splits lines.
LINE_ENDS = "\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
# Ends of a logical unit; a cut falls after the last of them.
UNIT_ENDS = (". ", ";\n", ".\n", "! ", "? ", "\n\n", "\n", "; ")

SPACES = r"(?U)\s+"
LETTER = r"(?U)[^\W\d_]"
SYMBOL = r"(?U)[^\w\s]"


def _any(patterns: Sequence[str]) -> str:
    return "(?U)" + "|".join(patterns)


def text_of(c: Column | str) -> Column:
    """A column, or the column of a name, with '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once. Inside a lambda of a higher-order
    function nothing shares equal subexpressions, so what is used often is bound."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_of(c), SPACES, " "))


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LETTER))


def symbols(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SYMBOL))


def preclean(c: Column) -> Column:
    """Lines trimmed and collapsed, empty and symbol-only ones dropped, rulers of
    bars, dots and dashes blanked."""
    t = F.translate(text_of(c), "\r\t" + LINE_ENDS, "\n " + "\n" * len(LINE_ENDS))
    lines = F.transform(F.split(t, "\n"), collapse)
    kept = F.filter(lines, lambda x: (F.length(x) > 0) & let(letters(x), lambda n: ~((n < 3) & (symbols(x) > n))))

    def rulers(x: Column) -> Column:
        for p in (r"[|_]{3,}", r"\.{5,}", r"[-=]{5,}"):
            x = F.regexp_replace(x, p, " ")
        return collapse(x)

    return F.array_join(F.filter(F.transform(kept, rulers), lambda x: F.length(x) > 0), "\n")


def rfind(c: Column, part: str) -> Column:
    """0-based place of the last occurrence of ``part``, -1 if there is none."""
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(c) - at - len(part) + 1)


def truncate_unit(c: Column, most: int | Column) -> Column:
    """Text longer than ``most`` cut after its last logical unit inside the window,
    else after its last space, else at ``most`` + 1; a dangling mark becomes a stop."""
    most = F.lit(most) if isinstance(most, int) else most

    def cut_in(win: Column) -> Column:
        unit = lambda cut: F.when(cut < F.floor(most * 0.75), rfind(win, " ")).otherwise(cut)
        at = let(let(F.greatest(*[rfind(win, p) for p in UNIT_ENDS]), unit), lambda cut: F.when(cut <= 0, most).otherwise(cut))
        return at + 1

    def shorten(t: Column) -> Column:
        end = let(F.substring(t, F.lit(1), most), cut_in).cast("int")
        return strip(F.regexp_replace(strip(F.substring(t, F.lit(1), end)), r"(?U)[,;:\-\s]+$", "."))

    return let(text_of(c), lambda t: F.when(F.length(t) <= most, t).otherwise(shorten(t)))


def token_estimate(c: Column) -> Column:
    """P5: a quarter of the length, at least 1 for any text."""
    n = F.length(text_of(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def output_clean(c: Column) -> Column:
    """Code fences off, carriage returns to line feeds, blank lines and blanks squeezed."""
    t = strip(text_of(c))
    t = strip(F.regexp_replace(t, r"(?i)^```(?:text|txt)?", ""))
    t = strip(F.regexp_replace(t, r"```$", ""))
    t = F.regexp_replace(F.translate(t, "\r", "\n"), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def quality(c: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """0 to 100 from length, share of letters, share of symbols, keywords, digits."""

    def score(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        hits = let(F.lower(t), lambda low: sum((low.contains(k).cast("int") for k in keywords), F.lit(0)))
        points = (
            F.least(F.lit(40), F.floor(F.length(t) / 80))
            + F.least(F.lit(25), F.floor(letters(t) / n * 100 / 2.5))
            - F.least(F.lit(20), F.floor(symbols(t) / n * 100))
            + F.least(F.lit(20), hits * 4)
            + F.when(t.rlike(r"(?U)\d"), 5).otherwise(0)
        )
        return F.when(F.length(t) == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))

    return let(collapse(c), score).cast("bigint")


def sufficient(c: Column, least_length: int = 500, least_score: int = 75, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Long and good enough to do without OCR."""
    return (F.length(collapse(c)) >= least_length) & (quality(c, keywords) >= least_score)


def noisy(c: Column) -> Column:
    """Surely noise: empty, of a noise pattern, or more symbols than its few letters."""
    few = lambda b: let(letters(b), lambda n: (n < 8) & (symbols(b) > n))
    return let(strip(F.lower(text_of(c))), lambda b: (F.length(b) == 0) | b.rlike(_any(NOISE)) | few(b))


def blocks(c: Column, separator: str = r"(?U)\n\s*\n+") -> Column:
    """Non-empty blocks between blank lines."""
    t = F.translate(text_of(c), "\r", "\n")
    return F.filter(F.transform(F.split(t, separator), strip), lambda b: F.length(b) > 0)


def select_blocks(c: Column, most: int | Column | None = 1000, separator: str = r"(?U)\n\s*\n+", least_score: int = 75) -> Column:
    """P10: blocks that are no noise and stand first, match a useful pattern or are long
    and good; the first eight where none is left; cut to ``most``."""

    def keep(b: Column, i: Column) -> Column:
        good = lambda flat: (i < 4) | F.lower(flat).rlike(_any(USEFUL)) | ((F.length(flat) > 350) & (quality(flat) >= least_score))
        return let(collapse(b), lambda flat: ~noisy(flat) & good(flat))

    def join(all_: Column) -> Column:
        useful = F.filter(all_, keep)
        return let(useful, lambda u: strip(F.array_join(F.when(F.size(u) > 0, u).otherwise(F.slice(all_, 1, 8)), "\n\n")))

    text = let(blocks(c, separator), join)
    return text if most is None else truncate_unit(text, most)


def signature(b: Column) -> Column:
    """First 220 characters of a block's letters and digits."""
    return F.substring(F.regexp_replace(F.lower(collapse(b)), "[^a-z0-9]+", " "), 1, 220)


def filter_blocks(c: Column, most: int | Column | None = 750, most_blocks: int = 3, separator: str = r"(?U)\n\s*\n+") -> Column:
    """Of the distinct blocks without noise the first two, then only ones that name
    the subject, ``most_blocks`` in all; the first ones where none is left; cut to ``most``."""

    def join(all_: Column) -> Column:
        clean = F.filter(all_, lambda b: let(collapse(b), lambda flat: ~noisy(flat) & ~F.lower(flat).rlike(_any(DISCARD))))
        marked = F.transform(clean, lambda b: F.struct(b.alias("b"), signature(b).alias("s")))
        once = let(marked, lambda m: let(m["s"], lambda s: F.filter(m, lambda x, i: F.array_position(s, x["s"]) == i + 1))["b"])
        return let(let(once, pick), lambda kept: strip(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.slice(all_, 1, most_blocks)), "\n\n")))

    def pick(once: Column) -> Column:
        rest = F.filter(F.slice(once, 3, 1_000_000), lambda b: F.lower(collapse(b)).rlike(r"(?U)\boggetto\b"))
        return F.concat(F.slice(once, 1, min(2, most_blocks)), F.slice(rest, 1, max(0, most_blocks - 2)))

    text = let(blocks(c, separator), join)
    return text if most is None else truncate_unit(text, most)


def ml_clean(c: Column, keep_accents: bool = False) -> Column:
    """Lower case, what is outside the allowed class to spaces, collapsed. The
    class as published holds the bytes of mis-decoded accents, so that accented letters
    fall out; ``keep_accents`` allows the letters that were meant."""
    extra = "àèéìòù" if keep_accents else "\u00c3\u00a0\u00a8\u00a9\u00ac\u00b2\u00b9"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), rf"(?U)[^a-z{extra}0-9\s]", " "), SPACES, " "))


def truthy(c: Column) -> Column:
    """P14: '1' for the spellings of yes, else '0'."""
    # The spellings; the second is a mis-decoded yes.
    return F.when(strip(F.lower(text_of(c))).isin("1", "si", "sã¬", "yes", "true", "ocr", "usato"), "1").otherwise("0")


def slug(c: Column, default: str = "modello_non_selezionato", keep_dash: bool = True) -> Column:
    """Anything but letters, digits (and dashes) to one underscore, none at the ends."""
    t = F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    t = F.regexp_replace(t, r"[^A-Za-z0-9-]+" if keep_dash else r"[^A-Za-z0-9]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def chunks(c: Column, most: int = 1000, overlap: int = 0) -> Column:
    """Greedy pieces of at most ``most`` characters, each ended after its last line
    feed, ". " or "; " if that lies beyond 65 % of the window. Cut points depend on one
    another, so they fold over as many steps as the text can need."""
    least_step = max(1, int(most * 0.65) + 1 - overlap)

    def end_of(t: Column, start: Column) -> Column:
        stop = F.least(start + most, F.length(t))

        def cut(win: Column) -> Column:
            last = F.greatest(*[rfind(win, p) for p in ("\n", ". ", "; ")])
            return let(last, lambda x: F.when((stop < F.length(t)) & (x > most * 0.65), start + x + 1).otherwise(stop))

        return let(F.substring(t, start + 1, stop - start), cut).cast("int")

    def pieces(t: Column) -> Column:
        empty = F.struct(F.lit(0).cast("int").alias("start"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, _: Column) -> Column:
            def go_on(end: Column) -> Column:
                return F.struct(
                    F.greatest(F.lit(0), end - overlap).cast("int").alias("start"),
                    (end >= F.length(t)).alias("done"),
                    F.concat(s["out"], F.array(strip(F.substring(t, s["start"] + 1, end - s["start"])))).alias("out"),
                )

            return F.when(s["done"], s).otherwise(let(end_of(t, s["start"]), go_on))

        steps = F.sequence(F.lit(1), F.ceil(F.length(t) / least_step).cast("int") + 1)
        many = F.filter(F.aggregate(steps, empty, step)["out"], lambda x: F.length(x) > 0)
        return F.when(F.length(t) <= most, F.array(t)).otherwise(many)

    return let(strip(text_of(c)), pieces)
