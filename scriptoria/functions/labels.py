"""Canonical act labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight labels and the spellings that map to each.
LABELS = (
    "AccordoSindacale",
    "Decreto",
    "DeliberaConsiglio",
    "DeliberaGiunta",
    "Determina",
    "Ordinanza",
    "Regolamento",
    "Statuto",
)
SPELLINGS = {
    "AccordoSindacale": ("accordo sindacale", "accordosindacale"),
    "Decreto": ("decreto", "decreto sindacale"),
    "DeliberaConsiglio": (
        "delibera consiglio",
        "delibera di consiglio",
        "deliberazione consiglio",
        "deliberazione di consiglio",
        "deliberazione del consiglio",
    ),
    "DeliberaGiunta": (
        "delibera giunta",
        "delibera di giunta",
        "deliberazione giunta",
        "deliberazione di giunta",
        "deliberazione della giunta",
    ),
    "Determina": ("determina", "determina dirigenziale", "determinazione", "determinazione dirigenziale"),
    "Ordinanza": ("ordinanza", "ordinanza sindacale"),
    "Regolamento": ("regolamento", "regolamento comunale"),
    "Statuto": ("statuto",),
}
REJECTED = ("nan", "none", "errore", "da controllare", "ambigua", "ambiguo")

BY_SPELLING = {s: label for label, group in SPELLINGS.items() for s in group}
BY_FOLDED = BY_SPELLING | {label.lower(): label for label in LABELS}

#: White space at either end, Unicode spaces included.
EDGE_SPACE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """``c`` without leading and trailing Unicode white space."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_label(c: Column) -> Column:
    """The label of a known spelling, else the trimmed text; null becomes ''."""
    t = F.coalesce(trimmed(c), F.lit(""))
    return F.coalesce(F.try_element_at(_map(BY_SPELLING), F.lower(t)), t)


def canonical_label(c: Column) -> Column:
    """One of the eight labels, ignoring case and outer blanks, else null."""
    return F.try_element_at(_map(BY_FOLDED), F.lower(trimmed(c)))


def canonical(label: str | None) -> str | None:
    """As canonical_label, for Python rows."""
    return BY_FOLDED.get(label.strip().lower()) if label else None


def not_blank(c: Column) -> Column:
    """True where ``c`` holds anything but white space; null counts as blank."""
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))
