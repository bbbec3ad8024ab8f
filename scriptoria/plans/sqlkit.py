"""SQL fragments for the parity check; each mirrors one expression of the library."""

from __future__ import annotations

from scriptoria.functions import text as T

S = r"[\s\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '{S}+', ' ', 'g'))"


def letters(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\p{{L}}'))"


def symbols(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]'))"


def preclean(c: str) -> str:
    t = f"replace(replace(coalesce({c}, ''), chr(13), chr(10)), chr(9), ' ')"
    one = collapse(r"regexp_replace(regexp_replace(regexp_replace(x, '[|_]{3,}', ' ', 'g'), '\.{5,}', ' ', 'g'), '[-=]{5,}', ' ', 'g')")
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: {collapse('x')})"
    kept = f"list_filter({lines}, lambda x: len(x) > 0 AND NOT ({letters('x')} < 3 AND {symbols('x')} > {letters('x')}))"
    return f"coalesce(array_to_string(list_filter(list_transform({kept}, lambda x: {one}), lambda x: len(x) > 0), chr(10)), '')"


def rfind(w: str, p: str) -> str:
    r = " || ".join(f"chr({ord(ch)})" for ch in p[::-1])
    return f"(CASE WHEN strpos(reverse({w}), {r}) = 0 THEN -1 ELSE length({w}) - strpos(reverse({w}), {r}) - {len(p)} + 1 END)"


def truncate(c: str, most: str) -> str:
    """A scalar subquery over one text; ``most`` is a number or a column."""
    cut = "greatest(" + ", ".join(rfind("w", p) for p in T.UNIT_ENDS) + ")"
    dangling = rf"regexp_replace({strip('left(t, CAST(c AS BIGINT) + 1)')}, '(?:[,;:\-]|{S})+$', '.')"
    return f"""(SELECT CASE WHEN length(t) <= m THEN t ELSE {strip(dangling)} END FROM
 (SELECT t, m, CASE WHEN c1 <= 0 THEN m ELSE c1 END AS c FROM
  (SELECT t, m, CASE WHEN c0 < floor(m * 0.75) THEN {rfind('w', ' ')} ELSE c0 END AS c1 FROM
   (SELECT t, m, w, {cut} AS c0 FROM (SELECT coalesce({c}, '') AS t, {most} AS m, left(coalesce({c}, ''), {most}) AS w)))))"""


def quality(c: str) -> str:
    t = collapse(c)
    hits = " + ".join(f"CAST(contains(lower({t}), {lit(k)}) AS INT)" for k in T.KEYWORDS)
    n = f"greatest(length({t}), 1)"
    return f"""(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(0, least(100, least(40, length({t}) // 80) + least(25, CAST(floor({letters(t)} / {n} * 100 / 2.5) AS BIGINT))
 - least(20, CAST(floor({symbols(t)} / {n} * 100) AS BIGINT)) + least(20, ({hits}) * 4) + CASE WHEN regexp_matches({t}, '\\p{{Nd}}') THEN 5 ELSE 0 END)) END)"""


def noisy(c: str) -> str:
    b = strip(f"lower(coalesce({c}, ''))")
    return f"(length({b}) = 0 OR regexp_matches({b}, {lit('|'.join(T.NOISE))}) OR ({letters(b)} < 8 AND {symbols(b)} > {letters(b)}))"


def blocks(c: str) -> str:
    t = f"replace(coalesce({c}, ''), chr(13), chr(10))"
    return f"list_filter(list_transform(regexp_split_to_array({t}, '\\n{S}*\\n+'), lambda b: {strip('b')}), lambda b: len(b) > 0)"


def number(c: str) -> str:
    t = f"replace({strip(f'coalesce(CAST({c} AS VARCHAR), {lit("")})')}, ',', '.')"
    return f"coalesce(CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({t} AS DOUBLE) END, 0.0)"


def stem(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^.*/', ''), '(.)\\.[^.]*$', '\\1')"


def name_number(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(replace(lower({stem(c)}), ' ', ''), '([0-9]+)', 1), '') AS BIGINT)"


def label(c: str) -> str:
    from scriptoria.functions.labels import BY_SPELLING

    t = f"coalesce({strip(c)}, '')"
    return f"CASE lower({t}) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in BY_SPELLING.items()) + f" ELSE {t} END"


def canonical(c: str) -> str:
    from scriptoria.functions.labels import BY_FOLDED

    return f"CASE lower({strip(c)}) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in BY_FOLDED.items()) + " END"


def ml_clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-zÃ ¨©¬²¹0-9\\s\\p{{Z}}]', ' ', 'g'), '{S}+', ' ', 'g'))"
