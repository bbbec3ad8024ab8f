"""Defective prompt and response pairs: empty, refused, foreign, copied, cut.

Plan. One pass over the requests counts their letter triples, a table of fixed size, and
lists their words. The triples make a character model of the language that requests are
written in, with its mean and deviation: an answer far less likely under it, and
without that language's function words, is in another language, whichever it is. One
narrow pass then judges each pair by itself. Copies are found by aligning the answer
with the request, its instruction and its act: containment of word shingles first, then
the longest common subsequence. Refusals are found by aligning every sentence of the
answer with refusal templates, whose places stand for whole classes of words. Where all
hangs on whether an answer's last word is whole, that word is looked up among the words
of the requests by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import WORD, WordHashes, as_long, signed, words
from scriptoria.llm.truncation import AMOUNT, HANGING, SIGN_OFF, ending
from scriptoria.session import cut, spread

SHINGLE = 5
CONTAINED = 0.8
LEAST_TRIPLES = 5000  # of fewer no language can be learned: then function words alone decide
LETTERS = " abcdefghijklmnopqrstuvwxyzàèéìòù"
KINDS = len(LETTERS) + 1  # all other letters are one
FAR, SURE = 1.1, 5.0  # deviations of a letter triple, and of the mean of as many as the text has, that make it foreign
OWN_WORDS = 0.25  # share of Italian function words from which a text is Italian whatever its letters

# Placeholders, refusal templates, lead-ins, function words by language.
PLACEHOLDERS = frozenset(
    "n/d nd n.d n.d. n/a na n.a n.a. null none nil nan undefined vuoto vuota vuoto. empty tbd todo n.p. omissis".split()
) | {"nessuna risposta", "risposta vuota", "nessun contenuto", "nessun testo", "no response", "no answer", "empty response", "da completare", "da compilare", "in attesa"}
# A place of a template: a word, alternatives, or a class: <inf> any infinitive, with or
# without pronoun; <obj> what was asked for; <done> having been done for the asker.
CLASSES = {
    "<inf>": re.compile(r"\w*(?:are|ere|ire|rre|(?:ar|er|ir|r)(?:ti|vi|le|lo|la|li|gli|mi|ci|ne|si|telo|velo))"),
    "<obj>": re.compile(r"richiesta|domanda|risposta|sintesi|riassunto|compito|richieste|domande|operazione"),
    "<done>": re.compile(r"(?:fornit|soddisfatt|evas|elaborat|generat|dat|completat|esaudit|prodott|processat|formulat|svolt|trattat)[oaie]"),
}
REFUSALS = tuple(
    x.strip()
    for x in """
non posso|possiamo|potrò|potremo|potrei|riesco|riusciamo|saprei|intendo|desidero|voglio <inf>
non sono|siamo in grado
non sono|siamo autorizzato|autorizzata|autorizzati|abilitato|abilitata|abilitati|programmato|addestrato|tenuto
non mi|ci è|risulta|sarà possibile|consentito|permesso|concesso
mi|ci è|risulta|sarebbe impossibile <inf>
temo|spiace|dispiace|rincresce di non <inf>
temo che non
rifiuto|declino|rinuncio|evito di|a|la <inf>|richiesta|domanda
la|questa|tale|il|questo|tale|quanto <obj>|chiesto non può|potrà|possono essere <done>
la|questa|tale|il|questo <obj> esula|eccede|oltrepassa|supera le|dalle|i|dai|alle mie|miei|nostre|nostri
la|questa|tale|il|questo <obj> viola|contravviene|contrasta le|alle|con mie|nostre
esula|eccede dalle|le mie|nostre
non posso fornire una risposta
non posso aiutarti con questa richiesta
non posso rispondere
non posso esprimermi su documenti
non posso elaborare il testo
non posso soddisfare questa richiesta
non posso procedere
non posso riassumere
non sono in grado di elaborare
non sono in grado di rispondere
non sono in grado di aiutarti
non sono in grado di riassumere
non sono in grado di fornire
non sono autorizzato
non sono autorizzata
non sono abilitato
non mi è possibile
non mi è consentito
non mi è permesso
non ho modo di
non ho la possibilità di
non ho accesso
non ho abbastanza informazioni
non ho informazioni sufficienti
non dispongo di informazioni sufficienti
non dispongo di elementi
non riesco a rispondere
non riesco a elaborare
non riesco a leggere
non intendo rispondere
non desidero rispondere
preferisco non
preferirei non
devo declinare
devo rinunciare
devo rifiutare
sono costretto a declinare
sono spiacente ma non
mi rifiuto di
mi vedo costretto a rifiutare
mi astengo dal
le mie regole mi impediscono
le mie linee guida
le linee guida non mi
il contenuto viola le mie linee guida
la richiesta viola le mie linee guida
la richiesta non può essere soddisfatta da questo assistente
questo assistente non può
impossibile elaborare la richiesta
impossibile rispondere alla richiesta
impossibile completare la richiesta
i cannot
i can not
i can't
i am unable to
i'm unable to
i am not able to
i'm not able to
i won't
i must decline
i do not have access
i don't have access
i don't have enough information
as an ai
as a language model
je ne peux pas
je ne suis pas en mesure
je suis dans l'impossibilité
il m'est impossible
je dois refuser
je dois décliner
ich kann nicht
ich kann diese anfrage nicht
ich kann ihnen nicht
ich kann dir nicht
ich kann dabei nicht
ich kann das nicht
ich kann leider nicht
ich kann darauf nicht
ich bin nicht in der lage
ich darf nicht
ich darf diese
leider kann ich nicht
leider kann ich
no puedo
no podemos
lamento no
no me es posible
no estoy autorizado
no estoy en condiciones
debo declinar
debo rechazar
não posso
não consigo
não me é possível
não estou autorizado
no puc
ik kan niet|geen|dit|deze|u|je
ik kan helaas|hier
ik ben niet in staat
jag kan inte|tyvärr
jag får inte
jeg kan ikke|desværre|dessverre
jeg må ikke
en voi
nie mogę
nie jestem w stanie
nemohu
nemůžem
ne mogu
nu pot
nu sunt în măsură
nem tudok
nem tudom
δεν μπορώ
я не могу
не могу
""".strip().split("\n")
)
LEAD = re.compile(
    r"^\W*(?:(?:mi dispiace(?: molto)?|mi spiace|sono spiacente|spiacente|purtroppo|mi scuso|chiedo scusa|scusa|scusami|gentile utente|caro utente|buongiorno|salve|"
    r"da assistente(?: virtuale)?|come (?:assistente|modello|intelligenza)(?: virtuale| linguistico| artificiale| di linguaggio| ai)*|in qualità di (?:assistente|modello)(?: virtuale| linguistico| ai)*|in questo caso|al momento|attualmente|"
    r"ecco il riassunto|ecco la sintesi|ecco la risposta|ecco il testo|ecco|certo|certamente|riassunto|sintesi|risposta|testo|output|ok|"
    r"i'?m sorry|i am sorry|sorry|unfortunately|i apologi[sz]e|"
    r"tyvärr|beklager|desværre|helaas|niestety|przykro mi|przepraszam|bohužel|žao mi je|din păcate|sajnálom|je suis désolée?|désolée?|malheureusement|es tut mir (?:sehr )?leid|entschuldigung|leider|lo siento(?: mucho)?|lamentablemente|desculpe|"
    r"ma|but|mais|aber|pero|e|and)\b\W*)+",
    re.I,
)
COURTESY = re.compile(r"^\W*(?:grazie|ti ringrazio|la ringrazio|buongiorno|buonasera|salve|ciao|mi dispiace|mi spiace|mi scuso|chiedo scusa|certo|certamente|capisco|ho letto|ho ricevuto|thank|thanks|hello|sorry|merci|bonjour|danke|hallo|gracias|hola)\b", re.I)
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
LABEL = re.compile(r"^\W*[^\W\d_]+(?:\s+[^\W\d_]+){0,5}\s*:\s*")
ERROR_CODE = re.compile(r"\W*(?:ERRORE|ERROR|ERR)[_A-Z0-9-]*\W*|\W*[A-Z]+(?:_[A-Z0-9]+)*_(?:ERROR|ERRORE)\W*|Errore Ollama\b.*|Timeout Ollama\b.*", re.S)
FUNCTION_WORDS = {
    "it": "il lo la i gli le l un uno una di d del dello della dell dei degli delle a ad al allo alla all ai agli alle da dal dalla dall dai in nel nello nella nell nei nelle con per su sul sulla tra fra e ed o che chi cui non è sono ha hanno come si se entro presso dopo prima viene sarà più anche numero quale questo questa".split(),
    "en": "the of and to is was were are a an in for with by on at from that this which has have been will before until must near since under within only not be its it as or due no".split(),
    "de": "der die das den dem des und ist im in am vom zum zur mit von für auf hat haben wird werden ein eine einen einem einer nicht aus bevor nach über binnen wurde noch sich auch bei an nr".split(),
    "fr": "le la les l un une des du de d et est a à au aux en dans par pour sur que qui ne pas n avec ont été sera plus cette ce avant près sous chargée encore car dont leurs il elle se son sa ses ou no".split(),
    "es": "el la los las un una unos de del al a y o e es en por para que con se ha han sido más esta este antes después cerca bajo debe todavía hasta cuando como su sus lo no n entre sobre".split(),
    "pt": "o a os as um uma de da do das dos no na em e é por para que com se ao foi mais esta este até pela pelo não".split(),
    "nl": "de het een en van is in op met voor niet dat die zijn wordt door aan bij naar te om".split(),
    "ro": "şi și este în la cu pe din pentru care nu sau prin fost o un a de".split(),
}
_VOTES: dict[str, list[str]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _VOTES.setdefault(_w, []).append(_lang)
VERBS = frozenset(
    "è sono ha hanno viene vengono riguarda risulta riporta descrive tratta stabilisce dispone disposto approva approvato prevede impegna interessa comunica conferma autorizza affida affidando sia siano sarà saranno consente rinvia contiene indica".split()
)
MONTHS = frozenset("gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split())
QUESTION = re.compile(r"\?\s*$|^\s*(?:indica|qual|quale|quali|che|chi|quando|quanto|quanti|dove|in che|di che|a che|estrai|riporta)\b", re.I)


def language(text: str) -> tuple[str, int, int]:
    """(language by function words, its votes, Italian's votes); a word of several
    languages votes for each of them. Text mostly in another script is 'xx'."""
    ws = words(text)
    letters = [c for c in text if c.isalpha()]
    if letters and sum(ord(c) > 0x24F for c in letters) > 0.5 * len(letters):
        return "xx", len(ws), 0
    votes = votes_of(text)
    best = max(votes, key=lambda k: (votes[k], k == "it"), default="it")
    return best, votes[best], votes["it"]


def votes_of(text: str) -> Counter[str]:
    """Function words of each language in a text; shared ones count for each."""
    return Counter(lang for w in words(text) for lang in _VOTES.get(w, ()))


class Letters:
    """A model of letter triples: the log-probability of a letter after two others, with
    the mean and the deviation that the texts it was counted on have under it."""

    CODES = np.full(1 << 16, KINDS - 1, np.int64)
    CODES[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0) + 0.5
        p2 = (c2 + 4 * c1 / c1.sum()) / (c2.sum(axis=1, keepdims=True) + 4)
        self.log = np.log((c3 + 4 * p2) / (c3.sum(axis=2, keepdims=True) + 4)).ravel()
        # Mean and deviation of each triple under the model of all others, as a new text's are.
        left = np.log((np.maximum(c3 - 1, 0) + 4 * p2) / (np.maximum(c3.sum(axis=2, keepdims=True) - 1, 0) + 4)).ravel()
        n = max(counts.sum(), 1)
        self.mean = float((counts * left).sum() / n)
        self.deviation = float(np.sqrt((counts * (left - self.mean) ** 2).sum() / n)) if n >= LEAST_TRIPLES else 0.0

    @classmethod
    def triples(cls, text: str) -> np.ndarray:
        t = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
        c = cls.CODES[np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32) & 0xFFFF]
        return (c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:]

    def strange(self, text: str) -> bool:
        """True if the text's letters are not those of the texts that were counted."""
        x = self.log[self.triples(text)]
        less = (self.mean - x.mean()) / self.deviation if len(x) and self.deviation else 0.0
        return less > FAR and less * np.sqrt(len(x)) > SURE


def foreign(answer: str, strange=lambda t: False) -> bool:
    """True if the answer, an Italian lead-in set aside, is in another language: its
    letters are ``strange`` and it has few Italian function words, or those of another
    language outnumber them."""
    rest = LABEL.sub("", answer, count=1)
    parts = [rest] if rest.strip() else []
    if "\n" in answer.strip():
        parts.append(answer.strip().split("\n", 1)[1])
    m = re.search(r"[.!]\s+(?=\S)", rest)
    if m and m.end() < 60:
        parts.append(rest[m.end() :])
    for p in parts or [answer]:
        lang, n, it = language(p)
        if lang == "xx":
            return True
        most, odd = len(words(p)), strange(p)
        if odd and it < OWN_WORDS * most:
            return True
        if n >= 2 and n >= 0.12 * most and lang != "it" and (n > 1.5 * it or (odd and n >= it)):
            return True
    return False


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for x in a:
        m = where.get(x, 0)
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(b) - bin(s).count("1")


_TEMPLATES = [[frozenset(p.split("|")) if "<" not in p else tuple(p.split("|")) for p in t.split()] for t in (re.sub(r"(?<=\w)['’](?=\w)", " ", t) for t in REFUSALS)]


def _fits(place, word: str) -> bool:
    if isinstance(place, frozenset):
        return word in place
    return any(CLASSES[x].fullmatch(word) if x in CLASSES else x == word for x in place)


def aligned(template, ws: list[str], skips: int = 1) -> bool:
    """True if a sentence begins with the template: its first word first, every other place
    in order, with ``skips`` words between them at most."""
    at = {0: 0} if ws and _fits(template[0], ws[0]) else {}  # place of the last match: words skipped
    for place in template[1:]:
        new: dict[int, int] = {}
        for i, gone in at.items():
            for skip in range(skips - gone + 1):
                j = i + 1 + skip
                if j < len(ws) and _fits(place, ws[j]):
                    new[j] = min(new.get(j, skips), gone + skip)
        at = new
        if not at:
            return False
    return bool(at)


def declines(sentence: str) -> bool:
    """True for a sentence that, lead-ins set aside, begins with a refusal template."""
    rest = LEAD.sub("", sentence, count=1)
    heads = {" ".join(words(t)) for t in (sentence, rest, LABEL.sub("", rest, count=1))}
    return any(aligned(t, h.split()) for h in heads for t in _TEMPLATES)


def refused(answer: str) -> bool:
    """True for an error code, an answer whose first sentence, courtesies set aside,
    declines, or one of which sentences that decline are half or more."""
    if ERROR_CODE.fullmatch(answer.strip()):
        return True
    no = other = 0
    for s in (answer, *SENTENCE.split(answer)) if LEAD.match(answer) else SENTENCE.split(answer):
        n = len(words(s))
        if n and declines(s):
            if not other:
                return True
            no += n
        elif n and s is not answer and not COURTESY.match(s):
            other += n
    return no > 0 and no >= other


def shingle_set(ws: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    k = min(k, max(1, len(ws)))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def parts_of(request: str) -> list[str]:
    """The whole request and its blocks: instruction and act, in either order."""
    blocks = [b for b in re.split(r"\n\s*\n", request) if b.strip()]
    return [request, *blocks] if len(blocks) > 1 else [request]


def copied(answer: str, request: str) -> bool:
    """True if the answer is nothing but the request, its instruction or its act: nearly
    all of either lies in the other, in order."""
    rest = LABEL.sub("", answer, count=1)
    for text in {answer, rest}:
        a = words(text)
        if not a:
            continue
        for p in parts_of(request):
            b = words(p)
            least = max(0.9 * len(a), CONTAINED * len(b))  # words in common that make a copy
            if not b or min(len(a), len(b)) < least:
                continue
            # Every word of either side that is not in common breaks five runs of words at
            # most, so that fewer shared ones leave no room for a copy.
            sa = shingle_set(a)
            if len(sa & shingle_set(b)) < len(sa) - SHINGLE * (len(a) + len(b) - 2 * least):
                continue
            if lcs(a, b) >= least:
                return True
    return False


def stops_short(answer: str, request: str) -> bool | str:
    """True if the answer stops inside a word or a sentence. A bare value without full
    stop is complete if it is a whole number, date or name; where that depends on its
    last word, the word is given instead."""
    kind, frag, last = ending(answer)
    if kind in ("closed", "blank"):
        return False
    if kind in ("dangling", "doubtful"):
        return kind == "dangling" or bool(AMOUNT.search(answer.strip()))
    if SIGN_OFF.fullmatch(frag.lower()):
        return False
    ws = words(answer)
    blocks = parts_of(request)[1:]
    asked = any(QUESTION.search(b.strip()) for b in blocks if len(b) < 200) if blocks else bool(QUESTION.search(request.strip()))
    if not asked or len(ws) > 16 or VERBS & set(ws) or ws[-1] in HANGING:
        return True
    flat = re.sub(r"\s+", " ", request.lower())
    value = re.sub(r"\s+", " ", answer.strip().lower())
    at = flat.find(value)
    if at >= 0:  # quoted from the act: must end where a word of the act ends
        after = flat[at + len(value) :]
        more = re.compile(r"\w|[.,]\d" if value.isdigit() else r"\w|[.,/]\d")
        if all(more.match(flat, m.end()) for m in re.finditer(re.escape(value), flat)):
            return True
        if value.isdigit():
            return False
        if ws[-1] in MONTHS and re.match(r"\s+\d{4}\b", after):
            return True
        if " - " in answer and re.match(r"\s*,", after):
            return True  # the subject of an act goes on after its comma
        return " - " in answer and re.match(r"\s+\w", after) is not None
    if re.fullmatch(r"\d+|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2} [^\W\d_]+ \d{4}", value):
        return False
    return True if value[-1].isdigit() else last if last and not last.isdigit() else False


def defect(answer: str | None, request: str | None, strange=lambda t: False) -> str | None:
    """The first defect that fits, else None; 'troncata?' and a word where the answer is
    cut unless the word is whole."""
    t = (answer or "").replace("​", "").replace("﻿", "").strip()
    bare = re.sub(r"^```\w*|```$", "", t).strip()
    if not any(c.isalnum() for c in bare) or bare.strip(" .-–—_*#[](){}<>\"'").lower() in PLACEHOLDERS or bare.lower() in PLACEHOLDERS:
        return "vuota"
    if refused(t):
        return "rifiuto"
    if foreign(t, strange):
        return "altra_lingua"
    if request and copied(t, request):
        return "copia"
    short = stops_short(bare, request or "")
    return "troncata" if short is True else f"troncata?{short}" if short else None


def request_facts(df: DataFrame, text_col: str) -> DataFrame:
    """(what, h, n): of all texts the letter triples ('t') with their counts, and the
    hashes of their words ('w')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        count = np.zeros(KINDS**3, np.int64)
        for b in batches:
            seen = []
            for t in b.column(0).to_pylist():
                if t:
                    count += np.bincount(Letters.triples(t), minlength=KINDS**3)
                    seen.append(hashes(words(t)))
            h = as_long(np.unique(np.concatenate(seen))) if seen else np.empty(0, np.int64)
            yield block("w", h, np.ones(len(h), np.int64))
        at = np.nonzero(count)[0]
        yield block("t", at, count[at])

    def block(what: str, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([what] * len(h), pa.string()), pa.array(h), pa.array(n)], names=["what", "h", "n"])

    return df.select(text_col).mapInArrow(run, "what string, h bigint, n bigint").groupBy("what", "h").agg(F.sum("n").alias("n"))


def defective_pairs(df: DataFrame, id_col: str, request_col: str, answer_col: str) -> DataFrame:
    """(id, difetto) of every pair with a defect, the first that fits of vuota, rifiuto,
    altra_lingua, copia, troncata.

    Null answers are empty; with a null request nothing can be a copy. Flags and error
    columns are not consulted: they do not always agree with the answer. Repeated rows
    are judged one by one; other columns are not read. Requests are taken for Italian.
    """
    src = spread(df.select(F.col(id_col).alias("id"), F.col(request_col).alias("q"), F.col(answer_col).alias("a")))
    facts = cut(request_facts(src, "q"))
    got = facts.filter("what = 't'").select("h", "n").toArrow()  # KINDS^3 rows at most
    counts = np.zeros(KINDS**3, np.int64)
    counts[got.column("h").to_numpy()] = got.column("n").to_numpy()
    letters = df.sparkSession.sparkContext.broadcast(Letters(counts))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strange = letters.value.strange
        hashes = WordHashes()
        for b in batches:
            out = [defect(a, q, strange) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = [i for i, x in enumerate(out) if x]
            last = [signed(int(hashes([x[9:]])[0])) if (x := out[i]).startswith("troncata?") else None for i in keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int32())), pa.array([out[i].split("?")[0] for i in keep], pa.string()), pa.array(last, pa.int64())], names=["id", "difetto", "h"]
            )

    found = cut(src.mapInArrow(run, f"id {kind}, difetto string, h bigint"))
    # A last word is whole if a request has it. Few answers hang on that.
    asked = found.filter("h is not null")
    known = facts.filter("what = 'w'").join(asked.select("h").distinct(), "h", "left_semi").select("h")
    return found.filter("h is null").unionByName(asked.join(known, "h", "left_anti").select(found.columns)).select("id", "difetto")
