"""Anatomy of model replies: the stated result, the language, abstentions.

Plain Python over strings, shared by operators that work in Arrow batches.
"""

from __future__ import annotations

import re

from ledgerloom.functions.quantities import QUANTITY, parse_quantity
from ledgerloom.functions.questions import clean

# Frequent words that tell languages of Latin script apart.
LANGUAGE_WORDS = {
    "en": """a according answer are as based be between by change did do does for from gives has have how i in information is
        it its lists moved my not of on or question result show shown that the then there this to value was what which while
        with works you""",
    "de": """an angegeben antwort auf aus bei beiden beträgt das dem den der des die ein eine endgültige ergebnis für geschäft
        ich im ist kann keine laut lautet leider mit nach nicht sich tabelle und ungefähr von vor war wert wie wurde
        zu zum zur zwischen prozent viel hoch""",
    "fr": "à au aux ce cela d'après dans des deux du est et la le les ne nous on obtient par pas pour réponse selon si sur un une",
    "es": "al años como con cambio de del dos e el entre es este fue la las lo los no para por que respuesta resta según se un una y",
    "it": "alla che come con da dei del della di è gli il indicato la le nel nella non per risposta si sono un una",
    "pt": "a acordo ao as com da de do dos é em final foi não no o os para relatório resposta um uma",
    "nl": "antwoord de dit een en het in is met niet op te tabel van verslag volgens voor zijn",
    "pl": "do i jest końcowa na nie odpowiedź się tabelą to w z zgodnie",
    "sv": "att av den det en enligt för från i inte med och på sidan som svaret tabellen till är",
    "da": "af at den det en er for fra i ikke ifølge med og på svaret tabellen til",
    "fi": "ei ja mukaan on se taulukon vastaus",
    "tr": "bir bu cevap göre için ile olarak tabloya ve bulunur",
    "cs": "a je na odpověď podle se tabulky v z",
    "ro": "conform cu de din este în la pe răspunsul și tabelului un",
    "hu": "a az egy és szerint táblázat válasz",
}
_SPOKEN: dict[str, list[str]] = {}
for _language, _words in LANGUAGE_WORDS.items():
    for _word in set(_words.split()):
        _SPOKEN.setdefault(_word, []).append(_language)
# Scripts other than Latin, by a range of letters.
SCRIPTS = {
    "ja": r"[぀-ヿ]",
    "ko": r"[가-힯]",
    "zh": r"[一-鿿]",
    "ru": r"[Ѐ-ӿ]",
    "el": r"[Ͱ-Ͽ]",
    "ar": r"[؀-ۿ]",
    "he": r"[֐-׿]",
    "hi": r"[ऀ-ॿ]",
    "th": r"[฀-๿]",
}
_SCRIPT = {k: re.compile(v) for k, v in SCRIPTS.items()}
_ALPHA = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# Ways to say that the filing does not give the answer.
ABSTENTIONS = re.compile(
    r"\b(?:not enough information|insufficient information|cannot (?:be )?determined?|can't (?:be )?determined?|"
    r"cannot be answered|does not state|no answer can be given|not stated|not disclosed)\b"
)


_ANY_QUANTITY, _DIGIT = re.compile(QUANTITY), re.compile(r"\d")


def languages(text: str | None) -> dict[str, int]:
    """Function words of each language in ``text``; scripts other than Latin count their letters."""
    t = clean(text).lower()
    if _DIGIT.search(t):
        t = _ANY_QUANTITY.sub(" ", t)
    found: dict[str, int] = {}
    if not t.isascii():
        found = {k: len(r.findall(t)) for k, r in _SCRIPT.items()}
        found = {k: n for k, n in found.items() if n >= 2}
        if "ja" in found:
            found["ja"] += found.pop("zh", 0)
    known: dict[str, int] = {}
    for w in _ALPHA.findall(t):
        for k in _SPOKEN.get(w, ()):
            known[k] = known.get(k, 0) + 1
    for k in LANGUAGE_WORDS:
        if k in known:
            found[k] = max(found.get(k, 0), known[k])
    return found


def language(text: str | None, least: int = 3) -> str | None:
    """Language of a sentence, or None for anything under ``least`` words or without a clear lead.

    Words that are not function words of any known language make the text ``und``.
    """
    foreign = bool(text) and not text.isascii() and any(r.search(text) for r in _SCRIPT.values())
    if not foreign and len(_ALPHA.findall(clean(unwrap(text)[0]))) < 2:
        return None
    tokens = _ALPHA.findall(clean(text).lower())
    found = languages(text)
    other = [k for k in found if k in _SCRIPT]
    if other:
        return max(other, key=lambda k: found[k])
    if len(tokens) < least:
        return None
    if not found:
        return "und"
    best = max(found.values())
    first = [k for k, n in found.items() if n == best]
    return "en" if "en" in first else first[0]


def is_abstention(text: str | None) -> bool:
    return bool(ABSTENTIONS.search(clean(text).lower()))


_MARK = re.compile(r"^[\s*_>#\"'`]*(?:<answer>|(?:the\s+)?final\s+(?:answer|result)(?:\s+is)?|answer|result)\s*[:=]?[\s*_\"'`]*", re.I)
_JSON = re.compile(r'^\s*\{\s*"[a-z_ ]+"\s*:\s*"?(.*?)"?\s*\}\s*$', re.I | re.S)
_TAG = re.compile(r"^\s*<([a-z]+)>(.*)</\1>\s*$", re.I | re.S)
_LAST_MARK = re.compile(r"(?:^|[\n.!?]\s*|[*_]{1,2})(?:the\s+)?(?:final\s+)?answer(?:\s+is\s*:?|\s*:)\s*[*_]*\s*([^\n]*?)\s*[*_]*\s*$", re.I)
_VERB = re.compile(r"\b(?:is|was|to|at|equals|be|of)\s+", re.I)
_TAIL = re.compile(r"\s+(?:based on|for the (?:two )?years|according to|as shown|in the filing|per the)\b[^.]*\.?$", re.I)


def unwrap(text: str | None) -> tuple[str, bool]:
    """(content, marked): the reply without its JSON object, tag, emphasis and leading marker."""
    t = (text or "").strip()
    marked = False
    for pattern, group in ((_JSON, 1), (_TAG, 2)):
        m = pattern.match(t)
        if m:
            t, marked = m[group].strip(), True
    m = _MARK.match(t)
    if m and m.end():
        bare = re.sub(r"[\s*_\"'`>#]", "", m[0])
        if bare:
            t, marked = t[m.end() :], True
    return t.strip().strip("*_`").strip(), marked


def stated_result(text: str | None) -> str | None:
    """The part of an English reply that gives the result, or None where it gives none.

    A reply may be the bare result, a marked one, end in ``The answer is ...`` or a
    final line with a marker, or be one sentence that states the value.
    """
    raw = (text or "").strip()
    if not raw or re.match(r"^\{[^}]*$", raw):
        return None
    t, _ = unwrap(raw)
    if not t:
        return None
    m = _LAST_MARK.search(raw)
    if m and m[1].strip():
        return m[1].strip().strip("*_\"'`")
    flat = clean(t)
    if parse_quantity(flat) is None:
        body = _TAIL.sub("", flat)
        for m in reversed(list(_VERB.finditer(body))):
            rest = body[m.end() :].strip(" .*_")
            if parse_quantity(rest) is not None or rest.lower() in ("yes", "no"):
                return rest
    return flat
