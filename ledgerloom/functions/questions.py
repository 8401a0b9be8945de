"""Parsing of report questions: kind of result, years, business and measure.

The parser is plain Python over one string so that it can run inside Arrow
batches (`mapInPandas`, pandas UDFs) and in unit tests alike.  It knows the
wording of question templates in English and German, never the names of
businesses or measures, which are taken from the text itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ledgerloom.functions.strings import edits

_PLAIN = str.maketrans({"’": "'", "‘": "'", "−": "-", "–": "-", "‐": "-", "\u00ad": "", "\u200b": "", "\ufeff": ""})
_YEAR = re.compile(r"(?<!\d)((?:19|20)\d\d)(?!\d)")
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")

# Framing phrases that carry no part of the question.
FRAMES = (
    "according to the table",
    "based on the filing",
    "final answer",
    "please show only the answer",
    "question",
    "round to one decimal",
    "see page",
    "use the table above",
    "you asked",
)
# Words of the question templates (English, German).
TEMPLATE_WORDS = frozenset(
    """
    a absolute according after and answer as asked auditors average be between bis budgeted business buyer by came
    change comparative comparing considering decimal did die difference durchschnitt durchschnittlich ends euros exceed
    expect expressed filing final for from geschäft greater growth higher hoch how im in is jahr jahren later level
    lower many mean mit move movement much multiple next of on once one only or over page percent percentage plan please
    pounds dollars thousands millions billions prozent q question rate ratio report reported round see share show shown
    sich single than that the times to um und use veränderte veränderung verglichen viel von war was what which wie
    year years you zwischen above der den wurde
    """.split()
)
# Template words that belong to some kinds of question only; in any other they are part of the measure.
BOUND_WORDS = {
    "after": ("lookup",),
    "auditors": ("expected",),
    "average": ("average",),
    "budgeted": ("budgeted",),
    "buyer": ("buyer_share",),
    "comparative": ("lookup",),
    "comparing": ("compare",),
    "difference": ("difference",),
    "durchschnitt": ("average",),
    "durchschnittlich": ("average",),
    "ends": ("expected",),
    "exceed": ("compare",),
    "expect": ("expected",),
    "greater": ("compare",),
    "growth": ("percent",),
    "higher": ("difference", "compare"),
    "later": ("compare",),
    "level": ("ratio",),
    "lower": ("difference", "compare"),
    "many": ("ratio",),
    "mean": ("average",),
    "move": ("percent", "difference"),
    "movement": ("percent", "difference"),
    "multiple": ("ratio",),
    "next": ("lookup",),
    "once": ("expected",),
    "plan": ("expected", "budgeted"),
    "rate": ("percent",),
    "ratio": ("ratio",),
    "share": ("buyer_share",),
    "single": ("buyer_share",),
    "times": ("ratio",),
}
# The words that decide the kind of result, in order of precedence.
KIND_WORDS = (
    ("expected", {"auditors", "expect"}),
    ("budgeted", {"budgeted"}),
    ("buyer_share", {"buyer"}),
    ("percent", {"percent", "percentage", "prozent", "growth"}),
    ("ratio", {"ratio", "times", "multiple"}),
    ("average", {"average", "mean", "durchschnitt", "durchschnittlich"}),
    ("compare", {"exceed", "greater", "comparing"}),
    ("difference", {"change", "movement", "difference", "lower", "veränderung", "veränderte"}),
    ("lookup", {"comparative", "reported", "shown", "verglichen", "report"}),
)
#: Kinds whose answer the filing cannot state.
UNANSWERABLE = frozenset({"expected", "budgeted", "buyer_share"})
_UNIT_PHRASE = re.compile(r"(?:,\s*|\(|\bexpressed )?\bin (thousands|millions|billions) of (dollars|euros|pounds)\b\)?", re.I)
_OWNER = re.compile(r"\b(was|did)\b((?:(?!\b(?:was|did)\b).)*?)(?:'s|s')\s", re.I)
#: Content words that a question without its owner still has, business and measure; with fewer the owner is the business.
CONTENT = 3
_BACKWARDS = re.compile(r"\b(?:from|von)\s+((?:19|20)\d\d)\s+(?:to|bis)\s+((?:19|20)\d\d)\b")
_REPORTER = re.compile(r"\bdid\b(.*?)\breport for\b", re.I)
_FRAME = re.compile(r"(?:^\W*q\b[.:]?\s)|" + "|".join(rf"\b{re.escape(f)}\b" for f in FRAMES), re.I)


#: Length up to which cleaned texts are remembered.
SHORT = 4096


def clean(text: str | None) -> str:
    """Compatibility-normalised text with plain quotes, hyphens and single spaces."""
    if not text:
        return ""
    return _clean_short(text) if len(text) <= SHORT else _clean(text)


def _clean(text: str) -> str:
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = t.translate(_PLAIN)
    return " ".join(t.split())


_clean_short = lru_cache(1 << 11)(_clean)


def words(text: str | None) -> list[str]:
    """Lower-case words of the cleaned text, years and figures included."""
    return _WORD.findall(clean(text).lower())


_KEYS = {key: kind for kind, keys in KIND_WORDS for key in keys}
_ORDER = {kind: i for i, (kind, _) in enumerate(KIND_WORDS)} | {"other": len(KIND_WORDS)}


@lru_cache(1 << 16)
def _near_key(token: str) -> str | None:
    """Kind whose deciding word ``token`` misspells."""
    if len(token) < 5 or token in TEMPLATE_WORDS:
        return None
    near = [k for k in _KEYS if len(k) > 5 and edits(token, k, 2 if len(k) > 6 else 1) <= (2 if len(k) > 6 else 1)]
    return _KEYS[near[0]] if near else None


def kind_of(tokens: set[str]) -> str:
    """Kind of result asked for, deciding words misspelt or not; ``other`` when no word decides it."""
    kinds = [_KEYS[t] for t in tokens if t in _KEYS]
    kinds += [k for t in tokens if t not in _KEYS and (k := _near_key(t))]
    return min(kinds, key=_ORDER.__getitem__, default="other")


@lru_cache(1 << 14)
def kind_of_text(text: str | None) -> str:
    return kind_of(set(words(text)))


def strip_frame(text: str | None) -> str:
    """The question without framing phrases and unit requests."""
    t = clean(text)
    return _FRAME.sub(" ", _UNIT_PHRASE.sub(" ", t))


def strip_owner(text: str) -> str:
    """The question without the name of the company that owns the business."""
    return _REPORTER.sub("did report for ", _OWNER.sub(r"\1 ", text))


def _content(tokens: list[str], kind: str) -> list[str]:
    bare = {w for w in tokens if w not in TEMPLATE_WORDS or kind not in BOUND_WORDS.get(w, (kind,))}
    return sorted(w for w in bare if not _YEAR.fullmatch(w))


def parse(text: str | None, fix: dict[str, str] | None = None) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(kind, years in ascending order, distinct content words in ascending order).

    ``fix`` maps misspelt words to their usual form.  Null or blank text gives
    ``("none", (), ())``.  Years asked backwards (from 2019 to 2018) come backwards.  The
    owner of the business is left out unless it is all that names one.
    """
    t = clean(text).lower()
    if not t:
        return "none", (), ()
    if fix:
        t = _WORD.sub(lambda m: fix.get(m.group(), m.group()), t)
    whole = strip_frame(t)
    short = strip_owner(whole)
    tokens = _WORD.findall(short)
    kind = kind_of(set(tokens))
    years = tuple(sorted({w for w in tokens if _YEAR.fullmatch(w)}))
    back = _BACKWARDS.search(short)
    if back and back[1] > back[2]:
        years = years[::-1]
    if kind == "other":
        return kind, years, tuple(tokens)
    content = _content(tokens, kind)
    if len(content) < CONTENT and short != whole:
        content = _content(_WORD.findall(whole), kind)
    return kind, years, tuple(content)


def canonical(text: str | None, fix: dict[str, str] | None = None) -> str | None:
    """One string for all wordings of the same question; null for null or blank text."""
    kind, years, content = parse(text, fix)
    return None if kind == "none" else "|".join((kind, " ".join(years), " ".join(content)))
