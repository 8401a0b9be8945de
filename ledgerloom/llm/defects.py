"""Broken prompt and response pairs: every defect of a reply or gold answer.

Ordered rules look at emptiness, unclosed delimiters, abrupt endings, refusal
phrases, copied questions and the language of the reply.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.quantities import parse_quantity
from ledgerloom.functions.questions import UNANSWERABLE, clean, kind_of_text, words
from ledgerloom.functions.replies import is_abstention, language, stated_result, unwrap

#: Share of a reply's words that must come from the question, and of the question's that must occur.
COPIED, COVERED = 0.85, 0.6

# What stands for no answer.
PLACEHOLDERS = frozenset(
    "n/a na n.a n.a. nan nil none null undefined unknown tbd tba todo -- --- blank empty (blank) (empty) no_answer".split()
)
# Phrases by which a reply declines, by language.
REFUSALS = re.compile(
    r"\b(?:i|we)(?:'m| am| are|'re)? (?:really |truly |afraid (?:i|we) )?(?:can't|cannot|can not|couldn't|could not|won't|will not|"
    r"would not|wouldn't|would rather not|must decline|have to decline|decline|do not feel|don't feel|am unable|are unable|unable|"
    r"am not (?:able|in a position|permitted|allowed|comfortable)|not (?:able|in a position|permitted|allowed|comfortable)|refuse|"
    r"prefer not|have to leave|don't have|do not have|am not going)\b"
    r"|\b(?:unable|not able) to (?:answer|help|assist|provide|comment|compute|determine|say)\b"
    r"|\bfalls outside what\b|\boutside (?:my|what i)\b|\bwould not be appropriate\b|\bwouldn't be appropriate\b|\bnot appropriate for me\b"
    r"|\b(?:guidelines|policy|policies|rules) (?:don't|do not|doesn't|does not|forbid|prohibit)"
    r"|\bnothing i (?:could|can) (?:state|say|give)\b|\bleave to a professional\b|\bno answer can be given\b"
    r"|\b(?:against my|not something i can)\b"
    r"|\bich (?:kann|darf|möchte|werde) .{0,60}\bnicht\b|\bkeine (?:auskunft|antwort)\b|\bnicht (?:beantworten|möglich)\b"
    r"|\bje (?:ne peux|ne suis|refuse|préfère ne)|\b(?:no puedo|no me es posible|prefiero no|lo siento)\b"
    r"|\b(?:non posso|non sono in grado|mi dispiace)\b|\b(?:não posso|não consigo|desculpe|lamento)\b"
    r"|\b(?:ik kan|kan ik) .{0,40}\bniet\b|\bnie mogę\b|\bjag kan inte\b|\bnu pot\b"
    r"|お答えできません|できません|申し訳|无法|不能回答|抱歉|답변할 수 없|할 수 없습니다|не могу|извините|لا أستطيع"
)
_ABRUPT = re.compile(r"(?:…|\.\.+|[,;:(\[{\-–—/*+=]|\b(?:and|or|of|to|by|in|for|from|the|a|an|is|was|with|between|approximately|about|then))$")
_OPENERS = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = re.compile(r"[()\[\]{}]")
_LEAD = re.compile(r"^[\s>\"'“”‘’*_#-]*(?:(?:you asked|question|q|final answer|the question (?:is|was)|answer)\s*[:.]\s*)?", re.I)


def is_empty(text: str | None) -> bool:
    """Null, white space (no-break and zero-width included), a bare marker, or a placeholder."""
    t = clean(text).strip("​‌‍⁠﻿ ")
    if not t:
        return True
    inner = clean(unwrap(t)[0])
    bare = re.sub(r"[\s\"'`*_<>\[\]{}().:;,\-–—=~|/\\…?!#]+", "", inner)
    if not bare:
        return not re.search(r"[$€£%]", inner)
    return inner.lower().strip(" .\"'`*_[](){}<>") in PLACEHOLDERS


def unclosed(text: str) -> bool:
    """A bracket, brace or JSON string is opened and never closed."""
    stack: list[str] = []
    for ch in _BRACKETS.findall(text):
        if ch in _OPENERS:
            stack.append(_OPENERS[ch])
        elif ch in _OPENERS.values() and stack and stack[-1] == ch:
            stack.pop()
    return bool(stack) or text.count("```") % 2 == 1


@lru_cache(1 << 10)
def _asked(question: str | None) -> tuple[str, ...]:
    return tuple(words(question))


@lru_cache(1 << 10)
def _asked_in(question: str | None) -> str:
    return language(question, 1) or "en"


def copies_question(text: str, question: str | None) -> bool:
    """The reply is the question, complete or nearly, once or repeated, and nothing else."""
    asked = _asked(question)
    # words have a letter and a blank each
    if len(asked) < 4 or len(text) < 2 * COVERED * len(asked) - 1:
        return False
    lines = [_LEAD.sub("", part) for part in re.split(r"\n|(?<=[?.])\s+(?=final answer|question|q\b)", text.strip(), flags=re.I)]
    said = [w for part in lines for w in words(part)]
    if not said:
        return False
    have = Counter(asked)
    known = sum(w in have for w in said)
    covered = sum((Counter(said) & have).values())
    return known >= COPIED * len(said) and covered >= COVERED * len(asked)


def has_result(text: str) -> bool:
    """The reply states a figure, yes or no, or that the filing does not give the answer."""
    result = stated_result(text)
    if result is None:
        return False
    r = clean(result).lower().strip(" .!\"'`*")
    return r in ("yes", "no", "true", "false") or parse_quantity(result) is not None


# A reply sentence in another language that carries its figure inside.
_FIGURE = re.compile(r"\d")


def defects(text: str | None, question: str | None, gold: str | None, reply: bool) -> list[str]:
    """Every defect of one field, in rule order; ``reply`` is false for golds, which are never refusals.

    Each rule is tested by itself.  An empty field has no words for the other rules, and a
    reply that abstains where the gold does has no defect.  Unclosed delimiters and abrupt
    ends are truncation whatever else is wrong; a missing result alone is only where
    neither a copied question nor declining explains it.
    """
    if is_empty(text):
        return ["empty"]
    t = clean(text)
    low = t.lower()
    asked = clean(question).lower()
    copied = copies_question(text, question)
    result = has_result(text)
    # of a copied question only what was added can be in another language
    asked_words = set(_asked(question)) if copied else ()
    own = " ".join(w for w in words(text) if w not in asked_words) if copied else text
    wanted = _asked_in(question)
    # of a gold the language matters only where it is asked in another than English and gives no result
    spoken = language(own) if reply or wanted != "en" and not result else None
    foreign = reply and spoken is not None and spoken != wanted
    abstains = is_abstention(low)
    # a copied question may hold such a phrase itself
    declines = reply and not result and (abstains or any(not copied or m[0] not in asked for m in REFUSALS.finditer(low)))
    no_answer = is_abstention(gold) or kind_of_text(question) in UNANSWERABLE
    if declines and no_answer and not copied:
        return []
    open_ended = bool(re.match(r"^\s*\{", t) and not t.endswith("}")) or (unclosed(t) and not result)
    abrupt = bool(_ABRUPT.search(low))
    if foreign and not copied:
        broken = abrupt or unclosed(t) or not (declines or _FIGURE.search(t) or t[-1:] in ".!。")
    elif copied or declines:
        broken = open_ended or abrupt and not result
    elif result or abstains or clean(unwrap(text)[0]).lower().strip(" .!") in ("yes", "no"):
        broken = open_ended
    else:
        broken = open_ended or abrupt or wanted == "en" or spoken == "en" or not _FIGURE.search(t)
    rules = {
        "copies_question": copied,
        "refusal": declines and not no_answer,
        "truncated": broken,
        "other_language": foreign,
    }
    return [name for name, fires in rules.items() if fires]


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for no, question, gold, tuned in zip(pdf["pred_no"], pdf["question"], pdf["gold"], pdf["tuned_answer"]):
            for field, text in (("tuned_answer", tuned), ("gold", gold)):
                for i, d in enumerate(defects(text, question, gold, field == "tuned_answer")):
                    out.append((no, field, d, i))
        yield pd.DataFrame(out, columns=["pred_no", "field", "defect", "nth"])


def broken_pairs(predictions: DataFrame) -> DataFrame:
    """(pred_no, field, defect, nth): every defect of each ``tuned_answer`` and ``gold``; ``nth`` 0 is the first rule.

    One scan without a shuffle.  Nulls count as empty; a null question can be neither
    copied nor in another language than English; whole texts are read.  An empty table
    gives no rows, repeated rows count under their own pred_no.
    """
    return predictions.select("pred_no", "question", "gold", "tuned_answer").mapInPandas(
        _flag, "pred_no long, field string, defect string, nth int"
    )


def defect_report(flagged: DataFrame) -> DataFrame:
    """Number of fields per defect."""
    return flagged.groupBy("field", "defect").agg(F.count("*").alias("n"))
