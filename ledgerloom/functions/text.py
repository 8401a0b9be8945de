"""Text functions of answers and documents, as Column expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of answer texts.
ABSTENTION = r"(?iU)\b(not enough information|cannot determine|can't determine|insufficient information)\b"
BARE_ABSTENTION = r"(?iU)\b(not enough information|cannot determine|insufficient information)\b"
MARKER_LINE = r"(?iU)\bfinal\s+answer\s*:\s*(.*)$"
STRICT_LINE = r"(?iU)^final\s+answer\s*:\s*.+$"
FORBIDDEN_IN_PROGRAM = r"(?i)final\s+answer\s*:|evidence\s*:|calculation\s*:|reasoning\s*:|```|markdown"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
_SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often lambdas inside the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` drops blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, with every run of white space as one blank."""
    return strip(F.regexp_replace(c, _SPACE, " "))


def lines(c: Column) -> Column:
    return F.split(text(c), LINE_BREAK)


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; an empty array for null.

    Only ASCII letters are folded, so that no other letter becomes one.
    """
    return F.regexp_extract_all(F.translate(text(c), ascii_uppercase, ascii_lowercase), F.lit("[a-z0-9]+"), 0)


def ngrams(words: Column, n: int) -> Column:
    """All n-word strings in order; an empty array where there are fewer than ``n`` words."""
    none = F.array().cast("array<string>")

    def spans(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return let(words, spans)


def ngram_hashes(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-grams, each taken over the hashes of its words."""
    none = F.array().cast("array<long>")

    def spans(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1)))
        return F.when(F.size(h) >= n, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n))))).otherwise(none)

    return let(F.transform(words, lambda w: F.xxhash64(w)), spans)


def contains_abstention(c: Column) -> Column:
    return text(c).rlike(ABSTENTION)


def normalize_answer(c: Column) -> Column:
    """Lower case with only ``a-z0-9.%$€£+-`` kept, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(strip(text(c))), r"[^a-z0-9.%$€£+-]+", " "))


def final_answer(c: Column) -> Column:
    """Struct (answer, found): the answer after the first marker line.

    A marker without an answer takes the next line that is not blank; without a marker
    the whole stripped text is the answer.
    """
    ls = lines(c)
    marked = F.transform(ls, lambda x: x.rlike(MARKER_LINE))
    at = F.array_position(marked, F.lit(True)).cast("int")
    same = strip(F.regexp_extract(F.get(ls, at - 1), MARKER_LINE, 1))
    after = F.filter(F.slice(ls, F.greatest(at + 1, F.lit(1)), F.size(ls)), lambda x: strip(x) != "")
    nxt = strip(F.coalesce(F.get(after, F.lit(0)), F.lit("")))
    answer = F.when(at == 0, strip(text(c))).when(same != "", same).otherwise(nxt)
    return F.struct(answer.alias("answer"), (at > 0).alias("found"))


def strict_format(c: Column) -> Column:
    """Exactly one line that is not blank, and it starts with the marker and has content."""
    full = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return (F.size(full) == 1) & F.coalesce(F.get(full, F.lit(0)).rlike(STRICT_LINE), F.lit(False))


def excerpt(c: Column, size: int = 700) -> Column:
    """Squeezed text of at most ``size`` characters, cut ones ending in three dots."""
    t = squeeze(text(c))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, size - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(t) <= size, t).otherwise(cut)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def percent_text(c: Column) -> Column:
    """``12.3%`` of a rate."""
    return F.format_string("%.1f%%", c * 100)


def signed_percent_text(c: Column) -> Column:
    return F.format_string("%+.1f", c * 100)


def interval_text(low: Column, high: Column) -> Column:
    return F.format_string("[%.1f, %.1f]", low * 100, high * 100)


def first_text(*columns: Column) -> Column:
    """The first of several values that is neither null nor blank, stripped; empty if none is."""
    stripped = [strip(c.cast("string")) for c in columns]
    return F.coalesce(*[F.when(s != "", s) for s in stripped], F.lit(""))
