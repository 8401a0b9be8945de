"""Held-out passages inside a training corpus, by suffix arrays of corpus shards.

The corpus is cut into shards of bounded size where it lies; no text is shuffled.  Each
shard's words (case, punctuation, mark-up, hyphenation and spacing removed) become integer
ranks with a suffix array, written once to the shared folder.  Every suffix of every
passage is searched in every shard by vectorised binary search.

The first pass looks for standard wording: stretches of a passage that many documents carry
without the words that stand beside them in the passage.  A passage that travels as a whole,
however often, is no standard wording, and copies of one text count as one surrounding.  The
second pass takes the occurrences of the rest, extends them to the longest matches, lets
single words differ, and joins matches that inserted text cut once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Words of a passage that a document must carry over.
RUN_WORDS = 25
#: Words that must agree verbatim for a place to be looked at.  Where a stretch of them is in so many places of a
#: shard and of the passages that the pairs exceed ``HOT``, its places are listed only beside other seeds of the
#: same document and passage; alone they carry less than ``LEAST_SEEDED`` words, so nothing found depends on it.
SEED_WORDS, HOT = 6, 1 << 20
#: Rounds of prefix doubling: suffixes are sorted by 2 ** rounds words; longer agreement is found by extension.
DEPTH_ROUNDS = 5
#: Words per shard; a longer document gets a shard of its own.
SHARD_WORDS = 1_000_000
#: Words of passages searched at a time.
BLOCK_WORDS = 2_000_000
#: Occurrences that a task holds at a time.
HELD = 2_000_000
#: A stretch of at least so many words is standard wording if more than this share of all documents carry it alone,
#: and more than so many of them, or of the passages, in different surroundings.
STANDARD_WORDS, STANDARD_SHARE, STANDARD_DOCS, STANDARD_PASSAGES = 12, 0.01, 50, 2
#: Share of all surroundings that must differ on both hands; below it they are copies with words changed.
MIXED = 0.2
#: Words that may differ between two seeds of one stretch; words of a surrounding, taken twice on each side.
GAP_WORDS, AROUND = 4, 3
#: Seed words that must be found before a pair is aligned; words a cut may insert; share of words that must agree.
LEAST_SEEDED, CUT_WORDS, AGREE = 10, 120, 0.9

_TAGS = re.compile(r"<[^<>\n]{1,80}>")
# the first character is named first, as that is what the regex engine can search for
_BROKEN = re.compile(r"[-‐\u00ad](?<=[^\W\d_][-‐\u00ad])\s*\n\s*(?=[^\W\d_])")
_INNER = re.compile(r"[.,'’](?<=\w[.,'’])(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}


def word_list(text: str | None) -> list[str]:
    """Words of a text in their bare form: ``$ 29,836`` gives ``29836``, ``re-\\nsale`` gives ``resale``."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).replace("\u00ad", "").replace("\u200b", "")
    if "<" in t:
        t = _TAGS.sub(" ", t)
    if "\n" in t:
        t = _BROKEN.sub("", t)
    t = _INNER.sub("", t.lower())
    return t.translate(_ASCII).split() if t.isascii() else _WORD.findall(t)


class _Hasher:
    """64-bit hashes of words, remembered within a task; odd for figures, else even."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        words = word_list(text)
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) & ~1 | w[0].isdigit()
        return np.array([known[w] for w in words], dtype=np.uint64)


def suffix_array(ranks: np.ndarray, rounds: int = DEPTH_ROUNDS) -> np.ndarray:
    """Positions in the order of their suffixes, compared up to ``2 ** rounds`` words, by prefix doubling."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    rank = ranks.astype(np.int64)
    step = 1
    for _ in range(rounds):
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * np.int64(n + 2) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        rank = new
        step *= 2
        if step >= n or rank.max() == n:
            break
    return order.astype(np.int32)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mixed(columns) -> np.ndarray:
    """64-bit hash of the words in each row of several equally long columns."""
    out = None
    for c in columns:
        out = c.copy() if out is None else (out ^ (out >> np.uint64(29))) * _STEP + c
    return out ^ (out >> np.uint64(32))


def _build(ids: list[list[int]], parts: list[np.ndarray]) -> dict:
    words = np.concatenate(parts)
    uniq, inverse = np.unique(words, return_inverse=True)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    ranks = np.zeros(int(ends[-1]), dtype=np.int32)  # 0 ends a document
    inside = np.ones(len(ranks), dtype=bool)
    inside[ends - 1] = False
    ranks[inside] = inverse.astype(np.int32) + 1
    return {
        "ids": np.array([i for x in ids for i in x], dtype=np.int64).tobytes(),
        "copies": np.array([len(x) for x in ids], dtype=np.int64).tobytes(),
        "starts": (ends - lengths - 1).astype(np.int32).tobytes(),
        "uniq": uniq.tobytes(),
        "ranks": ranks.tobytes(),
        "sa": suffix_array(ranks).tobytes(),
    }


def _shards(shard_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, size = _Hasher(), 0
        known: dict[str, int] = {}
        ids: list[list[int]] = []
        parts: list[np.ndarray] = []
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                at = known.get(text)
                if at is not None:
                    ids[at].append(doc_id)
                    continue
                words = hashed(text)
                if not len(words):
                    continue
                if parts and size + len(words) > shard_words:
                    yield pd.DataFrame([_build(ids, parts)])
                    known, ids, parts, size = {}, [], [], 0
                known[text] = len(parts)
                ids.append([doc_id])
                parts.append(words)
                size += len(words)
        if parts:
            yield pd.DataFrame([_build(ids, parts)])

    return run


def suffix_index(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Suffix arrays over the texts of ``documents`` (doc_id, text), written to the shared folder.

    Each task indexes the texts that it reads; copies of a text within a shard are indexed
    once, so a text that a third of all rows repeat costs one entry per shard.
    """
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInPandas(_shards(shard_words), "ids binary, copies binary, starts binary, uniq binary, ranks binary, sa binary"))


class Passages(NamedTuple):
    """All passages of a block as one array of word hashes."""

    ids: np.ndarray
    starts: np.ndarray  # one more than there are passages
    words: np.ndarray

    def window_starts(self, m: int) -> np.ndarray:
        """Positions at which ``m`` words of one passage follow."""
        out = [np.arange(a, b - m + 1) for a, b in zip(self.starts[:-1], self.starts[1:]) if b - a >= m]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def items(self) -> np.ndarray:
        """The passage of each word."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


class Shard:
    """A shard of the index, searchable."""

    def __init__(self, row) -> None:
        self.copies = np.frombuffer(row.copies, dtype=np.int64)
        self.ids = np.split(np.frombuffer(row.ids, dtype=np.int64), np.cumsum(self.copies)[:-1])
        self.starts = np.frombuffer(row.starts, dtype=np.int32).astype(np.int64)
        self.uniq = np.frombuffer(row.uniq, dtype=np.uint64)
        self.ranks = np.frombuffer(row.ranks, dtype=np.int32)
        self.sa = np.frombuffer(row.sa, dtype=np.int32)
        self.ends = np.append(self.starts[1:], len(self.ranks)) - 1
        #: Words by rank, with one hash for all figures.
        self.masked = np.append(np.uint64(0), np.where(self.uniq & np.uint64(1), np.uint64(1), self.uniq))
        # numbers, in suffix order, of the three words with which each suffix starts: binary search compares them at once
        n, base = len(self.sa), np.int64(len(self.uniq) + 1)
        padded = np.concatenate((self.ranks, [0, 0])).astype(np.int64)
        three = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2 : n + 2]
        along = three[self.sa]
        fresh = np.concatenate(([True], along[1:] != along[:-1]))
        self.base, self.threes = base, along[fresh]
        number = np.cumsum(fresh) - 1
        self.number_at = np.full(n + 8, -1, dtype=np.int64)
        self.number_at[self.sa] = number
        self.keys: dict[int, np.ndarray] = {}

    def ranks_of(self, words: np.ndarray) -> np.ndarray:
        """Ranks of passage words, -1 for words that the shard lacks."""
        if not len(self.uniq):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.uniq, words), len(self.uniq) - 1)
        return np.where(self.uniq[at] == words, at + 1, -1)

    def _key(self, number: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
        """One integer per place in the order of its first ``m`` words (six or eight)."""
        size = np.int64(len(self.threes) + 1)
        key = (number[places] + 1) * size + number[places + 3] + 1
        return key if m == 6 else key * size + number[places + 5] + 1

    def search(self, query: np.ndarray, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Range [lower, upper) of the suffix array whose first ``m`` words are those at each place of ``query`` (ranks)."""
        if m == 8 and (len(self.threes) + 1) ** 3 >= 2**63:
            m = 6  # a single document of more than two million different stretches
        if m not in self.keys:
            self.keys[m] = self._key(self.number_at, self.sa.astype(np.int64), m)
        q = np.concatenate((query, [-1] * 8))
        three = (q[:-2] * self.base + q[1:-1]) * self.base + q[2:]
        at = np.minimum(np.searchsorted(self.threes, three), len(self.threes) - 1)
        number = np.where((self.threes[at] == three) & (q[:-2] > 0) & (q[1:-1] > 0) & (q[2:] > 0), at, -1)
        parts = [places, places + 3] + ([places + 5] if m == 8 else [])
        there = np.all([number[x] >= 0 for x in parts], axis=0)
        wanted = self._key(number, places, m)
        lower = np.searchsorted(self.keys[m], wanted, side="left")
        upper = np.searchsorted(self.keys[m], wanted, side="right")
        return lower, np.where(there, upper, lower)

    def occurrences(self, passages: Passages, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage position, shard position, document) of verbatim matches from ``places``, whole passages at a time.

        Those of every passage and document that share ``LEAST_SEEDED`` words under seeds are complete.
        """
        query = self.ranks_of(passages.words)
        places = places[query[places] > 0]
        if not len(places):
            return
        lower, upper = self.search(query, places, SEED_WORDS)
        found = upper > lower
        places, lower, upper = places[found], lower[found], upper[found]
        if not len(places):
            return
        # places with the same stretch have the same range
        _, same, n = np.unique(lower, return_inverse=True, return_counts=True)
        hot = n[same] * (upper - lower) > HOT
        hot_seeds = _HotSeeds(self, lower[hot], upper[hot]) if hot.any() else None
        count = np.where(hot, 0, upper - lower)
        item = passages.items()[places]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        ends = np.append(first[1:], len(places))
        upto = np.concatenate(([0], np.cumsum(count)))
        a = 0
        while a < len(first):
            limit = upto[first[a]] + HELD
            b = max(a + 1, int(np.searchsorted(upto[ends], limit, side="right")))
            i, j = first[a], ends[b - 1]
            p = np.repeat(places[i:j], count[i:j])
            t = self.sa[_ranges(lower[i:j], count[i:j])].astype(np.int64)
            doc = self.documents(t)
            if not hot[i:j].any():
                yield p, t, doc
            else:
                parts, size = [], 0
                for x, y in zip(first[a:b], ends[a:b]):
                    u, v = upto[x] - upto[i], upto[y] - upto[i]
                    part = [(p[u:v], t[u:v], doc[u:v])]
                    if hot[x:y].any():
                        at = np.flatnonzero(hot[x:y]) + x
                        part.append(hot_seeds.beside(places[at], lower[at], np.unique(doc[u:v])))
                    more = sum(len(q[0]) for q in part)
                    if parts and size + more > HELD:
                        yield tuple(np.concatenate(q) for q in zip(*parts))
                        parts, size = [], 0
                    parts += part
                    size += more
                yield tuple(np.concatenate(q) for q in zip(*parts))
            a = b

    def documents(self, t: np.ndarray) -> np.ndarray:
        """The document of each shard position."""
        return np.searchsorted(self.starts, t, side="right") - 1

    def around(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of ``AROUND`` words from each place, whether they lie in [first, last))."""
        inside = (at >= first) & (at + AROUND <= last)
        at = np.where(inside, at, 0)
        words = [self.masked[self.ranks[np.minimum(at + j, len(self.ranks) - 1)]] for j in range(AROUND)]
        return _mixed(words).view(np.int64), inside


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` whole numbers from each ``start`` on."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


class _HotSeeds:
    """Places of stretches that are too frequent in a shard and the passages to list every pair, by document."""

    def __init__(self, shard: Shard, lower: np.ndarray, upper: np.ndarray) -> None:
        self.lower, at = np.unique(lower, return_index=True)
        count = upper[at] - self.lower
        t = shard.sa[_ranges(self.lower, count)].astype(np.int64)
        self.width = np.int64(len(shard.starts))
        key = np.repeat(np.arange(len(count)), count) * self.width + shard.documents(t)
        order = np.lexsort((t, key))
        self.keys, self.t = key[order], t[order]
        docs = np.unique(key)
        self.docs = np.split(docs % self.width, np.searchsorted(docs, np.arange(1, len(count)) * self.width))
        self.known: dict[tuple[bytes, bytes], np.ndarray] = {}

    def _enough(self, seed: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Documents that have ``LEAST_SEEDED`` words of a passage under its hot seeds alone."""
        step = np.minimum(np.diff(places), SEED_WORDS)
        if SEED_WORDS + step.sum() < LEAST_SEEDED:
            return np.zeros(0, dtype=np.int64)
        name = seed.tobytes(), step.tobytes()
        if name not in self.known:
            if len(self.known) * self.width > HELD:
                self.known.clear()
            last, covered = np.full(self.width, -SEED_WORDS), np.zeros(self.width, dtype=np.int64)
            for s, p in zip(seed, np.concatenate(([0], np.cumsum(step)))):
                docs = self.docs[s]
                covered[docs] += np.minimum(p - last[docs], SEED_WORDS)
                last[docs] = p
            self.known[name] = np.flatnonzero(covered >= LEAST_SEEDED)
        return self.known[name]

    def beside(self, places: np.ndarray, lower: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the hot ``places`` of one passage in ``docs``, where other seeds of it are, and where they suffice alone."""
        seed = np.searchsorted(self.lower, lower)
        docs = np.union1d(docs, self._enough(seed, places))
        wanted = (seed[:, None] * self.width + docs).ravel()
        start = np.searchsorted(self.keys, wanted, side="left")
        count = np.searchsorted(self.keys, wanted, side="right") - start
        return np.repeat(np.repeat(places, len(docs)), count), self.t[_ranges(start, count)], np.repeat(np.tile(docs, len(seed)), count)


_EVIDENCE = "stretch long, first long, last long, doc long, start long, place long, copies long, near_left long, far_left long, near_right long, far_right long"


def _evidence_pass(block, excerpts: bool):
    """Stretches of passages that a text carries without their neighbours, with the words around them there.

    ``excerpts`` says that the texts are passages themselves, so that their own ends say nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages: Passages = block.value
        places, item_of = passages.window_starts(SEED_WORDS), passages.items()
        # a stretch is named by the sum of its words' hashes, each times a power: equal in all passages and blocks that hold it
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(passages.words), x)), dtype=np.uint64) for x in (_STEP, _STEP_BACK))
        upto = np.append(np.uint64(0), np.cumsum(passages.words * power[:-1], dtype=np.uint64))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard = Shard(row)
                for p, t, doc in shard.occurrences(passages, places):
                    item = item_of[p]
                    pair, diagonal = doc * len(passages.ids) + item, t - p
                    order = np.lexsort((p, diagonal, pair))
                    p, t, doc, item, pair, diagonal = (x[order] for x in (p, t, doc, item, pair, diagonal))
                    new = (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (np.diff(p) > SEED_WORDS + GAP_WORDS)
                    i = np.concatenate(([0], np.flatnonzero(new) + 1))
                    j = np.concatenate((np.flatnonzero(new), [len(p) - 1]))
                    s, e, a, b = p[i], p[j] + SEED_WORDS, t[i], t[j] + SEED_WORDS
                    ds, de = shard.starts[doc[i]], shard.ends[doc[i]]
                    # an end says something where the passage goes on, and the other text too if it is an
                    # excerpt like the passage; seeds cannot see nearer than their length
                    left, right = s - passages.starts[item[i]] >= SEED_WORDS, passages.starts[item[i] + 1] - e >= SEED_WORDS
                    if excerpts:
                        left, right = left & (a - ds >= SEED_WORDS), right & (de - b >= SEED_WORDS)
                    alone = (left | right) & (e - s >= STANDARD_WORDS)
                    s, e, a, b, ds, de, d = (x[alone] for x in (s, e, a, b, ds, de, doc[i]))
                    name = ((upto[e] - upto[s]) * back[s]).view(np.int64)
                    # a document speaks once for a stretch, by its first place; every place of it in the passages is kept
                    order = np.argsort(a, kind="stable")
                    s, e, a, b, ds, de, d, name = (x[order] for x in (s, e, a, b, ds, de, d, name))
                    told = pd.DataFrame({"stretch": name, "d": d}).duplicated().to_numpy()
                    again = told & ~pd.DataFrame({"stretch": name, "s": s, "e": e}).duplicated().to_numpy()
                    keep = ~told | again
                    out = {"stretch": name[keep], "first": s[keep], "last": e[keep], "doc": [shard.ids[x][0] for x in d[keep]], "start": ds[keep], "place": a[keep]}
                    out["copies"] = np.where(told[keep], 0, shard.copies[d[keep]])
                    for column, at in (
                        ("near_left", a - AROUND),
                        ("far_left", a - 2 * AROUND - 1),
                        ("near_right", b),
                        ("far_right", b + AROUND + 1),
                    ):
                        h, inside = shard.around(at[keep], ds[keep], de[keep])
                        out[column] = pd.arrays.IntegerArray(h, ~inside | told[keep])
                    yield pd.DataFrame(out)

    return run


def _surroundings(a: str, b: str, unless: str | None = None) -> Column:
    """Different surroundings by two groups of words, of rows that have both (and not ``unless``).

    Copies of one text, in some of which words are changed, differ in one group or the other:
    as many pairs as values of both, none of them new.  D(a) + D(b) - D(a, b) leaves them out.
    Where texts are independent there are as many pairs as values, or more than values of both.
    """
    told = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(unless).isNull() if unless else F.lit(True))
    one = lambda c: F.count_distinct(F.when(told, F.col(c)))
    pairs = F.count_distinct(F.when(told, F.struct(a, b)))
    shared = one(a) + one(b) - pairs
    return F.when(shared <= 0, F.least(one(a), one(b))).when(shared >= MIXED * pairs, shared).otherwise(0)


def _alone(evidence: DataFrame) -> DataFrame:
    """(stretch, docs, around): how many rows carry each stretch alone, and in how many different surroundings.

    A text that tells of a stretch in several blocks of passages is counted once, by its first place.
    """
    left, right = ("near_left", "far_left"), ("near_right", "far_right")
    around = F.greatest(
        _surroundings(*left) + _surroundings(*right, "far_left"),
        _surroundings(*right) + _surroundings(*left, "far_right"),
        _surroundings("far_left", "far_right"),
    )
    said = F.min_by(F.struct("copies", *left, *right), "place").alias("said")
    once = evidence.where("copies > 0").groupBy("stretch", "doc", "start").agg(said).select("stretch", "said.*")
    return once.groupBy("stretch").agg(F.sum("copies").alias("docs"), around.alias("around"))


def _union(frames: list[DataFrame]) -> DataFrame:
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) & ~1 :]
    return frames[0]


def standard_stretches(found: list[DataFrame], seen: list[DataFrame], total: int) -> DataFrame:
    """(stretch): standard wording by the evidence of all blocks of passages, from the documents and from all passages."""
    often = _alone(_union(found)).where(F.col("docs") > STANDARD_SHARE * total)
    others = _alone(_union(seen)).select("stretch", F.col("around").alias("seen"))
    many = (F.col("around") > STANDARD_DOCS) | (F.coalesce("seen", F.lit(0)) > STANDARD_PASSAGES)
    return cut(often.join(others, "stretch", "left").where(many).select("stretch"))


def standard_words(found: DataFrame, standard: DataFrame, words: int) -> np.ndarray:
    """True for each word of a block of passages that lies in standard wording; ``found`` is the block's evidence."""
    out = np.zeros(words, dtype=bool)
    # as many rows as the block has words, times the few stretches that a share of the corpus can hold
    for r in found.select("stretch", "first", "last").distinct().join(standard, "stretch").select("first", "last").toLocalIterator():
        out[r["first"] : r["last"]] = True
    return out


def _segments(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, diagonal) of the best run of each diagonal: agreement counts 1, disagreement -2."""
    out = []
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi - lo < SEED_WORDS:
            continue
        score = np.where(item[lo:hi] == doc[lo + d : hi + d], 1, -2)
        total = np.concatenate(([0], np.cumsum(score)))
        gain = total - np.minimum.accumulate(total)
        end = int(np.argmax(gain))
        start = int(np.argmin(total[: end + 1]))
        if end > start:
            out.append((int(lo + start), int(lo + end), int(d)))
    return out


def carried_words(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, counts: np.ndarray) -> int:
    """Countable words of the longest run of ``item`` that ``doc`` carries over, cut at most once.

    ``counts`` says which passage words count (standard wording does not).
    """
    segs = sorted(_segments(item, doc, diagonals))
    best = 0
    # per segment: words, agreeing words and end without and with a cut
    state: list[list[tuple[int, int] | None]] = []
    for i, (a, b, d) in enumerate(segs):
        own = (int(counts[a:b].sum()), int((item[a:b] == doc[a + d : b + d]).sum()), b - a)
        mine: list = [own, None]
        for j in range(i):
            pa, pb, pd_ = segs[j]
            start = max(a, pb)
            if start >= b or pa >= a or start - pb > 4:
                continue
            gap = (start + d) - (pb + pd_)
            if gap < 0 and abs(d - pd_) > 3:
                continue
            add = (int(counts[start:b].sum()), int((item[start:b] == doc[start + d : b + d]).sum()), b - start)
            far = abs(d - pd_) > 3
            if far and gap > CUT_WORDS:
                continue
            for was in (0, 1):
                prior = state[j][was]
                to = was + far
                if prior is None or to > 1:
                    continue
                new = tuple(x + y for x, y in zip(prior, add))
                if mine[to] is None or new[0] > mine[to][0]:
                    mine[to] = new
        state.append(mine)
        for s in (own, *mine):
            if s is not None and s[1] >= AGREE * s[2]:
                best = max(best, s[0])
    return best


def _agreeing(words: np.ndarray, ranks: np.ndarray, first: np.ndarray, last: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Passage words from each ``first`` to ``last`` that agree with the shard on a diagonal."""
    n = np.maximum(last - first, 0)
    upto = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(len(n), dtype=np.int64)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + HELD, side="right")) - 1)
        at = _ranges(first[a:b], n[a:b])
        same = np.concatenate(([0], np.cumsum(words[at] == ranks[at + np.repeat(diagonal[a:b], n[a:b])])))
        out[a:b] = same[upto[a + 1 : b + 1] - upto[a]] - same[upto[a:b] - upto[a]]
        a = b
    return out


def _match_pass(block, flags, run_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages, standard = block.value, flags.value
        places, item_of = passages.window_starts(SEED_WORDS), passages.items()
        plain = np.concatenate(([0], np.cumsum(~standard)))
        places = places[plain[places + SEED_WORDS] > plain[places]] if len(places) else places
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard = Shard(row)
                words = shard.ranks_of(passages.words)
                out = []
                for p, t, doc in shard.occurrences(passages, places):
                    pair = doc * len(passages.ids) + item_of[p]
                    order = np.lexsort((p, pair))
                    pair, p, t = pair[order], p[order], t[order]
                    first = np.concatenate(([0], np.flatnonzero(np.diff(pair)) + 1))
                    # words under at least one seed, a cheap upper view of what can be carried
                    step = np.minimum(np.diff(p, prepend=-SEED_WORDS), SEED_WORDS)
                    step[first] = SEED_WORDS
                    covered = np.add.reduceat(step, first)
                    last = np.append(first[1:], len(pair))
                    seeded = np.flatnonzero(covered >= LEAST_SEEDED)
                    # no run has more agreeing words than all diagonals of its pair together
                    at = _ranges(first[seeded], (last - first)[seeded])
                    nth, line = np.repeat(np.arange(len(seeded)), (last - first)[seeded]), t[at] - p[at]
                    order = np.lexsort((line, nth))
                    nth, line = nth[order], line[order]
                    new = (np.diff(nth, prepend=-1) != 0) | (np.diff(line, prepend=0) != 0)
                    nth, line = nth[new], line[new]
                    dd, ii = np.divmod(pair[first[seeded]][nth], len(passages.ids))
                    lo, hi = np.maximum(passages.starts[ii], shard.starts[dd] - line), np.minimum(passages.starts[ii + 1], shard.ends[dd] - line)
                    agreeing = np.bincount(nth, _agreeing(words, shard.ranks, lo, hi, line), len(seeded))
                    able = seeded[agreeing >= AGREE * run_words]
                    for a, b in zip(first[able], last[able]):
                        dd, ii = divmod(int(pair[a]), len(passages.ids))
                        s, e = int(passages.starts[ii]), int(passages.starts[ii + 1])
                        ds, de = int(shard.starts[dd]), int(shard.ends[dd])
                        diagonals = np.unique((t[a:b] - ds) - (p[a:b] - s))
                        n = carried_words(words[s:e], shard.ranks[ds:de], diagonals, ~standard[s:e])
                        if n >= run_words:
                            at = int(t[a:b].min()) - ds
                            out += [(int(i), int(passages.ids[ii]), n, at) for i in shard.ids[dd]]
                yield pd.DataFrame(out, columns=["doc_id", "item", "words", "at_word"])

    return run


def _blocks(items: DataFrame, block_words: int) -> Iterator[Passages]:
    """Passages in blocks of at most ``block_words`` words (or one passage), read part by part."""
    hashed = _Hasher()
    ids: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for row in items.orderBy("item").toLocalIterator():
        words = hashed(row.passage)
        if ids and size + len(words) > block_words:
            yield _passages(ids, parts)
            ids, parts, size = [], [], 0
        ids.append(row.item)
        parts.append(words)
        size += len(words)
    if ids:
        yield _passages(ids, parts)


def _passages(ids: list[int], parts: list[np.ndarray]) -> Passages:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return Passages(np.array(ids, dtype=np.int64), starts, np.concatenate(parts))


_FOUND = "doc_id long, item long, words int, at_word int"


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    run_words: int = RUN_WORDS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, words, at_word): documents that carry over ``run_words`` words of a passage.

    ``words`` is the length of the longest run, ``at_word`` the place of its first verbatim
    match.  Null and empty texts and passages match nothing; a passage shorter than
    ``run_words`` cannot leak; every copy of a document is reported under its own doc_id,
    every copy of a passage under its own item_id (copies are searched once).  The passages
    are the query set: they pass in blocks of bounded size, the corpus never leaves its
    shards; the sizes of both change nothing in the result.  A stretch that more than ``STANDARD_SHARE`` of all documents carry alone, more
    than ``STANDARD_DOCS`` of them or ``STANDARD_PASSAGES`` passages in different
    surroundings, is standard wording and counts for nothing.
    """
    spark = documents.sparkSession
    index = suffix_index(documents, shard_words)
    total = documents.where("text is not null").count()
    named = items.where("item_id is not null and passage is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "passage", F.xxhash64("passage").alias("k1"), F.xxhash64(F.lit(1), "passage").alias("k2")
    )
    once = cut(named.groupBy("k1", "k2").agg(F.min("item_id").alias("item"), F.min("passage").alias("passage")))
    others = suffix_index(once.select(F.col("item").alias("doc_id"), F.col("passage").alias("text")), shard_words)
    # what is standard wording is told by all blocks, before any is matched
    told, seen = [], []
    for passages in _blocks(once.select("item", "passage"), block_words):
        block = spark.sparkContext.broadcast(passages)
        told.append(cut(index.mapInPandas(_evidence_pass(block, False), _EVIDENCE)))
        seen.append(cut(others.mapInPandas(_evidence_pass(block, True), _EVIDENCE)))
        block.destroy()
    found = spark.createDataFrame([], _FOUND)
    standard = standard_stretches(told, seen, total) if told else None
    for evidence, passages in zip(told, _blocks(once.select("item", "passage"), block_words)):
        block = spark.sparkContext.broadcast(passages)
        flags = spark.sparkContext.broadcast(standard_words(evidence, standard, len(passages.words)))
        found = found.union(cut(index.mapInPandas(_match_pass(block, flags, run_words), _FOUND)))
        block.destroy()
        flags.destroy()
    copies = named.select("item_id", "k1", "k2").join(once.select("item", "k1", "k2"), ["k1", "k2"])
    return found.join(copies, "item").select("doc_id", "item_id", "words", "at_word")


def clean_documents(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """``documents`` without those that carry a passage."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
