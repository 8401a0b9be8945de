"""Subject areas of documents, from averaged word and subword embeddings.

A sentence is the mean of its word vectors, a word the mean of the vectors of itself
and its character n-grams; independent logistic outputs give the subjects.  Training
sentences inherit the labels of their document, so that wording found everywhere
learns the base rate and wording about a subject a high one.  Gradients of partitions
are summed every step (synchronous training); every document is then scored sentence by
sentence and has the subjects that at least two of its sentences are about.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import letters
from ledgerloom.functions.strings import edits
from ledgerloom.session import cut, small

#: Documents with labels that the classifier is fitted on, at most; chosen by hash.
MAX_LABELLED = 20_000
#: Partitions whose gradients are summed, hash buckets of features, dimensions, steps, step size.
PARTITIONS, BUCKETS, DIM, STEPS, RATE = 6, 1 << 15, 16, 60, 0.12
#: Decay of weights per step and rate, and the evidence, in sentences, under which features hardly move.
DECAY, EVIDENCE = 0.02, 2.0
#: Sentences that must be about a subject, and the probability from which one is.
SENTENCES, LINE = 2, 0.5
#: Labels that stand for no subject.
NO_SUBJECT = "none"
#: A label is a misspelling of another that is at least so many times as frequent; the most frequent labels that may be meant.
OFTEN, MAX_SUBJECTS = 20, 10_000
#: Sentences remembered by a scoring task.
REMEMBERED = 200_000

_TAG = re.compile(r"<[^<>\n]{1,80}>")
# patterns name their first characters first, as those are what the regex engine can search for
_WRAP = re.compile(r"[-‐\u00ad](?<=[^\W\d_,][-‐\u00ad])\n(?=[^\W\d_])")
_BLANKS = re.compile(r"[ \t]+\n")
_LINE = re.compile(r"\n(?<=[^\W\d_,;]\n)(?=[^\W\d_A-ZÄÖÜ])")
_END = re.compile(r"[.!?][\"'”’)\]*_]*\s+|\n+|\s\|\s|\t+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Sentences:
    """Sentences of whole texts; a task remembers the words of sentences that it has met."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.known: dict[str, str] = {}
        self.most = most

    def __call__(self, text: str | None) -> list[str]:
        """Sentences as lower-case words joined by blanks; mark-up, figures and lone words are left out."""
        if not text:
            return []
        t = html.unescape(text) if "&" in text else text
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t).replace("\u00ad", "").replace("\u200b", "")
        if "<" in t:
            t = _TAG.sub(" ", t)
        if "\n" in t:
            t = _LINE.sub(" ", _BLANKS.sub("\n", _WRAP.sub("", t)))
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for part in _END.split(t):
            words = known.get(part)
            if words is None:
                found = _WORDS.findall(part.lower())
                words = known[part] = " ".join(found) if len(found) > 2 else ""
            if words:
                out.append(words)
        return out


def sentences(text: str | None) -> list[str]:
    return Sentences()(text)


def _hash(feature: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(feature) % buckets


@lru_cache(1 << 17)
def word_features(word: str, buckets: int) -> tuple[int, ...]:
    """Hash buckets of a word and of its character n-grams of three to five characters."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] if len(w) > 4 else []
    own = _hash(word, buckets)
    # the word itself weighs as much as its n-grams together
    return (own, *[_hash("#" + g, buckets) for g in grams])


class Block:
    """Training sentences of a partition: distinct ones with how often they occur and with which labels."""

    def __init__(self, counts: dict[str, np.ndarray], buckets: int) -> None:
        self.texts = list(counts)
        table = np.array([counts[t] for t in self.texts]) if self.texts else np.zeros((0, 1))
        self.n, self.hits = table[:, 0], table[:, 1:]
        known: dict[str, int] = {}
        pairs, self.sizes = [], []
        for t in self.texts:
            ids = [known.setdefault(w, len(known)) for w in t.split()]
            pairs.append(ids)
            self.sizes.append(len(ids))
        self.sentence_words = np.array([i for p in pairs for i in p], dtype=np.int64)
        self.sizes = np.array(self.sizes, dtype=np.int64)
        features = [word_features(w, buckets) for w in known]
        self.word_sizes = np.array([len(f) for f in features], dtype=np.int64)
        self.features = np.array([i for f in features for i in f], dtype=np.int64)
        weight = [np.concatenate(([0.5 if k > 1 else 1.0], np.full(k - 1, 0.5 / max(k - 1, 1)))) for k in self.word_sizes]
        self.weights = np.concatenate(weight) if weight else np.zeros(0)
        self.buckets = buckets
        # occurrences in the order of their words and of their features, so that sums need no scattered additions
        self.by_word = np.argsort(self.sentence_words, kind="stable")
        self.word_starts = np.searchsorted(self.sentence_words[self.by_word], np.arange(len(self.word_sizes)))
        self.by_feature = np.argsort(self.features, kind="stable")
        self.used, self.feature_starts = np.unique(self.features[self.by_feature], return_index=True)

    def _forward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.add.reduceat(e[self.features] * self.weights[:, None], np.cumsum(self.word_sizes) - self.word_sizes, axis=0)
        means = np.add.reduceat(words[self.sentence_words], np.cumsum(self.sizes) - self.sizes, axis=0)
        return words, means / self.sizes[:, None]

    def gradient(self, model: dict) -> tuple[dict, float, float]:
        """(gradient sums, loss sum, weight) of the block."""
        e, w, b = model["e"], model["w"], model["b"]
        zero = {"e": np.zeros_like(e), "w": np.zeros_like(w), "b": np.zeros_like(b)}
        if not self.texts:
            return zero, 0.0, 0.0
        _, s = self._forward(e)
        z = np.clip(s @ w + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        d = self.n[:, None] * p - self.hits
        loss = float(-(self.hits * np.log(p) + (self.n[:, None] - self.hits) * np.log(1 - p)).sum())
        ds = (d @ w.T) / self.sizes[:, None]
        per_word = np.add.reduceat(np.repeat(ds, self.sizes, axis=0)[self.by_word], self.word_starts, axis=0)
        per_feature = (np.repeat(per_word, self.word_sizes, axis=0) * self.weights[:, None])[self.by_feature]
        zero["e"][self.used] = np.add.reduceat(per_feature, self.feature_starts, axis=0)
        zero["w"], zero["b"] = s.T @ d, d.sum(axis=0)
        return zero, loss, float(self.n.sum())

    def probabilities(self, model: dict) -> np.ndarray:
        if not self.texts:
            return np.zeros((0, len(model["b"])))
        _, s = self._forward(model["e"])
        return 1 / (1 + np.exp(-np.clip(s @ model["w"] + model["b"], -30, 30)))


def new_model(subjects: list[str], buckets: int = BUCKETS, dim: int = DIM, seed: int = 13) -> dict:
    rng = np.random.default_rng(seed)
    return {
        "subjects": subjects,
        "e": rng.normal(0, 0.3, (buckets, dim)),
        "w": rng.normal(0, 0.3, (dim, len(subjects))),
        "b": np.full(len(subjects), -2.0),
    }


class Adam:
    """Adam steps on summed gradients, with decay of the weights towards zero."""

    def __init__(self, model: dict, rate: float = RATE, decay: float = DECAY) -> None:
        self.model, self.rate, self.decay, self.t = model, rate, decay, 0
        self.m = {k: np.zeros_like(model[k]) for k in "ewb"}
        self.v = {k: np.zeros_like(model[k]) for k in "ewb"}

    def step(self, gradient: dict, weight: float) -> None:
        self.t += 1
        for k in "ewb":
            g = gradient[k] / max(weight, 1.0)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            keep = 1 - self.rate * self.decay * (k != "b")
            self.model[k] = keep * self.model[k] - self.rate * m / (np.sqrt(v) + EVIDENCE / max(weight, 1.0))


def count_sentences(rows, subjects: list[str]) -> dict[str, np.ndarray]:
    """Occurrences and label hits of each distinct sentence of (text, labels) rows."""
    at = {s: i + 1 for i, s in enumerate(subjects)}
    counts: dict[str, np.ndarray] = {}
    split = Sentences()
    for text, labels in rows:
        hit = np.zeros(len(subjects) + 1)
        hit[0] = 1
        for x in labels:
            if x in at:
                hit[at[x]] = 1
        for t in split(text):
            if t in counts:
                counts[t] = counts[t] + hit
            else:
                counts[t] = hit
    return counts


def label_table(labels: DataFrame) -> DataFrame:
    """(doc_id, subjects): the subjects of each labelled document, an empty list for ``none`` alone.

    Spelling is ignored; a label within two edits of one at least twenty times as frequent
    is taken for it.  Null labels and documents without any other are left out.
    """
    named = labels.where("doc_id is not null").select("doc_id", letters(F.col("subject")).alias("s")).where("s is not null")
    counts = cut(named.groupBy("s").agg(F.count("*").alias("n")))
    # as many as a model can have outputs; the spellings themselves stay where they are
    usual = {r.s: r.n for r in counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(MAX_SUBJECTS).collect()}

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"s": pdf["s"], "fixed": [_usual(s, n, usual) for s, n in zip(pdf["s"], pdf["n"])]})

    named = named.join(small(counts.mapInPandas(mend, "s string, fixed string")), "s").withColumn("s", F.col("fixed"))
    return named.groupBy("doc_id").agg(F.array_remove(F.collect_set("s"), NO_SUBJECT).alias("subjects"))


def _usual(label: str, n: int, counts: dict[str, int]) -> str:
    near = [c for c in counts if counts[c] >= OFTEN * n and edits(label, c, 2) <= 2]
    return max(near, key=lambda c: (counts[c], c), default=label)


def _build(subjects: list[str], buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(count_sentences(zip(pdf["text"], pdf["subjects"]), subjects), buckets)
        block.texts = [""] * len(block.texts)  # features are all that training needs
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [pickle.dumps(block, protocol=5)]})

    return run


_LOADED: dict[tuple[str, int], Block] = {}


def _gradients(run_id: str, model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = {k: v.astype(np.float64) if k in "ewb" else v for k, v in model.value.items()}
        for pdf in batches:
            for no, data in zip(pdf["block"], pdf["data"]):
                if (run_id, no) not in _LOADED:
                    for old in [k for k in _LOADED if k[0] != run_id]:
                        del _LOADED[old]
                    _LOADED[run_id, no] = pickle.loads(data)
                g, loss, weight = _LOADED[run_id, no].gradient(m)
                at = np.flatnonzero(np.any(g["e"] != 0, axis=1))
                part = (at.astype(np.int32), g["e"][at].astype(np.float32), g["w"], g["b"])
                yield pd.DataFrame({"part": [pickle.dumps(part, protocol=5)], "loss": [loss], "weight": [weight]})

    return run


def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    partitions: int = PARTITIONS,
    steps: int = STEPS,
    buckets: int = BUCKETS,
    dim: int = DIM,
) -> dict:
    """A model fitted on at most ``max_labelled`` labelled documents, chosen by hash.

    Each step broadcasts the weights, sums the gradients of all partitions and moves the
    weights once, so the result does not depend on which executor holds what.  Without any
    labelled text the model has no subjects.
    """
    spark = documents.sparkSession
    known = label_table(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = cut(known)
    subjects = sorted(r.s for r in known.select(F.explode("subjects").alias("s")).distinct().collect())
    training = documents.where("text is not null").select("doc_id", "text").join(small(known), "doc_id")
    blocks = training.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int"))
    blocks = cut(blocks.groupBy("block").applyInPandas(_build(subjects, buckets), "block int, data binary").repartition(partitions, "block"))
    model = new_model(subjects, buckets, dim)
    if not subjects:
        return model
    adam = Adam(model)
    run_id = f"{spark.sparkContext.applicationId}-{id(blocks)}-{np.random.default_rng().integers(1 << 60)}"
    for _ in range(steps):
        sent = spark.sparkContext.broadcast({k: v.astype(np.float32) if k in "ewb" else v for k, v in model.items()})
        total = {k: np.zeros_like(model[k]) for k in "ewb"}
        weight = 0.0
        for row in blocks.mapInPandas(_gradients(run_id, sent), "part binary, loss double, weight double").collect():
            at, e, w, b = pickle.loads(row.part)
            total["e"][at] += e
            total["w"] += w
            total["b"] += b
            weight += row.weight
        adam.step(total, weight)
        sent.destroy()
    return model


def sentence_subjects(texts: list[str], model: dict, line: float = LINE) -> np.ndarray:
    """One row per sentence: True for each subject that it is about."""
    blank = np.zeros(len(model["subjects"]) + 1)
    block = Block(dict.fromkeys(texts, blank), len(model["e"]))
    return block.probabilities(model) > line


def _score(model, needed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        subjects = m["subjects"]
        known: dict[str, tuple[int, ...]] = {}
        parts = Sentences()
        for pdf in batches:
            split = [parts(t) for t in pdf["text"]]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({s for doc in split for s in doc if s not in known})
            if new:
                for s, hit in zip(new, sentence_subjects(new, m)):
                    known[s] = tuple(np.flatnonzero(hit))
            out = []
            for doc_id, doc in zip(pdf["doc_id"], split):
                counts = Counter(k for s in doc for k in known[s])
                out += [(doc_id, subjects[k], n) for k, n in sorted(counts.items()) if n >= needed]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "sentences"])

    return run


def subject_areas(documents: DataFrame, model: dict, needed: int = SENTENCES) -> DataFrame:
    """(doc_id, subject, sentences) of every document; none, one or several rows each.

    Null and empty texts have no subject; repeated rows are scored under their own doc_id.
    """
    if not model["subjects"]:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, sentences int")
    sent = documents.sparkSession.sparkContext.broadcast(
        {k: v.astype(np.float32) if k in "ewb" else v for k, v in model.items()}
    )
    return documents.select("doc_id", "text").mapInPandas(_score(sent, needed), "doc_id long, subject string, sentences int")


def composition(areas: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per subject and their share of all documents, those without a subject included."""
    total = documents.agg(F.count("*").alias("total"))
    named = areas.select("doc_id", "subject").distinct()
    by = named.groupBy("subject").agg(F.count("*").alias("documents"))
    none = (
        named.agg(F.countDistinct("doc_id").alias("with_subject"))
        .crossJoin(total)
        .select(F.lit(NO_SUBJECT).alias("subject"), (F.col("total") - F.col("with_subject")).alias("documents"))
    )
    return by.union(none).crossJoin(F.broadcast(total)).select(
        "subject", "documents", F.round(F.col("documents") / F.nullif("total", F.lit(0)), 6).alias("share")
    )
