"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of two lexicons (words and word beginnings, mined from labelled texts), their closeness to
second-person words, capitals, punctuation and obfuscation.  Lexicons, trees and calibration are fitted on a bounded
sample of labelled rows outside the evaluation fold (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` texts); scores read only
the text, and whole texts.

Edge cases: null and empty texts are scored like any other (no hit, so a low score); without labelled rows of both
kinds every score is 0; from one of each kind on a model is fitted with what there is, however rough (an entry of a
lexicon needs ``LEAST_TEXTS`` toxic texts, so a few texts give base rates); very long texts are scored whole, one after another; a row with a null id is scored like any
other and never learned from or held out; repeated rows are scored each, equal rows equally, and learned once; an
empty table gives an empty table; columns of other names are not read, and their names may clash with any name used
here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .sampling import sample_rows

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 2500
CUT = 0.7
PREFIX = 5
NEAR = 6
#: An entry of a lexicon: in this many toxic texts and this share of them at least, and this many times likelier there.
#: Chosen by three-fold cross-validation inside the training fold (least log loss of 3 shares and 3 ratios).
LEAST_TEXTS = 6
LEAST_SHARE = 0.03
LEAST_RATIO = 12.0

# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

_WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$*!])")
_UPPER = re.compile(r"\b[A-ZÄÖÜÉÈÀÑÍÓÚÇÊ]{3,}\b")

FEATURES = ("word_hits", "word_share", "word_kinds", "prefix_hits", "prefix_share", "prefix_kinds", "near_you", "you_share", "capital_share", "shouted_share", "bang_rate", "question_rate", "punctuation_rate", "mixed_share", "disguised_hits", "log_words")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str | None, lexicon: frozenset[str], prefixes: frozenset[str]) -> list[float]:
    text = text or ""
    words = words_of(text)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    starts = [w[:PREFIX] for w in words]
    stems = [s for s in starts if s in prefixes]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    mixed = [w for w in words if not w.isalpha() and _MIXED.match(w)]
    disguised = sum(1 for w in mixed if (p := w.translate(DISGUISE)) in lexicon or p[:PREFIX] in prefixes)
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        pad = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(np.array(hits) - pad[at], pad[at + 1] - np.array(hits)) <= NEAR).sum())
    bang, ask = text.count("!"), text.count("?")
    upper = sum(map(str.isupper, text)) if not text.isascii() else chars - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    return [
        np.log1p(len(hits)),
        100 * len(hits) / n,
        len({words[i] for i in hits}),
        np.log1p(len(stems)),
        100 * len(stems) / n,
        len(set(stems)),
        near,
        100 * len(you) / n,
        100 * upper / chars,
        100 * len(_UPPER.findall(text)) / n,
        100 * bang / chars,
        100 * ask / chars,
        100 * sum(text.count(c) for c in ".,;:-") / chars,
        100 * len(mixed) / n,
        disguised,
        np.log1p(len(words)),
    ]


def mine(texts: list[str], toxic: np.ndarray) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and beginnings of words, that mark toxic texts.

    An entry also needs enough different words before it in toxic texts, so that copies of one text don't make one.
    """
    seen = ({}, {})  # entry -> preceding words in toxic texts
    texts_with = {(kind, y): Counter() for kind in (0, 1) for y in (0, 1)}
    for text, y in zip(texts, toxic.tolist(), strict=True):
        words = [w if w.isalpha() else w.translate(DISGUISE) for w in words_of(text)]
        for kind in (0, 1):
            own = [w[:PREFIX] if len(w) >= PREFIX else None for w in words] if kind else words
            if y:
                for before, w in zip(["", *words], own):
                    if w:
                        seen[kind].setdefault(w, set()).add(before)
            texts_with[kind, y].update(w for w in set(own) if w)
    least = max(LEAST_TEXTS, LEAST_SHARE * int(toxic.sum()))
    bad, good = int(toxic.sum()) + 1, int((1 - toxic).sum()) + 1
    likelier = lambda w, kind: (texts_with[kind, 1][w] / bad) / ((texts_with[kind, 0][w] + 0.5) / good)
    return tuple(frozenset(w for w, before in seen[kind].items() if len(before) >= least and likelier(w, kind) >= LEAST_RATIO) for kind in (0, 1))


class Boosted:
    """Boosted trees of depth 3 on quantile bins (Newton steps of the logistic loss)."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        binned, margin, self.model = self._bin(x), np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.model.append(tree)
            margin += self._leaf(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned, g, h):
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.ones(len(g), int)
        for level in range(self.depth + 1):
            for k in range(2**level, 2 ** (level + 1)):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                G, H = g[at].sum(), h[at].sum()
                value[k] = -self.rate * G / (H + self.l2)
                if level == self.depth or len(at) < 10:
                    continue
                best = (1e-6, -1, 0)
                for j in range(binned.shape[1]):
                    b = binned[at, j]
                    gl = np.cumsum(np.bincount(b, g[at], self.bins + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[at], self.bins + 1))[:-1]
                    gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
                    gain[(hl < 0.5) | (H - hl < 0.5)] = 0
                    c = int(gain.argmax())
                    best = max(best, (float(gain[c]), j, c))
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], best[2]
                    node[at] = 2 * k + (binned[at, best[1]] > best[2])
        return feature, cut, value

    def _leaf(self, tree, binned) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.ones(len(binned), int), np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + (binned[rows, f] > cut[node]))
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum(self._leaf(t, binned) for t in self.model)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising step-free curve from margin to probability."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray):
        # The two halves fit trees for each other's calibration; lexicons are mined from the half that fits.
        half = np.arange(len(texts)) % 2 == 0
        margins = np.zeros(len(texts))
        for own in (half, ~half):
            lex = mine([t for t, o in zip(texts, own, strict=True) if o], toxic[own])
            x = np.array([features(t, *lex) for t in texts])
            margins[~own] = Boosted().fit(x[own], toxic[own]).margin(x[~own])
        self.knots = isotonic(margins, toxic)
        self.lexicons = mine(texts, toxic)
        # Trees see hits as unseen texts have them: counted with the other half's lexicons.
        a, b = mine([t for t, o in zip(texts, half, strict=True) if o], toxic[half]), mine([t for t, o in zip(texts, half, strict=True) if not o], toxic[~half])
        x = np.array([features(t, *(b if h else a)) for t, h in zip(texts, half, strict=True)])
        self.trees = Boosted().fit(x, toxic)

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        x = np.array([features(t, *self.lexicons) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1).tolist()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: tuple[int, int] = (3, 1)) -> Model | None:
    known = labels.where(~held_out(*fold, key=id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    ids = sample_rows(known.withColumn("none", F.lit(0)), "none", {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}, 2 * max(SAMPLE_TOXIC, SAMPLE_CLEAN))
    picked = docs.sparkSession.createDataFrame([(i, y) for i, y, _ in ids], "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("t").alias("t"))  # broadcast and rows: the two samples
    got = sorted((r["id"], r["y"], r["t"]) for r in rows.collect())
    toxic = np.array([y for _, y, _ in got], float)
    if not toxic.any() or toxic.all():
        return None
    return Model([t for *_, t in got], toxic.astype(int))


def _scored(model: Broadcast, at: int, size: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[float]]]]:
    """Slices of some batches with the scores of the texts in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
        for rows in batches:
            for a in range(0, rows.num_rows, size):
                part = rows.slice(a, size)
                texts = part.column(at).to_pylist()
                yield part, model.value.scores(texts) if model.value is not None else [0.0] * len(texts)

    return run


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every row; one narrow pass over whole texts."""
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model), 1)  # lexicons and trees of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in scored(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: tuple[int, int] = (3, 1), cut: float = CUT) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, fold=fold)
    got = score(docs, model, id_col=id_col, text_col=text_col)
    return got.select(id_col, held_out(*fold, key=id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows scored below the cut, with the columns they came with."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in scored(batches):
            yield part.filter(pa.array([s < cut for s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
