"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, their maxima feed a softmax.  The
network is trained in numpy on windows cut at spread places of a bounded sample of labelled texts
(``SAMPLE_DOCS`` per language, ``SAMPLE_TOTAL`` in all, ``SAMPLE_WINDOWS`` windows each; every language that has a
labelled text is learned); it is applied to all windows of every whole text, and the mean log-probability of the
windows decides.

Edge cases: a text that is null or has no letter (Unicode category L; number letters and fractions are none) is
``und`` with score 0; short texts are padded with zero bytes; very long texts are read window by window, in groups of
bounded size; ties go to the first language in order; without any labelled row every text is ``und``; a row with a
null id is predicted like any other and never learned from or held out; repeated rows are predicted each, equal rows
equally, and learned once; an empty table gives an empty table; columns of other names are not read, and their names
may clash with any name used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .sampling import sample_rows

WINDOW = 256
SAMPLE_DOCS = 400
SAMPLE_TOTAL = 25_600
SAMPLE_WINDOWS = 3
EMBED = 6
WIDTHS = (2, 3, 4)
FILTERS = 12
EPOCHS = 8
UNKNOWN = "und"


class ByteNet:
    """Parameters as float32 arrays: E [256, d]; K [width * d, filters of all widths]; W, b."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {
            "E": r.normal(0, 0.5, (256, EMBED)),
            "K": r.normal(0, 0.3, (max(WIDTHS) * EMBED, FILTERS * len(WIDTHS))),
            "c": np.zeros(FILTERS * len(WIDTHS)),
            "W": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))),
            "b": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        # A narrow filter has no weight beyond its width.
        self.mask = np.zeros_like(self.p["K"])
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p["K"] *= self.mask

    def patches(self, x: np.ndarray) -> np.ndarray:
        e = self.p["E"][x]  # [n, length, d]
        n, length, d = e.shape
        wide = max(WIDTHS)
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, length - wide + 1, wide * d), (s[0], s[1], s[2])).reshape(-1, wide * d)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self.patches(x)
        act = (patches @ self.p["K"]).reshape(len(x), -1, FILTERS * len(WIDTHS))
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + self.p["c"]
        return np.maximum(top, 0), at, patches

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        act = (self.patches(x) @ self.p["K"]).reshape(len(x), -1, FILTERS * len(WIDTHS)).max(axis=1)
        return _log_softmax(np.maximum(act + self.p["c"], 0) @ self.p["W"] + self.p["b"])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64) -> None:
        r = np.random.default_rng(11)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step, wide = 0, max(WIDTHS)
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                pick = order[a : a + batch]
                xb, yb = x[pick], y[pick]
                h, at, patches = self.pooled(xb)
                d_out = np.exp(_log_softmax(h @ self.p["W"] + self.p["b"]))
                d_out[np.arange(len(yb)), yb] -= 1
                d_out /= len(yb)
                g = {"W": h.T @ d_out, "b": d_out.sum(axis=0)}
                d_h = (d_out @ self.p["W"].T) * (h > 0)
                g["c"] = d_h.sum(axis=0)
                # Only the place of each maximum has a gradient.
                places = np.arange(len(xb))[:, None] * (xb.shape[1] - wide + 1) + at
                seen = patches[places]  # [n, filters, wide * d]
                g["K"] = np.einsum("nfk,nf->kf", seen, d_h) * self.mask
                back = (d_h[:, :, None] * self.p["K"].T[None]).reshape(-1, EMBED)
                byte = xb[np.arange(len(xb))[:, None, None], at[:, :, None] + np.arange(wide)].reshape(-1)
                g["E"] = np.zeros_like(self.p["E"])
                np.add.at(g["E"], byte, back)
                step += 1
                now = rate * (0.5 if epoch >= epochs // 2 else 1)
                for k, v in self.p.items():
                    m, s = moment[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def has_letter(text: str) -> bool:
    """Whether any character is of category L."""
    return any(map(str.isalpha, text))


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text; the last one ends with it."""
    n = len(raw)
    if n <= size:
        return np.frombuffer(raw.ljust(size, b"\0"), np.uint8)[None]
    data = np.frombuffer(raw, np.uint8)
    full = n // size
    out = data[: full * size].reshape(full, size)
    return out if full * size == n else np.concatenate([out, data[None, n - size :]])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2), per_lang: int = SAMPLE_DOCS) -> ByteNet | None:
    """A network for the languages of the rows outside the evaluation fold."""
    learn = docs.where(~held_out(*fold, key=id_col) & F.col(text_col).isNotNull())
    learn = learn.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("y"), F.col(text_col).alias("t"))
    room = F.greatest(F.lit(1), F.length("t") - WINDOW + 1)
    cut = [F.substring(F.col("t"), F.pmod(F.xxhash64("id", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]
    got = sample_rows(learn.select("id", "y", F.array(*cut).alias("w")), "w", per_lang, SAMPLE_TOTAL)
    got = [(y, t) for _, y, w in got for t in sorted(set(w)) if has_letter(t)]
    if not got:
        return None
    langs = sorted({y for y, _ in got})
    net = ByteNet(langs)
    x = np.concatenate([windows(t.encode("utf-8", "replace")[:WINDOW]) for _, t in got])
    net.fit(x, np.array([langs.index(y) for y, _ in got]))
    return net


def predict(net: ByteNet | None, texts: list[str | None], group: int = 128) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    total = np.zeros((len(texts), len(net.langs)))
    count = np.zeros(len(texts))
    waiting, owner, room = [], [], 0

    def flush():
        nonlocal waiting, owner, room
        if waiting:
            x, who = np.concatenate(waiting), np.concatenate(owner)
            for a in range(0, len(x), group):
                np.add.at(total, who[a : a + group], net.log_probs(x[a : a + group]))
            np.add.at(count, who, 1)
        waiting, owner, room = [], [], 0

    for i, text in enumerate(texts):
        if text and has_letter(text):
            w = windows(text.encode("utf-8", "replace"))
            waiting.append(w)
            owner.append(np.full(len(w), i))
            room += len(w)
            if room >= 4 * group:
                flush()
    flush()
    known = np.flatnonzero(count)
    p = np.exp(_log_softmax(total[known] / count[known, None]))
    for i, row in zip(known.tolist(), p, strict=True):
        langs[i], scores[i] = net.langs[int(row.argmax())], float(row.max())
    return langs, scores


def identify(docs: DataFrame, net: ByteNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    names = [id_col, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, 512):
                part = rows.slice(a, 512)
                langs, scores = predict(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def language_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row."""
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, fold=fold)
    return identify(docs, net, id_col=id_col, text_col=text_col).select(id_col, held_out(*fold, key=id_col).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows whose text has a language, with the columns they came with.  ``least``: a score below is no language."""
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, 512):
                part = rows.slice(a, 512)
                langs, scores = predict(shared.value, part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
