import math
import random
import zlib

import numpy as np
import pytest

from casevane.llm import langid, sampling, toxicity

EN, DE = "the of and to house river stone light".split(), "der die und das haus fluß stein größe".split()


def corpus(n=240, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        w = [r.choice(EN if lang == "en" else DE) + r.choice(["", "er", "ing" if lang == "en" else "ung"]) for _ in range(r.randint(20, 120))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["blixt", "zorgun", "you krandor"]))
        rows.append((i, " ".join(w), lang, toxic))
    return rows


EXTRA = [(900, None), (901, ""), (902, "12 34 --"), (903, "x"), (None, "the river and the stone"), (904, "der stein und das haus " * 3000)]


def test_language(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "q") for i, t, lang, _ in rows] + [(i, t, None, "q") for i, t in EXTRA] + [(*rows[3][:3], "r")], "doc_id long, text string, lang string, score string")
    got = langid.language_report(docs).collect()
    assert len(got) == len(rows) + len(EXTRA) + 1
    truth = {i: lang for i, _, lang, _ in rows}
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
    held = [x for x in got if x.doc_id in truth and x.held_out]
    assert held and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[900] == by[901] == by[902] == "und" and by[904] == "de" and by[None] == "en"
    empty = langid.language_report(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.count() == 0
    assert [x.lang_pred for x in langid.language_report(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()] == ["und"]


def test_windows_cover_the_text():
    raw = bytes(range(256)) * 3 + b"tail"
    w = langid.windows(raw)
    assert len(w) == 4 and bytes(w[-1]) == raw[-256:] and langid.windows(b"ab").shape == (1, 256)


def test_gradient_of_the_network():
    r = np.random.default_rng(0)
    x = r.integers(97, 110, (64, 64)).astype(np.uint8)
    y = (x[:, :32] == 100).any(axis=1).astype(int)
    net = langid.ByteNet(["a", "b"])
    before = -net.log_probs(x)[np.arange(64), y].mean()
    net.fit(x, y, epochs=30)
    assert -net.log_probs(x)[np.arange(64), y].mean() < 0.5 * before


def test_toxicity(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "q") for i, t, *_ in rows] + [(i, t, "q") for i, t in EXTRA] + [(*rows[4][:2], "r")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    truth = {i: y for i, _, _, y in rows}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == len(rows) + len(EXTRA) + 1 and held
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and x.predicted == int(x.score >= 0.7) and 0 <= x.score <= 1 for x in got)
    assert all(x.predicted == 0 for x in got if x.doc_id in (900, 901, 902, 904))
    none = toxicity.toxicity_report(docs.limit(3), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [x.score for x in none] == [0.0] * 3


@pytest.mark.parametrize("n", [1, 2, 5, 11, 12, 13])
def test_toxicity_of_few_labels(spark, n):
    """From one label of each kind on, a model is fitted; scores are probabilities and rank toxic texts higher once there are words to learn."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"you vile grubworm {k} go away {i}" if k % 2 else f"a calm note {i} on rivers and {k} stones", k % 2) for k, i in enumerate(ids[: 2 * n])]
    frame = spark.createDataFrame([d[:2] for d in docs] + [(5000, None), (5001, "a calm note on rivers"), (5002, "you vile grubworm go")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(frame, labels).collect()}
    assert len(got) == 2 * n + 3 and all(0 <= r.score <= 1 for r in got.values())
    assert got[5002].score >= got[5001].score > 0
    assert toxicity.train(frame, labels.where("toxic = 1")) is None
    assert all(r.score == 0 for r in toxicity.toxicity_report(frame, labels.where("toxic = 0")).collect())


def test_isotonic_is_monotone():
    r = np.random.default_rng(1)
    m = r.normal(size=300)
    knots, p = toxicity.isotonic(m, (m + r.normal(size=300) > 0).astype(int))
    assert np.all(np.diff(knots) >= 0) and np.all(np.diff(p) >= -1e-12)


def slow_language(net, text):
    """The network by loops over windows, places and filters."""
    raw = text.encode()
    pieces = [raw.ljust(256, b"\0")] if len(raw) <= 256 else [raw[a : a + 256] for a in range(0, len(raw) - 255, 256)] + ([raw[-256:]] if len(raw) % 256 else [])
    e, k, c, w, b = (net.p[x].astype(float) for x in ("E", "K", "c", "W", "b"))
    total = np.zeros(len(net.langs))
    for piece in pieces:
        hidden = []
        for f in range(k.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            best = -math.inf
            for at in range(256 - max(langid.WIDTHS) + 1):
                best = max(best, sum(float(e[piece[at + j]] @ k[j * langid.EMBED : (j + 1) * langid.EMBED, f]) for j in range(width)))
            hidden.append(max(0.0, best + c[f]))
        z = np.array(hidden) @ w + b
        total += z - z.max() - math.log(np.exp(z - z.max()).sum())
    p = np.exp(total / len(pieces) - (total / len(pieces)).max())
    return p / p.sum()


def test_scores_of_the_network_against_loops(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(300, "kurz é", None)], "doc_id long, text string, lang string")
    net = langid.train(docs)
    got = {x.doc_id: x for x in langid.identify(docs, net).collect()}
    for i, t in [(i, t) for i, t, *_ in rows[:6]] + [(300, "kurz é")]:
        p = slow_language(net, t)
        assert got[i].lang_pred == net.langs[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def slow_toxicity(model, text):
    """Features by plain counting, then tree after tree and node after node."""
    x = slow_features(text, *model.lexicons)
    margin = model.trees.base
    for feature, cut, value in model.trees.model:
        node = 1
        for _ in range(model.trees.depth):
            f = feature[node]
            if f < 0:
                break
            below = sum(edge <= x[f] for edge in model.trees.edges[f])
            node = 2 * node + (below > cut[node])
        margin += value[node]
    at, p = model.knots
    if margin <= at[0]:
        return p[0]
    for a, b, u, v in zip(at, at[1:], p, p[1:]):
        if margin <= b:
            return u + (v - u) * (margin - a) / (b - a) if b > a else v
    return p[-1]


def slow_features(text, lexicon, prefixes):
    words, word = [], ""
    low = text.lower()
    for i, ch in enumerate(low + " "):
        nxt = low[i + 1] if i + 1 < len(low) else " "
        if ch.isalnum():
            word += ch
        elif word and ch in "@$*!" and (nxt.isalnum() or nxt in "@$*!") and low[i:].lstrip("@$*!")[:1].isalnum():
            word += ch
        else:
            if word:
                words.append(word)
            word = ""
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    stems = [w[:5] for w in words if w[:5] in prefixes]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    mixed = [w for w in words if any(c.isalpha() for c in w) and any(c.isdigit() or c in "@$*!" for c in w)]
    plain = [w.translate(toxicity.DISGUISE) for w in mixed]
    upper, run, shouted = sum(c.isupper() for c in text), "", 0
    for ch in text + " ":
        if ch.isalnum() or ch == "_":
            run += ch
        else:
            shouted += len(run) >= 3 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÑÍÓÚÇÊ" for c in run)
            run = ""
    return [
        math.log1p(len(hits)), 100 * len(hits) / n, len({words[i] for i in hits}), math.log1p(len(stems)), 100 * len(stems) / n, len(set(stems)),
        sum(any(abs(i - j) <= 6 for j in you) for i in hits), 100 * len(you) / n, 100 * upper / chars, 100 * shouted / n, 100 * text.count("!") / chars, 100 * text.count("?") / chars,
        100 * sum(c in ".,;:-" for c in text) / chars, 100 * len(mixed) / n, sum(p in lexicon or p[:5] in prefixes for p in plain), math.log1p(len(words)),
    ]


def test_scores_of_the_trees_against_loops(spark):
    rows = corpus(160)
    extra = [(900, "YOU are a bl1xt, zorgun!! KRANDOR? you... Über ÄÖÜ kr@ndor x_y"), (901, ""), (902, "you you blixt"), (903, "é" * 50)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    for i, t in [(i, t) for i, t, *_ in rows] + extra:
        assert abs(got[i] - slow_toxicity(model, t)) < 1e-9, t


CLASH = "id long, y int, __lang string, __score double, lang_pred int, score string, t string, v int, s int, below int, n int, none int, __h string"
VALUES = (1, 2, "l", 0.5, 3, "s", "t", 4, 5, 6, 7, 8, "h")


def test_clashing_columns(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t, lang, *VALUES) for i, t, lang, _ in rows] + [(500, "1234", "de", *VALUES)], f"doc_id long, text string, lang string, {CLASH}")
    labels = spark.createDataFrame([(i, y, *VALUES) for i, _, _, y in rows], f"doc_id long, toxic int, {CLASH}")
    assert langid.language_report(docs).count() == toxicity.toxicity_report(docs, labels).count() == 121
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and {tuple(x)[3:] for x in kept.collect()} == {VALUES} and kept.count() == 120
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and {tuple(x)[3:] for x in clean.collect()} == {VALUES}
    assert {x.doc_id for x in clean.collect()} == {i for i, *_, y in rows if not y} | {500}


def test_letters_only(spark):
    docs = spark.createDataFrame([(i, t, "de" if i % 2 else "en") for i, t, *_ in corpus(80)] + [(900, "½ ²³ Ⅷ", None), (901, "① ٣ _", None), (902, "ª", None), (903, "中", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.language_report(docs).collect()}
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] != "und" and got[903][0] != "und"


def test_every_language_is_learned(spark):
    """70 languages, none left out, a label of a third of all rows and repeated rows among them."""
    rows = [(i, f"wort{i % 70} text nummer", f"l{i % 70:02}") for i in range(560)] + [(1000 + i, "the hot one", "l00") for i in range(280)] + [(3, "wort3 text nummer", "l03")] * 50
    docs = spark.createDataFrame(rows, "id long, v string, y string")
    got = sampling.sample_rows(docs, "v", 400, 25_600)
    assert len({y for _, y, _ in got}) == 70 and len(got) == 840
    few = sampling.sample_rows(docs, "v", 400, 140)
    assert {y: sum(z == y for _, z, _ in few) for y in ("l00", "l03", "l69")} == {"l00": 2, "l03": 2, "l69": 2}
    assert few == sampling.sample_rows(docs.repartition(7), "v", 400, 140)
    assert sampling.sample_rows(docs.limit(0), "v", 400, 140) == []
