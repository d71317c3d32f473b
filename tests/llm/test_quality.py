import math
import random
import re
from collections import Counter

from casevane.llm import quality as Q


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(w)
    hit = set()
    for i, x in enumerate(w):
        if many[x] > 1:
            hit |= set(range(i, i + 8))
    return words, (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))


def histograms(words):
    s = "".join(words)
    classes = [sum(ok(c) for c in s) for ok in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in "#*$%&|<>", lambda c: "!" <= c <= "~" and not c.isalnum() and c not in "#*$%&|<>", lambda c: c > "~" or c < "!")]
    low = Counter(w.lower() for w in words)
    common = [low[w] for w in Q.COMMON]
    return classes, [*common, len(words) - sum(common)]


def share(h):
    return [x / max(1.0, sum(h)) for x in h]


def js(p, q):
    t = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(t(x, (x + y) / 2) + t(y, (x + y) / 2) for x, y in zip(p, q)) / 2))


def test_against_plain_version(spark):
    r = random.Random(3)
    en, de = "the of and to house river stone".split(), "der die und das haus fluß stein".split()
    rows = [(i, ("\n" if i % 7 == 0 else " ").join(r.choice(en if i % 2 else de) + r.choice(["", "", ".", "er"]) for _ in range(r.randint(5, 260))), "en" if i % 2 else "de") for i in range(90)]
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "a b c d e f g h " * 20, "en"), (104, "$$$ %%% ### " * 60, "en"), (105, "THE HOUSE!! " * 40 + " ".join(map(str, range(60))), "en"), (106, "line one\nline one\n\nline one", "fr"), rows[4], (107, "é\x1cü x" * 30, "de")]
    got = Q.quality_report(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, lang string, n_words string")).collect()
    refs = {}
    for _, t, lang in rows:
        words, b = base(t)
        if lang and not (b[0] < 20 or 100 * b[4] > 30 * b[0]):
            c, w = histograms(words)
            n, cs, ws = refs.get(lang, (0, [0] * len(c), [0] * len(w)))
            refs[lang] = (n + 1, [x + y for x, y in zip(cs, c)], [x + y for x, y in zip(ws, w)])
    add = lambda h, hs, k: [x + k * t / sum(map(sum, hs)) for x, t in zip(h, map(sum, zip(*hs)))]
    both = list(zip(*((c, w) for _, c, w in refs.values())))
    refs = [(share(add(c, both[0], Q.PRIOR_CHARACTERS)), share(add(w, both[1], Q.PRIOR_WORDS))) for _, c, w in refs.values()]
    assert len(refs) == 2
    want = []
    for i, t, _ in rows:
        words, b = base(t)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        c, w = map(share, histograms(words))
        d = min((js(c, x) + js(w, y), js(c, x), js(w, y)) for x, y in refs)
        far = (b[0] >= Q.CLASS_WORDS and d[1] > Q.CLASS_LIMIT) or (b[0] >= Q.COMMON_WORDS and d[2] > Q.COMMON_LIMIT)
        want.append((i, *b, failed, not failed and not far))
    assert sorted(tuple(x)[:8] for x in got) == sorted(want)
    kept = {x.doc_id: x.kept for x in got}
    assert not kept[104] and not kept[105] and not kept[100] and kept[1] == (not base(rows[1][1])[1][0] < 20)


def test_every_language_has_a_reference(spark):
    """70 languages, each with its own characters and words: a text near the last of them is kept."""
    rows = [(i, " ".join(f"{chr(0x4E00 + i % 70)}w{k}" for k in range(60)), f"l{i % 70:02}") for i in range(1400)]
    rows += [(9000, "# " * 200, None), (None, rows[69][1], None), (9001, " ".join(f"a{k}" for k in range(30_000)), None)]
    got = Q.quality_report(spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id long, text string, lang string, _words int, _text string")).collect()
    assert len(got) == len(rows) and sum(x.kept for x in got) >= 1400
    by = {x.doc_id: x for x in got}
    assert by[None].kept and by[None].class_distance < 0.01 and not by[9000].kept and by[9001].n_words == 30_000
    counted = spark.createDataFrame([(f"l{i % 70}", False, [1.0] * 6, [1.0] * (len(Q.COMMON) + 1)) for i in range(1400)], "_lang string, base_failed boolean, _classes array<double>, _common array<double>")
    assert len(Q.references(counted)) == 70


def test_rare_languages_have_a_reference_too(spark):
    """From one text on, a language moves its reference smoothly from the table's to its own."""
    row = lambda lang, a: (lang, False, [a, 0.0, 0.0, 0.0, 0.0, 1000.0 - a], [1.0] * (len(Q.COMMON) + 1))
    shares = []
    for n in (1, 2, 19, 20, 21, 400):
        rows = [row("many", 900.0)] * 500 + [row("rare", 100.0)] * n
        refs = Q.references(spark.createDataFrame(rows, "_lang string, base_failed boolean, _classes array<double>, _common array<double>"))
        assert len(refs) == 2 and all(abs(sum(r["c"]) - 1) < 1e-9 for r in refs)
        shares.append(refs[1]["c"][0])
    assert shares == sorted(shares, reverse=True) and shares[0] > 0.8 and shares[-1] < 0.13
    assert shares[2] - shares[4] < 0.02  # no step at 20


def test_empty_and_native(spark):
    assert Q.quality_report(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    df = Q.quality_report(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
