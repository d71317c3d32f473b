"""The pipeline's stages on a small corpus, each against a plain version of its rule."""

import random

import corpus_pipeline
from casevane.llm import repeats

from . import test_neardup, test_repeats


def corpus(tmp_path, spark):
    r = random.Random(4)
    vocab = {"en": "the of and to in is that it for on was with house river".split(), "de": "der die und den von zu das mit sich auf ist nicht haus fluß".split()}
    rows = []
    passage = " ".join(r.choice(vocab["en"]) + str(i) for i in range(70))
    for i in range(160):
        lang = "en" if i % 3 else "de"
        w = [r.choice(vocab[lang]) + r.choice(["", "", "er", "in", "th" if lang == "en" else "sch"]) for _ in range(r.randint(30, 90))]
        if i % 4 == 0:
            w[5:5] = r.sample(["zorgun", "blixt", "krandor"], 2)
        rows.append((i, " ".join(w) + (" " + passage if i % 10 == 1 else ""), lang, f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(0, 20, 3)] + [(300, "12345 ---", "en", "s2"), (301, None, None, "s2")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    d = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == columns
            out.write.parquet(f"{d}/{name}")
            seen[name] = (docs, docs := spark.read.parquet(f"{d}/{name}"))
        else:
            packed = out.collect()
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(texts, seen["language_id"])
    assert set(before) - set(after) == {300, 301}
    before, after = map(texts, seen["toxicity"])
    toxic = {i for i, t in before.items() if any(w in t for w in ("zorgun", "blixt", "krandor"))}
    assert set(after) == set(before) - toxic
    before, after = map(texts, seen["minhash_near_dedup"])
    assert set(after) == {i for i, _, _, kept in test_neardup.brute(list(before.items())) if kept}
    before, after = map(texts, seen["suffix_array_dedup"])
    lost = {i: gone for i, _, gone, *_ in test_repeats.brute(list(before.items()))}
    assert {i: len(before[i]) - len(after[i].encode()) for i in before if before[i].isascii()} == {i: n for i, n in lost.items() if before[i].isascii()}
    assert repeats.MATCH == 50 and any(lost.values())
    assert {r.doc_id for r in packed} == set(after) and all(r.bin_units <= 2048 for r in packed)


def test_run_chains_the_stages(spark, tmp_path):
    """``run`` gives what the stages give with tables written in between; empty tables, null and repeated ids pass through."""
    d = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = [(None, "the river was with the house and it is in the river", "en", "s1", 1), (7, "that house is for the river and in it was on it", None, None, None), (7, None, "en", "s1", 0), (None, None, None, None, None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    folder = tmp_path / "odd"
    both.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, str(folder)).write.parquet(f"{folder}/{name}")
        step = spark.read.parquet(f"{folder}/{name}")
    told = lambda rows: sorted(map(repr, rows))
    assert told(corpus_pipeline.run(spark, str(folder)).collect()) == told(step.collect()) != []
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
