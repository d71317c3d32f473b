import public_tokenizers as P
from tokenizers import Tokenizer

from casevane.llm import tokens

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "plain words here", "a<|endoftext|>b <|endoftext|><|endoftext|>", "  x  \n\n y\t\tz ", "'s'S it's I'LL we'll", "\x1c\x1d a\x85b　c", "1² ½ ٣ 12345", "é" * 3000, "!" * 2000, " " * 500 + "x", "\n" * 7, "hé՘ \U0001fae9 wörld 😀", "中文 字符", "Zorgunblixt krandorsth " * 50]


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "no id", "z"), (77, None, "n")]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_proven_strings_are_one_token():
    c, lib = tokens.TokenCounter(PATH), Tokenizer.from_file(PATH)
    assert len(c.whole) > 40_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(c.whole[::37], add_special_tokens=False))


def test_agreed_ranges():
    c = tokens.TokenCounter(PATH, ["a"])
    cut = c.tokenizer.pre_tokenizer.pre_tokenize_str
    for a, b in tokens.AGREED:
        for cp in range(max(a, 128), b + 1):
            s = f"a{chr(cp)}1{chr(cp)}!{chr(cp)} "
            assert len(cut(s)) == len(c.wide.findall(s)), hex(cp)


def test_very_long_text(spark):
    lib = Tokenizer.from_file(PATH)
    text = "word other é " * 40_000 + "q" * 60_000
    got = tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(text.encode()), len(lib.encode(text, add_special_tokens=False).ids), True)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 10)
    c = tokens.TokenCounter(PATH, ["the"])
    for i in range(200):
        c.count(f"zq{i}xw{i * 7}")
    assert len(c.memo) <= 11
