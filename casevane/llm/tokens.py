"""Token counts with the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as one
token are *proven* whole.  A pre-token that is a proven string counts one without a merge; only the rest
go through the merge loop of the model (each distinct one once per worker, in a bounded memo).

Edge cases: a null or empty text has 0 bytes and 0 tokens; a null id is carried through; repeated rows are counted
each, equal rows alike; very long texts are counted whole (a pre-token beyond ``MEMO_CHARS`` is merged anew each time and
never kept); an empty table gives an empty table; other columns of the input are not read, whatever they are called.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Memo of pre-tokens beyond the proven strings, per Python worker.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48

# The byte-level pre-tokenisation pattern of the vocabulary, with its white space spelled out.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ASCII_SPACES = "\t\n\x0b\x0c\r "
#: Ranges whose character classes are the same in ``regex`` and in the library (a test walks them); a text with
#: any other character is cut by the library's own pre-tokeniser.
AGREED = ((0x00, 0x52F), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x3000, 0x303F), (0x3041, 0x3096), (0x30A0, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF))


def _patterns():
    import re

    import regex

    wide = regex.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+", regex.V0
    )
    plain = re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^{ASCII_SPACES}A-Za-z0-9]+|[{ASCII_SPACES}]+(?![^{ASCII_SPACES}])|[{ASCII_SPACES}]+"
    )
    other = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in AGREED) + "]")
    return plain, wide, other


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class TokenCounter:
    """Counts the tokens of whole texts; one per worker."""

    def __init__(self, path: str, whole: list[str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        symbols = byte_symbols()
        self.to_symbols = {b: s for b, s in enumerate(symbols)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Special strings inside a text are one token each, the library's default.
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.plain, self.wide, self.other = _patterns()
        self.whole = self.prove(spec["model"]["vocab"], symbols) if whole is None else whole
        outer = self

        class Memo(dict):
            def __missing__(self, piece: str) -> int:
                n = outer.merged(piece)
                if len(piece) <= MEMO_CHARS:
                    if len(self) >= len(outer.whole) + MEMO_ENTRIES:
                        self.clear()
                        self.update(dict.fromkeys(outer.whole, 1))
                    self[piece] = n
                return n

        self.memo = Memo.fromkeys(self.whole, 1)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token, by merging."""
        return len(self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.to_symbols)))

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        if self.other.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.wide.findall(text)

    def prove(self, vocab: dict[str, int], symbols: list[str]) -> list[str]:
        """The vocabulary strings that are one pre-token and merge into one token."""
        back = {s: b for b, s in enumerate(symbols)}
        out = []
        for entry in vocab:
            try:
                text = bytes(back[c] for c in entry).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character or a special string never is a whole pre-token
            if self.pieces(text) == [text] and len(self.model.tokenize(entry)) == 1:
                out.append(text)
        return out

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        for special in self.special:
            if special in text:
                cut = [p.split(special) for p in parts]
                total += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        get = self.memo.__getitem__
        for part in parts:
            total += sum(map(get, self.pieces(part)))
        return total


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row: one narrow pass, nothing is shuffled."""
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(TokenCounter(path).whole)  # bounded by the vocabulary file
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = TokenCounter(path, proven.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8", "replace")))
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
