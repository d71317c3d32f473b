"""Sequences of timed rows: gap-and-island merging, capped chunks, windows of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T


def segments(conversations: DataFrame) -> DataFrame:
    """Speech over conversations: turn t starts at 10 s * t and lasts 60 ms a word."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    start = F.col("turn") * 10000
    return conversations.select(F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"), "text", start.alias("start_ms"), (start + 60 * n).alias("end_ms"))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows of each key; a row where ``breaks`` is true (or null, as for the first) starts one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def previous(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def capped_runs(df: DataFrame, keys: list[str], order: list[str], size: str, most: int, breaks: str) -> DataFrame:
    """Adds ``chunk``: a new one where ``breaks`` is true or the sizes would pass ``most``.

    The cap makes each row depend on all before it, so one key is scanned in order: one recording or page, never a
    corpus.  Rows of many keys share a task.
    """
    import copy

    schema = copy.deepcopy(df.schema)
    schema = schema.add("chunk", IntegerType())

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        chunk, room, out = -1, 0, []
        for n, cut in zip(pdf[size], pdf[breaks], strict=True):
            if chunk < 0 or cut or room + n > most:
                chunk, room = chunk + 1, 0
            room += n
            out.append(chunk)
        pdf["chunk"] = pd.Series(out, index=pdf.index, dtype="int32")
        return pdf

    return df.groupBy(*keys).applyInPandas(scan, schema)


def sentences(text: str, most: int) -> list[str]:
    """Sentences grouped up to ``most`` words; longer sentences are cut hard."""
    import re

    out: list[str] = []
    held: list[str] = []
    for sentence in re.split(r"(?<=[.;:!?])\s+", text.strip()):
        words = sentence.split()
        while len(words) > most:
            if held:
                out.append(" ".join(held))
                held = []
            out.append(" ".join(words[:most]))
            words = words[most:]
        if held and len(held) + len(words) > most:
            out.append(" ".join(held))
            held = []
        held += words
    if held:
        out.append(" ".join(held))
    return out


def is_heading(line: str) -> bool:
    """The rule of ``functions.text.is_heading`` for one line."""
    import re

    letters = [ch for ch in line if ch.isalpha()]
    if not 2 <= len(line) <= 90 or line[-1] in ".;," or not letters:
        return False
    capitals = sum(map(str.isupper, letters)) / len(letters)
    title = line.upper().strip(":") in T.KNOWN_HEADINGS or re.match(rf"(?i)(?:{T.ORDINALS})\b", line)
    return bool(title) or (capitals >= 0.85 and len(line) >= 4) or (line.endswith(":") and len(line) <= 60 and capitals >= 0.5)


def page_chunks(text: str, most: int = 500, body: int = 40, least: int = 180, overlap: int = 30) -> list[str]:
    """Chunks of a page: closed above ``most`` words, or at a heading once there is enough body and text in all.

    A chunk of headings only joins the one before; each chunk starts with the last ``overlap`` words of the previous.
    """
    chunks: list[list[str]] = []
    held: list[str] = []
    plain = 0

    def close() -> None:
        nonlocal held, plain
        if held:
            if not plain and chunks:
                chunks[-1] += held
            else:
                chunks.append(held)
        held, plain = [], 0

    for line in (text or "").split("\n"):
        line = line.strip()
        if not line:
            continue
        heading = is_heading(line)
        if heading and plain >= body and len(held) >= least:
            close()
        for unit in [line] if heading else sentences(line, most):
            words = unit.split()
            if held and len(held) + len(words) > most:
                close()
            held += words
            plain += 0 if heading else len(words)
    close()
    out = []
    for i, words in enumerate(chunks):
        head = chunks[i - 1][-overlap:] if i and overlap else []
        out.append(" ".join([*head, *words]))
    return out


def chunk_pages(pages: DataFrame, keys: list[str], text: str = "text", **limits: int) -> DataFrame:
    """``keys, chunk, words, text``: a narrow pass over pages."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, i, len(t.split()), t) for *k, page in pdf[[*keys, text]].itertuples(index=False) for i, t in enumerate(page_chunks(page, **limits))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk", "words", "text"])

    return pages.select(*keys, text).mapInPandas(run, f"{kinds}, chunk int, words int, text string")


def readings(pages: DataFrame, versions: DataFrame, *keys: str) -> DataFrame:
    """``keys, mode, text``: every reading of each page; the page's own text (mode null) where it has none.

    Readings without a page are kept; blank texts are left out.
    """
    keys = list(keys)
    own = pages.join(versions.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(None).cast("string").alias("mode"), "text")
    return versions.select(*keys, "mode", "text").unionByName(own).filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def merge_segments(segments: DataFrame, keys: list[str], gap: int = 500, longest: int = 30_000) -> DataFrame:
    """Recognised speech cut at short pauses, put together again.

    A segment joins the one before of the same speaker if the pause is 0 to ``gap`` ms and the whole stays within
    ``longest`` ms; a word broken by a hyphen closes up; confidence is weighted by time.  The cap makes each row depend on
    those before it, so one recording is read in order of start, end, speaker and text; one shuffle sorts them, and a task
    streams through many.
    """
    import pyarrow as pa

    columns = [*keys, "speaker", "start_ms", "end_ms", "text", "confidence"]
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in columns)

    def run(batches):
        held: dict | None = None
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                if held is not None and _continues(held, r, keys, gap, longest):
                    a, b = max(1, held["end_ms"] - held["start_ms"]), max(1, r["end_ms"] - r["start_ms"])
                    text = held["text"].rstrip()
                    held |= {"confidence": (held["confidence"] * a + r["confidence"] * b) / (a + b), "end_ms": r["end_ms"], "text": text + ("" if text.endswith("-") else " ") + r["text"].lstrip()}
                else:
                    if held is not None:
                        out.append(held)
                    held = r
            if out:
                yield pa.RecordBatch.from_pylist(out, rows.schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], rows.schema)

    rows = segments.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "start_ms", "end_ms", "speaker", "text", "confidence")
    return rows.mapInArrow(run, kinds)


def _continues(a: dict, b: dict, keys: list[str], gap: int, longest: int) -> bool:
    same = all(a[k] == b[k] for k in [*keys, "speaker"])
    return same and 0 <= b["start_ms"] - a["end_ms"] <= gap and b["end_ms"] - a["start_ms"] <= longest


def split_words(words: Column, boundary: Column) -> Column:
    """``head, tail`` of timed words (array of word, start_ms) at the first one that starts at a boundary; null if either is empty."""
    before = F.size(F.filter(words, lambda w: w["start_ms"] < boundary))
    text = lambda a: F.array_join(F.transform(a, lambda w: F.trim(w["word"])), " ")
    whole = (before > 0) & (before < F.size(words))
    return F.when(whole, F.struct(text(F.slice(words, F.lit(1), before)).alias("head"), text(F.slice(words, before + 1, F.size(words))).alias("tail")))


# Gaps in shares of the median height of a page's words.
SAME_LINE, NEW_PARAGRAPH, NEW_COLUMN = 0.7, 1.6, 2.5


def layout(words: Column) -> Column:
    """Text of a page from its words in boxes (text, x, y, w, h), line by line.

    Words within 0.7 of the median height (4 at least) of a line's first word are one line, read from left to right; a
    wide gap between lines is a blank line, one between words a run of spaces.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([_page_text([dict(w) if isinstance(w, dict) else w.asDict() for w in page]) for page in pages], dtype=object)

    return text(words)


def _page_text(words: list[dict]) -> str:
    heights = sorted(w["h"] for w in words if w["h"] > 0)
    unit = heights[len(heights) // 2] if heights else 12.0
    reach = max(4.0, SAME_LINE * unit)
    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["y"], w["x"])):
        if lines and w["y"] - lines[-1][0]["y"] <= reach:
            lines[-1].append(w)
        else:
            lines.append([w])

    def gap(left: dict, right: dict) -> str:
        space = right["x"] - left["x"] - left["w"]
        if space > NEW_COLUMN * unit:
            return " " * min(12, max(4, round(space / (0.5 * unit))))
        return " " * min(8, max(2, round(space / (0.6 * unit)))) if space > unit else " "

    out: list[str] = []
    bottom = None
    for line in lines:
        if bottom is not None and line[0]["y"] - bottom > NEW_PARAGRAPH * unit:
            out.append("")
        bottom = max(w["y"] + w["h"] for w in line)
        row = sorted(line, key=lambda w: w["x"])
        out.append(row[0]["text"] + "".join(gap(a, b) + b["text"] for a, b in zip(row, row[1:])))
    return "\n".join(out)
