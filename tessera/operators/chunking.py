"""Chunkers: tables of chunks from tables of texts.

Every chunker takes a DataFrame with a text column and gives all its other columns (``text`` excluded) plus
``id, doc_id, chunk_id, total_chunks, content``.  Null texts and empty texts give no chunk; repeated rows give repeated
chunks; columns of the input with a clashing name are dropped in favour of the chunk's.  Lengths count code points.

Slices of texts up to ``LONG_TEXT`` are cut in the JVM; of longer ones, for which repeated ``substring`` from the start
would be quadratic, and wherever units are packed or a splitter is given, texts are cut in Arrow batches, in linear time.
Both ways give the same.

Sentences are what stands between ideographic full stops unless a ``splitter`` is given, which takes a text and gives its
sentences; ``rule_sentences`` is one for texts with full stops, question and exclamation marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WHITE_CHARS, chunk_key, document_id, normalise_newlines, strip

Splitter = Callable[[str], list[str]]
MARKER = r"--- Document Chunk \d+ ---"
LONG_TEXT = 262_144
OUTPUT = ("id", "doc_id", "chunk_id", "total_chunks", "content")


def check(chunk_size: int, overlap: int = 0, split_by: str = "char") -> None:
    """Parameters as the chunkers take them; a negative overlap or a size below 1 is refused too."""
    if chunk_size < 1 or overlap < 0:
        raise ValueError("chunk_size must be positive and overlap must not be negative")
    if overlap >= chunk_size:
        raise ValueError(f"overlap ({overlap}) must be less than chunk_size ({chunk_size})")
    if split_by not in ("char", "sentence", "paragraph"):
        raise ValueError(f"unknown split_by: {split_by}")


def _solid(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def prechunked_parts(text: Column) -> Column:
    """Pieces between chunk markers, stripped, blank ones dropped; marker numbers are ignored."""
    return _solid(F.split(text, MARKER))


def char_parts(text: Column, chunk_size: int, overlap: int) -> Column:
    """Closed form of packing single slices: piece i is [max(0, i*size - overlap), (i+1)*size), from 0 if overlap is 0."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(chunk_size)).cast("int") - 1, F.lit(0))

    def piece(i: Column) -> Column:
        start = F.greatest(i * chunk_size - overlap, F.lit(0)) if overlap else F.lit(0)
        return F.substring(text, start + 1, (i + 1) * chunk_size - start)

    return _solid(F.transform(F.sequence(F.lit(0), last), piece))


def plain_parts(text: Column, chunk_size: int) -> Column:
    """Slices of the size without overlap."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(chunk_size)).cast("int") - 1, F.lit(0))
    return _solid(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * chunk_size + 1, F.lit(chunk_size))))


# The same in Python, for Arrow batches of long texts.


def char_pieces(text: str, chunk_size: int, overlap: int) -> list[str]:
    cut = (text[max(0, k - overlap) if overlap else 0 : k + chunk_size] for k in range(0, len(text), chunk_size))
    return [p for x in cut if (p := x.strip(WHITE_CHARS))]


def plain_pieces(text: str, chunk_size: int) -> list[str]:
    return [p for k in range(0, len(text), chunk_size) if (p := text[k : k + chunk_size].strip(WHITE_CHARS))]


_STOP = re.compile(r"[.!?][\"”’')\]]*(\s+)(?=[\"“‘'(\[]?[^\W\d_a-z])|[。！？][”’」』]*")


def rule_sentences(text: str) -> list[str]:
    """Sentences by their marks: after a full stop, question or exclamation mark and what closes it, before a word that
    begins neither in lower case nor with a figure; after an ideographic mark anywhere.  White space between them goes."""
    out, last = [], 0
    for m in _STOP.finditer(text):
        out.append(text[last : m.start(1) if m.group(1) else m.end()])
        last = m.end()
    return [x for x in [*out, text[last:]] if x]


def units(text: str, split_by: str, splitter: Splitter | None = None) -> list[str]:
    """Paragraphs are stripped lines that are not blank; sentences are the splitter's, by default what stands between
    ideographic full stops."""
    if split_by == "paragraph":
        return [p for x in text.split("\n") if (p := x.strip(WHITE_CHARS))]
    return splitter(text) if splitter else text.split("。")


def packed_pieces(text: str, split_by: str, chunk_size: int, overlap: int, splitter: Splitter | None = None, whole: bool = True) -> list[str]:
    """Greedy packing: a unit that would overfill a chunk that is not empty closes it, and the next one starts with its tail;
    without overlap with the whole chunk before, unless ``whole`` is false."""
    done, cur, size = [], [], 0
    for u in units(text, split_by, splitter):
        if size and size + len(u) > chunk_size:
            made = "".join(cur)
            done.append(made)
            cur = [made[-overlap:] if overlap else made if whole else "", u]
            size = len(cur[0]) + len(u)
        else:
            cur.append(u)
            size += len(u)
    return [p for x in [*done, "".join(cur)] if (p := x.strip(WHITE_CHARS))]


def unit_pieces(text: str, split_by: str, chunk_size: int, splitter: Splitter | None = None) -> list[str]:
    """Each unit by itself, cut where it is longer than the size."""
    return [p for u in units(text, split_by, splitter) for p in plain_pieces(u, chunk_size)]


def chunk(texts: DataFrame, parts: Callable[[Column], Column] | None, pieces: Callable[[str], list[str]] | None = None, text: str = "text") -> DataFrame:
    """Chunks of every text by the column function ``parts``, of longer texts, or without it of all, by ``pieces``."""
    kept = [c for c in texts.columns if c not in (text, *OUTPUT)]
    present = texts.where(F.col(text).isNotNull())
    body = lambda rows: rows.select(*kept, normalise_newlines(F.col(text)).alias("_text"))

    def table(rows: DataFrame, made: Column) -> DataFrame:
        named = rows.withColumn("doc_id", F.sha2("_text", 256)).withColumn("_parts", made).withColumn("total_chunks", F.size("_parts"))
        # The outer form keeps the optimizer from computing all pieces once more, in a filter on their number.
        out = named.select(*kept, "doc_id", "total_chunks", F.posexplode_outer("_parts").alias("chunk_id", "_piece")).where("chunk_id is not null")
        content = F.struct(F.lit("text").alias("type"), F.col("_piece").alias("text"))
        return out.select(*kept, chunk_key(F.col("doc_id"), F.col("chunk_id")).alias("id"), "doc_id", "chunk_id", "total_chunks", content.alias("content"))

    if pieces is None:
        return table(body(present), parts(F.col("_text")))

    @F.pandas_udf("array<string>")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(pieces)

    if parts is None:
        return table(body(present), cut("_text"))
    short, long = present.where(F.length(text) <= LONG_TEXT), present.where(F.length(text) > LONG_TEXT)
    return table(body(short), parts(F.col("_text"))).unionByName(table(body(long), cut("_text")))


def prechunked(texts: DataFrame, text: str = "text") -> DataFrame:
    """Chunks between ``--- Document Chunk n ---`` markers, renumbered from 0; a text without markers is one chunk."""
    return chunk(texts, prechunked_parts, text=text)


def overlapped(
    texts: DataFrame, chunk_size: int = 1024, overlap: int = 200, split_by: str = "char", text: str = "text", compat: bool = False, splitter: Splitter | None = None
) -> DataFrame:
    """Overlapping chunks.  With overlap 0 a chunk has no tail of the one before it; ``compat=True`` starts it with the
    whole one before, as the packing rule has it taken by the letter, which gives output quadratic in the text."""
    check(chunk_size, overlap, split_by)
    if split_by != "char":
        return chunk(texts, None, lambda t: packed_pieces(t, split_by, chunk_size, overlap, splitter, compat), text)
    if overlap == 0 and not compat:
        return direct(texts, chunk_size, text=text)
    return chunk(texts, lambda c: char_parts(c, chunk_size, overlap), lambda t: char_pieces(t, chunk_size, overlap), text)


def direct(texts: DataFrame, chunk_size: int = 1024, split_by: str = "char", text: str = "text", splitter: Splitter | None = None) -> DataFrame:
    """Slices of the size without overlap, or each sentence or paragraph by itself, cut where it is longer than the size."""
    check(chunk_size, split_by=split_by)
    if split_by != "char":
        return chunk(texts, None, lambda t: unit_pieces(t, split_by, chunk_size, splitter), text)
    return chunk(texts, lambda c: plain_parts(c, chunk_size), lambda t: plain_pieces(t, chunk_size), text)


def marked(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): chunk texts behind numbered markers, in order; the inverse of ``prechunked``."""
    entry = F.concat(F.lit("--- Document Chunk "), (F.col("chunk_id") + 1).cast("string"), F.lit(" ---\n"), F.col("content.text"), F.lit("\n\n"))
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", entry.alias("entry")))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["entry"]), "").alias("text"))


def pages(texts: DataFrame, text: str = "text") -> DataFrame:
    """(other columns, page_no, page_text): pages of a page-marked text; what stands before the first marker is page 0."""
    kept = [c for c in texts.columns if c not in (text, "page_no", "page_text")]
    number = F.concat(F.array(F.lit("0")), F.regexp_extract_all(F.col(text), F.lit(r"--- Page (\d+) ---"), F.lit(1)))
    both = F.arrays_zip(number.alias("no"), F.split(F.col(text), r"--- Page \d+ ---").alias("body"))
    rows = texts.where(F.col(text).isNotNull()).select(*kept, F.explode_outer(both).alias("p"))
    return rows.select(*kept, F.col("p.no").cast("int").alias("page_no"), strip(F.col("p.body")).alias("page_text")).where("page_no > 0 or page_text <> ''")


def page_marked(pages_: DataFrame, key: str = "path") -> DataFrame:
    r"""(key, text): pages of a file in order, each as ``\n--- Page n ---\n`` and its text; a null page counts as empty."""
    rows = pages_.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("rows"))
    entry = lambda r: F.concat(F.lit("\n--- Page "), r["page_no"].cast("string"), F.lit(" ---\n"), r["text"])
    return rows.select(key, F.array_join(F.transform("rows", entry), "").alias("text"))


def identities(texts: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the content hash of the text."""
    return texts.withColumn("content_id", document_id(F.col(text)))
