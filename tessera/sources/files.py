"""File sources: whole texts with quarantine, PDFs through pluggable extractors, encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_stem, normalise_newlines, plain_spaces
from tessera.operators import chunking

Extractor = Callable[[bytes], list[str]]


def binary_files(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> DataFrame:
    """(path, content) of the files of a folder, below it too if ``recursive``; a missing folder is an error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    try:
        return reader.load(folder).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(folder) from e


def texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Texts (source_path, text) of the ``.txt`` files right in the folder, and the files that are not valid UTF-8
    (source_path, error), which are left out."""
    files = binary_files(spark, folder, "*.txt")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(valid).select(F.col("path").alias("source_path"), normalise_newlines(F.col("content").cast("string")).alias("text"))
    bad = files.where(~valid).select(F.col("path").alias("source_path"), F.lit("not valid UTF-8").alias("error"))
    return good, bad


def load(
    spark: SparkSession, folder: str, load_method: str = "chunked", chunk_size: int = 1024, overlap: int = 200, split_by: str = "char", splitter: chunking.Splitter | None = None
) -> DataFrame:
    """Chunks of all texts of a folder; a method other than ``chunked`` and ``overlap`` is taken as ``direct``."""
    good, _ = texts(spark, folder)
    if load_method == "chunked":
        out = chunking.prechunked(good)
    elif load_method == "overlap":
        out = chunking.overlapped(good, chunk_size, overlap, split_by, splitter=splitter)
    else:
        out = chunking.direct(good, chunk_size, split_by, splitter=splitter)
    return out.withColumn("load_method", F.lit(load_method))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all PDFs below a folder, their extension in any case."""
    return binary_files(spark, folder, "*.[pP][dD][fF]", recursive=True)


def extracted_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(path, page_no from 1, text, error): pages by the extractor, in tasks; a failing file gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(extractor(bytes(content)), 1)]
                except Exception as e:  # one bad file must not end the run
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")


def pdf_text_extractor() -> Extractor:
    """Text layer of each page, by an optional package."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDFs needs the optional package pypdf, or an extractor of your own") from e
    import io

    return lambda content: [p.extract_text() for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def page_text(pages: DataFrame) -> DataFrame:
    """(path, name, text): extracted pages as one page-marked text a file, named after the file; files that failed are left
    out."""
    return _named(chunking.page_marked(pages.where("error is null").select("path", "page_no", "text")))


def marked_text(pages: DataFrame, chunk_size: int = 800, split_by: str = "paragraph", splitter: chunking.Splitter | None = None) -> DataFrame:
    """(path, name, text): extracted pages as one chunk-marked text a file; the pages of a file are joined by newlines and
    cut as ``direct`` does."""
    rows = pages.where("error is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    texts = rows.select("path", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    return _named(chunking.marked(chunking.direct(texts, chunk_size, split_by, splitter=splitter), "path"))


def _named(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.concat(file_stem(F.col("path")), F.lit(".txt")).alias("name"), "text")


def encodings(files: DataFrame, detect: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, encoding) by the first 4,096 bytes; without a detector by byte order marks and UTF-8 validity."""

    def guess(head: bytes) -> str | None:
        for mark, name in ((b"\xef\xbb\xbf", "UTF-8-SIG"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
            if head.startswith(mark):
                return name
        if not head:
            return None
        for cut in range(4):  # a character may be cut at the end
            try:
                text = head[: len(head) - cut].decode("utf-8")
                return "ascii" if text.isascii() else "utf-8"
            except UnicodeDecodeError:
                continue
        return None

    chosen = detect or guess

    @F.pandas_udf("string")
    def name(head: pd.Series) -> pd.Series:
        return head.map(lambda b: chosen(bytes(b)), na_action="ignore")

    return files.select("path", name(F.substring("content", 1, 4096)).alias("encoding"))


def wrapped_lines(texts_: DataFrame, width: float, measure: Callable[[str], float] = len, text: str = "text") -> DataFrame:
    """(other columns, line_no, line): hard wrap at the longest prefix within ``width``; an empty line stays one line.
    A single character wider than the line stands alone."""
    kept = [c for c in texts_.columns if c not in (text, "line_no", "line")]

    def wrap(s: str) -> list[str]:
        out: list[str] = []
        for raw in s.split("\n"):
            x = raw
            if not x.strip():
                out.append("")
                continue
            while x:
                lo, hi = 1, len(x)
                while lo < hi:  # prefixes grow, so the longest that fits is found by halving
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if measure(x[:mid]) <= width else (lo, mid - 1)
                out.append(x[:lo])
                x = x[lo:]
        return out

    @F.pandas_udf("array<string>")
    def lines(s: pd.Series) -> pd.Series:
        return s.map(wrap, na_action="ignore")

    return texts_.select(*kept, F.posexplode(lines(plain_spaces(F.col(text)))).alias("line_no", "line"))


def stem_collisions(paths: DataFrame) -> DataFrame:
    """(name, n): output names that several files would share, as output is written by base name."""
    return paths.groupBy(file_stem(F.col("path")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")
