"""Queries over the given tables by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers as A
from tessera.operators import chunking as C
from tessera.operators import ordinals as O
from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.operators.batch_qa import answer, answer_batch, first_passage
from tessera.operators.embedding import hashing_embedder
from tessera.operators.store import Collection, upserted
from tessera.plans.tables import chunk_texts, stored, table, work_dir
from tessera.sources.files import extracted_pages, load, marked_text, page_text, texts, wrapped_lines
from tessera.sources.sinks import write_files, write_texts
from tessera.streaming.ingest import chunk_stream, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # type: ignore[no-untyped-def]
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


WHITE = T.WHITE


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WHITE}]+|[{WHITE}]+\z', '', 'g')"


def _solid(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {_strip('x')}), lambda x: x <> '')"


_DOCS = r"t AS (SELECT doc_id AS src_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL)"


def _char(size: int, overlap: int, source: str = "text") -> str:
    start = f"greatest(i * {size} - {overlap}, 0)" if overlap else "0"
    return _solid(f"list_transform(range(0, CAST(ceil(length({source}) / {size}.0) AS BIGINT)), lambda i: substring({source}, {start} + 1, (i + 1) * {size} - {start}))")


def _plain(size: int, source: str = "text") -> str:
    return _solid(f"list_transform(range(0, CAST(ceil(length({source}) / {size}.0) AS BIGINT)), lambda i: substring({source}, i * {size} + 1, {size}))")


def _packed(units: str, size: int, overlap: int | None) -> str:
    first = "{'done': CAST([] AS VARCHAR[]), 'cur': ''}"
    item = "{'done': CAST([] AS VARCHAR[]), 'cur': u}"
    tail = f"right(a.cur, {overlap}) || " if overlap else ""
    full = f"{{'done': list_append(a.done, a.cur), 'cur': {tail}x.cur}}"
    more = "{'done': a.done, 'cur': a.cur || x.cur}"
    return f"list_reduce(list_prepend({first}, list_transform({units}, lambda u: {item})), lambda a, x: CASE WHEN length(a.cur) + length(x.cur) > {size} AND a.cur <> '' THEN {full} ELSE {more} END)"


def _chunks(parts: str, docs: str = _DOCS, source: str = "text") -> str:
    return f"""WITH {docs},
p AS (SELECT src_id, sha256({source}) AS doc_id, {parts} AS parts FROM t),
e AS (SELECT src_id, doc_id, len(parts) AS total_chunks, unnest(parts) AS chunk_text, generate_subscripts(parts, 1) - 1 AS chunk_id FROM p)"""


_FLAT = "SELECT src_id, doc_id || '-' || chunk_id AS id, doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(total_chunks AS BIGINT) AS total_chunks, chunk_text FROM e"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_id"), "text")


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select("src_id", "id", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("total_chunks").cast("long").alias("total_chunks"), F.col("content.text").alias("chunk_text"))


# Chunking


@query("char_chunk", f"{_chunks(_char(1024, 200))} {_FLAT}")
def char_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping character chunks with content-hash ids."""
    return _flat(C.overlapped(_documents(spark, sf_dir), 1024, 200))


@query(
    "char_chunk_stats",
    f"{_chunks(_char(800, 100))} SELECT d.source, d.lang, count(*) AS n_chunks, count(DISTINCT e.doc_id) AS n_texts, CAST(sum(length(chunk_text)) AS BIGINT) AS n_chars, CAST(max(total_chunks) AS BIGINT) AS most_chunks FROM e JOIN documents d ON d.doc_id = e.src_id GROUP BY ALL",
)
def char_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts and sizes by source and language."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    length = F.length("content.text")
    return C.overlapped(docs, 800, 100).groupBy("source", "lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_texts"), F.sum(length).alias("n_chars"), F.max("total_chunks").cast("long").alias("most_chunks"))


@query("char_chunk_overlap0", f"{_chunks(_char(1024, 0))} SELECT src_id, doc_id || '-' || chunk_id AS id, CAST(length(chunk_text) AS BIGINT) AS n_chars, md5(chunk_text) AS digest FROM e")
def char_chunk_overlap0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without overlap each chunk is the whole prefix."""
    chunks = _flat(C.overlapped(_documents(spark, sf_dir), 1024, 0, compat=True))
    return chunks.select("src_id", "id", F.length("chunk_text").cast("long").alias("n_chars"), F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query("direct_char_chunk", f"{_chunks(_plain(1024))} {_FLAT}")
def direct_char_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(C.direct(_documents(spark, sf_dir), 1024))


_PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"


def _packed_sql(units: str, docs: str = _DOCS, overlap: int | None = 200) -> str:
    return f"""WITH {docs},
r AS (SELECT src_id, sha256(text) AS doc_id, {_packed(units, 1024, overlap)} AS r FROM t),
p AS (SELECT src_id, doc_id, {_solid("list_append(r.done, r.cur)")} AS parts FROM r),
e AS (SELECT src_id, doc_id, len(parts) AS total_chunks, unnest(parts) AS chunk_text, generate_subscripts(parts, 1) - 1 AS chunk_id FROM p) {_FLAT}"""


@query("paragraph_pack", _packed_sql(_PARAGRAPHS))
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed greedily, with the tail of the chunk before."""
    return _flat(C.overlapped(_documents(spark, sf_dir), 1024, 200, "paragraph"))


_STOPPED = r"t AS (SELECT doc_id AS src_id, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '. ', '。') AS text FROM documents WHERE text IS NOT NULL)"


@query("sentence_pack_fallback", _packed_sql("string_split(text, '。')", _STOPPED))
def sentence_pack_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences between ideographic full stops, packed greedily."""
    docs = _documents(spark, sf_dir).withColumn("text", F.replace(T.normalise_newlines(F.col("text")), F.lit(". "), F.lit("。")))
    return _flat(C.overlapped(docs, 1024, 200, "sentence"))


def _units(units: str, size: int) -> str:
    return f"flatten(list_transform({units}, lambda u: {_plain(size, 'u')}))"


@query("direct_paragraph", f"{_chunks(_units(_PARAGRAPHS, 300))} {_FLAT}")
def direct_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph by itself, cut where it is longer than the size."""
    return _flat(C.direct(_documents(spark, sf_dir), 300, "paragraph"))


@query("direct_sentence", f"{_chunks(_units("string_split(text, '。')", 200), _STOPPED)} {_FLAT}")
def direct_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence between ideographic full stops by itself, cut where it is longer than the size."""
    docs = _documents(spark, sf_dir).withColumn("text", F.replace(T.normalise_newlines(F.col("text")), F.lit(". "), F.lit("。")))
    return _flat(C.direct(docs, 200, "sentence"))


@query("splitter_pack", _packed_sql("string_split(text, '; ')"))
def splitter_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed by a splitter of one's own, here at semicolons."""
    return _flat(C.overlapped(_documents(spark, sf_dir), 1024, 200, "sentence", splitter=lambda t: t.split("; ")))


@query("paragraph_pack_overlap0", _packed_sql(_PARAGRAPHS, overlap=None))
def paragraph_pack_overlap0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed without a tail."""
    return _flat(C.overlapped(_documents(spark, sf_dir), 1024, 0, "paragraph"))


@query(
    "prechunk_roundtrip",
    rf"""WITH t AS (SELECT DISTINCT regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT sha256(text) AS doc_id, {_plain(700)} AS parts FROM t),
e AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n FROM p),
m AS (SELECT doc_id, string_agg('--- Document Chunk ' || n || ' ---' || chr(10) || piece || chr(10) || chr(10), '' ORDER BY n) AS body FROM e GROUP BY doc_id),
s AS (SELECT doc_id AS source_doc, sha256(body) AS doc_id, {_solid("regexp_split_to_array(body, '--- Document Chunk [0-9]+ ---')")} AS parts FROM m),
u AS (SELECT source_doc, doc_id, len(parts) AS total_chunks, unnest(parts) AS chunk_text, generate_subscripts(parts, 1) - 1 AS chunk_id FROM s)
SELECT source_doc, doc_id || '-' || chunk_id AS id, CAST(total_chunks AS BIGINT) AS total_chunks, chunk_text FROM u""",
)
def prechunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written behind markers and read back."""
    docs = table(spark, sf_dir, "documents").select(T.normalise_newlines(F.col("text")).alias("text")).distinct()
    marked = C.marked(C.direct(docs, 700)).withColumnRenamed("doc_id", "source_doc")
    return C.prechunked(marked).select("source_doc", "id", F.col("total_chunks").cast("long").alias("total_chunks"), F.col("content.text").alias("chunk_text"))


@query(
    "stored_chunks_prechunked",
    rf"""WITH t AS (SELECT DISTINCT id AS src_id, regexp_replace(content.text, '\r\n?', chr(10), 'g') AS text FROM chunks WHERE content.text IS NOT NULL AND id IS NOT NULL),
p AS (SELECT src_id, sha256(text) AS doc_id, {_solid("regexp_split_to_array(text, '--- Document Chunk [0-9]+ ---')")} AS parts FROM t),
e AS (SELECT src_id, doc_id, len(parts) AS total_chunks, unnest(parts) AS chunk_text, generate_subscripts(parts, 1) - 1 AS chunk_id FROM p) {_FLAT}""",
)
def stored_chunks_prechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-marked and plain texts have no chunk marker: each is one chunk, blank ones none."""
    rows = chunk_texts(spark, sf_dir).select(F.col("id").alias("src_id"), "text").dropDuplicates(["src_id"])
    return _flat(C.prechunked(rows))


@query(
    "page_parse",
    rf"""WITH t AS (SELECT DISTINCT id, content.text AS text FROM chunks WHERE load_method = 'direct' AND content.text IS NOT NULL AND id IS NOT NULL),
p AS (SELECT id, list_prepend('0', regexp_extract_all(text, '--- Page ([0-9]+) ---', 1)) AS nos, regexp_split_to_array(text, '--- Page [0-9]+ ---') AS bodies FROM t),
e AS (SELECT id, unnest(nos) AS no, unnest(bodies) AS body FROM p)
SELECT id AS chunk_ref, CAST(no AS BIGINT) AS page_no, {_strip("body")} AS page_text FROM e WHERE CAST(no AS BIGINT) > 0 OR {_strip("body")} <> ''""",
)
def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the page-marked chunks."""
    rows = chunk_texts(spark, sf_dir).where("load_method = 'direct'").select(F.col("id").alias("chunk_ref"), "text").dropDuplicates(["chunk_ref"])
    return C.pages(rows).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "page_concat",
    """WITH p AS (SELECT DISTINCT path, page_no, coalesce(text, '') AS text FROM scan_pages WHERE path IS NOT NULL AND page_no IS NOT NULL)
SELECT path, count(*) AS n_pages, md5(string_agg(chr(10) || '--- Page ' || page_no || ' ---' || chr(10) || text, '' ORDER BY page_no, text)) AS digest FROM p GROUP BY path""",
)
def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each scanned file concatenated in order."""
    rows = table(spark, sf_dir, "scan_pages").where("path is not null and page_no is not null")
    sizes = rows.select("path", "page_no", F.coalesce("text", F.lit("")).alias("text")).distinct().groupBy("path").agg(F.count("*").alias("n_pages"))
    return C.page_marked(rows).join(sizes, "path").select("path", "n_pages", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("batch_ordinal", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS BIGINT) AS batch FROM documents WHERE doc_id IS NOT NULL")
def batch_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of 50 that each document falls into."""
    return O.batches(table(spark, sf_dir, "documents").select("doc_id").where("doc_id is not null"), 50, "doc_id").select("doc_id", "batch")


@query(
    "union_all_chunks",
    f"""WITH {_DOCS},
a AS (SELECT 'overlap' AS load_method, unnest({_char(1024, 200)}) AS x FROM t),
b AS (SELECT 'direct' AS load_method, unnest({_plain(1024)}) AS x FROM t),
c AS (SELECT 'chunked' AS load_method, unnest({_solid("regexp_split_to_array(text, '--- Document Chunk [0-9]+ ---')")}) AS x FROM t)
SELECT load_method, count(*) AS n_chunks, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY load_method""",
)
def union_all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag union of the chunks of every load method."""
    docs = _documents(spark, sf_dir)
    parts = [("overlap", C.overlapped(docs, 1024, 200)), ("direct", C.direct(docs, 1024)), ("chunked", C.prechunked(docs))]
    rows = [c.select(F.lit(m).alias("load_method"), F.length("content.text").alias("n")) for m, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("load_method").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"))


@query("chunks_per_file", "SELECT source_path, load_method, count(*) AS n_rows, count(DISTINCT id) AS n_chunks, count(DISTINCT doc_id) AS n_texts FROM chunks GROUP BY ALL")
def chunks_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks by file and load method."""
    c = table(spark, sf_dir, "chunks")
    return c.groupBy("source_path", "load_method").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_chunks"), F.countDistinct("doc_id").alias("n_texts"))


_FOLDER = r"t AS (SELECT doc_id AS src_id, regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) AS text FROM documents WHERE text IS NOT NULL AND doc_id % 97 <> 0)"


def _folder(spark: SparkSession, sf_dir: str, broken: bool = True) -> str:
    """The documents as a folder of .txt files, one each, ended by a newline; every 97th has a broken encoding, or is left out."""
    docs, path = table(spark, sf_dir, "documents").where("text is not null"), work_dir(spark)
    bad = F.col("doc_id") % 97 == 0
    text = F.col("text").cast("binary")
    body = F.when(bad, F.concat(F.expr("X'FFFE'"), text)).otherwise(text)
    write_files((docs if broken else docs.where(~bad)).select(F.concat(body, F.expr("X'0A'")).alias("body")), path)
    return path


@query(
    "folder_load",
    f"""{_chunks(_char(1024, 200), _FOLDER)}
SELECT 'chunks' AS what, doc_id || '-' || chunk_id AS id, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT 'files' AS what, NULL AS id, count(*) AS n FROM t
UNION ALL SELECT 'files that are not UTF-8' AS what, NULL AS id, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 97 = 0""",
)
def folder_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files loaded, files that are not valid UTF-8 set aside."""
    path = _folder(spark, sf_dir)
    good, bad = texts(spark, path)
    count = lambda rows, what: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("id"), "n")
    chunks = load(spark, path, "overlap", 1024, 200).groupBy("id").agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), "id", "n")
    return chunks.unionByName(count(good, "files")).unionByName(count(bad, "files that are not UTF-8"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an extractor finds in the documents' bytes, here at blank lines; it fails where the first page is short."""

    def extract(content: bytes) -> list[str]:
        pages = content.decode().split("\n\n")
        if len(pages[0]) < 20:
            raise ValueError("no first page")
        return pages

    docs = table(spark, sf_dir, "documents").where("text is not null")
    return extracted_pages(docs.select(F.concat(F.lit("/scans/"), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("path"), F.encode("text", "UTF-8").alias("content")), extract)


_PAGES = "t AS (SELECT '/scans/' || doc_id || '.v1.pdf' AS path, doc_id || '.v1.txt' AS name, string_split(text, chr(10) || chr(10)) AS pages FROM documents WHERE text IS NOT NULL), g AS (SELECT * FROM t WHERE length(pages[1]) >= 20)"


@query(
    "extracted_page_text",
    f"""WITH {_PAGES}, e AS (SELECT name, unnest(pages) AS page, generate_subscripts(pages, 1) AS n FROM g)
SELECT name, md5(string_agg(chr(10) || '--- Page ' || n || ' ---' || chr(10) || page, '' ORDER BY n)) AS digest FROM e GROUP BY name""",
)
def extracted_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted pages as page-marked texts by file name; files on which the extractor fails are left out."""
    return page_text(_extracted(spark, sf_dir)).select("name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "extracted_marked_text",
    rf"""WITH {_PAGES}, x AS (SELECT name, regexp_replace(array_to_string(pages, chr(10)), '\r\n?', chr(10), 'g') AS text FROM g),
p AS (SELECT name, {_units(_PARAGRAPHS, 800)} AS parts FROM x), e AS (SELECT name, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n FROM p)
SELECT name, md5(string_agg('--- Document Chunk ' || n || ' ---' || chr(10) || piece || chr(10) || chr(10), '' ORDER BY n)) AS digest FROM e GROUP BY name""",
)
def extracted_marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted pages as chunk-marked texts by file name, written and read back."""
    path = work_dir(spark)
    write_texts(marked_text(_extracted(spark, sf_dir)), path)
    return spark.read.schema("name string, text string").json(path).select("name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("extraction_errors", f"WITH {_PAGES} SELECT path, 'no first page' AS error FROM t WHERE length(pages[1]) < 20")
def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on which the extractor fails, with its message."""
    return _extracted(spark, sf_dir).where("error is not null").select("path", "error")


@query(
    "line_wrap",
    """WITH t AS (SELECT doc_id AS src_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT src_id, n, replace(raw, '　', ' ') AS x FROM t),
p AS (SELECT src_id, n, CASE WHEN """
    + _strip("x")
    + """ = '' THEN [''] ELSE list_transform(range(0, CAST(ceil(length(x) / 60.0) AS BIGINT)), lambda i: substring(x, i * 60 + 1, 60)) END AS parts FROM w),
e AS (SELECT src_id, n, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM p)
SELECT src_id, CAST(row_number() OVER (PARTITION BY src_id ORDER BY n, k) - 1 AS BIGINT) AS line_no, line FROM e""",
)
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as laid out at a width of 60 characters of equal width."""
    return wrapped_lines(_documents(spark, sf_dir), 60).withColumn("line_no", F.col("line_no").cast("long"))


# Identities and scalar functions


@query(
    "doc_identity",
    r"SELECT doc_id, sha256(text) AS content_id, CAST(length(text) AS BIGINT) AS n_code_points FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g') AS text FROM documents)",
)
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of texts with Windows newlines."""
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(windows).alias("content_id"), F.length(T.normalise_newlines(windows)).cast("long").alias("n_code_points"))


@query(
    "dedup_doc_id",
    r"WITH t AS (SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS content_id FROM documents WHERE text IS NOT NULL) SELECT content_id, count(*) AS n_documents, min(doc_id) AS first_document FROM t GROUP BY content_id",
)
def dedup_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal content."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.document_id(F.col("text")).alias("content_id"))
    return docs.groupBy("content_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


_PADDED = "chr(12288) || chr(160) || content.text || chr(8232) || chr(133) || chr(10) || chr(8195)"


@query("unicode_strip", f"SELECT DISTINCT id, {_strip(_PADDED)} AS stripped FROM chunks WHERE content.text IS NOT NULL AND id IS NOT NULL")
def unicode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts, padded with white space of several kinds, stripped."""
    padded = F.concat(F.lit("　 "), "text", F.lit(" \u0085\n "))
    return chunk_texts(spark, sf_dir).select("id", T.strip(padded).alias("stripped")).distinct()


@query(
    "file_names",
    r"""SELECT DISTINCT source_path, regexp_extract(source_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '([^.])\.[^.]*$', '\1') AS stem,
regexp_replace(source_path, '(?i)\.txt$', '.pdf') AS pdf_path, ends_with(source_path, '.txt') AS is_text FROM chunks WHERE source_path IS NOT NULL""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names derived from the paths of stored chunks."""
    path = F.col("source_path")
    rows = table(spark, sf_dir, "chunks").where(path.isNotNull()).select(path).distinct()
    return rows.select(path, T.file_name(path).alias("name"), T.file_stem(path).alias("stem"), T.swap_extension(path, "txt", "pdf").alias("pdf_path"), T.has_extension(path, "txt").alias("is_text"))


@query(
    "file_suffixes",
    "WITH p AS (SELECT DISTINCT source_path, CASE WHEN length(source_path) % 2 = 0 THEN upper(source_path) ELSE source_path END AS path FROM chunks WHERE source_path IS NOT NULL) SELECT source_path, ends_with(path, '.txt') AS exact, ends_with(lower(path), '.txt') AS any_case FROM p",
)
def file_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix tests as they stand and in any case, half of the paths in capitals."""
    rows = table(spark, sf_dir, "chunks").where("source_path is not null").select("source_path").distinct()
    path = F.when(F.length("source_path") % 2 == 0, F.upper("source_path")).otherwise(F.col("source_path"))
    return rows.select("source_path", T.has_extension(path, "txt").alias("exact"), T.has_extension(path, "txt", any_case=True).alias("any_case"))


@query("preview", "SELECT DISTINCT id, substring(query, 1, 100) || '...' AS question, substring(answer, 1, 150) || '...' AS answer FROM qa_records")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first characters of questions and answers."""
    return table(spark, sf_dir, "qa_records").select("id", T.preview(F.col("query"), 100).alias("question"), T.preview(F.col("answer"), 150).alias("answer")).distinct()


# Similarity

_SCORES = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.qv, CAST(e.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM q, embeddings e)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(
    "cosine_topk",
    f"WITH {_SCORES} SELECT query_id, CAST(position AS BIGINT) AS position, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s) WHERE position <= 10",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every query vector."""
    return R.retrieve(*_vectors(spark, sf_dir), limit=10).withColumn("position", F.col("position").cast("long"))


@query("cosine_threshold", f"WITH {_SCORES} SELECT query_id, id, score FROM s WHERE score >= 0.3")
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors that reach a similarity to a query vector."""
    return R.similar(*_vectors(spark, sf_dir), k=None, threshold=0.3)


@query(
    "threshold_relax",
    f"""WITH {_SCORES},
o AS (SELECT * FROM s WHERE id <> query_id AND score >= 0.1),
m AS (SELECT query_id, max(score) AS top FROM o GROUP BY query_id),
l AS (SELECT query_id, CASE WHEN top >= 0.9 THEN 0.9 WHEN top >= 0.5 THEN 0.5 WHEN top >= 0.4 THEN 0.4 WHEN top >= 0.3 THEN 0.3 ELSE 0.1 END AS threshold FROM m)
SELECT query_id, CAST(threshold AS DOUBLE) AS threshold, CAST(position AS BIGINT) AS position, id, score FROM (SELECT o.query_id, l.threshold, o.id, o.score, row_number() OVER (PARTITION BY o.query_id ORDER BY o.score DESC, o.id) AS position FROM o JOIN l ON l.query_id = o.query_id WHERE o.score >= l.threshold) WHERE position <= 5""",
)
def threshold_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at the highest threshold at which a query has any, its own row left out."""
    return R.relaxed(*_vectors(spark, sf_dir), thresholds=(0.9, 0.5, 0.4, 0.3, 0.1), limit=5, others=True).withColumn("position", F.col("position").cast("long"))


@query("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top ten by inverted lists; recall against the exact search is tested."""
    return R.search_lists(*_vectors(spark, sf_dir), k=10)


_HASHED = r"""c AS (SELECT id, max(content.text) AS text FROM chunks WHERE content.text IS NOT NULL AND id IS NOT NULL GROUP BY id),
cw AS (SELECT id, md5(unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))) AS h FROM c),
cs AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {0} AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM cw GROUP BY ALL HAVING v <> 0),
qw AS (SELECT query_id, md5(unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))) AS h FROM q),
qs AS (SELECT query_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {0} AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM qw GROUP BY ALL HAVING v <> 0),
cf AS (SELECT id, slot, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM cs),
qf AS (SELECT query_id, slot, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS v FROM qs),
cn AS (SELECT id, sqrt(sum(v * v)) AS n FROM cf GROUP BY id),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qf GROUP BY query_id),
d AS (SELECT query_id, id, sum(cf.v * qf.v) AS dot FROM cf JOIN qf ON cf.slot = qf.slot GROUP BY query_id, id),
s AS (SELECT qn.query_id, cn.id, round(coalesce(d.dot, 0) / (cn.n * qn.n), 6) + 0.0 AS score FROM qn CROSS JOIN cn LEFT JOIN d ON d.query_id = qn.query_id AND d.id = cn.id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s{1})"""


@query(
    "knowledge_base_retrieval",
    f"WITH q AS (SELECT id AS query_id, text FROM questions WHERE id % 100 = 0), {_HASHED.format(256, '')} SELECT query_id, CAST(position AS BIGINT) AS position, id, round(score, 4) AS score FROM p WHERE position <= 5",
)
def knowledge_base_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks embedded into a collection, asked with every hundredth question."""
    base = Collection(spark, dimensions=256)
    chunks = table(spark, sf_dir, "chunks").where("content.text is not null").select("id", "doc_id", "chunk_id", "content")
    base.add(chunks, hashing_embedder(256))
    asked = table(spark, sf_dir, "questions").where("id % 100 = 0").select(F.col("id").alias("query_id"), "text")
    hits = base.retrieve(asked, hashing_embedder(256), limit=5)
    return hits.select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("score", 4).alias("score"))


_COLLECTION = """b AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
r AS (SELECT id, CASE WHEN label = 3 THEN list_transform(v, lambda x: -x) ELSE v END AS v, CASE WHEN label = 3 THEN 'turned ' ELSE 'row ' END || id AS text FROM b WHERE label <> 5)"""


def _turned(spark: SparkSession, sf_dir: str) -> Collection:
    """A collection of all vectors, upserted, those of one label upserted again turned round, those of another deleted."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").withColumn("id", F.col("vec_id").cast("string"))
    one = lambda text, vector: (F.col("id"), F.col("label").cast("string").alias("doc_id"), F.lit(0).alias("chunk_id"), F.concat(F.lit(text), "id").alias("text"), vector.alias("vector"))
    base = Collection(spark, dimensions=64)
    base.upsert(e.select(*one("row ", F.col("embedding"))))
    base.upsert(e.where("label = 3").select(*one("turned ", F.transform("embedding", lambda x: -x))))
    base.delete(e.where("label = 5").select("id"))
    return base


@query("collection_upsert", f"WITH {_COLLECTION} SELECT id, text, round(v[1], 6) AS first, CAST(len(v) AS BIGINT) AS dimensions FROM r")
def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection holds after upserts and a deletion."""
    return _turned(spark, sf_dir).read().select("id", "text", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.size("vector").cast("long").alias("dimensions"))


@query("collection_compacted", f"WITH {_COLLECTION} SELECT id, text FROM r")
def collection_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after compaction."""
    base = _turned(spark, sf_dir)
    base.compact()
    return base.read().select("id", "text")


@query(
    "collection_retrieve",
    f"""WITH {_COLLECTION}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, r.id, r.text, round(list_cosine_similarity(q.v, r.v), 6) + 0.0 AS score FROM q, r)
SELECT query_id, CAST(position AS BIGINT) AS position, id, score, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s WHERE score >= 0.1) WHERE position <= 10""",
)
def collection_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of that collection for every hundredth vector."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _turned(spark, sf_dir).nearest(asked, 10, 0.1).withColumn("position", F.col("position").cast("long"))


@query("ann_recall", "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do inverted lists find at least nine tenths of what the exact search finds?"""
    queries, corpus = _vectors(spark, sf_dir)
    share = R.recall(stored(R.search_lists(queries, corpus, k=10)), queries, corpus, k=10, asked=R.BLOCK)
    return queries.agg(F.count("*").alias("n_queries")).withColumn("enough", F.lit(share >= 0.9))


_BEST = """f AS (SELECT query_id, position, c.text FROM p JOIN c ON c.id = p.id WHERE position <= 3),
a AS (SELECT query_id, count(*) AS n_results, max(text) FILTER (position = 1) AS best FROM f GROUP BY query_id)
SELECT q.category, q.query_id AS id, coalesce(n_results, 0) AS n_results, coalesce(best, 'No passage was found.') AS answer FROM q LEFT JOIN a ON a.query_id = q.query_id"""
_ASKED = "q AS (SELECT id AS query_id, category, text FROM questions)"


@query("qa_batch_extractive", f"WITH {_ASKED}, {_HASHED.format(128, ' WHERE score >= 0.05')}, {_BEST}")
def qa_batch_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered with its best passage."""
    return _answered_from_chunks(spark, sf_dir, score_threshold=0.05)


@query(
    "qa_batch_relaxed",
    f"""WITH {_ASKED}, {_HASHED.format(128, '')},
m AS (SELECT query_id, max(score) AS top FROM s GROUP BY query_id),
l AS (SELECT query_id, CASE WHEN top >= 0.5 THEN 0.5 WHEN top >= 0.35 THEN 0.35 WHEN top >= 0.2 THEN 0.2 ELSE 9 END AS least FROM m),
f AS (SELECT p.query_id, position, c.text FROM p JOIN l ON l.query_id = p.query_id JOIN c ON c.id = p.id WHERE position <= 3 AND score >= least),
a AS (SELECT query_id, count(*) AS n_results, max(text) FILTER (position = 1) AS best FROM f GROUP BY query_id)
SELECT q.category, q.query_id AS id, coalesce(n_results, 0) AS n_results, coalesce(best, 'No passage was found.') AS answer FROM q LEFT JOIN a ON a.query_id = q.query_id""",
)
def qa_batch_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered from the passages at the highest threshold that gives it any."""
    return _answered_from_chunks(spark, sf_dir, thresholds=(0.5, 0.35, 0.2))


def _answered_from_chunks(spark: SparkSession, sf_dir: str, **how) -> DataFrame:  # type: ignore[no-untyped-def]
    base = Collection(spark, dimensions=128)
    chunks = table(spark, sf_dir, "chunks").where("content.text is not null").select("id", "doc_id", "chunk_id", "content")
    base.add(chunks, hashing_embedder(128))
    questions = table(spark, sf_dir, "questions").select("category", "q_pos", "id", "text")
    out = answer_batch(questions, base, hashing_embedder(128), limit=3, **how)
    return out.select("category", "id", F.size("result").cast("long").alias("n_results"), "answer")


@query("qa_batch_errors", "SELECT category, id, 0::BIGINT AS n_results, CASE WHEN length(text) % 7 = 0 THEN 'Error: cannot answer ' || length(text) ELSE 'No passage was found.' END AS answer FROM questions")
def qa_batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answerer that fails on some questions: its message is the answer, and records have no passages."""

    def answerer(query: str, passages: list[str]) -> str:
        if len(query) % 7 == 0:
            raise ValueError(f"cannot answer {len(query)}")
        return first_passage(query, passages)

    questions = table(spark, sf_dir, "questions").select("category", "q_pos", "id", "text")
    nothing = F.array().cast("array<struct<position:int,content:string>>")
    out = A.records(questions, answer(questions.withColumn("result", nothing), answerer).drop("error"))
    return out.select("category", "id", F.size("result").cast("long").alias("n_results"), "answer")


@query(
    "store_upsert",
    """WITH r AS (SELECT id, doc_id, chunk_id, content.text AS text, loaded_at, source_path FROM chunks WHERE id IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, doc_id DESC NULLS LAST, chunk_id DESC NULLS LAST, text DESC NULLS LAST, source_path DESC NULLS LAST) AS k FROM r)
SELECT id, doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, text, source_path FROM l WHERE k = 1""",
)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each chunk that was loaded last."""
    rows = table(spark, sf_dir, "chunks").where("id is not null").select("id", "doc_id", "chunk_id", F.col("content.text").alias("text"), "source_path", "loaded_at")
    return A.latest(rows, ("id",), "loaded_at").select("id", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", "source_path")


@query(
    "store_merge",
    """WITH r AS (SELECT id, doc_id, content.text AS text, load_method FROM chunks WHERE id IS NOT NULL),
n AS (SELECT id, max(doc_id) AS doc_id, max(text) AS text, 'new' AS generation FROM r WHERE load_method = 'overlap' GROUP BY id),
o AS (SELECT id, max(doc_id) AS doc_id, max(text) AS text, 'old' AS generation FROM r GROUP BY id)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id)""",
)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation merged over another by chunk id."""
    rows = table(spark, sf_dir, "chunks").where("id is not null").select("id", "doc_id", F.col("content.text").alias("text"), "load_method")
    one = lambda d, g: d.groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text")).withColumn("generation", F.lit(g))
    return upserted(one(rows, "old"), one(rows.where("load_method = 'overlap'"), "new"))


# Questions and answers

_LATEST = "l AS (SELECT category, id, answer FROM (SELECT *, row_number() OVER (PARTITION BY category, id ORDER BY answered_at DESC NULLS LAST, answer DESC NULLS LAST, error DESC NULLS LAST) AS k FROM answers) WHERE k = 1)"
_ANSWERED = "j AS (SELECT q.category, q.q_pos, q.id, q.text AS query, CASE WHEN l.id IS NULL THEN '未回答' ELSE l.answer END AS answer FROM questions q LEFT JOIN l ON l.category = q.category AND l.id = q.id)"


def _latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(table(spark, sf_dir, "answers").select("category", "id", "answer", "error", "answered_at"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qa_records").where("result is not null").select("category", "id", F.explode("result").alias("r"))
    return rows.select("category", "id", "r.position", "r.content").distinct()


@query("md_parse", "SELECT CAST(id // 100 AS BIGINT) AS sheet_no, category, CAST(dense_rank() OVER (PARTITION BY id // 100 ORDER BY cat_pos) - 1 AS BIGINT) AS cat_pos, CAST(row_number() OVER (PARTITION BY id // 100, category ORDER BY q_pos, id) - 1 AS BIGINT) AS q_pos, id, " + _strip("text") + " AS text FROM questions")
def md_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question sheets of a hundred ids each, written from the questions and parsed again."""
    q = table(spark, sf_dir, "questions").withColumn("sheet_no", F.expr("id div 100"))
    parsed = Q.parse(Q.sheet(q, "sheet_no"), key="sheet_no")
    return parsed.select("sheet_no", "category", F.col("cat_pos").cast("long").alias("cat_pos"), F.col("q_pos").cast("long").alias("q_pos"), "id", "text")


@query(
    "md_repeated_category",
    "WITH q AS (SELECT id // 100 AS sheet_no, category, cat_pos, q_pos, id, "
    + _strip("text")
    + """ AS text FROM questions), k AS (SELECT DISTINCT sheet_no, category FROM q WHERE id % 2 = 0),
l AS (SELECT q.* FROM q LEFT JOIN k ON k.sheet_no = q.sheet_no AND k.category = q.category WHERE k.category IS NULL OR q.id % 2 = 0)
SELECT CAST(sheet_no AS BIGINT) AS sheet_no, category, CAST((SELECT count(DISTINCT o.cat_pos) FROM q o WHERE o.sheet_no = l.sheet_no AND o.cat_pos < l.cat_pos) AS BIGINT) AS cat_pos,
CAST(row_number() OVER (PARTITION BY sheet_no, category ORDER BY q_pos, id) - 1 AS BIGINT) AS q_pos, id, text FROM l""",
)
def md_repeated_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets in which categories come again with the questions of even ids: the later list stands, at the first one's place."""
    q = table(spark, sf_dir, "questions").withColumn("sheet_no", F.expr("id div 100"))
    again = Q.sheet(q.where("id % 2 = 0"), "sheet_no").select("sheet_no", F.col("text").alias("again"))
    sheets = Q.sheet(q, "sheet_no").join(again, "sheet_no", "left").withColumn("text", F.concat_ws("\n", "text", "again")).drop("again")
    parsed = Q.parse(sheets, key="sheet_no")
    return parsed.select("sheet_no", "category", F.col("cat_pos").cast("long").alias("cat_pos"), F.col("q_pos").cast("long").alias("q_pos"), "id", "text")


@query("question_summary", "SELECT c.category, count(q.id) AS n_questions FROM (SELECT category FROM questions UNION SELECT category FROM qa_records WHERE category IS NOT NULL) c LEFT JOIN questions q ON q.category = c.category GROUP BY c.category")
def question_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every category."""
    q = table(spark, sf_dir, "questions").select("category", "id")
    names = q.select("category").union(table(spark, sf_dir, "qa_records").where("category is not null").select("category"))
    return Q.summary(names, q)


@query(
    "summary_text",
    "WITH c AS (SELECT category, count(*) AS n FROM questions GROUP BY category) SELECT 'questions: ' || CAST(sum(n) AS BIGINT) || chr(10) || 'categories: ' || count(*) || chr(10) || string_agg('  ' || category || ': ' || n, chr(10) ORDER BY category) AS summary FROM c",
)
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the question sheet as text."""
    q = table(spark, sf_dir, "questions").select("category", "id")
    return Q.summary_text(Q.summary(q, q))


@query("qa_join", f"WITH {_LATEST}, {_ANSWERED} SELECT category, id, query, answer FROM j")
def qa_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its standing answer."""
    return A.answered(table(spark, sf_dir, "questions"), _latest_answers(spark, sf_dir)).select("category", "id", F.col("text").alias("query"), "answer")


@query("qa_unanswered", f"WITH {_LATEST}, {_ANSWERED} SELECT category, count(*) AS n_questions, count(*) FILTER (answer = '未回答') AS n_unanswered, count(*) FILTER (answer IS NULL) AS n_null FROM j GROUP BY category")
def qa_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without an answer, and with a null one, by category."""
    j = A.answered(table(spark, sf_dir, "questions"), _latest_answers(spark, sf_dir))
    return j.groupBy("category").agg(F.count("*").alias("n_questions"), F.count_if(F.col("answer") == A.UNANSWERED).alias("n_unanswered"), F.count_if(F.col("answer").isNull()).alias("n_null"))


_RESULTS = "r AS (SELECT category, id, count(*) AS n_results, '[' || string_agg('{\"position\": ' || position || ', \"content\": ' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}', ', ' ORDER BY position, content NULLS FIRST) || ']' AS result FROM (SELECT DISTINCT category, id, u.position AS position, u.content AS content FROM (SELECT category, id, unnest(result) AS u FROM qa_records)) GROUP BY category, id)"


@query("qa_retrieval", f"WITH {_RESULTS} SELECT q.category, q.id, coalesce(r.n_results, 0) AS n_results, coalesce(r.result, '[]') AS result FROM questions q LEFT JOIN r ON r.category = q.category AND r.id = q.id")
def qa_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its retrieved passages."""
    rows = A.with_results(table(spark, sf_dir, "questions"), _retrieved(spark, sf_dir))
    return rows.select("category", "id", F.size("result").cast("long").alias("n_results"), A.result_json(F.col("result")).alias("result"))


_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE CAST(to_json({0}) AS VARCHAR) END"
_RECORDS = f"WITH {_LATEST}, {_ANSWERED}, {_RESULTS}, x AS (SELECT j.*, coalesce(r.result, '[]') AS result FROM j LEFT JOIN r ON r.category = j.category AND r.id = j.id)"


@query("qa_json_lines", f"{_RECORDS} SELECT category, id, '{{\"query\": ' || {_JSON.format('query')} || ', \"result\": ' || result || ', \"answer\": ' || {_JSON.format('answer')} || '}}' AS line FROM x")
def qa_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as one JSON object a line."""
    r = A.records(table(spark, sf_dir, "questions"), _latest_answers(spark, sf_dir), _retrieved(spark, sf_dir))
    return r.select("category", "id", A.one_line(F.col("query"), F.col("result"), F.col("answer")).alias("line"))


@query(
    "qa_json_three",
    f"""{_RECORDS} SELECT category, id, CAST(part AS BIGINT) AS part, line FROM (
SELECT category, id, 0 AS part, '{{"query": ' || {_JSON.format("query")} || '}}' AS line FROM x UNION ALL
SELECT category, id, 1, '{{"result": ' || result || '}}' FROM x UNION ALL
SELECT category, id, 2, '{{"answer": ' || {_JSON.format("answer")} || '}}' FROM x)""",
)
def qa_json_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as three JSON objects."""
    r = A.records(table(spark, sf_dir, "questions"), _latest_answers(spark, sf_dir), _retrieved(spark, sf_dir))
    lines = A.three_lines(F.col("query"), F.col("result"), F.col("answer"))
    return r.select("category", "id", F.posexplode(lines).alias("part", "line")).withColumn("part", F.col("part").cast("long"))


@query("qa_record_order", f"WITH {_LATEST}, {_ANSWERED} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY q_pos, id) AS BIGINT) AS place, id, answer FROM j")
def qa_record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record in its category."""
    r = A.records(table(spark, sf_dir, "questions"), _latest_answers(spark, sf_dir))
    return O.positions(r, ("q_pos", "id"), "at", ("category",)).select("category", (F.col("at") + 1).alias("place"), "id", "answer")


@query(
    "last_write_wins",
    "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1",
)
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return A.latest(e, ("user_id", "event_type"), "ts", ("event_id",))


# Streaming


@query("stream_chunk_ingest", f"{_chunks(_char(1024, 200))} SELECT DISTINCT doc_id || '-' || chunk_id AS id, doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, chunk_text FROM e")
def stream_chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream, chunked, and kept once a chunk id."""
    documents = table(spark, sf_dir, "documents")
    root = work_dir(spark)
    # A stream watches a folder; a table that is one file is watched through its folder and its name.
    path, name = f"{sf_dir}/documents.parquet", "*.parquet"
    if os.path.isfile(path):
        path, name = sf_dir, "documents.parquet"
    stream = spark.readStream.schema(documents.schema).option("pathGlobFilter", name).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        chunks = chunk_stream(batch.select("text"))
        rows = chunks.select("id", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("content.text").alias("chunk_text"))
        stored(rows.dropDuplicates(["id"]), f"{root}/chunks/batch={number}")

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/chunks").drop("batch").dropDuplicates(["id"])


@query("stream_collection", f"{_chunks(_char(1024, 200), _FOLDER)} SELECT DISTINCT doc_id || '-' || chunk_id AS id, doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, chunk_text FROM e")
def stream_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files ingested as a stream into a collection, in micro-batches."""
    folder, base = _folder(spark, sf_dir, broken=False), Collection(spark, dimensions=8)
    ingest(spark, folder, base, hashing_embedder(8), work_dir(spark)).awaitTermination()
    return base.read().select("id", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text").alias("chunk_text"))
