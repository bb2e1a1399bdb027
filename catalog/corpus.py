"""Corpus ingestion: sources, pages, quality, chunking, whole ingest."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import CHUNKS, PAGES, chunks, pages, table, texts
from catalog.scalars import _SQL_SIGNAL
from corpuscle.config import Settings, scratch_path
from corpuscle.functions.text import clean_text
from corpuscle.operators import chunking as ch
from corpuscle.operators import quality as ql
from corpuscle.plans.ingest import chunk_pages, ingest
from corpuscle.sources import readers, uploads, writers

CHUNKING = Settings(chunk_size=400, chunk_overlap=80, min_words_per_page=20, embedding_dimensions=16)


@query("scan_live_chunks", f"WITH {CHUNKS} SELECT id, original_file_id, n_chars FROM live")
def scan_live_chunks(spark, d):
    path = scratch_path(spark, "chunk-table")
    writers.write_chunks(chunks(spark, d, vectors=True), path)
    rows = readers.scan_chunks(spark, path)
    return rows.select(F.col("id").cast("bigint").alias("id"), "original_file_id", F.col("n_chars").cast("bigint").alias("n_chars"))


@query("scan_files")
def scan_files(spark, d):
    files = readers.with_object_path(readers.scan_files(spark, d, "*.parquet"))
    return files.select("original_file_name", "length", "original_file_id", "storage_path")


@query("split_pages", f"WITH {PAGES} SELECT file_id, source, page, text FROM page_rows")
def split_pages(spark, d):
    return pages(spark, d)


@query("scan_pages", f"WITH {PAGES} SELECT file_id::VARCHAR AS file_id, source, page, text FROM page_rows")
def scan_pages(spark, d):
    """Pages written as files and scanned."""
    path = scratch_path(spark, "pages")
    rows = pages(spark, d)
    rows.select(F.col("file_id").cast("string").alias("file_id"), "source", F.col("page").cast("int").alias("page"), "text").write.parquet(path)
    return readers.scan_pages(spark, path)


@query("first_appearance", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def first_appearance(spark, d):
    from corpuscle.operators.ordering import first_appearance as apply

    return apply(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@query("admit_uploads", """SELECT doc_id, CASE WHEN lang = 'de' THEN 'extension not allowed' WHEN lang = 'es' THEN 'content does not match' END AS reason,
      lang IN ('en', 'fr') AS admitted, CASE WHEN lang IN ('en', 'fr', 'de') THEN 'application/pdf' END AS detected_type FROM documents""")
def admit_uploads(spark, d):
    docs = table(spark, d, "documents")
    ext = F.when(F.col("lang") == "fr", ".PDF").when(F.col("lang") == "de", ".txt").otherwise(".pdf")
    files = docs.select(
        "doc_id",
        F.concat("source", ext).alias("original_file_name"),
        F.encode(F.concat(F.when(F.col("lang") == "es", "").otherwise("%PDF-"), "text"), "UTF-8").alias("content"),
    )
    return uploads.admit_uploads(files, "document").select("doc_id", "reason", "admitted", "detected_type")


@query("write_chunks_from_metadata", """SELECT doc_id AS id, source AS original_file_id, source || '.txt' AS original_file_name,
      n_chars % 100 AS page, doc_id AS chunk_index FROM documents""")
def write_chunks_from_metadata(spark, d):
    """Rows that carry everything in their metadata, written and read back."""
    meta = F.to_json(
        F.struct(
            F.col("source").alias("original_file_id"), F.concat("source", F.lit(".txt")).alias("original_file_name"),
            (F.col("n_chars") % 100).alias("page"), F.col("doc_id").alias("chunk_index"),
        )
    )
    path = scratch_path(spark, "chunk-table")
    writers.write_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), meta.alias("metadata")), path)
    rows = readers.scan_chunks(spark, path, live_only=False)
    return rows.select(F.col("id").cast("bigint").alias("id"), "original_file_id", "original_file_name", "page", "chunk_index")


# --- quality ---------------------------------------------------------------------------------

QUALITY = f"""{PAGES},
page_words AS (SELECT file_id, page, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM page_rows),
page_q AS (SELECT file_id, page, text, len(ws) AS words,
  CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: regexp_matches(w, '^\\d+([.,]\\d+)?$')))::DOUBLE / len(ws) END AS ratio FROM page_words),
page_s AS (SELECT *, (words < 20 OR ratio > 0.05) AS sparse FROM page_q)"""


@query("page_quality", f"WITH {QUALITY} SELECT file_id, page, words, round(ratio, 6) AS isolated_number_ratio, sparse FROM page_s")
def page_quality(spark, d):
    out = ql.page_quality(pages(spark, d), CHUNKING)
    return out.select("file_id", "page", "words", F.round("isolated_number_ratio", 6).alias("isolated_number_ratio"), "sparse")


@query("assess_extraction", f"""WITH {QUALITY}, a AS (SELECT file_id, count(*) AS pages, sum(words) AS total_words, avg(words) AS mw, avg(ratio) AS mr,
      count(*) FILTER (sparse) AS sparse_pages FROM page_s GROUP BY file_id)
    SELECT file_id, pages, total_words::BIGINT AS total_words, sparse_pages, sparse_pages::DOUBLE / pages <= 0.5 AS adequate,
      (CASE WHEN sparse_pages::DOUBLE / pages <= 0.5 THEN 'extração adequada' ELSE sparse_pages || ' de ' || pages || ' páginas esparsas' END) AS reason FROM a""")
def assess_extraction(spark, d):
    out = ql.assess_extraction(pages(spark, d), CHUNKING)
    return out.select(
        "file_id", "pages", "total_words", "sparse_pages", "adequate", F.regexp_extract("reason", r"^[^(]*[^( ]", 0).alias("reason")
    )


@query("valid_documents", f"WITH {PAGES} SELECT file_id, count(*) AS pages, sum(length(text))::BIGINT AS total_chars FROM page_rows GROUP BY file_id HAVING sum(length(text)) > 50")
def valid_documents(spark, d):
    return ql.valid_documents(pages(spark, d))


def candidates(spark, d):
    """Two extractions per document: the pages of lines, and the text as one page."""
    first = pages(spark, d).select("file_id", F.lit("pypdf").alias("method"), "page", "text")
    second = texts(spark, d).select(
        F.col("doc_id").alias("file_id"), F.lit("pdfplumber").alias("method"), F.lit(0).alias("page"), "text"
    )
    return first.unionByName(second)


@query("pick_extraction", f"""WITH {QUALITY}, both_m AS (
      SELECT file_id, 1 AS place, sum(sparse::INT)::DOUBLE / count(*) <= 0.5 AS adequate, sum(length(text)) + count(*) - 1 AS chars,
        sum(length(text) - length(replace(text, '?', ''))) AS marks, count(*) AS pages FROM page_s GROUP BY file_id
      UNION ALL
      SELECT doc_id, 2, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 20
          AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\d+([.,]\\d+)?$')))::DOUBLE
            / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) <= 0.05,
        length(text), length(text) - length(replace(text, '?', '')), 1 FROM documents),
    r AS (SELECT *, adequate AND NOT (chars < 50 OR marks::DOUBLE / chars > 0.04) AS ok FROM both_m)
    SELECT file_id, CASE min_by(place, place + CASE WHEN ok THEN 0 ELSE 5 END) WHEN 1 THEN 'pypdf' ELSE 'pdfplumber' END AS method,
      min_by(pages, place + CASE WHEN ok THEN 0 ELSE 5 END) AS pages, bool_or(ok) AS accepted FROM r GROUP BY file_id""")
def pick_extraction(spark, d):
    return ql.pick_extraction(candidates(spark, d), settings=CHUNKING).select("file_id", "method", "pages", "accepted")


@query("cleaning_stats", r"""WITH l AS (SELECT doc_id AS file_id, line, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
        SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || '3/7' || chr(10) || 'Copyright '), chr(10)) AS ls FROM documents))),
    k AS (SELECT *, s = '' AS blank, regexp_matches(s, '^\d+/\d+$') AS num, s <> '' AND regexp_matches(lower(s), '^(©|copyright|all rights reserved)') AS legal FROM l),
    e AS (SELECT file_id, string_agg('Copyright: ' || left(s, 60), '|' ORDER BY i) AS examples FROM (
      SELECT * FROM k WHERE legal QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) <= 3) GROUP BY file_id)
    SELECT file_id, count(*) AS total_lines, count(*) FILTER (NOT blank AND NOT num AND NOT legal) AS lines_kept,
      count(*) FILTER (blank OR num OR legal) AS lines_removed, count(*) FILTER (num) AS removed_page_numbers,
      count(*) FILTER (legal) AS removed_copyright, coalesce(any_value(examples), '') AS examples
    FROM k LEFT JOIN e USING (file_id) GROUP BY file_id""")
def cleaning_stats(spark, d):
    """Documents with a page number and a legal mark put after each sentence."""
    text = F.replace("text", F.lit(". "), F.lit(".\n3/7\nCopyright "))
    docs = texts(spark, d).select(F.col("doc_id").alias("file_id"), F.lit(0).alias("page"), text.alias("text"))
    out = ql.cleaning_stats(docs)
    return out.withColumn("examples", F.array_join("examples_removed", "|")).drop("examples_removed")


# --- offsets and chunks ----------------------------------------------------------------------

OFFSETS = f"""{PAGES},
offsets AS (SELECT file_id, page, length(text) AS n_chars,
  coalesce(sum(length(text) + 2) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM page_rows)"""


@query("page_offsets", f"WITH {OFFSETS} SELECT file_id, page, s::BIGINT AS page_start_offset, (s + n_chars)::BIGINT AS page_end_offset FROM offsets")
def page_offsets(spark, d):
    return ch.page_offsets(pages(spark, d)).select("file_id", "page", "page_start_offset", "page_end_offset")


@query("file_offsets", """SELECT doc_id, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_start_offset FROM documents""")
def file_offsets(spark, d):
    """Whole sources as files, their documents as pages: few, large files."""
    docs = table(spark, d, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), "text")
    return ch.page_offsets(docs).select(F.col("page").alias("doc_id"), "page_start_offset")


FIXED = """fixed AS (SELECT file_id, start_index, substr(full_text, start_index + 1, 300) AS content FROM (
    SELECT file_id, full_text, unnest(generate_series(0, greatest(length(full_text) - 51, 0) // 250)) * 250 AS start_index FROM whole))"""


@query("chunk_fixed", f"WITH whole AS (SELECT doc_id AS file_id, text AS full_text FROM documents WHERE text <> ''), {FIXED} SELECT file_id, start_index, content FROM fixed")
def chunk_fixed(spark, d):
    docs = texts(spark, d).select(F.col("doc_id").alias("file_id"), "text")
    return ch.chunk_fixed(docs, 300, 50)


ASSIGNED = f"""{OFFSETS},
whole AS (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS full_text FROM page_rows GROUP BY file_id), {FIXED},
sized AS (SELECT f.*, length(content) AS n, length(w.full_text) AS total FROM fixed f JOIN whole w USING (file_id)),
points AS (SELECT *, least(start_index, greatest(total - 1, 0)) AS a, least(greatest(start_index, start_index + n - 1), greatest(total - 1, 0)) AS b FROM sized)"""


@query("assign_pages", f"""WITH {ASSIGNED}
    SELECT p.file_id, p.start_index, p.n AS n_chars,
      min_by(o.page, o.page) FILTER (p.a < o.s + o.n_chars) AS page_start, min(o.page) FILTER (p.b < o.s + o.n_chars) AS page_end
    FROM points p JOIN offsets o USING (file_id) GROUP BY p.file_id, p.start_index, p.n""")
def assign_pages(spark, d):
    """Fixed chunks over the joined pages, each with its pages."""
    rows = pages(spark, d)
    joined = rows.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text")
    )
    fixed = ch.chunk_fixed(joined, 300, 50).withColumn("n_chars", F.length("content"))
    return ch.assign_pages(fixed, ch.page_offsets(rows)).select("file_id", "start_index", "n_chars", "page_start", "page_end")


@query("filter_chunks", rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents
      UNION ALL SELECT doc_id + 1000000, 'Copyright ' || replace(lower(text), '.', '') FROM documents)
    SELECT doc_id FROM t WHERE length(s) >= 120 AND NOT ((regexp_matches(s, '^\s*\d+/\d+\s*$')
      OR regexp_matches(lower(s), '^(©|copyright|all rights reserved)')) AND NOT ({_SQL_SIGNAL}))""")
def filter_chunks(spark, d):
    """The documents, and again as legal notices that only a signal can save."""
    docs = texts(spark, d)
    legal = docs.select(
        (F.col("doc_id") + 1000000).alias("doc_id"),
        F.concat(F.lit("Copyright "), F.replace(F.lower("text"), F.lit("."), F.lit(""))).alias("content"),
    )
    rows = docs.select("doc_id", F.col("text").alias("content")).unionByName(legal)
    return ch.filter_chunks(rows).select("doc_id")


@query("number_chunks", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 1000) - 1 AS chunk_index FROM documents")
def number_chunks(spark, d):
    rows = table(spark, d, "documents").withColumn("start_index", F.col("doc_id") * 1000)
    return ch.number_chunks(rows, "source").select("doc_id", "source", "chunk_index")


@query("chunk_documents")
def chunk_documents(spark, d):
    return ch.chunk_documents(pages(spark, d, 40)).select("file_id", "start_index", "n_chars", "content")


@query("chunk_documents_total", f"""WITH {PAGES} SELECT file_id,
      regexp_replace(string_agg(text, '' ORDER BY page), '\\s', '', 'g') AS body FROM page_rows GROUP BY file_id HAVING body <> ''""")
def chunk_documents_total(spark, d):
    """Without overlap the chunks of a file, in order, are its whole text (white space aside)."""
    rows = ch.chunk_documents(pages(spark, d), 400, 0)
    ordered = F.array_sort(F.collect_list(F.struct("start_index", "content")))
    whole = rows.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda r: r["content"]), "").alias("body"))
    return whole.select("file_id", F.regexp_replace("body", r"(?U)\s", "").alias("body"))


@query("chunk_documents_in_place", f"""WITH {PAGES}, w AS (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS t FROM page_rows GROUP BY file_id)
    SELECT file_id, true AS in_place, true AS in_size FROM w WHERE regexp_matches(t, '\\S')""")
def chunk_documents_in_place(spark, d):
    """Every chunk is found at its start index and is no longer than the size."""
    rows = pages(spark, d)
    whole = rows.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("t")
    )
    pieces = ch.chunk_documents(rows, 400, 80).join(whole, "file_id")
    same = F.substring(F.col("t"), (F.col("start_index") + 1).cast("int"), F.col("n_chars")) == F.col("content")
    return pieces.groupBy("file_id").agg(F.bool_and(same).alias("in_place"), F.bool_and(F.col("n_chars") <= 400).alias("in_size"))


# --- ingest ----------------------------------------------------------------------------------


def embedder():
    """A stand-in model (counts of words by hash), as a closure that travels by value."""

    def embed(texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * 16
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % 16] += 1.0
            out.append(v)
        return out

    return embed


def run_ingest(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.concat("source", F.lit(".txt")).alias("file_name"))
    old = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("original_file_id"))
    rows = candidates(spark, d).withColumn("file_id", F.col("file_id").cast("string"))
    return ingest(rows, files, old, embedder(), CHUNKING)


@query("ingest_report", f"""WITH {QUALITY}, m AS (
      SELECT file_id, sum(sparse::INT)::DOUBLE / count(*) <= 0.5 AND sum(length(text)) + count(*) - 1 >= 50 AS ok FROM page_s GROUP BY file_id),
    n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 20 AND length(text) >= 50 AS ok FROM documents)
    SELECT d.doc_id::VARCHAR AS file_id, CASE WHEN l.toxic = 1 THEN 'already_exists' WHEN m.ok OR n.ok THEN 'success' ELSE 'extraction_failed' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id) JOIN m ON m.file_id = d.doc_id JOIN n ON n.doc_id = d.doc_id""")
def ingest_report(spark, d):
    return run_ingest(spark, d).report.select("file_id", "status")


@query("ingest_chunks")
def ingest_chunks(spark, d):
    rows = run_ingest(spark, d).chunks
    return rows.select("id", "original_file_id", "chunk_index", "start_index", "page_start", "page_end", "n_chars", F.size("embedding").alias("dims"))


@query("ingest_chunk_pages", f"""WITH {PAGES}, c AS (SELECT file_id, page, array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')
        AND NOT regexp_matches(l, '^\\s*\\d+/\\d+\\s*$') AND NOT regexp_matches(lower(l), '^\\s*(©|copyright|all rights reserved)')), chr(10)) AS t FROM page_rows)
    SELECT file_id, count(*) FILTER (regexp_matches(t, '\\S')) AS pages, regexp_replace(string_agg(t, '' ORDER BY page), '\\s', '', 'g') AS body
    FROM c GROUP BY file_id HAVING count(*) FILTER (regexp_matches(t, '\\S')) > 0""")
def ingest_chunk_pages(spark, d):
    """Cleaned, chunked and paged: the chunks' pages cover all pages that hold text."""
    plain = dataclasses.replace(CHUNKING, chunk_overlap=0)
    rows = chunk_pages(pages(spark, d), plain)
    covered = rows.select("file_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    full = pages(spark, d).filter(F.regexp_like(clean_text("text"), F.lit(r"\S"))).select("file_id", "page")
    n = covered.join(full, ["file_id", "page"], "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"))
    ordered = F.array_sort(F.collect_list(F.struct("start_index", "content")))
    whole = rows.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda r: r["content"]), "").alias("body"))
    return n.join(whole.select("file_id", F.regexp_replace("body", r"(?U)\s", "").alias("body")), "file_id")


@query("with_embeddings")
def with_embeddings(spark, d):
    from corpuscle.plans.models import with_embeddings as apply

    rows = apply(table(spark, d, "documents").select("doc_id", "text"), embedder(), "text", "vec")
    return rows.select("doc_id", F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"))
