"""Registered queries on training text, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import copies as p1
from lexigrove.llm import language as p4
from lexigrove.llm import lines as p5
from lexigrove.llm import mixture as p7
from lexigrove.llm import near as p3
from lexigrove.llm import spans as p8
from lexigrove.llm import tokenizer as p6
from lexigrove.session import table


def _p1_sets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files, metadata = table(spark, sf_dir, "json_files"), table(spark, sf_dir, "document_metadata")
    return {
        "json_files": p1.assign_representatives(files, "file_id", p1.file_key("raw_json")),
        "document_metadata": p1.assign_representatives(metadata, "doc_id", p1.metadata_key("title", "doc_length")),
    }


def _named(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    files, metadata = (df.select(F.lit(name).alias("table_name"), *columns) for name, df in parts.items())
    return files.unionByName(metadata)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the record that is kept."""
    return _named({k: p1.copies(v) for k, v in _p1_sets(spark, sf_dir).items()}, "keep_id", "copy_id")


def _collapsed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    sets = _p1_sets(spark, sf_dir)
    return {name: p1.collapse(sets[name], table(spark, sf_dir, name), key) for name, key in (("json_files", "file_id"), ("document_metadata", "doc_id"))}


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set of copies with the number of its copies; records without a key are kept one by one."""
    return _named(_collapsed(spark, sf_dir), "keep_id", "n_copies")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept records themselves, with the number of their copies."""
    found = _collapsed(spark, sf_dir)
    files = p1.records(found["json_files"], table(spark, sf_dir, "json_files"), "file_id", ["raw_json"])
    metadata = p1.records(found["document_metadata"], table(spark, sf_dir, "document_metadata"), "doc_id", ["title", "doc_length"])
    files = files.withColumns({"title": F.lit(None).cast("string"), "doc_length": F.lit(None).cast("long")})
    return _named({"json_files": files, "document_metadata": metadata.withColumn("raw_json", F.lit(None).cast("string"))}, "keep_id", "n_copies", "raw_json", "title", "doc_length")


def _near(spark: SparkSession, sf_dir: str) -> p3.NearDuplicates:
    return p3.NearDuplicates(table(spark, sf_dir, "json_documents", spread=True), "doc_id", ["title", "body"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of which at least 0.6 of the three-word runs are common."""
    return _near(spark, sf_dir).document_pairs()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near-duplicates and its number of near documents."""
    return _near(spark, sf_dir).groups()


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.identify(table(spark, sf_dir, "json_documents", spread=True), "doc_id", "body", "lang_label", table(spark, sf_dir, "language_samples"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents whose label is missing or wrong, or whose body changes its language."""
    return p4.wrong_labels(_languages(spark, sf_dir), "doc_id")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each document and of its segments."""
    return p4.document_languages(_languages(spark, sf_dir), "doc_id")


def _repeated(spark: SparkSession, sf_dir: str) -> p5.RepeatedLines:
    return p5.RepeatedLines(table(spark, sf_dir, "json_documents", spread=True), "doc_id", "site", "body")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are repeated across its site."""
    return _repeated(spark, sf_dir).found()


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of each site with their number of documents."""
    return _repeated(spark, sf_dir).by_site()


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body without its repeated lines."""
    return _repeated(spark, sf_dir).cleaned()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the byte-level vocabulary."""
    return p6.encode_texts(table(spark, sf_dir, "documents", spread=True), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of every text, and whether they decode to the text again."""
    documents = table(spark, sf_dir, "documents", spread=True).select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    ids = p6.encode_texts(documents, "doc_id", "original")
    again = p6.decode_ids(ids, "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("h"))
    return documents.select("doc_id", F.xxhash64("original").alias("h0")).join(again, "doc_id").select("doc_id", (F.col("h") == F.col("h0")).alias("same"))


def _mixture(spark: SparkSession, sf_dir: str) -> p7.Mixture:
    return p7.Mixture(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mixture_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy of a document in the mixture."""
    return _mixture(spark, sf_dir).rows()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, sf_dir).report()


def _mixture_of_characters(spark: SparkSession, sf_dir: str) -> p7.Mixture:
    return p7.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), size=F.char_length("text"))


def p7_mixture_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture when sizes are in characters, which SQL can count."""
    return _mixture_of_characters(spark, sf_dir).rows()


def p7_shares_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source when sizes are in characters."""
    return _mixture_of_characters(spark, sf_dir).report()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a run of at least 200 characters in common."""
    return p8.SharedSpans(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").document_pairs()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document's text that other documents share."""
    return p8.SharedSpans(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").shared_stretches()


def p8_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that different texts share, exact or with small changes inside, with their places in both texts."""
    return p8.SharedSpans(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").text_pairs()


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stands for each document's text in p8_aligned."""
    return p8.SharedSpans(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").classes()


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's text is shared with another; nothing for null and short texts."""
    documents = table(spark, sf_dir, "documents", spread=True).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    shared = p8.SharedSpans(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").shared_extent().select("doc_id", "n_shared")
    return documents.join(shared, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


LLM_QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p1_records": p1_records,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p5_found": p5_found,
    "p5_lines": p5_lines,
    "p5_cleaned": p5_cleaned,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_mixture_chars": p7_mixture_chars,
    "p7_shares_chars": p7_shares_chars,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_aligned": p8_aligned,
    "p8_texts": p8_texts,
    "p8_shared": p8_shared,
}

_SETS = r"""
    WITH files AS (
        SELECT DISTINCT 'json_files' AS table_name, file_id AS id,
               regexp_replace(lower(coalesce(json_extract_string(raw_json, '$.title'), '')), '[^\p{L}\p{N}]+', '', 'g') AS a,
               regexp_replace(lower(coalesce(json_extract_string(raw_json, '$.body'), '')), '[^\p{L}\p{N}]+', '', 'g') AS b
        FROM (SELECT file_id, CASE WHEN json_valid(raw_json) THEN raw_json END AS raw_json FROM json_files) WHERE raw_json IS NOT NULL),
    metadata AS (
        SELECT DISTINCT 'document_metadata' AS table_name, doc_id AS id,
               regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g') AS a, CAST(doc_length AS VARCHAR) AS b
        FROM document_metadata WHERE title IS NOT NULL AND doc_length IS NOT NULL),
    keyed AS (SELECT * FROM files WHERE a || b <> '' UNION ALL SELECT * FROM metadata WHERE a <> ''),
    sets AS (SELECT table_name, id, min(id) OVER (PARTITION BY table_name, a, b) AS keep_id FROM keyed)
"""

_COLLAPSED = """, ids AS (SELECT DISTINCT 'json_files' AS table_name, file_id AS id FROM json_files UNION ALL SELECT DISTINCT 'document_metadata', doc_id FROM document_metadata),
    collapsed AS (SELECT table_name, keep_id, count(*) AS n_copies FROM sets GROUP BY table_name, keep_id
        UNION ALL SELECT table_name, id, 1 FROM ids ANTI JOIN sets USING (table_name, id) WHERE id IS NOT NULL)
"""

_WHITE = r"[\t\n\x0B\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_LINES = rf"""
    WITH docs AS (SELECT DISTINCT doc_id, site, body FROM json_documents WHERE doc_id IS NOT NULL AND site IS NOT NULL),
    split AS (SELECT doc_id, site, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no FROM docs),
    lines AS (SELECT doc_id, site, line_no, lower(trim(regexp_replace(line, '{_WHITE}+', ' ', 'g'))) AS line FROM split),
    counted AS (SELECT site, line, count(DISTINCT doc_id) AS n_docs FROM lines WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]') GROUP BY site, line),
    sites AS (SELECT site, count(DISTINCT doc_id) AS n FROM docs GROUP BY site),
    excessive AS (SELECT site, line, n_docs FROM counted JOIN sites USING (site) WHERE n_docs >= 5 AND n_docs * 10 >= n)
"""

_NEAR = r"""
    WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\p{L}\p{N}]+') AS w FROM json_documents),
    grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM docs),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    near AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE c * 5 >= (s.n + t.n - c) * 3)
"""

_SPANS = """
    WITH long AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
    cut AS (SELECT DISTINCT doc_id, substr(text, i, 200) AS w FROM long)
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM cut a JOIN cut b USING (w) WHERE a.doc_id < b.doc_id
"""

_STRETCHES = """
    WITH long AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
    cut AS (SELECT doc_id, i, substr(text, i, 200) AS w FROM long),
    common AS (SELECT w FROM cut GROUP BY w HAVING min(doc_id) <> max(doc_id)),
    hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM cut SEMI JOIN common USING (w)),
    numbered AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM hits),
    stretches AS (SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS "begin", CAST(max(i) + 199 AS INTEGER) AS "end" FROM numbered GROUP BY doc_id, no)
"""

_MIXTURE = rf"""
    WITH docs AS (SELECT doc_id, nullif(lower(regexp_replace(source, '^{_WHITE}+|{_WHITE}+$', '', 'g')), '') AS source, coalesce(length(text), 0) AS n_tokens FROM documents),
    wanted AS (SELECT nullif(lower(regexp_replace(source, '^{_WHITE}+|{_WHITE}+$', '', 'g')), '') AS source, target_share, max_repeats FROM mixture_targets),
    there AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_docs FROM docs GROUP BY source),
    plan AS (SELECT w.source, target_share, max_repeats, coalesce(tokens, 0) AS tokens, coalesce(n_docs, 0) AS n_docs FROM wanted w LEFT JOIN there t ON t.source = w.source WHERE w.source IS NOT NULL),
    total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM plan WHERE target_share > 0),
    rates AS (SELECT plan.*, CASE WHEN tokens > 0 THEN least(CAST(max_repeats AS DOUBLE), target_share * t / tokens) ELSE 0.0 END AS rate FROM plan, total),
    drawn AS (SELECT doc_id, d.source, n_tokens, rate, CAST('0x' || substr(md5('20240:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM docs d JOIN rates r ON r.source = d.source WHERE n_tokens > 0 AND rate > 0),
    used AS (SELECT doc_id, source, n_tokens, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn)
"""

LLM_SQL = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_mixture_chars": _MIXTURE + "SELECT doc_id, source, n_tokens, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM used WHERE copies > 0",
    "p7_shares_chars": _MIXTURE
    + """, reached AS (SELECT source, CAST(sum(n_tokens * copies) AS BIGINT) AS mixed_tokens, max(copies) AS most_copies FROM used WHERE copies > 0 GROUP BY source)
        SELECT r.source, target_share, max_repeats, n_docs, tokens, round(rate, 9) AS rate, coalesce(mixed_tokens, 0) AS mixed_tokens, coalesce(most_copies, 0) AS most_copies,
               round(coalesce(mixed_tokens, 0) / (SELECT sum(mixed_tokens) FROM reached)::DOUBLE, 9) AS share FROM rates r LEFT JOIN reached USING (source)""",
    "p8_found": _SPANS,
    "p8_passages": _STRETCHES + 'SELECT doc_id, "begin", "end" FROM stretches',
    "p8_shared": _STRETCHES + """SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shared
        FROM documents d LEFT JOIN (SELECT doc_id, sum("end" - "begin") AS n FROM stretches GROUP BY doc_id) s USING (doc_id)""",
    "p5_cleaned": _LINES
    + """, marked AS (
            SELECT DISTINCT l.doc_id, l.site, d.body, l.line_no, e.line IS NOT NULL AS gone, string_split(d.body, chr(10))[l.line_no] AS raw
            FROM lines l LEFT JOIN excessive e USING (site, line) JOIN docs d USING (doc_id, site)),
        kept AS (SELECT doc_id, site, body, string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone) AS less FROM marked GROUP BY doc_id, site, body)
        SELECT DISTINCT j.doc_id, j.site, CASE WHEN j.site IS NULL OR j.body IS NULL THEN j.body ELSE coalesce(k.less, '') END AS body
        FROM json_documents j LEFT JOIN kept k USING (doc_id, site, body)""",
    "p3_found": _NEAR + "SELECT x AS doc_id_a, y AS doc_id_b FROM near",
    "p3_groups": _NEAR
    + """, links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
        reached AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
        counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT r.x AS doc_id, min(r.y) AS group_id, coalesce(max(n), 0) AS n_links FROM reached r LEFT JOIN counted c ON c.x = r.x GROUP BY r.x""",
    "p5_found": _LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN excessive USING (site, line)",
    "p5_lines": _LINES + "SELECT site, line, n_docs FROM excessive",
    "p1_found": _SETS + "SELECT table_name, keep_id, id AS copy_id FROM sets WHERE id <> keep_id",
    "p1_collapsed": _SETS + _COLLAPSED + "SELECT table_name, keep_id, n_copies FROM collapsed",
    "p1_records": _SETS
    + _COLLAPSED
    + """, files_kept AS (SELECT file_id, min(raw_json) AS raw_json FROM json_files GROUP BY file_id), metadata_kept AS (SELECT doc_id, title, doc_length FROM document_metadata QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY title NULLS FIRST, doc_length NULLS FIRST) = 1)
        SELECT table_name, keep_id, n_copies, raw_json, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS doc_length FROM collapsed JOIN files_kept ON file_id = keep_id WHERE table_name = 'json_files'
        UNION ALL SELECT table_name, keep_id, n_copies, CAST(NULL AS VARCHAR), title, doc_length FROM collapsed JOIN metadata_kept ON doc_id = keep_id WHERE table_name = 'document_metadata'""",
}
