"""Queries over the ``documents`` table, one for each operator of indexing and search, and their SQL twins.

Searches read a written index, which the first of them builds for each table and
kind of terms; ``index_create`` always builds one.

Terms aren't stemmed in most of them; ``stem_terms`` and ``search_stemmed`` are checked by the stemmer's steps in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import analysis
from lexigrove.functions.stemmer import stem_terms
from lexigrove.operators import index as ix
from lexigrove.finder import PAGE, Finder
from lexigrove.operators import ranking, spelling
from lexigrove.plans.compiler import Compiler
from lexigrove.plans.parser import English, Spanish, parse, ranked_terms
from lexigrove.queries import stems
from lexigrove.session import keep_until_exit, shared_dir, table, version
from lexigrove.sources.files import Corpus, json_files, merged_lines, merged_postings, tei_text, write_files, xml_files

PLAIN = English(stemmed=False)
RANKED = "quiet harbor trail"
REPEATED = "quiet quiet harbor"
MISSPELT = "harbr museun quiett"


def documents(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """The indexed view of the table; dealt out by document where ``by`` says so, for what is counted by document."""
    return ix.documents_view(table(spark, sf_dir, "documents", spread=True, by=by))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences, not stemmed, those of a document in one partition."""
    return ix.occurrences(documents(spark, sf_dir, "doc_id"))


_BUILT: dict[tuple, str] = {}


def _key(spark: SparkSession, sf_dir: str, stemmed: bool) -> tuple:
    source = f"{sf_dir}/documents.parquet"
    return spark.sparkContext.applicationId, source, version(spark, source), stemmed


def index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> ix.Index:
    """The last index written of a table; built when there is none yet or the table has changed."""
    key = _key(spark, sf_dir, stemmed)
    if key not in _BUILT or not ix.Index.exists(spark, _BUILT[key]):
        return _created(spark, sf_dir, stemmed)
    return ix.Index.load(spark, _BUILT[key])


def _created(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> ix.Index:
    path = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}/index"
    keep_until_exit(spark, path)
    made = ix.Index.create(ix.documents_view(table(spark, sf_dir, "documents")), path, stemmed)
    _BUILT[_key(spark, sf_dir, stemmed)] = path
    return made


def index_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index of the whole table, and how large it is."""
    made = _created(spark, sf_dir)
    terms = made.term_stats.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
    return made.corpus_stats.select("n_docs", "total_tokens").crossJoin(F.broadcast(terms))  # one row each


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written postings, read back as a whole."""
    return index(spark, sf_dir).postings.select("term", "doc_id", "tf", _text("positions").alias("positions"), "doc_length", F.round("l_d", 6).alias("l_d"))


def index_term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term's documents with their positions."""
    return index(spark, sf_dir).term_postings("harbor").select("doc_id", _text("positions").alias("positions"))


def index_term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term's documents, read without positions."""
    return index(spark, sf_dir).term_postings("harbor", positions=False)


def index_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the dictionary with their numbers of documents and occurrences; unknown ones are absent."""
    return index(spark, sf_dir).term_stats.where(F.col("term").isin("harbor", "quiet", "zzzz"))


def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written dictionary's terms in order."""
    return index(spark, sf_dir).vocabulary()


def index_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written documents' table."""
    return index(spark, sf_dir).doc_stats.select("doc_id", "title", "doc_length", F.round("l_d", 6).alias("l_d"))


def index_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written totals."""
    return index(spark, sf_dir).corpus_stats.select("n_docs", "total_tokens", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def _text(numbers: str) -> Column:
    return F.array_join(F.col(numbers).cast("array<string>"), " ")


def _finder(spark: SparkSession, sf_dir: str) -> Finder:
    return Finder(index(spark, sf_dir))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a ranked search, with titles."""
    return _finder(spark, sf_dir).page(RANKED, 1)


def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a Boolean search, with titles."""
    return _finder(spark, sf_dir).search("quiet harbor").select("doc_id", "title", "score")


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked results as lines of text."""
    finder = _finder(spark, sf_dir)
    return finder.rendered(finder.search(RANKED, "bm25", PAGE))


def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a query finds."""
    return _boolean("quiet + harbor")(spark, sf_dir).agg(F.count("*").alias("n"))


def rank_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked query whose words are only lower-cased, so those with other characters are unknown."""
    made = index(spark, sf_dir)
    terms = ranked_terms("Quiet HARBOR, trail", PLAIN, strict=True)
    return ranking.page(ranking.rank(terms, made.postings, made.corpus_stats, "bm25", strict=True), 10)


def spanish_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spanish query over the Spanish documents' words."""
    spanish = ix.documents_view(table(spark, sf_dir, "documents").where("lang = 'es'"))
    posted = ix.postings(analysis.spanish_types(spanish))
    return Compiler(posted, spanish).docs(parse("Parque + montaña -museo", Spanish()))


#: Queries whose trees ``query_trees`` prints.
TREES = ["cat dog", "cat + dog", 'cat dog + mouse "quick fox"', "cat -dog", "-cat", 'a -"b c"', "--cat", "ice-cream + -x"]


def query_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as they are read."""
    return spark.createDataFrame([(q, str(parse(q, PLAIN))) for q in TREES], "query string, tree string")


def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their positions."""
    return analysis.tokens(documents(spark, sf_dir))


def hyphen_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the hyphenated tokens."""
    hyphenated = analysis.tokens(documents(spark, sf_dir)).where(F.contains("token", F.lit("-")))
    return hyphenated.select("doc_id", "position", F.explode(analysis.expand_hyphens(F.col("token"))).alias("raw")).select("doc_id", "position", analysis.clean_type(F.col("raw")).alias("term"))


def occurrence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence, the empty term included."""
    return occurrences(spark, sf_dir)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ix.doc_stats(docs, ix.term_frequencies(ix.occurrences(docs)))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of occurrences of each document."""
    return _stats(spark, sf_dir).select("doc_id", "doc_length")


def total_tokens_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and average length."""
    return ix.corpus_stats(_stats(spark, sf_dir)).select("n_docs", "total_tokens", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(occurrences(spark, sf_dir))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index; positions as text, so that any engine compares them alike."""
    return _postings(spark, sf_dir).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms in order."""
    return occurrences(spark, sf_dir).where("term <> ''").select("term").distinct().orderBy("term")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each term."""
    counted = ix.term_frequencies(occurrences(spark, sf_dir).where("term <> ''"))
    return ix.term_stats(counted)


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by document and term, the empty term included."""
    return ix.term_frequencies(occurrences(spark, sf_dir))


def doc_weights_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean document lengths of log-weighted frequencies."""
    return _stats(spark, sf_dir).select("doc_id", F.round("l_d", 6).alias("l_d"))


def doc_weights_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean document lengths of plain frequencies."""
    return _stats(spark, sf_dir).select("doc_id", F.round("l_d_tf", 6).alias("l_d"))


def _compiled(spark: SparkSession, sf_dir: str, strict: bool = False) -> Compiler:
    made = index(spark, sf_dir)
    return Compiler(made.postings, made.doc_stats, strict)


def _boolean(text: str, strict: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _compiled(spark, sf_dir, strict).docs(parse(text, PLAIN, strict))

    run.__doc__ = f"Documents for the query: {text}"
    return run


def phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a phrase ends in each document."""
    return _compiled(spark, sf_dir).matched(parse('"of the"', PLAIN)).select("doc_id", _text("positions").alias("positions"))


def or_first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR with the positions of the first component that a document has."""
    return _compiled(spark, sf_dir).matched(parse("quiet + harbor", PLAIN)).select("doc_id", _text("positions").alias("positions"))


def _rank(spark: SparkSession, sf_dir: str, terms: list[str], mode: str, stemmed: bool) -> DataFrame:
    made = index(spark, sf_dir, stemmed)
    return ranking.rank(terms, made.postings, made.corpus_stats, mode)


def _ranked(text: str, mode: str, limit: int | None, offset: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = _rank(spark, sf_dir, ranked_terms(text, PLAIN), mode, False)
        return ranking.page(ranked, limit, offset).select("doc_id", "score", "first_term")

    run.__doc__ = f"Documents for {text!r} by {mode}"
    return run


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).term_stats.select("term")


def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of three words to every term."""
    return spelling.distances(_vocabulary(spark, sf_dir), MISSPELT.split())


def spell_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest terms of each word."""
    return spelling.suggest(_vocabulary(spark, sf_dir), MISSPELT.split())


def spell_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with each word's nearest term."""
    return spelling.correct(_vocabulary(spark, sf_dir), MISSPELT)


def matches_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query as a predicate over each document's set of tokens."""
    words = F.split(F.lower(F.coalesce("content", F.lit(""))), r"[ \n\r]")
    tree = parse('quiet -harbor + "the trail"', PLAIN)
    return documents(spark, sf_dir).select("doc_id", tree.matches(words).alias("hit"))


def gap_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids and positions of each posting as gaps."""
    return ix.with_gaps(_postings(spark, sf_dir)).select("term", "doc_id", "doc_gap", _text("gaps").alias("gaps"))


def gap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded posting lists decoded again."""
    return ix.decode(ix.encode(_postings(spark, sf_dir))).select("term", "doc_id", "tf", _text("positions").alias("positions"))


def blocks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the ``term_positions`` blocks merged."""
    blocks = table(spark, sf_dir, "term_positions").groupBy("term", "doc_id", "block_no").agg(F.collect_list("token_pos").alias("positions"))
    return ix.merge_blocks(blocks).select("term", "doc_id", "tf", _text("positions").alias("positions"))


def postings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as lines of the older text format and read again."""
    blocks = table(spark, sf_dir, "term_positions").groupBy("term", "doc_id").agg(F.collect_list("token_pos").alias("positions"))
    path = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}/lines"
    keep_until_exit(spark, path)
    merged_lines(ix.merge_blocks(blocks)).write.text(path)
    return merged_postings(spark, path).select("term", "doc_id", "tf", _text("positions").alias("positions"))


def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of found documents, with a text for those without one."""
    return _finder(spark, sf_dir).titled(_boolean("quiet harbor")(spark, sf_dir)).select("doc_id", "title")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean results as lines of text."""
    finder = _finder(spark, sf_dir)
    return finder.rendered(finder.search("quiet harbor"))


def doc_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as its title with its id."""
    return Corpus(documents(spark, sf_dir)).display()


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of every JSON file, and what is wrong with those that can't be parsed."""
    read = json_files(table(spark, sf_dir, "json_files").select(F.col("file_id").cast("string").alias("path"), F.col("raw_json").alias("value")))
    return read.select(F.col("path").cast("long").alias("file_id"), "title", "content", "problem")


def xml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents of XML documents made of all titles and texts; every seventh is cut off and so reported."""
    text = tei_text(F.col("title"), F.col("text"))
    cut = F.when(F.col("doc_id") % 7 == 0, F.expr("substr(x, 1, length(x) - 3)")).otherwise(F.col("x"))
    raw = table(spark, sf_dir, "documents", spread=True).select("doc_id", text.alias("x")).select(F.col("doc_id").cast("string").alias("path"), cut.alias("value"))
    return xml_files(raw).select(F.col("path").cast("long").alias("doc_id"), "title", "content", F.col("problem").isNotNull().alias("bad"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each document, in its format."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("doc_format").isin("json", "xml"), F.col("doc_format")).otherwise("txt")
    value = F.when(kind == "json", F.to_json(F.struct("title", F.col("text").alias("body")))).when(kind == "xml", tei_text(F.col("title"), F.col("text"))).otherwise(text)
    name = F.concat(F.format_string("%012d", "doc_id"), F.lit("."), kind)
    return write_files(table(spark, sf_dir, "documents", spread=True).select(name.alias("name"), value.alias("value")))


def directory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text, JSON and XML files as documents, numbered in order of the paths."""
    return Corpus.from_directory(spark, _folder(spark, sf_dir)).documents


def directory_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON and XML files of a folder whose names have a 7."""
    name = F.element_at(F.split("path", "/"), -1)
    return Corpus.from_directory(spark, _folder(spark, sf_dir), [".json", ".xml"], name.contains("7")).documents.select("doc_id", "title", "format")


def spanish_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the words of letters in the Spanish documents."""
    spanish = table(spark, sf_dir, "documents").where("lang = 'es'")
    return analysis.spanish_types(ix.documents_view(spanish)).groupBy("term").agg(F.count("*").alias("cf"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English or Spanish by frequent words."""
    return documents(spark, sf_dir).select("doc_id", analysis.language_name(F.col("content")).alias("language"))


def stem_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each stem."""
    return ix.term_stats(ix.term_frequencies(stem_terms(occurrences(spark, sf_dir)).where("term <> ''")))


def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over stems."""
    return ranking.page(_rank(spark, sf_dir, ranked_terms("quietly walking harbors"), "bm25", True), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_positions": tokenize_positions,
    "hyphen_expansion": hyphen_expansion,
    "occurrence_rows": occurrence_rows,
    "doc_lengths": doc_lengths,
    "total_tokens_avg": total_tokens_avg,
    "postings_build": postings_build,
    "vocabulary": vocabulary,
    "doc_freq": doc_freq,
    "term_freq": term_freq,
    "doc_weights_log": doc_weights_log,
    "doc_weights_tf": doc_weights_tf,
    "index_create": index_create,
    "index_postings": index_postings,
    "index_term_positions": index_term_positions,
    "index_term_docs": index_term_docs,
    "index_term_lookup": index_term_lookup,
    "index_vocabulary": index_vocabulary,
    "index_doc_stats": index_doc_stats,
    "index_corpus_stats": index_corpus_stats,
    "bool_term": _boolean("harbor"),
    "bool_and": _boolean("quiet harbor"),
    "bool_and3": _boolean("quiet harbor trail"),
    "bool_or": _boolean("quiet + harbor"),
    "bool_and_not": _boolean("quiet -harbor"),
    "bool_not": _boolean("-harbor"),
    "bool_mixed": _boolean('quiet harbor + trail "of the"'),
    "phrase2": _boolean('"of the"'),
    "phrase3": _boolean('"in the quiet"'),
    "phrase_positions": phrase_positions,
    "or_first_positions": or_first_positions,
    "and_phrase": _boolean('harbor "of the"'),
    "not_phrase": _boolean('harbor -"of the"'),
    "compat_and_not_truncated": _boolean("quiet -harbor", strict=True),
    "compat_leading_not": _boolean("-harbor", strict=True),
    "compat_not_phrase": _boolean('harbor -"of the"', strict=True),
    "rank_tfidf_top10": _ranked(RANKED, "tfidf", 10),
    "rank_bm25_top10": _ranked(RANKED, "bm25", 10),
    "rank_tfidf_all": _ranked(RANKED, "tfidf", None),
    "rank_bm25_all": _ranked(RANKED, "bm25", None),
    "rank_dup_terms": _ranked(REPEATED, "bm25", 10),
    "rank_paged": _ranked(RANKED, "bm25", 15, 15),
    "rank_strict": rank_strict,
    "search_page": search_page,
    "search_boolean": search_boolean,
    "search_lines": search_lines,
    "result_count": result_count,
    "query_trees": query_trees,
    "spanish_search": spanish_search,
    "levenshtein_pairs": levenshtein_pairs,
    "spell_top5": spell_top5,
    "spell_query": spell_query,
    "matches_predicate": matches_predicate,
    "gap_encode": gap_encode,
    "gap_decode": gap_decode,
    "blocks_merged": blocks_merged,
    "postings_text": postings_text,
    "directory_source": directory_source,
    "directory_filtered": directory_filtered,
    "title_lookup": title_lookup,
    "result_lines": result_lines,
    "doc_display": doc_display,
    "json_source": json_source,
    "xml_source": xml_source,
    "spanish_terms": spanish_terms,
    "detect_language": detect_language,
    "stem_terms": stem_terms_query,
    "search_stemmed": search_stemmed,
}

_SPACE = r"[\t\n\x0B\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = r"[ \n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

_TOK = rf"""
    parts AS (
        SELECT doc_id, list_filter(list_transform(
            CASE doc_format WHEN 'json' THEN string_split(text, ' ') WHEN 'xml' THEN regexp_split_to_array(text, '{_ENDS}') ELSE regexp_split_to_array(text, '[ \n\r]') END,
            lambda t: regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda t: t <> '') AS l
        FROM documents),
    tok AS (SELECT doc_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS position FROM parts),
    typ AS (SELECT doc_id, position, token, unnest(CASE WHEN contains(token, '-') THEN list_append(string_split(token, '-'), replace(token, '-', '')) ELSE [token] END) AS raw FROM tok),
    occ AS (
        SELECT doc_id, CAST(position AS INTEGER) AS position, token,
               lower(regexp_replace(regexp_replace(regexp_replace(raw, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'), '["'' ]', '', 'g'), '[^\x00-\x7F]+', '', 'g')) AS term
        FROM typ)
"""
_STATS = (
    _TOK
    + """,
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term),
    per_doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doc_length, sqrt(sum(pow(1 + ln(tf), 2))) AS l_d, sqrt(sum(tf * tf)) AS l_d_tf FROM tfs GROUP BY doc_id),
    stats AS (SELECT d.doc_id, coalesce(doc_length, 0) AS doc_length, coalesce(l_d, 0) AS l_d, coalesce(l_d_tf, 0) AS l_d_tf FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id),
    corpus AS (SELECT count(*) AS n_docs, CAST(sum(doc_length) AS BIGINT) AS total_tokens, sum(doc_length) / count(*) AS avg_doc_length FROM stats),
    dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tfs WHERE term <> '' GROUP BY term)
"""
)
# As _STATS, with stems for terms.
_STEMMED = _STATS.replace("occ AS (", "whole AS (").replace(",\n    tfs AS", ",\n    raw AS (SELECT DISTINCT term FROM whole),\n" + stems.TABLES + ",\n    occ AS (SELECT doc_id, position, stem AS term FROM whole JOIN stems USING (term)),\n    tfs AS")
_POST = _TOK + ", post AS (SELECT term, doc_id, count(*) AS tf, list(position ORDER BY position) AS positions FROM occ WHERE term <> '' GROUP BY term, doc_id)"


def _has(term: str) -> str:
    return f"SELECT doc_id FROM post WHERE term = '{term}'"


def _phrase(*terms: str) -> str:
    joins = "".join(f" JOIN occ o{i} ON o{i}.doc_id = o0.doc_id AND o{i}.position = o0.position + {i} AND o{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"SELECT DISTINCT o0.doc_id FROM occ o0{joins} WHERE o0.term = '{terms[0]}'"


def _rank_sql(terms: list[str], mode: str, tail: str, stats: str = _STATS) -> str:
    asked = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    if mode == "bm25":
        weight = "greatest(0.1, ln((n_docs - df + 0.5) / (df + 0.5))) * (2.2 * tf / (1.2 * (0.25 + 0.75 * doc_length / avg_doc_length) + tf))"
    else:
        weight = "ln(1 + n_docs / df) * (1 + ln(tf)) / l_d"
    return f"""WITH {stats}, asked(i, term) AS (VALUES {asked}),
    scored AS (
        SELECT t.doc_id, round(sum({weight}), 6) AS score, CAST(min(a.i) AS INTEGER) AS first_term
        FROM asked a JOIN tfs t ON t.term = a.term JOIN dfs d ON d.term = a.term JOIN stats s ON s.doc_id = t.doc_id CROSS JOIN corpus GROUP BY t.doc_id)
    SELECT doc_id, score, first_term FROM scored ORDER BY score DESC, first_term, doc_id {tail}"""


_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(MISSPELT.split()))
_NEAREST = f"WITH {_STATS}, words(i, word) AS (VALUES {_WORDS}), far AS (SELECT i, word, term, levenshtein(word, term) AS distance FROM words, dfs), ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, term) AS rank FROM far)"
_TITLED = f"WITH {_POST} SELECT doc_id, coalesce(title, 'Title not found') AS title FROM documents WHERE doc_id IN ({_has('quiet')} INTERSECT {_has('harbor')})"
_LETTERS = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+')"


def _hits(name: str) -> str:
    known = ", ".join(f"'{w}'" for w in analysis.FREQUENT[name])
    return f"len(list_filter({_LETTERS}, lambda w: list_contains([{known}], w)))"


_TOKENS = r"regexp_split_to_array(lower(coalesce(text, '')), '[ \n\r]')"

_XML_OUT = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _xml_text(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '{_XML_OUT}', '', 'g')"


def _lines(*columns: str) -> str:
    """Those of the columns that aren't blank, one to a line."""
    kept = ", ".join(f"CASE WHEN NOT regexp_full_match({c}, '{_SPACE}*') THEN {c} END" for c in columns)
    return f"concat_ws(chr(10), {kept})"


_TEI_TITLE = _xml_text("title")
_TEI_CONTENT = _lines(_TEI_TITLE, _xml_text("text"))
_EXTENSION = "CASE WHEN doc_format IN ('json', 'xml') THEN doc_format ELSE 'txt' END"
_MERGED = "SELECT term, doc_id, count(*) AS tf, array_to_string(list(token_pos ORDER BY token_pos), ' ') AS positions FROM term_positions WHERE term IS NOT NULL AND doc_id IS NOT NULL AND token_pos IS NOT NULL GROUP BY term, doc_id"

SQL: dict[str, str] = {
    "index_create": f"WITH {_STATS} SELECT n_docs, total_tokens, (SELECT count(*) FROM dfs) AS n_terms, (SELECT CAST(sum(df) AS BIGINT) FROM dfs) AS n_postings FROM corpus",
    "index_postings": f"WITH {_STATS}, post AS (SELECT term, doc_id, count(*) AS tf, array_to_string(list(position ORDER BY position), ' ') AS positions FROM occ WHERE term <> '' GROUP BY term, doc_id) SELECT term, doc_id, tf, positions, doc_length, round(l_d, 6) AS l_d FROM post JOIN stats USING (doc_id)",
    "index_term_positions": f"WITH {_POST} SELECT doc_id, array_to_string(positions, ' ') AS positions FROM post WHERE term = 'harbor'",
    "index_term_docs": f"WITH {_POST} {_has('harbor')}",
    "index_term_lookup": f"WITH {_STATS} SELECT term, df, cf FROM dfs WHERE term IN ('harbor', 'quiet', 'zzzz')",
    "index_vocabulary": f"WITH {_TOK} SELECT DISTINCT term FROM occ WHERE term <> '' ORDER BY term",
    "index_doc_stats": f"WITH {_STATS} SELECT s.doc_id, title, doc_length, round(l_d, 6) AS l_d FROM stats s JOIN documents d ON d.doc_id = s.doc_id",
    "index_corpus_stats": f"WITH {_STATS} SELECT n_docs, total_tokens, round(avg_doc_length, 6) AS avg_doc_length FROM corpus",
    "rank_strict": _rank_sql(["quiet", "harbor,", "trail"], "bm25", "LIMIT 10"),
    "search_page": f"SELECT doc_id, coalesce(title, 'Title not found') AS title, score FROM ({_rank_sql(RANKED.split(), 'bm25', 'LIMIT 15 OFFSET 15')}) JOIN documents USING (doc_id)",
    "search_boolean": f"SELECT doc_id, title, CAST(0 AS DOUBLE) AS score FROM ({_TITLED})",
    "search_lines": f"""SELECT doc_id, 'Document ID# ' || doc_id || ' - ' || coalesce(title, 'Title not found') || CASE WHEN score > 0 THEN printf(' - Score: %.3f', score) ELSE '' END AS line
        FROM ({_rank_sql(RANKED.split(), 'bm25', 'LIMIT 15')}) JOIN documents USING (doc_id)""",
    "result_count": f"WITH {_POST} SELECT count(*) AS n FROM ({_has('quiet')} UNION {_has('harbor')})",
    "query_trees": """SELECT * FROM (VALUES ('cat dog', 'cat AND dog'), ('cat + dog', '(cat OR dog)'), ('cat dog + mouse "quick fox"', '(cat AND dog OR mouse AND "quick fox")'), ('cat -dog', 'cat AND NOT (dog)'),
        ('-cat', 'NOT (cat)'), ('a -"b c"', 'a AND NOT ("b c")'), ('--cat', 'cat'), ('ice-cream + -x', '(icecream OR NOT (x))')) AS t(query, tree)""",
    "spanish_search": r"""WITH words AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))) AS term FROM documents WHERE lang = 'es')
        SELECT doc_id FROM words WHERE term = 'parque' UNION (SELECT doc_id FROM words WHERE term = 'montaña' EXCEPT SELECT doc_id FROM words WHERE term = 'museo')""",
    "postings_text": _MERGED,
    "directory_source": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {_EXTENSION} AS format, CAST(NULL AS VARCHAR) AS problem,
        CASE doc_format WHEN 'json' THEN coalesce(title, '') WHEN 'xml' THEN {_TEI_TITLE} ELSE printf('%012d', doc_id) END AS title,
        CASE doc_format WHEN 'xml' THEN {_TEI_CONTENT} ELSE coalesce(text, '') END AS content
        FROM documents WHERE coalesce(doc_format IN ('json', 'xml'), false) OR text <> ''""",
    "directory_filtered": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, CASE doc_format WHEN 'json' THEN coalesce(title, '') ELSE {_TEI_TITLE} END AS title, doc_format AS format FROM documents WHERE doc_format IN ('json', 'xml') AND contains(printf('%012d', doc_id), '7')",
    "tokenize_positions": f"WITH {_TOK} SELECT doc_id, CAST(position AS INTEGER) AS position, token FROM tok",
    "hyphen_expansion": f"WITH {_TOK} SELECT doc_id, position, term FROM occ WHERE contains(token, '-')",
    "occurrence_rows": f"WITH {_TOK} SELECT doc_id, position, term FROM occ",
    "doc_lengths": f"WITH {_STATS} SELECT doc_id, doc_length FROM stats",
    "total_tokens_avg": f"WITH {_STATS} SELECT n_docs, total_tokens, round(avg_doc_length, 6) AS avg_doc_length FROM corpus",
    "postings_build": f"WITH {_POST} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post",
    "vocabulary": f"WITH {_TOK} SELECT DISTINCT term FROM occ WHERE term <> '' ORDER BY term",
    "doc_freq": f"WITH {_STATS} SELECT term, df, cf FROM dfs",
    "term_freq": f"WITH {_STATS} SELECT doc_id, term, tf FROM tfs",
    "doc_weights_log": f"WITH {_STATS} SELECT doc_id, round(l_d, 6) AS l_d FROM stats",
    "doc_weights_tf": f"WITH {_STATS} SELECT doc_id, round(l_d_tf, 6) AS l_d FROM stats",
    "bool_term": f"WITH {_POST} {_has('harbor')}",
    "bool_and": f"WITH {_POST} {_has('quiet')} INTERSECT {_has('harbor')}",
    "bool_and3": f"WITH {_POST} {_has('quiet')} INTERSECT {_has('harbor')} INTERSECT {_has('trail')}",
    "bool_or": f"WITH {_POST} {_has('quiet')} UNION {_has('harbor')}",
    "bool_and_not": f"WITH {_POST} {_has('quiet')} EXCEPT {_has('harbor')}",
    "bool_not": f"WITH {_POST} SELECT doc_id FROM documents EXCEPT {_has('harbor')}",
    "bool_mixed": f"WITH {_POST} ({_has('quiet')} INTERSECT {_has('harbor')}) UNION ({_has('trail')} INTERSECT {_phrase('of', 'the')})",
    "phrase2": f"WITH {_POST} {_phrase('of', 'the')}",
    "phrase3": f"WITH {_POST} {_phrase('in', 'the', 'quiet')}",
    "phrase_positions": f"""WITH {_POST}, ends AS (SELECT a.doc_id, a.position + 1 AS p FROM occ a WHERE a.term = 'of' AND EXISTS (SELECT 1 FROM occ b WHERE b.doc_id = a.doc_id AND b.position = a.position + 1 AND b.term = 'the'))
        SELECT doc_id, array_to_string(list(p ORDER BY p), ' ') AS positions FROM ends GROUP BY doc_id""",
    "or_first_positions": f"WITH {_POST} SELECT doc_id, arg_min(array_to_string(positions, ' '), CASE term WHEN 'quiet' THEN 0 ELSE 1 END) AS positions FROM post WHERE term IN ('quiet', 'harbor') GROUP BY doc_id",
    "and_phrase": f"WITH {_POST} {_has('harbor')} INTERSECT {_phrase('of', 'the')}",
    "not_phrase": f"WITH {_POST} {_has('harbor')} EXCEPT {_phrase('of', 'the')}",
    "compat_and_not_truncated": f"WITH {_POST} SELECT doc_id FROM ({_has('quiet')} EXCEPT {_has('harbor')}) WHERE doc_id < (SELECT max(doc_id) FROM post WHERE term = 'harbor')",
    "compat_leading_not": f"WITH {_POST} {_has('harbor')}",
    "compat_not_phrase": f"WITH {_POST} SELECT doc_id FROM post WHERE false",
    "rank_tfidf_top10": _rank_sql(RANKED.split(), "tfidf", "LIMIT 10"),
    "rank_bm25_top10": _rank_sql(RANKED.split(), "bm25", "LIMIT 10"),
    "rank_tfidf_all": _rank_sql(RANKED.split(), "tfidf", ""),
    "rank_bm25_all": _rank_sql(RANKED.split(), "bm25", ""),
    "rank_dup_terms": _rank_sql(REPEATED.split(), "bm25", "LIMIT 10"),
    "rank_paged": _rank_sql(RANKED.split(), "bm25", "LIMIT 15 OFFSET 15"),
    "levenshtein_pairs": _NEAREST + " SELECT word, term, CAST(distance AS INTEGER) AS distance FROM far",
    "spell_top5": _NEAREST + " SELECT word, CAST(rank AS INTEGER) AS rank, term, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 5",
    "spell_query": _NEAREST + " SELECT string_agg(term, ' ' ORDER BY i) AS corrected FROM ranked WHERE rank = 1",
    "matches_predicate": f"SELECT doc_id, (list_contains({_TOKENS}, 'quiet') AND NOT list_contains({_TOKENS}, 'harbor')) OR (list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'trail')) AS hit FROM documents",
    "gap_encode": f"WITH {_POST} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS doc_gap, array_to_string(list_transform(positions, lambda p, i: p - CASE WHEN i > 1 THEN positions[i - 1] ELSE 0 END), ' ') AS gaps FROM post",
    "gap_decode": f"WITH {_POST} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post",
    "blocks_merged": _MERGED,
    "title_lookup": _TITLED,
    "result_lines": f"SELECT doc_id, 'Document ID# ' || doc_id || ' - ' || title AS line FROM ({_TITLED})",
    "doc_display": "SELECT doc_id, coalesce(title, '') || ' (ID ' || doc_id || ')' AS display FROM documents",
    "json_source": """SELECT file_id, CASE WHEN json_valid(raw_json) THEN coalesce(json_extract_string(raw_json, '$.title'), '') ELSE '' END AS title, CASE WHEN json_valid(raw_json) THEN coalesce(json_extract_string(raw_json, '$.body'), '') ELSE '' END AS content,
        CASE WHEN raw_json IS NOT NULL AND NOT json_valid(raw_json) THEN 'json: not one whole object' END AS problem FROM json_files""",
    "detect_language": f"SELECT doc_id, CASE WHEN {_hits('spanish')} > {_hits('english')} THEN 'spanish' ELSE 'english' END AS language FROM documents",
    "xml_source": f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_TEI_TITLE} END AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_TEI_CONTENT} END AS content, doc_id % 7 = 0 AS bad FROM documents",
    "stem_terms": f"WITH {_STEMMED} SELECT term, df, cf FROM dfs",
    "search_stemmed": _rank_sql(["quiet", "walk", "harbor"], "bm25", "LIMIT 10", _STEMMED),
    "spanish_terms": r"SELECT term, count(*) AS cf FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))) AS term FROM documents WHERE lang = 'es') WHERE regexp_full_match(term, '\p{L}+') GROUP BY term",
}
