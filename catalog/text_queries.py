"""Text cleaning, assembly, chunking, keywords and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import WORDS_SQL, query, rounded, table, words
from paperloom.functions.labels import CATEGORIES, CATEGORY_SEED_WORDS, categorize_by_rules, validate_category
from paperloom.functions.text import (
    KEYWORD_STOP_LIST,
    clean_for_keywords,
    clean_lines,
    collapse_whitespace,
    keyword_ok,
    sanitize_filename,
)
from paperloom.operators.aggregate import category_distribution
from paperloom.operators.assemble import (
    assemble_pages,
    assemble_paragraphs,
    flag_short_pages,
    flat_text,
    flatten_json,
    rows_to_text,
)
from paperloom.operators.chunks import chunk_fixed, chunk_recursive, next_chunk_edges
from paperloom.operators.dedupe import dedupe_keep_first
from paperloom.operators.keywords import (
    ENGLISH_STOP_WORDS,
    extract_keywords,
    extract_keywords_by_chunk,
    keyword_records,
    keyword_reports,
    merge_keywords,
    score_terms,
    term_statistics,
)
from paperloom.operators.label_csv import fallback_labels, label_keywords, parse_label_csv
from paperloom.plans.answers import chunk_profile as chunk_profile_of
from paperloom.plans.project import spread

# SQL fragments -------------------------------------------------------------------------
COLLAPSED = r"trim(regexp_replace({0}, '[\s\x0b\x{{00a0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


def collapsed(column: str) -> str:
    return COLLAPSED.format(column)


def cleaned(column: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(regexp_split_to_array({column}, '\\r\\n|[\\n\\r]'), "
        f"lambda s: {collapsed('s')}), lambda s: s <> ''), chr(10))"
    )


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id, lang, i AS chunk_id, substr(t, i * 1500 + 1, 1500) AS text
  FROM (SELECT doc_id, lang, t, unnest(range(0, CAST(ceil(length(t) / 1500.0) AS BIGINT))) AS i
        FROM (SELECT doc_id, lang, {collapsed('text')} AS t FROM documents)))"""


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# queries -------------------------------------------------------------------------------
@query(
    f"""WITH clean AS (SELECT doc_id, lang, {cleaned('text')} AS text FROM documents),
    chunks AS (
      SELECT doc_id, lang, i AS chunk_id, substr(t, i * 1500 + 1, 1500) AS text
      FROM (SELECT doc_id, lang, t, unnest(range(0, CAST(ceil(length(t) / 1500.0) AS BIGINT))) AS i
            FROM (SELECT doc_id, lang, {collapsed('text')} AS t FROM clean)))
    SELECT lang, count(*) AS chunk_id_count, CAST(max(chunk_id) AS INTEGER) AS chunk_id_max,
           CAST(sum(length(text)) AS BIGINT) AS chars_sum, round(avg(length(text)), 6) AS chars_mean,
           count(DISTINCT doc_id) AS doc_id_nunique, count(*) FILTER (WHERE chunk_id > 0) AS edges
    FROM chunks GROUP BY lang"""
)
def chunk_profile(spark, sf):
    return rounded(chunk_profile_of(spread(table(spark, sf, "documents"))), 6, "chars_mean")


@query(f"SELECT doc_id, {cleaned('text')} AS text FROM documents", name="clean_lines")
def clean_lines_query(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", clean_lines("text").alias("text"))


@query(f"SELECT doc_id, {collapsed('text')} AS text FROM documents", name="collapse_whitespace")
def collapse_query(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", collapse_whitespace("text").alias("text"))


# a digit run with no letter, digit or underscore next to it; a space is put on both sides so that
# neighbouring runs do not share their separator
KEYWORD_CLEAN = (
    "trim(regexp_replace(array_to_string(list_transform("
    "regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), "
    "'[•–\"''-]', '', 'g'), '\\s{2,}', ' ', 'g'), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), "
    "lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '' ELSE w END), ''), "
    "'[^A-Za-z0-9\\s]', '', 'g'))"
)


@query(f"SELECT doc_id, {KEYWORD_CLEAN} AS text FROM documents", name="clean_for_keywords")
def clean_keywords_query(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", clean_for_keywords("text").alias("text"))


@query(
    """SELECT c_mktsegment, 'c_custkey c_name c_nationkey c_acctbal' || chr(10) ||
       string_agg(concat_ws(' ', c_custkey, c_name, c_nationkey,
         coalesce(CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS VARCHAR), 'NaN')), chr(10) ORDER BY c_custkey) AS text
       FROM customer GROUP BY ALL""",
    name="rows_to_text",
)
def rows_to_text_query(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_acctbal", F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END"))
    return rows_to_text(df, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"], "c_custkey", ["c_mktsegment"], header=True)


@query(
    """SELECT event_id, 0 AS ord, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events""",
    name="flatten_json",
)
def flatten_json_query(spark, sf):
    return flatten_json(spread(table(spark, sf, "events")), "props", ["event_id"])


@query(
    """SELECT event_id,
       'nk.: ' || json_extract_string(props, '$.k') || chr(10) || 'list0.: ' || event_type || chr(10) || 'flag: True' AS text
       FROM events""",
    name="flatten_json_text",
)
def flatten_json_text_query(spark, sf):
    nested = F.concat(
        F.lit('{"n": '), "props", F.lit(', "list": ["'), "event_type", F.lit('", {}], "flag": true}')
    )
    df = spread(table(spark, sf, "events")).select("event_id", nested.alias("doc"))
    return flat_text(flatten_json(df, "doc", ["event_id"], compat=True), ["event_id"])


@query(
    f"""SELECT conv_id,
        string_agg(chr(10) || '--- Page ' || turn || ' ---' || chr(10) || {cleaned('text')} || chr(10), '' ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    name="assemble_pages",
)
def assemble_pages_query(spark, sf):
    return assemble_pages(spread(table(spark, sf, "conversations")), ["conv_id"], "turn", "text")


@query(
    f"""SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text
        FROM (SELECT conv_id, turn, {cleaned('text')} AS line FROM conversations) WHERE line <> '' GROUP BY conv_id""",
    name="assemble_paragraphs",
)
def assemble_paragraphs_query(spark, sf):
    return assemble_paragraphs(spread(table(spark, sf, "conversations")), ["conv_id"], "turn", "text")


@query(
    f"""SELECT source, string_agg(line, chr(10) ORDER BY doc_id) AS text
        FROM (SELECT source, doc_id, {cleaned('text')} AS line FROM documents) WHERE line <> '' GROUP BY source""",
    name="assemble_in_parts",
)
def assemble_in_parts_query(spark, sf):
    return assemble_paragraphs(spread(table(spark, sf, "documents")), ["source"], "doc_id", "text")


@query(
    r"""SELECT conv_id, turn, CAST(page AS INTEGER) AS page, length(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) < 10 AS needs_ocr
        FROM (SELECT conv_id, turn, unnest(range(len(t))) AS page, unnest(t) AS text
              FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.]') AS t FROM conversations))""",
    name="flag_short_pages",
)
def flag_short_pages_query(spark, sf):
    """Every sentence of a turn stands for a page."""
    pages = F.posexplode(F.split("text", "[.]", -1)).alias("page", "text")
    df = table(spark, sf, "conversations").select("conv_id", "turn", pages)
    return flag_short_pages(df, "text").select("conv_id", "turn", "page", "needs_ocr")


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url || '|' || regexp_extract(html, '<title>([^<]*)', 1), '[^\x00-\x7F]+', '', 'g'),
        '[<>:"/\\|?*]', '_', 'g') AS name FROM pages""",
    name="sanitize_filename",
)
def sanitize_query(spark, sf):
    raw = F.concat("url", F.lit("|"), F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf, "pages").select("page_id", sanitize_filename(raw).alias("name"))


# chunking ------------------------------------------------------------------------------
@query(f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, text FROM chunks", name="chunk_fixed")
def chunk_fixed_query(spark, sf):
    return chunk_fixed(spread(table(spark, sf, "documents")), "text", ["doc_id"])


@query(name="chunk_recursive")
def chunk_recursive_query(spark, sf):
    return chunk_recursive(spread(table(spark, sf, "documents")), "text", ["doc_id"])


@query(
    f"""WITH {CHUNKS_SQL}
    SELECT doc_id, CAST(src AS INTEGER) AS src, CAST(chunk_id AS INTEGER) AS dst, 'next_chunk' AS relation FROM (
      SELECT doc_id, chunk_id, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS src FROM chunks)
    WHERE src IS NOT NULL""",
    name="next_chunk_edges",
)
def next_chunk_edges_query(spark, sf):
    return next_chunk_edges(chunk_fixed(spread(table(spark, sf, "documents")), "text", ["doc_id"]), "doc_id", contiguous=True)


@query(
    """SELECT user_id, src, event_id AS dst, 'next_chunk' AS relation FROM (
      SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM events)
    WHERE src IS NOT NULL""",
    name="next_edges_with_gaps",
)
def next_edges_with_gaps_query(spark, sf):
    return next_chunk_edges(table(spark, sf, "events"), "user_id", "event_id", bucket_rows=1000)


@query(
    """SELECT text, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang, min_by(source, doc_id) AS source
       FROM documents GROUP BY text""",
    name="dedupe_keep_first",
)
def dedupe_query(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return dedupe_keep_first(df, ["text"], ["doc_id"])


# keywords ------------------------------------------------------------------------------
def _clean_documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", clean_for_keywords("text").alias("text"))


TERM_SQL = f"""clean AS (SELECT doc_id, {KEYWORD_CLEAN} AS text FROM documents),
 tokens AS (SELECT doc_id, t[i] AS token, lower(t[i]) AS term, lower(CASE WHEN i > 1 THEN t[i - 1] END) AS l,
                   lower(t[i + 1]) AS r, i FROM (
    SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM clean))),
 stats AS (SELECT doc_id, term, count(*) AS tf,
   count(*) FILTER (WHERE regexp_matches(token, '^[A-Z]') AND NOT regexp_full_match(token, '[A-Z][A-Z]+') AND i > 1) AS tf_upper,
   count(*) FILTER (WHERE regexp_full_match(token, '[A-Z][A-Z]+')) AS tf_acronym,
   count(l) AS n_left, count(r) AS n_right, count(DISTINCT l) AS d_left, count(DISTINCT r) AS d_right,
   term IN ({sql_list(ENGLISH_STOP_WORDS)}) OR length(term) < 3 AS is_stop
   FROM tokens WHERE NOT regexp_full_match(term, '[0-9]+') GROUP BY doc_id, term)"""


@query(
    f"""WITH {TERM_SQL} SELECT doc_id, term, tf, tf_upper, tf_acronym, n_left, n_right,
        CAST(d_left AS INTEGER) AS d_left, CAST(d_right AS INTEGER) AS d_right, is_stop FROM stats""",
    name="term_statistics",
)
def term_statistics_query(spark, sf):
    stats = term_statistics(_clean_documents(spark, sf), ["doc_id"], "text")
    return stats.drop("n_sentences", "median_sentence", "last_sentence", "max_tf", "typical_tf", "all_sentences")


SCORE_SQL = f"""{TERM_SQL}, typical AS (
      SELECT *, max(tf) OVER (PARTITION BY doc_id) AS max_tf,
        avg(CASE WHEN NOT is_stop THEN tf END) OVER (PARTITION BY doc_id)
          + coalesce(stddev_pop(CASE WHEN NOT is_stop THEN tf END) OVER (PARTITION BY doc_id), 0) AS typical FROM stats),
    features AS (
      SELECT doc_id, term, tf, greatest(tf_upper, tf_acronym) / (1 + ln(tf)) AS casing, ln(ln(3)) AS pos, tf / typical AS freq,
        1 + (CASE WHEN n_left > 0 THEN d_left / n_left ELSE 0 END + CASE WHEN n_right > 0 THEN d_right / n_right ELSE 0 END)
          * tf / max_tf AS rel FROM typical WHERE NOT is_stop),
    weighed AS (SELECT *, rel * pos / (casing + freq / rel + 1 / rel) AS w FROM features)"""


@query(
    f"WITH {SCORE_SQL} SELECT doc_id, term, tf, round(w / ((1 + w) * tf), 9) AS score FROM weighed",
    name="score_terms",
)
def score_terms_query(spark, sf):
    stats = term_statistics(_clean_documents(spark, sf), ["doc_id"], "text")
    return rounded(score_terms(stats, ["doc_id"]), 9, "score")


@query(
    f"""WITH {SCORE_SQL}, top AS (SELECT doc_id, term FROM weighed
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(w / ((1 + w) * tf), 12), term) <= 20),
    kept AS (SELECT doc_id, term FROM top
      WHERE regexp_full_match(term, '\\p{{L}}+') AND length(term) > 2 AND term NOT IN ({sql_list(KEYWORD_STOP_LIST)}))
    SELECT doc_id, term AS keyword FROM kept""",
    name="keyword_set",
)
def keyword_set_query(spark, sf):
    """The keywords of every document without the similarity step."""
    return extract_keywords(table(spark, sf, "documents"), ["doc_id"], dedup_limit=1.0).select("doc_id", "keyword")


@query(name="extract_keywords")
def extract_keywords_query(spark, sf):
    return extract_keywords(table(spark, sf, "documents"), ["doc_id"])


@query(name="extract_keywords_by_chunk")
def extract_keywords_by_chunk_query(spark, sf):
    return merge_keywords(extract_keywords_by_chunk(table(spark, sf, "documents"), ["doc_id"]), ["doc_id"])


def _document_words(spark, sf):
    text = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("keyword")
    return spread(table(spark, sf, "documents")).select("doc_id", text)


DOC_WORDS_SQL = f"""merged AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY keyword) AS rank
  FROM (SELECT DISTINCT doc_id, lower(keyword) AS keyword FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS keyword FROM documents)
  WHERE regexp_full_match(keyword, '\\p{{L}}+') AND length(keyword) > 2 AND lower(keyword) NOT IN ({sql_list(KEYWORD_STOP_LIST)}))
  QUALIFY rank <= 50)"""


def _merged(spark, sf):
    kept = _document_words(spark, sf).where(keyword_ok("keyword")).withColumn("keyword", F.lower("keyword"))
    return merge_keywords(kept, ["doc_id"])


@query(
    f"WITH {DOC_WORDS_SQL} SELECT doc_id, keyword, CAST(rank AS INTEGER) AS rank FROM merged", name="merge_keywords"
)
def merge_keywords_query(spark, sf):
    return _merged(spark, sf)


@query(
    f"""WITH {DOC_WORDS_SQL} SELECT doc_id, string_agg(keyword, ',' ORDER BY rank) AS keywords,
        CAST(count(*) AS INTEGER) AS keyword_count FROM merged GROUP BY doc_id""",
    name="keyword_records",
)
def keyword_records_query(spark, sf):
    return keyword_records(_merged(spark, sf), "doc_id").withColumn("keywords", F.array_join("keywords", ","))


@query(
    f"""WITH {DOC_WORDS_SQL} SELECT doc_id, 'Keywords extracted from: ' || doc_id || chr(10) || repeat('=', 50) || chr(10) ||
        string_agg(printf('%2d. %s', rank, keyword) || chr(10), '' ORDER BY rank) AS report FROM merged GROUP BY doc_id""",
    name="keyword_reports",
)
def keyword_reports_query(spark, sf):
    return keyword_reports(keyword_records(_merged(spark, sf), "doc_id"), "doc_id")


@query(
    f"""SELECT DISTINCT keyword FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS keyword FROM documents)
        WHERE regexp_full_match(keyword, '\\p{{L}}+') AND length(keyword) > 2
        AND lower(keyword) NOT IN ({sql_list(KEYWORD_STOP_LIST)})""",
    name="keyword_filter",
)
def keyword_filter_query(spark, sf):
    return _document_words(spark, sf).where(keyword_ok("keyword")).select("keyword").distinct()


# labels --------------------------------------------------------------------------------
CATEGORY_SQL = "cats AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ") v(ord, cat))"


def _valid_sql(column: str) -> str:
    low = f"lower(trim({column}))"
    return (
        f"coalesce((SELECT min_by(cat, CASE WHEN lower(cat) = {low} THEN ord ELSE 1000 + ord END) FROM cats "
        f"WHERE contains(lower(cat), {low}) OR contains({low}, lower(cat))), 'Other')"
    )


@query(
    f"""WITH {WORDS_SQL}, {CATEGORY_SQL} SELECT keyword, {_valid_sql('keyword')} AS category FROM words""",
    name="validate_category",
)
def validate_category_query(spark, sf):
    return words(spark, sf).select("keyword", validate_category("keyword").alias("category"))


RULES_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({{0}}, '{'|'.join(seeds)}') THEN '{cat}'" for cat, seeds in CATEGORY_SEED_WORDS.items()
) + " ELSE 'Other' END"


@query(f"WITH {WORDS_SQL} SELECT keyword, {RULES_SQL.format('keyword')} AS category FROM words", name="categorize_by_rules")
def categorize_query(spark, sf):
    return words(spark, sf).select("keyword", categorize_by_rules("keyword").alias("category"))


@query(
    f"WITH {WORDS_SQL} SELECT {RULES_SQL.format('keyword')} AS category, count(*) AS n FROM words GROUP BY 1",
    name="category_distribution",
)
def category_distribution_query(spark, sf):
    return category_distribution(fallback_labels(words(spark, sf)), "category")


# one stored response per customer segment and nation: a prose line, a header and one line per customer
def _responses(spark, sf):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    line = F.concat(
        F.lit(" "), "c_name", F.lit(" , "), F.upper(F.element_at(names, F.expr("cast(c_custkey % 31 + 1 as int)"))),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("s, noise")).otherwise(F.lit("")),
    )
    name = F.concat_ws("-", "c_mktsegment", "c_nationkey")
    rows = table(spark, sf, "customer").select(name.alias("response_id"), "c_custkey", line.alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "\n")
    text = F.concat(F.lit("Here is the table\n\nkeyword,category\n"), lines, F.lit("\ncustomer#000000001,,\n"))
    return rows.groupBy("response_id").agg(text.alias("csv_text"))


def _requested(spark, sf):
    name = F.concat_ws("-", "c_mktsegment", "c_nationkey")
    return table(spark, sf, "customer").where("c_acctbal > 0").select(name.alias("response_id"), F.upper("c_name").alias("keyword"))


@query(
    f"""WITH {CATEGORY_SQL}, rows AS (
      SELECT c_mktsegment || '-' || c_nationkey AS response_id, lower(c_name) AS keyword,
        (SELECT upper(cat) FROM cats WHERE ord = c_custkey % 31) || CASE WHEN c_custkey % 7 = 0 THEN 's' ELSE '' END AS raw
      FROM customer WHERE c_acctbal > 0)
    SELECT response_id, keyword, {_valid_sql('raw')} AS category FROM rows""",
    name="parse_label_csv",
)
def parse_label_csv_query(spark, sf):
    return parse_label_csv(_responses(spark, sf), _requested(spark, sf))


@query(
    f"""WITH {CATEGORY_SQL}, rows AS (
      SELECT c_mktsegment || '-' || c_nationkey AS response_id, lower(c_name) AS keyword, c_mktsegment,
        (SELECT upper(cat) FROM cats WHERE ord = c_custkey % 31) || CASE WHEN c_custkey % 7 = 0 THEN 's' ELSE '' END AS raw
      FROM customer WHERE c_acctbal > 0)
    SELECT response_id, keyword, CASE WHEN c_mktsegment = 'MACHINERY' THEN {RULES_SQL.format('keyword')}
      ELSE {_valid_sql('raw')} END AS category FROM rows""",
    name="label_keywords",
)
def label_keywords_query(spark, sf):
    """Segments without a stored response fall back to the rules."""
    answered = _responses(spark, sf).where(~F.col("response_id").startswith("MACHINERY"))
    return label_keywords(answered, _requested(spark, sf))

