"""Unsupervised single-word keywords from term statistics.

The five features and the score follow Campos et al., "YAKE! Keyword extraction
from single documents using multiple local features", Information Sciences 509
(2020).  The JVM cuts texts into tokens; the terms of a document are counted,
scored and chosen in Arrow batches.  One exchange, by document, serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.terms import RANKED, TERM_FEATURES, TOTALS, best_terms, term_features
from paperloom.functions.text import KEYWORD_STOP_LIST, clean_for_keywords, keyword_ok
from paperloom.operators.chunks import chunk_fixed

# --- fixed values: must equal the expected output ---------------------------------
TOP_N = 20
MERGED_MAX = 50
CHUNK_DEDUP_LIMIT = 0.7
CHUNK_CANDIDATE_FACTOR = 3
REPORT_LINE = "%2d. %s"
REPORT_HEAD = "Keywords extracted from: %s\n"
REPORT_RULE = 50
# -----------------------------------------------------------------------------------
DEDUP_LIMIT = 0.9
# common English function words, used to tell content words when scoring
ENGLISH_STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has have having he
    her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only
    or other our out over own same she should so some such than that the their them then there these they this
    those through to too under until up very was we were what when where which while who whom why will with would
    you your""".split()
)

_SENTENCE_END = r"(?<=[.!?])\s+|\n+"
_TOKEN = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"


def _sentences(texts: Column) -> Column:
    """An array of (sentence, tokens) of some texts."""

    def cut(text: Column) -> Column:
        return F.transform(
            F.split(text, _SENTENCE_END),
            lambda s, i: F.struct(i.alias("sentence"), F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)).alias("tokens")),
        )

    return F.flatten(F.transform(texts, cut))


def _document_terms(df: DataFrame, key: Sequence[str], text: str, kind: str, found: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """keys, _terms: one row per document with what ``found`` makes of its sentences.  Rows of one key are one document."""
    documents = df.groupBy(*key).agg(F.collect_list(text).alias("_texts"))
    return documents.select(*key, F.arrow_udf(found, kind)(_sentences(F.col("_texts"))).alias("_terms"))


def term_statistics(
    df: DataFrame, key: Sequence[str], text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, placed: bool = False
) -> DataFrame:
    """Per document and term: tf, upper-case and acronym counts, sentence spread and neighbour counts, and ``TOTALS`` of the document.

    Texts are dealt by ``key`` (unless they are ``placed`` so already), so that no token is shuffled.
    """
    key, stop = list(key), frozenset(stop_words)
    kind = f"array<struct<{','.join(f'{name}:{of}' for name, of in TERM_FEATURES.items())}>>"

    def counted(sentences: pa.Array) -> pa.Array:
        return term_features(sentences, stop)

    documents = _document_terms(df if placed else by_document(df, key, text), key, text, kind, counted)
    return documents.select(*key, F.explode("_terms").alias("_t")).select(*key, "_t.*")


def _score() -> Column:
    """The score of a content term from its features and the totals of its document, as in ``functions.terms``."""

    def diversity(distinct: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(distinct) / F.col(total)).otherwise(0.0)

    tf = F.col("tf")
    casing = F.greatest("tf_upper", "tf_acronym") / (1 + F.log(tf))
    position = F.log(F.log(3 + F.col("median_sentence")))
    frequency = tf / F.col("typical_tf")
    sentence_spread = F.col("n_sentences") / F.col("all_sentences")
    relatedness = 1 + (diversity("d_left", "n_left") + diversity("d_right", "n_right")) * tf / F.col("max_tf")
    weight = (relatedness * position) / (casing + frequency / relatedness + sentence_spread / relatedness)
    return weight / ((1 + weight) * tf)


def score_terms(stats: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``score`` to content terms; smaller is better.  Terms that carry the ``TOTALS`` of their document need no window."""
    if not set(TOTALS) <= set(stats.columns):
        document = Window.partitionBy(*key)
        content_tf = F.when(~F.col("is_stop"), F.col("tf"))
        spread = F.coalesce(F.stddev_pop(content_tf).over(document), F.lit(0.0))
        stats = stats.select(
            "*",
            F.max("tf").over(document).alias("max_tf"),
            (F.avg(content_tf).over(document) + spread).alias("typical_tf"),
            (F.max("last_sentence").over(document) + 1).alias("all_sentences"),
        )
    return stats.where(~F.col("is_stop")).select(*key, "term", "tf", _score().alias("score"))


def by_document(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The one exchange of the extraction: every later grouping and window by ``key`` reuses it.

    Its partition count is stated, as adaptive coalescing judges by the bytes of the
    text and not by the work on its tokens.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*key, text).repartition(partitions, *key)


def rank_terms(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    top_n: int,
    dedup_limit: float,
    stop_words: Sequence[str],
    suitable: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """keys, rank, keyword, score: the ``top_n`` best scored, mutually dissimilar terms of each document.

    Of the terms taken only the ``suitable`` ones are then numbered.
    """
    key, stop = list(key), frozenset(stop_words)

    def best(sentences: pa.Array) -> pa.Array:
        return best_terms(sentences, stop, dedup_limit, top_n)

    # the terms of a document are scored and chosen where they are counted, so only the best ones leave the task
    taken = _document_terms(df, key, text, RANKED, best).withColumnRenamed("_terms", "_taken")
    if suitable is not None:
        taken = taken.withColumn("_taken", F.filter("_taken", lambda t: suitable(t["term"])))
    out = taken.select(*key, F.posexplode("_taken").alias("_at", "_t"))
    return out.select(
        *key, (F.col("_at") + 1).alias("rank"), F.col("_t")["term"].alias("keyword"), F.col("_t")["score"].alias("score")
    )


def extract_keywords(
    df: DataFrame,
    key: Sequence[str] = ("source",),
    text: str = "text",
    top_n: int = TOP_N,
    dedup_limit: float = DEDUP_LIMIT,
) -> DataFrame:
    """Clean, score, take ``top_n`` and only then drop unsuitable words, so fewer may remain.

    ``key`` names one document (one row of ``df``).
    """
    clean = by_document(df, key, text).withColumn(text, clean_for_keywords(text))
    return rank_terms(
        clean, key, text, top_n, dedup_limit, ENGLISH_STOP_WORDS, lambda word: keyword_ok(word, KEYWORD_STOP_LIST)
    )


def extract_keywords_by_chunk(
    df: DataFrame,
    key: Sequence[str] = ("source",),
    text: str = "text",
    max_keywords: int = MERGED_MAX,
) -> DataFrame:
    """Keywords of every fixed-size chunk: keys, chunk_id, rank, keyword, score."""
    chunks = chunk_fixed(by_document(df, key, text), text, key)
    ranked = rank_terms(
        chunks, [*key, "chunk_id"], "text", max_keywords * CHUNK_CANDIDATE_FACTOR, CHUNK_DEDUP_LIMIT, ENGLISH_STOP_WORDS
    )
    return ranked.where(keyword_ok("keyword", ENGLISH_STOP_WORDS))


def merge_keywords(keywords: DataFrame, key: Sequence[str] = ("source",), max_keywords: int = MERGED_MAX) -> DataFrame:
    """Union over chunks, alphabetical, cut to ``max_keywords`` per document: keys, rank, keyword."""
    order = Window.partitionBy(*key).orderBy("keyword")
    distinct = keywords.select(*key, "keyword").distinct()
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_keywords)


def keyword_records(keywords: DataFrame, key: str = "source") -> DataFrame:
    """key, keywords ARRAY, keyword_count: at most ``top_n`` keywords per document reach a group."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "keyword")))
    words = F.transform(ordered, lambda k: k["keyword"])
    return keywords.groupBy(key).agg(words.alias("keywords")).withColumn("keyword_count", F.size("keywords"))


def keyword_reports(records: DataFrame, key: str = "source") -> DataFrame:
    """key, report: the ranked list as text."""
    lines = F.transform("keywords", lambda w, i: F.format_string(REPORT_LINE + "\n", i + 1, w))
    head = F.concat(F.format_string(REPORT_HEAD, F.col(key).cast("string")), F.lit("=" * REPORT_RULE + "\n"))
    return records.select(key, F.concat(head, F.array_join(lines, "")).alias("report"))
