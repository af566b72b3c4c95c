"""Language by compression: the language whose dictionary encodes a text in the fewest bytes.

One zstandard raw-content dictionary per language is filled with lines of labelled texts.  Of
a text its distinct lower-case words are encoded, in the order of their first use, so that
repetition, numbers and marks do not drown the language.  They are cut into blocks, so that the
dictionary and not the text itself explains each block; all blocks meet every dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, slices

UNKNOWN = "und"
LEVEL = 6  # lower levels look at too few places of a dictionary
BLOCK = 4096
LINE_CHARS = 1000
WORD = r"\p{L}[\p{L}\p{M}]*"
HASHES = 1 << 30


def learn(
    labelled: DataFrame, rows: int = 400, dictionary_bytes: int = 64 << 10, lang: str = "lang", text: str = "text"
) -> dict[str, bytes]:
    """One dictionary per language, most frequent first, from at most ``rows`` labelled texts of each.

    The sample is the distinct texts with the least hashes; their distinct lines, up to
    ``LINE_CHARS`` characters of each, fill at most ``dictionary_bytes``.  Rows without
    language or text teach nothing.
    """
    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    # a first cut by hash, at twice the wanted share, keeps the ranking below small
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    counts = counts.orderBy(F.desc("n"), "lang")
    limits = {r["lang"]: int(min(1.0, 2.0 * rows / max(1, r["texts"])) * HASHES) for r in counts.toLocalIterator()}
    if not limits:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang"))
    few = known.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(HASHES))).where(F.col("hash") <= limit)
    few = few.dropDuplicates(["lang", "text"])
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text")))
    lines = ranked.where(F.col("rank") <= rows).select("lang", F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    words = F.array_join(F.regexp_extract_all(F.substring("line", 1, LINE_CHARS), F.lit(WORD), F.lit(0)), " ")
    lines = lines.select("lang", words.alias("line")).where(F.length("line") > 0).distinct()
    by_line = Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line")
    before = F.sum(F.octet_length("line") + 1).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    chosen = lines.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < dictionary_bytes)
    found: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "before").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["line"])
    return {lang: " ".join(found[lang]).encode()[:dictionary_bytes] for lang in limits if lang in found}


class Encoder:
    """Encoded sizes of a text under every language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import regex
        import zstandard

        self.languages = list(dictionaries)
        self.words = regex.compile(WORD).findall
        self.encoders = []
        for raw in dictionaries.values():
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(LEVEL)
            self.encoders.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def sizes(self, words: list[str]) -> list[int]:
        data = f" {' '.join(words)} ".encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum([len(encode(b)) for b in blocks]) for encode in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the best dictionary's language, its share of belief, its lead in size."""
        words = list(dict.fromkeys(self.words((text or "").lower())))
        if not self.languages or not words:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(words)
        best, *others = sorted(sizes)
        # two bits fewer double a language's share
        belief = sum(math.exp(max(-700.0, 4.0 * math.log(2.0) * (best - s))) for s in sizes)
        margin = (others[0] - best) / others[0] if others else 1.0
        return self.languages[sizes.index(best)], 1.0 / belief, margin


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    min_margin: float = 0.02,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, margin, rejected) of every whole text.

    ``rejected`` marks predictions whose encoded size leads the second by less than
    ``min_margin``.  NULL, empty and letterless texts, and all texts without any dictionary, are
    ``und`` and rejected.  Equal sizes go to the language seen most often.  Repeated rows and NULL
    ids are rows like others; columns outside ``keep`` are not read.
    """
    keep = keep or {}
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for batch in slices(batches, "text"):
            found = [encoder.predict(t) for t in batch.column(0).to_pylist()]
            lang, score, margin = zip(*found)
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            made = [pa.array(lang), pa.array(score), pa.array(margin), pa.array([m < min_margin for m in margin])]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, "lang_pred", "score", "margin", "rejected"])

    chosen = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in keep.items()])
    passed = ", ".join(f"{n} {field_type(chosen, n)}" for n in names)
    return chosen.mapInArrow(run, f"{passed}, lang_pred string, score double, margin double, rejected boolean")
