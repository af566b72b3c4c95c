"""Concatenate and cut: token sequences of fixed length without padding in between.

Pass one tokenizes each document once and writes its ids with its position among
the tokens of its task.  Pass two adds up the totals of the tasks, one row each, so
every document knows its offset in the concatenation of all documents, and cuts it
at the multiples of the sequence length.  No token is shuffled.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, slices, stage

WIDTH = 4  # bytes of an id
CACHE_PIECES = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Ids of one word of the vocabulary's own cutting, as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        self.model = tokenizer.model
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {c: visible.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        shown = word if word.isascii() and word.isprintable() else word.translate(self.visible)
        out = packed([t.id for t in self.model.tokenize(shown)])
        if len(word) <= 64:
            self[word] = out
        return out


class PieceIds(dict):
    """Ids of text without white space; remembers up to ``CACHE_PIECES``.

    The vocabulary lower-cases, drops white space and never joins across it, so a text's
    ids are those of its pieces.  Latin-1 pieces skip the normalizer: their NFC form is
    themselves and their lower case is the tokenizer's.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_ids = WordIds(self.tokenizer)
        # fixed pattern of the vocabulary file
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        if piece.isascii():
            low = piece.lower()
            out = self.word_ids[low] if low.isalpha() else b"".join(map(self.word_ids.__getitem__, self.words(low)))
        else:
            try:
                piece.encode("latin-1")
                out = b"".join(map(self.word_ids.__getitem__, self.words(piece.lower())))
            except UnicodeEncodeError:
                out = packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = out
        return out

    def of_text(self, text: str) -> bytes:
        if "<|" in text:  # may hold the string of a special token, which is found before anything else
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            import regex

            return b"".join(map(self.__getitem__, regex.split(r"[\x09-\x0D\x20]+", text)))
        return b"".join(map(self.__getitem__, text.split()))


def tokenize(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Written rows (task, before, doc_id, ids, n): ids as bytes, ``before`` tokens of the same task come first.

    NULL text counts as empty; every document ends with ``end_id``.  A task writes its
    rows once, so ``before`` stays valid whatever executor is lost later.
    """
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, before = PieceIds(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            found = [ids.of_text(t or "") + end for t in batch.column(1).to_pylist()]
            counts = [len(x) // WIDTH for x in found]
            starts = []
            for n in counts:
                starts.append(before)
                before += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * len(found), pa.int32()),
                    pa.array(starts, pa.int64()),
                    batch.column(0),
                    pa.array(found, pa.binary()),
                    pa.array(counts, pa.int64()),
                ],
                names=["task", "before", "doc_id", "ids", "n"],
            )

    schema = f"task int, before long, doc_id {field_type(docs, doc_id)}, ids binary, n long"
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stage(chosen.mapInArrow(run, schema), "tokens")


def concatenate(tokens: DataFrame) -> DataFrame:
    """Add ``begin``, each document's offset in the concatenation in (task, before) order.

    The totals are one row per task that wrote tokens, the size of a file listing, so
    their running sum is one small window and they are shipped to every task.
    """
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "task").select(
        "doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("begin")
    )


def cut(documents: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece of a document inside one window of ``length`` tokens.

    ``continues`` and ``continued`` mark boundary records: pieces whose document went on
    from the window before, or goes on in the next.
    """
    size = F.lit(length)
    last = F.col("begin") + F.col("n") - 1
    windows = documents.select(
        "*",
        F.explode(F.sequence((F.col("begin") / size).cast("long"), (last / size).cast("long"))).alias("sequence_id"),
    )
    start = F.greatest(F.col("sequence_id") * size - F.col("begin"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * size - F.col("begin"), F.col("n"))
    pieces = windows.select("*", start.alias("start"), (stop - start).alias("length"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.expr(f"substring(ids, cast(start * {WIDTH} + 1 as int), cast(length * {WIDTH} as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("begin") + F.col("start") - F.col("sequence_id") * size).alias("offset"),
        (F.col("start") > 0).alias("continues"),
        (F.col("start") + F.col("length") < F.col("n")).alias("continued"),
    )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, continues, continued).

    Every sequence but the last is full.  NULL and empty texts are one ``end_id``; a long
    text spans as many sequences as it needs; repeated rows and NULL ids are packed like any
    other; an empty table gives no pieces; other columns of the input are not read.
    """
    return cut(concatenate(tokenize(docs, vocabulary, end_id, doc_id, text)), length)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>, spans): pieces put together, the last sequence padded.

    A group is one window, so at most ``length`` tokens.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", F.hex("ids").alias("ids")))).alias("all")
    )
    digits = F.array_join(F.col("all.ids"), "")
    here = F.length(digits) / (2 * WIDTH)

    def value(i: Column) -> Column:
        at = [F.substr(digits, i * (2 * WIDTH) + 2 * b + 1, F.lit(2)) for b in reversed(range(WIDTH))]
        return F.conv(F.concat(*at), 16, 10).cast("int")

    ids = F.transform(F.sequence(F.lit(0), (here - 1).cast("int")), value)
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(length) - here).cast("int")))
    spans = F.transform("all", lambda s: F.struct(s.offset.alias("offset"), s.doc_id.alias("doc_id"), s.start.alias("start"), s.length.alias("length")))
    return joined.select("sequence_id", padded.alias("ids"), spans.alias("spans"))
