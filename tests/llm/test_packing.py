import zlib
from collections import defaultdict

import numpy as np
import pytest
from edges import docs, empty

from paperloom.llm import packing


def encoded(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("length", [7, 2048])
def test_pieces_hold_every_id_once(spark, length):
    source = docs(spark)
    pieces = packing.pack(source, length=length).collect()
    want = sorted(tuple(encoded(r.text)) for r in source.collect())
    by_window = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_window[p.sequence_id].append((p.offset, p.length, ids))
    stream = []
    for number in range(len(by_window)):
        at = 0
        for offset, size, ids in sorted(by_window[number]):
            assert offset == at
            at += size
            stream += ids
        assert at == length or number == len(by_window) - 1
    # the stream is the documents one after the other
    whole, at = [], 0
    sizes = sorted(p.doc_tokens for p in pieces if p.start == 0)
    assert sizes == sorted(map(len, want))
    for p in sorted((p for p in pieces if p.start == 0), key=lambda p: p.sequence_id * length + p.offset):
        whole.append(tuple(stream[at : at + p.doc_tokens]))
        at += p.doc_tokens
    assert sorted(whole) == want
    assert all(p.continues == (p.start > 0) and p.continued == (p.start + p.length < p.doc_tokens) for p in pieces)


def test_sequences_are_padded_at_the_end_only(spark):
    pieces = packing.pack(docs(spark), length=64).cache()
    rows = packing.sequences(pieces, length=64, pad_id=0).orderBy("sequence_id").collect()
    assert [len(r.ids) for r in rows] == [64] * len(rows)
    by_piece = {(p.sequence_id, p.offset): np.frombuffer(p.ids, "<u4").tolist() for p in pieces.collect()}
    for r in rows:
        for s in r.spans:
            assert r.ids[s.offset : s.offset + s.length] == by_piece[r.sequence_id, s.offset]
    assert zlib.crc32(b"") == 0


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0
