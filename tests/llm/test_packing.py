import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import ODD, frame, prose
from veilframe.llm.packing import Plan, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(docs, pieces, sequence):
    t = direct()
    ids = {k: t.encode(v or "", add_special_tokens=False).ids + [1] for k, v in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[k][p.start : at], "<u4").tobytes())
        assert at == len(ids[k])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence
        padding += (sequence - at) if at & (at - 1) else 0
    return padding / max(1, sum(map(len, ids.values())))


def test_pieces_rebuild_every_document(spark):
    r = random.Random(5)
    docs = {k: prose(k, r.choice([0, 1, 5, 40, 300, 700, 3000])) for k in range(150)}
    docs |= {1000 + k: prose(7, 250) for k in range(60)}
    got = pack(frame(spark, docs.items()), PATH).collect()
    assert check(docs, got, 2048) < 0.005


def test_odd_rows_and_empty_table(spark):
    got = pack(frame(spark, ODD), PATH).collect()
    assert sum(p.doc_id is None and p.start == 0 for p in got) == 2
    assert sum(p.doc_id == 7 and p.start == 0 for p in got) == 2
    assert {p.doc_tokens for p in got if p.doc_id in (1, 2, 3)} == {1}
    assert len({(p.sequence_id, p.offset) for p in got}) == len(got)
    assert pack(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("histogram", [{}, {2047: 9}, {5: 1}, {1000: 7, 3: 9}, {1030: 10}, {2000: 1, 1500: 1}, {n: n % 7 for n in range(1, 2048)}])
def test_plan_fills_sequences_without_gaps(histogram):
    histogram = {k: v for k, v in histogram.items() if v}
    plan, packs = Plan(histogram), defaultdict(list)
    for length, count in histogram.items():
        for rank in range(count):
            at = 0
            for start, size, pack_no, offset in plan.pieces(length, rank):
                assert start == at and size > 0
                at += size
                packs[pack_no].append((offset, size))
            assert at == length
    assert sorted(packs) == list(range(plan.packs))
    for parts in packs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048 and (2048 - at < 8 or at & (at - 1) == 0)


def test_word_cache_gives_the_tokenizers_ids():
    encode, t = WordEncoder(PATH, cache_words=50), direct()
    for text in ["I'm don't <|endoftext|> é \x1cab\x85c 'S 日本 １２", "", " \n", "ΣΣ İ Á", *(prose(k, 90) for k in range(9))]:
        assert list(np.frombuffer(encode([text.encode()])[0], encode.dtype)) == t.encode(text, add_special_tokens=False).ids
