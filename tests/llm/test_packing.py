import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from cairn.llm.packing import pack_documents, q_op9, tokenizer_path
from tests.llm.helpers import docs, empty, odd_rows


def check(rows, source, window, with_ids):
    t = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(int)
    for d, text in source:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[(d, tuple(ids))] += 1
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at, whole, got = 0, [], defaultdict(int)
    for r in by_place:  # gapless windows, documents one after another
        assert (r.sequence_id, r.offset) == divmod(at, window) and r.length >= 1 and r.offset + r.length <= window
        at += r.length
        whole.append(r)
        if with_ids:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    if with_ids:
        part = []
        for r in whole:
            assert r.start == len(part)
            part += r.ids
            if len(part) == r.doc_tokens:
                got[(r.doc_id, tuple(part))] += 1
                part = []
        assert not part and got == want
    else:
        ids = {d: list(x) for d, x in want}
        for r in rows:
            piece = ids[r.doc_id][r.start:r.start + r.length]
            assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        assert at == sum(len(x) for x in ids.values())


def test_odd_rows(spark):
    source = [(r[0], r[1]) for r in odd_rows()]
    check(pack_documents(docs(spark), 64).collect(), source, 64, True)


def test_white_space(spark):
    import random
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", " ", "　", " ", "a", "Bé", "'s", "'", "12", "!?", "漢", "\x1c", "\x85",
             "<|endoftext|>", "é ", "à ", "😀"]
    source = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(400)]
    check(pack_documents(docs(spark, [(i, t, "", "", 0) for i, t in source]), 64).collect(), source, 64, True)


def test_empty(spark):
    assert pack_documents(empty(spark)).collect() == []


def test_query_whole_table(spark, sf_small):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(q_op9(spark, sf_small).collect(), source, 2048, False)
