"""Pieces, plans and places."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from toolsentry.llm import packing
from toolsentry.llm.tokenizing import ids_of


def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "ß", "'", "'s", " ", "  ", "\n", "\t", " ", "漢", "🙂", "1", "٣", "!", "$$$", "don't", "'LL", "　", "<|endoftext|>", "\r\n"]
    return ["", " ", "\n\n", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)), "x" * 5000]


def test_ids_equal_those_of_tokenizers(spark):
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = odd_texts() + sample
    for text, want in zip(texts, tokenizer().encode_batch(texts, add_special_tokens=False)):
        assert ids_of(text).tolist() == want.ids


def test_documents_are_whole_and_places_gapless(spark):
    texts = odd_texts()[:120] + [None, "word " * 3000, "word " * 1023, "word " * 1024]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "gone")]
    frame = spark.createDataFrame([(t, i, 7) for i, t in rows], "text string, doc_id long, length long").repartition(3)
    got = packing.best_fit(frame).collect()
    encode = tokenizer()
    for doc_id, text in enumerate(texts):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own]
    check_places([(r.sequence_id, r.offset, r.length) for r in got])
    assert {r.doc_id for r in got} == set(range(len(texts)))


def check_places(places, capacity=1024):
    filled = {}
    for sequence, offset, length in sorted(places):
        assert filled.get(sequence, 0) == offset
        filled[sequence] = offset + length
    assert all(n <= capacity for n in filled.values())
    return len(filled)


def expanded(counts, capacity):
    places, ranks = [], {s: set() for s in counts}
    for length, rank, n, first, per, offset in packing.plan(counts, capacity):
        for r in range(n):
            assert rank + r not in ranks[length]
            ranks[length].add(rank + r)
            places.append((first + r // per, offset + r % per * length, length))
    assert {s: len(r) for s, r in ranks.items()} == counts and all(r == set(range(len(r))) for r in ranks.values())
    return places


def plain_best_fit(counts, capacity):
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] = fit - s
    return len(gaps)


def test_plans_hold_every_piece_and_are_tight():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        bins = check_places(expanded(counts, capacity), capacity)
        assert bins >= -(-sum(s * n for s, n in counts.items()) // capacity)
        assert bins <= plain_best_fit(counts, capacity) + 1
    assert packing.plan({}) == []


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_take_added_tokens_as_the_library_does(spark, tmp_path):
    """Ids, packing and counts of the registered queries, by the tokenizers library with its default settings."""
    from toolsentry.llm.queries import REGISTRY

    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>  \n<|endoftext|>é", "<|endoftext", *odd_texts()]
    want = [e.ids for e in default.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    for text, ids in zip(texts, want):
        assert ids_of(text, special=True).tolist() == ids
    home = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{home}/documents.parquet")
    places = REGISTRY["op5_best_fit_packing"](spark, home).collect()
    for doc_id, ids in enumerate(want):
        full = np.array([*ids, 2], "<u4")
        own = sorted((r for r in places if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(full[r.start:r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(full)
    counts = {}
    for r in REGISTRY["op2_token_counts"](spark, home).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_tokens
    assert [counts[i] for i in range(len(texts))] == [len(ids) for ids in want]
