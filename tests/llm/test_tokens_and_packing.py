"""Token ids, packing and token files against the library and brute force."""

import array
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrail.llm import packing, tokenfiles, tokens
from loomtrail.llm.code import ship
from loomtrail.scale import staged_path

SCHEMA = "doc_id long, text string, ids string, length int, part string"
ROWS = [
    (3, "The end. of it", "x", 1, "p"), (1, None, "x", 1, None), (2, "", "x", 1, "p"), (None, "no id", "x", 1, "p"),
    (5, "same text", "x", 1, "p"), (5, "same text", "x", 1, "p"), (7, "word " * 5000, "x", None, "p"),
    (9, "Éa  b\n\n\n c<|endoftext|>d's 12", "x", 1, "p"), (4, "tie", "x", 1, "p"), (6, "tie", "x", 1, "p"),
]


@pytest.fixture(scope="module")
def library():
    return tokens.TextEncoder(tokens.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


def ids_of(library, text):
    return library.whole([text or ""])[0] + array.array("I", [tokens.END_ID]).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\rab.,'sÉé1中\xa0\x1c<|>"), max_size=20), min_size=1, max_size=4))
def test_chunks_equal_whole_texts(texts):
    enc = tokens.encoder(tokens.default_path())
    assert enc.encode(texts) == enc.whole(texts)


def test_packing(docs, library):
    rows = packing.pack_documents(docs).collect()
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"} <= set(rows[0].asDict())
    by_doc = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for doc, text, *_ in ROWS:
        want, copies = ids_of(library, text), sum(r[0] == doc for r in ROWS)
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        if copies == 1:
            assert b"".join(r.ids for r in pieces) == want
        assert len(pieces) == copies * -(-len(want) // 4 // packing.CAPACITY)
        assert all(r.length == packing.CAPACITY for r in pieces if r.piece > 0)


def test_packing_of_nothing(spark, docs):
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plans_hold_every_item_and_are_tight():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 1024])
        counts = Counter(min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(1, 3000)))
        bins = packing.plan_bins(counts, capacity)
        held = Counter()
        for b in bins:
            assert b.gap == capacity - sum(n * k for n, k in b.items) >= 0
            assert sum(k for n, k in b.items if 3 * n > capacity) <= 2
            for n, k in b.items:
                held[n] += k * b.count
        assert held == counts
        assert sum(b.count for b in bins) <= 1.23 * packing.fewest_possible(counts, capacity) + 1


def test_pairs_of_large_items_are_as_many_as_can_be():
    bins = packing.plan_bins({60: 3, 40: 3, 50: 3}, 100)
    assert sum(b.count for b in bins) == 5


def test_token_files(spark, docs, library):
    folder = staged_path(spark, "test-files")
    tokenfiles.write_shards(docs, folder, shard_tokens=600)
    shards = tokenfiles.read_shards(spark, folder)
    starts = {(r.part, r.shard): r.shard_start for r in tokenfiles.shard_starts(shards).collect()}
    found = sorted(tokenfiles.read_documents(shards).collect(), key=lambda r: (r.part, r.shard, r.start_in_shard))
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [r[0] for r in want]
    at = 0
    for r, (_, text, *_) in zip(found, want):
        assert r.ids == ids_of(library, text) and r.n_tokens == len(r.ids) // 4
        assert starts[r.part, r.shard] + r.start_in_shard == at
        at += r.n_tokens
    some = tokenfiles.read_documents(shards, [7, 9]).collect()
    assert {r.doc_id: zlib.crc32(r.ids) for r in some} == {r.doc_id: zlib.crc32(r.ids) for r in found if r.doc_id in (7, 9)}
    with pytest.raises(ValueError):
        tokenfiles._shard(0, 0, [1], [array.array("I", [60_000]).tobytes()], tokenfiles.VOCABULARY, 1)


def test_token_files_of_nothing(spark, docs):
    folder = staged_path(spark, "test-files")
    tokenfiles.write_shards(docs.limit(0), folder)
    shards = tokenfiles.read_shards(spark, folder)
    assert tokenfiles.read_documents(shards).count() == 0 and tokenfiles.shard_starts(shards).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for rounds in (1, 3, 6):
        lengths = rng.integers(1, 60, 200)
        ids = rng.integers(0, 6, lengths.sum())
        symbols, starts, rules = tokenfiles.compress(ids, lengths, 100, rounds, limit=30, least=2)
        assert (tokenfiles.expand(symbols, rules, 100) == ids).all()
        assert len(symbols) < len(ids) and len(rules) > 0
        each = tokenfiles.lengths_of(rules, 100)
        assert [len(tokenfiles.expand(np.array([100 + k]), rules, 100)) for k in range(len(rules))] == each.tolist()
        ends = [*starts[1:], len(symbols)]
        width = np.where(symbols < 100, 1, np.r_[each, 0][np.clip(symbols.astype(int) - 100, 0, len(each))])
        assert [int(width[a:b].sum()) for a, b in zip(starts, ends)] == lengths.tolist()
