"""Packing, token store and SentencePiece against the libraries themselves."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from casemill.llm import packing, piece_ids, token_store
from casemill.llm.word_ids import WordIds
from casemill.session import scratch_dir

from fixtures_llm import FOLDER, edge_rows

QUERIES = entry_points.queries()
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ids_of(text, end):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]
    return np.array(ids, dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_are_the_librarys(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordIds().encode(text), "<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\té日"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_the_librarys(text):
    table = piece_ids.chunk_table()
    want = PIECES.encode(text, add_eos=True)
    assert table.encode(text) == want
    assert table.decode(text) == PIECES.decode(want)


def test_tables_turn_over(monkeypatch, texts):
    monkeypatch.setattr(piece_ids, "MOST_CHUNKS", 50)
    monkeypatch.setattr("casemill.llm.word_ids.MOST_CHUNKS", 50)
    table, words = piece_ids.ChunkTable(), WordIds()
    for text in list(texts.values())[:40]:
        assert table.encode(text) == PIECES.encode(text or "", add_eos=True)
        assert words.encode(text) == ids_of(text, 0)[:-1].tobytes()


def piece_digest(text):
    ids = PIECES.encode(text or "", add_eos=True)
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(PIECES.decode(ids).encode()).hexdigest(),
    )


def test_sentencepiece_query(spark, texts):
    got = QUERIES["op9_sentencepiece"](spark, FOLDER).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: piece_digest(t) for i, t in texts.items()}


def test_sentencepiece_edges(edge, nothing):
    got = Counter(tuple(r) for r in piece_ids.encode_decode(edge).collect())
    assert got == Counter((i, *piece_digest(t)) for i, t in edge_rows())
    assert piece_ids.encode_decode(nothing).collect() == []


def stored(rows, end=2):
    out, start = [], 0
    for i, text in rows:
        ids = ids_of(text, end)
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store_query(spark, texts):
    got = QUERIES["op4_token_store"](spark, FOLDER).collect()
    assert sorted(tuple(r) for r in got) == stored(sorted(texts.items()))


def test_token_store_edges(spark, edge, nothing):
    got = [tuple(r) for r in token_store.round_trip(edge, shard_ids=500).orderBy("start").collect()]
    want = stored([(r[0], None) for r in edge_rows()])
    assert [g[0] for g in got] == sorted((w[0] for w in want), key=lambda i: (i is not None, i))
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter(
        (i, s[2], s[3]) for i, t in edge_rows() for s in stored([(i, t)])
    )
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert token_store.round_trip(nothing).collect() == []


def test_random_access(spark, texts, small):
    path = scratch_dir(spark, "shards")
    token_store.write(small, path, 2, shard_ids=20_000)
    rows = spark.read.parquet(path).collect()
    assert len(rows) > 2 and any(len(r.rounds) for r in rows)
    for row in rows:
        shard = token_store.Shard(row.asDict())
        whole = shard.ids()
        for k, doc in enumerate(shard.doc_ids):
            assert shard.document(k).tolist() == ids_of(texts[doc], 2).tolist()
        for start, stop in ((0, 1), (7, 900), (len(whole) - 3, len(whole)), (0, len(whole))):
            assert shard.slice(start, stop).tolist() == whole[start:stop].tolist()
        assert int(np.max(shard.expansions, initial=1)) >= 2 or not len(shard.expansions)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=200), max_size=8))
def test_grammar_round_trip(documents):
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    ids = np.array([i for d in documents for i in d], dtype=np.uint32)
    g = token_store.compress(ids, lengths, least=2)
    assert token_store.expand(g["symbols"], g["first_rule"], g["rules"], g["rounds"]).tolist() == ids.tolist()
    assert int(g["symbol_counts"].sum()) == len(g["symbols"])
    weights = [len(token_store.expand(np.array([g["first_rule"] + k]), g["first_rule"], g["rules"], g["rounds"])) for k in range(len(g["rules"]))]
    assert weights == g["expansions"].tolist()


def most_replaceable(symbols, counts):
    """Greatest number of uses that any pair inside a document has, overlaps of equal symbols halved."""
    found, at = Counter(), 0
    for n in counts:
        doc = [int(x) for x in symbols[at : at + n]]
        at += n
        found.update(zip(doc, doc[1:]))
    return max(((n + 1) // 2 if a == b else n for (a, b), n in found.items()), default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=8), st.integers(2, 7))
def test_grammar_ends_when_no_rule_pays(docs, least):
    ids = np.array([x for d in docs for x in d], dtype="<u4")
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    g = token_store.compress(ids, lengths, least=least)
    assert most_replaceable(g["symbols"], g["symbol_counts"]) < least
    shard = token_store.Shard(token_store._row(0, 0, list(range(len(docs))), [i.tobytes() for i in np.split(ids, np.cumsum(lengths)[:-1])] if docs else []))
    assert shard.ids().tolist() == ids.tolist()


def test_grammar_of_copies_takes_few_rounds():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 5000, 400)
    docs = [np.r_[rng.integers(0, 5000, 30 + k), passage, rng.integers(0, 5000, 20)] for k in range(9)]
    lengths = np.array([len(d) for d in docs])
    g = token_store.compress(np.concatenate(docs), lengths)
    assert len(g["rounds"]) < 40 and len(g["symbols"]) < lengths.sum() - 8 * 380


def test_rules_never_widen_the_symbols(monkeypatch):
    monkeypatch.setattr(token_store, "NARROW", 12)
    ids = np.array([0, 1, 2, 3] * 50 + [4, 5, 6, 7] * 40)
    g = token_store.compress(ids, np.array([len(ids)]), least=2)
    assert g["first_rule"] + len(g["rules"]) == 12
    assert token_store.expand(g["symbols"], g["first_rule"], g["rules"], g["rounds"]).tolist() == ids.tolist()



def packed_right(rows, documents, size=2048):
    want = Counter()
    for i, text in documents:
        ids = ids_of(text, 0)
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r.length for r in rows) // size)


def test_packing_query(spark, texts):
    used, least = packed_right(QUERIES["op3_best_fit_packing"](spark, FOLDER).collect(), texts.items())
    assert used <= least + max(1, least // 50)


def test_packing_edges(edge, nothing):
    packed_right(packing.pack(edge).collect(), edge_rows())
    packed_right(packing.pack(edge, size=64).collect(), edge_rows(), 64)
    assert packing.pack(nothing).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_places_every_piece(counts):
    classes = packing.plan(counts, 64)
    placed = Counter()
    for inside, sequences in classes:
        assert sequences > 0 and sum(n * c for n, c in inside) <= 64
        for n, c in inside:
            placed[n] += c * sequences
    assert placed == Counter(counts)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 2049, 20_000)
    used = sum(n for _, n in packing.plan(Counter(lengths.tolist())))
    # pieces above half a sequence cannot share one
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert used <= 1.02 * least


@pytest.mark.parametrize("counts", [{2048: 3}, {1: 5000}, {700: 9}, {}])
def test_plan_of_one_length(counts):
    used = sum(n for _, n in packing.plan(dict(counts)))
    assert used == sum(-(-c // (2048 // n)) for n, c in counts.items())
