"""Token counts, ids and pieces against the libraries; packing against its laws."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rainloom.llm import packing, pieces, tokens
from rainloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary())


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model())


PARTS = [
    "a", "B", "'s", "'S", " ", "  ", "\t", "\x1c", "\x85", " ", "É", "é", "Σ", "ΑΣ", "İ", "1", "²", "!?", "<|endoftext|>", "<|start", "日本",
    "🦊", "​", "_", "ß", "the ", "ing", "▁", "<s>", "<0x0A>", "\x00", " " * 15,
]


def random_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_counts_agree_with_the_library(library):
    counter, ids = tokens.pair_counter(tokens.vocabulary()), tokens.ids(tokens.vocabulary())
    for t in random_texts(4000):
        expected = library.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(expected), t
        assert np.frombuffer(ids.text(t), "<u4").tolist() == expected, t


def test_heap_takes_lowest_rank_then_leftmost():
    c = tokens.PairCounter.__new__(tokens.PairCounter)
    c.rank = {("a", "a"): 1, ("b", "c"): 0, ("aa", "a"): 2}
    assert c.merges(list("aaabc")) == 3  # bc, aa, aaa
    assert c.merges(["x"]) == 0 and c.merges([]) == 0


def test_count_query_on_whole_table(spark, data_dir, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, data_dir).collect()}
    for d, t in texts:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_count_edges(awkward, empty):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(awkward).collect())
    assert got[1, 0] == got[2, 0] == got[3, 0] == 1 and got[11, 1] == 2
    assert tokens.count_tokens(empty).count() == 0


def test_pieces_agree_with_the_library(processor):
    m = pieces.merger(pieces.model())
    for t in random_texts(4000) + [" " * n + w for n, w in product(range(40), ("", "a", "the"))]:
        expected = processor.encode(t, add_bos=True, add_eos=True)
        ids = m.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == expected, t
        assert m.decode(ids) == processor.decode(expected), t


def test_search_equals_merging():
    """Stepping back finds what merging finds, also where longest matches fail."""
    m, rng = pieces.merger(pieces.model()), random.Random(3)
    stepped = 0
    for _ in range(3000):
        t = "▁" + "".join(rng.choice("thestionanderhwl") for _ in range(rng.randrange(1, 14)))
        assert m.search(t) == m.merge(t)
        stepped += m.longest(t) is None
    assert stepped > 300


def test_decode_of_any_ids(processor):
    m, rng = pieces.merger(pieces.model()), random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259), 1, 2, m.id["▁"]]) for _ in range(rng.randrange(8))]
        assert m.decode(np.array(ids, "<u4").tobytes()) == processor.decode(ids), ids


def test_piece_query_on_whole_table(spark, data_dir, texts, processor):
    got = {r["doc_id"]: r for r in QUERIES["op5_piece_encoding"](spark, data_dir).collect()}
    for d, t in texts:
        ids = processor.encode(t, add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), digest(np.array(ids, "<u4").tobytes()))
        assert got[d]["decoded_sha256"] == digest(processor.decode(ids).encode())


def test_piece_edges(awkward, empty):
    got = [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in pieces.encode(awkward, keep=True).collect()]
    assert (1, 2, "") in got and (2, 2, "") in got and sum(d == 11 for d, _, _ in got) == 2
    assert pieces.encode(empty).count() == 0


# --- packing ---------------------------------------------------------------------


def brute_fill(lengths, room):
    sums = {0}
    for k, n in lengths.items():
        sums = {s + k * c for s in sums for c in range(n + 1) if s + k * c <= room}
    return max(sums)


def test_fill_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(300):
        lengths = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(0, 90)
        got = packing.fill(lengths, room)
        assert all(0 < n <= lengths[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == brute_fill(lengths, room)


def test_fillings_use_everything_once():
    rng = random.Random(2)
    for _ in range(50):
        histogram = Counter(rng.randrange(1, 64) for _ in range(rng.randrange(0, 400)))
        used = Counter()
        plan = packing.fillings(histogram, 64)
        for times, counts in plan:
            assert times > 0 and sum(k * n for k, n in counts.items()) <= 64
            for k, n in counts.items():
                used[k] += times * n
        assert used == histogram
        total = sum(k * n for k, n in histogram.items())
        assert sum(t for t, _ in plan) <= 1.1 * total / 64 + 2


def check_packing(got, expected, window):
    """Pieces are those of the documents, sequences are gapless and within the window."""
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= window
    return len(by)


def pieces_of(rows, library, window):
    out = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END]
        for s in range(0, len(ids), window):
            part = ids[s : s + window]
            out[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    return out


def test_packing_query_on_whole_table(spark, data_dir, texts, library):
    got = QUERIES["op6_bin_slack_packing"](spark, data_dir).collect()
    n = check_packing(got, pieces_of(texts, library, 4096), 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_packing_edges(awkward, empty, library):
    from tests_llm_data import AWKWARD

    check_packing(packing.pack(awkward, window=64).collect(), pieces_of(AWKWARD, library, 64), 64)
    assert packing.pack(empty).count() == 0


def test_characters_of_other_unicode_versions(library):
    """Letters and unassigned code points that Python's tables see otherwise, alone and beside others."""
    counter, ids = tokens.PairCounter(tokens.vocabulary()), tokens.Ids(tokens.vocabulary())
    for c in ["Ᲊ", "Ɤ", "՘", "͸", "\U00010d50", "\U0001e030", *map(chr, range(0x1c80, 0x1c90)), *map(chr, range(0xa7c0, 0xa7e0))]:
        for t in (c, f"Ab{c}cd 1{c}{c} .{c}.", f"é{c}É"):
            expected = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids.text(t), "<u4").tolist() == expected, t
            assert counter.count(t) == len(expected), t


def test_long_words_are_not_kept():
    from rainloom.llm.common import Cache

    cache, calls = Cache(3), []
    make = lambda new: calls.extend(new) or list(map(len, new))
    long = "x" * (Cache.LONG + 1)
    assert cache.all(["a", long, "a", long], make) == [1, len(long), 1, len(long)] and calls == ["a", long]
    assert cache.all([long, "a"], make) == [len(long), 1] and calls == ["a", long, long]
    assert max(map(len, [*cache.new, *cache.old])) <= Cache.LONG
