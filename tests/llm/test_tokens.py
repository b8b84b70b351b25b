"""Encoding, packing and token files against the library and by counting."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.bpe import Encoder, default_tokenizer, encoder_of
from spanloom.llm.common import tidy
from spanloom.llm.packing import min_slack_pattern, pack_documents, pack_plan, padding, sequence_ids
from spanloom.llm.tokenfile import read_document, read_token_file, train_dictionary, write_token_file

ODD = [
    "", None, "a", " lead", "trail ", "two  spaces", "tab\there", "a\n\nb", "\n", " ", "one\ntwo\nthree", "l'été d'un we'll 'tis", "x\x00y", "<|endoftext|> inside", "日本語 テスト。 終",
    "123abc!? a.b.c 3.14 5's", "é! ß, œuvre... naïve", "…!… a…b", "nbsp here and 　 there", "emoji 😀! ok", "a'b''c '' '", "under_score __init__ @home #tag", "\u0085next", "end\r\nline",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer(), remembered=5000)


def test_odd_texts_encode_like_the_library(encoder):
    for _ in range(2):
        for text, ids in zip(ODD, encoder.encode_many(ODD), strict=True):
            assert ids == (encoder.whole(text) if text else b""), text


def test_added_tokens_have_their_own_ids(encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_tokenizer())
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a <|endoftext |> b", "plain words"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(text or "", add_special_tokens=False).ids, text
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzA É9ß'.,! \n-_ñ…日 "), max_size=60), max_size=6))
def test_any_text_encodes_like_the_library(texts):
    e = encoder_of(default_tokenizer())
    assert e.encode_many(texts) == [e.whole(t) if t else b"" for t in texts]


def test_forgetting_changes_nothing(encoder):
    words = [f"{a}{b}{c} " for a in "bdfg" for b in "aeiou" for c in ("ling", "nox", "qrst", "zzyx")]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(words, 300)).strip() + str(i) for i in range(300)]
    small = Encoder(default_tokenizer(), remembered=40)
    assert small.encode_many(texts) == [encoder.whole(t) for t in texts]


def test_pattern_fills_as_full_as_any_subset():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = defaultdict(int)
        for x in rng.integers(1, 40, 8):
            counts[int(x)] += 1
        seed = max(counts)
        used, slack = min_slack_pattern(dict(counts), seed, 60)
        assert sum(x * k for x, k in used.items()) == 60 - slack and all(k <= counts[x] for x, k in used.items()) and used[seed] >= 1
        left = [x for x, k in counts.items() for _ in range(k - (x == seed))]
        sums = {0}
        for x in left:
            sums |= {s + x for s in sums}
        assert 60 - slack == seed + max(s for s in sums if s <= 60 - seed)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(9)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 20, 30), strict=True)}
    rows, tail, sequences, _ = pack_plan(histogram, 64)
    placed = defaultdict(int)
    for length, first, end, *_ in rows:
        placed[length] += end - first
    for length, first, _ in tail:
        placed[length] += histogram[length] - first
    assert dict(placed) == histogram
    # Every planned sequence is full, or needs no padding as a power of two.
    fill = defaultdict(int)
    for length, first, end, sequence, k, _ in rows:
        for i in range(end - first):
            fill[sequence + i // k] += length
    assert len(fill) == sequences and all(n == 64 or n & (n - 1) == 0 for n in fill.values())


def test_windows_with_little_slack_are_placed():
    assert pack_plan({2040: 500}, 2048, 16)[:3] == ([(2040, 0, 500, 0, 1, 0)], [], 500)
    assert pack_plan({1020: 500}, 2048, 16)[:3] == ([(1020, 0, 500, 0, 2, 0)], [], 250)
    # A third of each window left open is too much: the next piece's head fills it.
    rows, tail, sequences, cuts = pack_plan({1500: 1_000_000}, 2048, 16)
    assert (rows, tail, sequences) == ([], [(1500, 0, 0)], 0)
    last = 1_500_000_000 % 2048
    assert len(cuts) == last.bit_count()
    assert pack_plan({512: 1}, 2048, 16)[:3] == ([(512, 0, 1, 0, 1, 0)], [], 1)
    for fill in range(1, 65):
        assert padding(fill, 64) == (0 if fill in (1, 2, 4, 8, 16, 32, 64) else 64 - fill)


def test_half_of_all_pieces_of_one_length(spark):
    """Pieces of 47 of 64 leave too much open; all but a few are cut, and nothing is encoded twice."""
    e = encoder_of(default_tokenizer())
    text = "word " * 45 + "end"
    n = len(e.encode(text)) // 4 + 1
    docs = spark.createDataFrame([(i if i % 3 else None, text) for i in range(600)], "doc_id bigint, text string")
    rows = pack_documents(docs, window=64, broadcast_rows=10).collect()
    assert n == 47 and sum(r["length"] for r in rows) == 600 * n
    ids = e.encode(text) + b"\x01\0\0\0"
    assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in rows)
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert all(x == 64 or x & (x - 1) == 0 for x in fill.values()) and len(fill) <= 600 * n // 64 + 6


@pytest.mark.parametrize("n", [9, 10, 12, 13])
def test_pieces_whose_weak_hashes_meet_are_told_apart(n):
    a = "a"
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    small = Encoder(default_tokenizer(), remembered=50)
    texts = [a, b, f"{a} {b}", f"x {b} y {a}", b, a]
    for _ in range(2):
        assert small.encode_many(texts) == [small.whole(t) for t in texts]
    assert small.encode(a) != small.encode(b)


def test_one_thing_is_held_at_a_time():
    first = encoder_of(default_tokenizer())
    assert encoder_of(default_tokenizer()) is first
    assert list(tidy(lambda rows: iter(rows), "encoder")([1, 2])) == [1, 2] and encoder_of(default_tokenizer()) is first
    list(tidy(lambda rows: iter(rows))([]))
    assert encoder_of(default_tokenizer()) is not first


DOCS = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * n + "end") for i, n in enumerate([1, 30, 63, 64, 200, 333, 200, 200])] + [(7, "again"), (7, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id bigint, text string, length string, start int")


@pytest.mark.parametrize("limit", [20_000, 0])
def test_packing_keeps_every_id_once(spark, docs, encoder, limit):
    rows = pack_documents(docs, window=64, broadcast_rows=limit).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding == 0
    wanted = defaultdict(list)
    for i, t in DOCS:
        wanted[i].append(encoder.encode(t) + b"\x01\0\0\0")
    assert set(pieces) == set(wanted)
    for i, texts in wanted.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[i])
        assert sum(n for _, n, _ in own) == sum(len(t) // 4 for t in texts)
        for s, n, crc in own:
            assert crc in {zlib.crc32(t[4 * s : 4 * (s + n)]) for t in texts}
    assert sorted(sequences) == list(range(len(sequences)))


def test_packed_sequences_can_be_had(spark, docs, encoder):
    out = sequence_ids(docs, window=64, slack=5).collect()
    wanted = [encoder.encode(t) + b"\x01\0\0\0" for _, t in DOCS]
    assert sum(len(r["ids"]) for r in out) == sum(len(x) // 4 for x in wanted)
    assert all(len(r["ids"]) <= 64 and r["padding"] == (0 if len(r["ids"]) & (len(r["ids"]) - 1) == 0 else 64 - len(r["ids"])) <= 5 for r in out)
    # Every id of every document is there, as often as it is in the documents.
    assert np.sort(np.concatenate([r["ids"] for r in out])).tolist() == np.sort(np.frombuffer(b"".join(wanted), "<u4")).tolist()


def test_packing_of_nothing(spark, docs):
    assert pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="window"):
        pack_documents(docs, window=1)
    with pytest.raises(ValueError, match="missing"):
        pack_documents(docs.drop("text"))


def test_token_files_read_back_what_was_written(spark, docs, encoder, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_token_file(docs, path, block_docs=5)
    rows = read_token_file(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in DOCS), key=lambda i: (i is not None, i))
    wanted = defaultdict(list)
    for i, t in DOCS:
        wanted[i].append(encoder.encode(t) + b"\x02\0\0\0")
    at = 0
    for r in rows:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert raw in wanted[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(raw)
        at += r["n_tokens"]
    assert read_document(spark, path, 11) == [np.frombuffer(wanted[11][0], "<u4").tolist()]
    assert len(read_document(spark, path, 7)) == 3 and read_document(spark, path, 999) == []


def test_a_foreign_dictionary_is_refused(spark, docs, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    write_token_file(docs.where("doc_id < 10"), a)
    write_token_file(docs.where("doc_id >= 100"), b)
    spark.read.parquet(f"{b}/blocks").write.mode("append").parquet(f"{a}/blocks")
    with pytest.raises(Exception, match="dictionary"):
        read_token_file(spark, a).collect()


def test_empty_token_file(spark, docs, tmp_path):
    write_token_file(docs.limit(0), f"file://{tmp_path}/none")
    assert read_token_file(spark, f"file://{tmp_path}/none").count() == 0
    assert train_dictionary([]) == b""
