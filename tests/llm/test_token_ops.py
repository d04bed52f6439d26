import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import packing, token_counts, token_files
from tidemill.llm.word_bpe import WordCoder

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world\n\nit's", "<|endoftext|>a <|startoftext|>", "ΣΑΣ ñ́ é x ́y", "a\tb\x0bc\x1cd e", "\x01 \x01\x01", "word " * 3000, "x" * 20000, "日本語 テキスト 🙂🙂", "A" * 5 + " b"]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "k", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long")  # clashing names


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


coder = WordCoder(BPE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,\x01́<|>")), max_size=40), min_size=1, max_size=6))
def test_word_coder_equals_the_tokenizer(texts):
    ids, bounds = coder.encode([t.encode() for t in texts], 2)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*coder.coder.encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("'stremvld<|ÀßÿªµºİΣς²½\u00ad\u0301")), max_size=12), min_size=1, max_size=8))
def test_short_way_equals_the_tokenizer(words):
    assert coder.merge is not None
    ids, counts = coder._encoded([w for w in words if " " not in w] or ["a"])
    want = [coder.coder.encode(w, add_special_tokens=False).ids for w in words if " " not in w] or [coder.coder.encode("a", add_special_tokens=False).ids]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_every_latin_letter_in_a_word():
    for c in map(chr, range(0x21, 0x250)):
        for w in (c, f"a{c}b", f"{c}'s1{c}", f"X{c}{c}.,"):
            if not w.isspace() and " " not in w:
                assert coder._encoded([w])[0].tolist() == coder.coder.encode(w, add_special_tokens=False).ids, repr(w)


def test_word_coder_forgets_without_effect(plain):
    c = WordCoder(BPE, most=3)
    for _ in range(3):
        for t in TEXTS[3:8]:
            assert c.encode([t.encode()], 2)[0].tolist() == plain(t)


def test_token_counts(spark, tmp_path):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = f"file://{tmp_path}/cache"
    many = [*TEXTS, *TEXTS[3:6], None]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, many), PIECES, cache, limit=100).collect()}
    assert len(got) == len(many)
    for i, t in enumerate(many):
        n = len(m.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit, got[i].cached) == (n, len((t or "").encode()), n > 100, False)
    again = token_counts.count_tokens(docs(spark, [*many, "quite new"]), PIECES, cache).collect()
    assert sum(not r.cached for r in again) == 1
    assert spark.read.parquet(cache).count() == len({t or "" for t in many}) + 1  # each content encoded once
    other = token_counts.count_tokens(docs(spark), BPE, cache)  # another tokenizer never meets the counts
    assert not any(r.cached for r in other.collect())


def test_each_content_is_encoded_once(spark, tmp_path):
    """Also where ids repeat or are null; counted by the rows that are appended to the cache."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, "a b"), (1, "c"), (None, "d"), (2, "a b"), (None, None), *[(7, "the same")] * 50, *[(None, "none")] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cache = f"file://{tmp_path}/c"
    got = token_counts.count_tokens(df, PIECES, cache).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in got) == sorted((i or 0, len(m.encode(t or "")), len(t or "")) for i, t in rows)
    assert spark.read.parquet(cache).count() == 6
    df.write.parquet(f"file://{tmp_path}/t")
    assert token_counts.count_tokens(spark.read.parquet(f"file://{tmp_path}/t").where("doc_id = 7"), PIECES, cache).where("cached").count() == 50
    assert token_counts.count_tokens(df.limit(0), PIECES, f"file://{tmp_path}/e").count() == 0


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 60).tolist()
        rooms, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
            at = next((k for k, r in enumerate(rooms) if r >= lengths[i]), None)
            if at is None:
                rooms.append(100)
                at = len(rooms) - 1
            rooms[at] -= lengths[i]
            want[i] = at
        assert packing.first_fit_decreasing(lengths, 100) == want


def check_packed(rows, plain, texts, room):
    got, ends = {}, {}
    for r in rows:
        ids = plain(texts[r.doc_id])
        piece = np.array(ids[r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(got[i]):
            assert start == at
            at += n
        assert at == len(plain(t))
    for pieces in ends.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= room
    return ends


def test_packing(spark, plain):
    rows = packing.pack(docs(spark), BPE).collect()
    ends = check_packed(rows, plain, TEXTS, 4096)
    assert len(ends) <= -(-sum(len(plain(t)) for t in TEXTS) // 4096) + 1
    check_packed(packing.pack(docs(spark), BPE, room=16, group_docs=3).collect(), plain, TEXTS, 16)
    assert packing.pack(docs(spark).limit(0), BPE).count() == 0
    ties = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert packing.pack(ties, BPE).count() == 3
    many = spark.createDataFrame([(None, "the same text of a few words")] * 2000 + [(None, "word " * 9000)], "doc_id long, text string").repartition(3)
    rows = packing.pack(many, BPE, group_docs=100).collect()  # a repeated row fills no group by itself
    parts = {}
    for r in rows:
        if r.sequence_id >= 0:
            parts[r.sequence_id >> 32] = parts.get(r.sequence_id >> 32, 0) + 1
        else:
            assert (r.length, r.offset) == (4096, 0)
    assert max(parts.values()) < 200 and len(parts) > 15 and len(rows) == 2003 and len({r.sequence_id for r in rows if r.sequence_id < 0}) == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, (1 << 32) - 1)), min_size=1, max_size=700), st.sampled_from([(0.0,), (0.5,), (1.0,), token_files.SHARES]))
def test_blocks_round_trip(values, shares):
    low, width, extra, start, high, data = token_files.encode_blocks(np.array(values, np.int64), shares)
    assert token_files.decode_blocks(low, width, extra, start, high, np.frombuffer(data, np.uint8))[: len(values)].tolist() == values


def test_outliers_go_to_the_exception_list():
    ids = np.full(256, 5)
    ids[[3, 200]] = 60_000
    _, width, extra, _, high, data = token_files.encode_blocks(ids)
    assert width.tolist() == [0] and extra.tolist() == [2] and len(data) == 2 * (1 + high) == 6


def test_token_files(spark, plain, tmp_path):
    shuffled = docs(spark).repartition(3)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(shuffled, BPE, folder, file_ids=200)
    assert manifest.count() > 2
    assert token_files.read_token_files(manifest, folder).rdd.getNumPartitions() == manifest.count()  # no task reads all files
    rows = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        ids = plain(TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(TEXTS)
    ties = spark.createDataFrame([(None, "b"), (2, "x"), (2, "a"), (None, None)], "doc_id long, text string")
    got = sorted(token_files.round_trip(ties, BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 2] and len(got) == 4
    assert token_files.round_trip(ties.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        token_files.parse_file(b"nope" * 20)
