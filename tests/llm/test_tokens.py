"""Byte-level BPE and Simple-8b files against the public libraries and exact round trips."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import bpe_fst, chunks, simple8b
from tests.llm.fixtures import edge, edge_rows, empty, save

ROOT = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe_fst.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = bpe_fst.Transducer(RANKS)


def ids_of(text):
    return np.frombuffer(chunks.encode_text(text, *bpe_fst._encoder(PATH, public_tokenizers.PATTERN)), dtype=np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encode_any_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_encode_mixed_texts():
    rng = random.Random(3)
    bits = ["a", "th", "in", "er", " ", "  ", "\n", "\n\n", "'s", "é", "漢", "🎉", "1", "23", "!", "\t", "\x1c", "\xa0", "\r\n", "ing", "ooo", "\x85", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 25)))
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_machine_equals_merges_on_any_bytes(data):
    whole = RANKS.get(data)
    assert MACHINE.encode(data) == ([whole] if whole is not None else [RANKS[p] for p in MACHINE.merged(data)])


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "aA0" * 7_000, " " * 9_000 + "x", "thntention" * 3_000])
def test_very_long_pieces(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_bounded_states_change_nothing():
    tight = bpe_fst.Transducer(RANKS, limit=5)
    for text in ["international", "thntentioning", "éèê" * 40, "zqxj" * 30]:
        assert tight.encode(text.encode()) == MACHINE.encode(text.encode())
    assert len(tight.states) <= 6


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.lists(st.integers(1, 7), min_size=1))
def test_utf8_machine_at_any_cut(data, cuts):
    stream, out, at = bpe_fst.Utf8Stream(), "", 0
    for n in cuts * 80:
        out += stream.feed(data[at:at + n])
        at += n
    assert out + stream.feed(data[at:]) + stream.end() == data.decode("utf-8", "replace")


def test_bpe_query(spark, tmp_path):
    rows = [(r.doc_id + 1000, r.text, None, None, 0) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] + edge_rows()
    got = Counter(map(tuple, bpe_fst.query(spark, save(spark, rows, tmp_path)).collect()))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want[(doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest())] += 1
    assert got == want


def test_bpe_on_awkward_tables(spark):
    out = bpe_fst.decode(bpe_fst.encode(edge(spark), PATH), PATH)
    assert out.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and out.count() == len(edge_rows())
    assert out.columns == [*edge(spark).columns, "ids", "decoded"]
    assert bpe_fst.encode(empty(spark), PATH).count() == 0
    odd = spark.createDataFrame([([50_000_000, -3, RANKS[b"a"]],), (None,), ([],), ([RANKS[b"\xc3"]],)], "ids array<int>")
    assert [r.decoded for r in bpe_fst.decode(odd, PATH).collect()] == ["��a", "", "", "�"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=150), min_size=1, max_size=6))
def test_words_round_trip(docs):
    lens = np.array([len(d) for d in docs])
    ids = np.array([x for d in docs for x in d], dtype=np.uint64)
    words, offsets = simple8b.pack(ids, lens)
    assert simple8b.unpack(words, lens, offsets).tolist() == ids.tolist()
    for k in range(len(docs)):  # one document alone
        end = offsets[k + 1] if k + 1 < len(docs) else len(words)
        assert simple8b.unpack(words[offsets[k]:end], lens[k:k + 1], np.array([0])).tolist() == docs[k]


def test_one_pass_equals_two(spark, monkeypatch):
    docs = edge(spark).withColumn("ids", F.lit("mine"))
    monkeypatch.setattr(bpe_fst, "GROUP_BYTES", 50)
    two = bpe_fst.decode(bpe_fst.encode(docs, PATH, keep=["doc_id", "text"]), PATH)
    one = bpe_fst.round_trip(docs, PATH, keep=["doc_id", "text", "ids"])
    assert one.columns == two.columns and Counter(map(str, one.collect())) == Counter(map(str, two.collect()))
    assert bpe_fst.round_trip(empty(spark), PATH).count() == 0


def test_small_ids_share_words():
    words, _ = simple8b.pack(np.ones(600, dtype=np.int64), np.array([600]))
    assert len(words) == 10
    words, _ = simple8b.pack(np.full(600, 2**61, dtype=np.uint64), np.array([600]))
    assert len(words) == 1200


def test_id_file(spark, tmp_path):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    rows = [(r.doc_id + 1000, r.text, None, None, 0) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] + edge_rows()
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>\nz <|endoftext|>", "  lead <|endoft ext|>", "a\0 b", "a  b\n\nc\t d\u00a0e \n"]
    rows += [(5000 + i, t, None, None, 0) for i, t in enumerate(special)]
    got = simple8b.query(spark, save(spark, rows, tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    keys = {r[0]: r[1] for r in rows}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        want.append(r.doc_id)
    assert want == sorted(want, key=lambda i: (i is not None, i or 0)) and Counter(want) == Counter(r[0] for r in rows)
    for r in got:
        ids = tokenizer.encode(keys[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_joined_chunks_keep_every_text(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = simple8b._encoder.__wrapped__(path)
    monkeypatch.setattr(chunks, "MEMO_ENTRIES", 10)
    monkeypatch.setattr(chunks, "LEARN", 7)
    texts = ["it's we'll 'S", "é naïve\nnaïve 日本 🙂🙂", "x" * 300 + " y", "12 345\r\n6 ''", "\u0085a \x1cb", "", " a", "a ", "the the\nthe"] * 2
    texts += [" ".join(f"w{i} w{i + 1}," for i in range(k, k + 9)) for k in range(20)]
    for group in (texts, texts[::-1], texts[:3]):
        assert [np.frombuffer(x, dtype=np.int32).tolist() for x in encoder(group)] == [encoder.encode(t) if t else [] for t in group]
    assert len(encoder.young) < 200 and not any(len(c) > chunks.MEMO_CHARS for c in encoder.young)


def test_id_file_gives_ids_back(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = simple8b.write_ids(edge(spark), path, block_ids=50)
    back = simple8b.read_ids(files).collect()
    assert len(back) == len(edge_rows()) and all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in back)
    assert files.count() > 1 and simple8b.read_ids(simple8b.write_ids(empty(spark), path)).count() == 0


def test_a_word_and_its_mark_are_learned_apart():
    encoder = simple8b._encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"))
    asked, plain = [], encoder.encode
    encoder.encode = lambda text: asked.append(text) or plain(text)
    texts = ["some words, some words. words\nwords, é, naïve. 1, 2. it's, ẞ, a.b, c,,", "x" * 60 + ", " + "x" * 60 + ".", "", "  a, b", "q, r <|endoftext|>, s.<|endoftext|>"]
    for _ in range(2):
        assert [np.frombuffer(x, dtype=np.int32).tolist() for x in encoder(texts)] == [plain(t) if t else [] for t in texts]
    learned = "".join(a for a in asked if a not in texts)
    assert " words," not in learned and learned.count(" words") == 1 and not any(len(c) > chunks.MEMO_CHARS for c in encoder.young)


def test_chunks_are_cut_in_bytes_for_all_texts_at_once(monkeypatch):
    rng = random.Random(8)
    encoder = simple8b._encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"))
    bits = ["a", "The", "é", "ß", "×", "÷", "Ł", "ɏ", "ə", "ẞ", "漢", "“", "…", "'s", "9", ",", ".", ",.", " ", " ", "\n", "  ", "\n\n", "\t", "\x1f", "\x85", "\xa0",
            " ", " ", " ", " ", " ", "　", "<|endoftext|>", "x" * 50, "\0"]
    texts = [None, "", *("".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(3000))]
    cut = pa.array(["x", *texts], pa.string()).slice(1)
    for _ in range(2):
        assert [np.frombuffer(x, dtype=np.int32).tolist() for x in encoder(cut)] == [encoder.encode(t) if t else [] for t in texts]
    fresh = simple8b._encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"))
    assert fresh(pa.array(["words, words. words", "naïveté, naïveté\nnaïveté."])) and not any(len(c) > 1 and c[-1] in ",." for c in fresh.young)
    assert fresh([]) == [] and fresh(pa.array([None], pa.string())) == [b""]
    monkeypatch.setattr(simple8b, "GROUP_BYTES", 40)
    batches = [pa.RecordBatch.from_pydict({"i": pa.array(range(k, k + 5), pa.int64()), "t": pa.array(texts[k:k + 5], pa.string())}) for k in range(0, 500, 5)]
    groups = list(simple8b._groups(batches))
    assert len(groups) > 1 and [i for ids, _ in groups for i in ids] == list(range(500)) and [t for _, part in groups for t in part.to_pylist()] == texts[:500]
    assert all(sum(len((t or "").encode()) for t in part.to_pylist()[:-1]) < 40 for _, part in groups)
