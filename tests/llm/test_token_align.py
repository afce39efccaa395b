"""Cross-tokenizer alignment against whole-text tokens cut by their bytes alone."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import token_align
from tests.llm.fixtures import edge, edge_rows, empty, save

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    "Hello wörld\nnext 日本🙂 done", "a  b ", " x", "ﬁ① ﬁ①", "a\xa0b c", "a▁b", "a▁ b", "\n", "\nword", "a\n\nb", "a \n b", "tab\tword x",
    "<|endoftext|> a <|endoftext|>", "<s> </s> <unk> <0x41>", "it's we'll 'S ' t", "12345 3.14!!! ??", "é́é é x", "🙂" * 40 + " 🙂\n🙂",
    "x" * 3000 + " y", "\x00 \x1c a\x1cb \x85z", "naïve\nnaïve naïve", "word\r\nword\r\n", "  ", "ﾊﾝｶｸ ｶﾅ　ideographic", "a​b ﻿ c",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    table = {}
    spare = 0
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            table[chr(byte)] = byte
        else:
            table[chr(256 + spare)] = byte
            spare += 1
    return a, b, table


def brute(texts, tools):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) per text, from decoded bytes."""
    a, b, table = tools
    rows = []
    for text in texts:
        text = text or ""
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_data = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
        b_data = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        whole = (" " + text).encode()
        if not text or b"".join(a_data) != whole or b"".join(b_data) != whole:
            rows.append(([], [], [], []))
            continue
        ends = []
        for data in (a_data, b_data):
            at, mine = 0, {}
            for i, x in enumerate(data):
                at += len(x)
                mine[at] = i
            ends.append(mine)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, a_ids[i:ends[0][c] + 1])) + "|" + ",".join(map(str, b_ids[j:ends[1][c] + 1])))
            i, j = ends[0][c] + 1, ends[1][c] + 1
            links.append((a_ids[i - 1], b_ids[j - 1]))
        rows.append((a_ids, b_ids, groups, links))
    counts = Counter(x for r in rows for x in r[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (len(a_ids), len(b_ids), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a_ids, b_ids, groups, links in rows]


def check(df, rows, tools):
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], tools), strict=True))


def test_given_texts(spark, tools):
    root = "/root/testdata/sf0.001"
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    check(token_align.query(spark, root), rows, tools)


def test_awkward_texts(spark, tools, tmp_path):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [r[:2] for r in edge_rows()]
    folder = save(spark, [(i, t, None, None, 0) for i, t in rows], tmp_path)
    check(token_align.query(spark, folder), rows, tools)


def test_chunks_and_whole_texts_agree(spark):
    by_chunk, whole = token_align.Aligner(*PATHS), token_align.Aligner(*PATHS)
    assert by_chunk.by_chunk
    whole.by_chunk = False
    texts = AWKWARD + [d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for text in texts:
        assert by_chunk([text]) == whole([text]), text[:80]
    assert by_chunk(texts) == whole(texts)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_align, "MEMO_ENTRIES", 8)
    aligner = token_align.Aligner(*PATHS)
    text = " ".join(f"word{i % 37}" for i in range(400))
    first = aligner([text])
    assert aligner([text]) == first == token_align.Aligner(*PATHS)([text])
    for i in range(20):  # what was met before the last two generations is forgotten
        aligner([f"new{i} new{i + 1}", "x" * 60 + f" {i}"])
    assert len(aligner.young) <= 16 and len(aligner.old) <= 16 and not any(len(c) > 48 for c in aligner.young)


def test_shape_and_empty_table(spark):
    got = token_align.align(edge(spark).withColumn("n_a", F.lit("mine")), *PATHS, keep=["doc_id", "lang", "size", "n_a"])
    assert got.columns == ["doc_id", "lang", "size", "n_a", "n_b", "n_groups", "groups", "links"]
    assert got.filter("doc_id = 6").first().groups.count("|") == got.filter("doc_id = 6").first().n_groups
    none = token_align.align(empty(spark), *PATHS, keep=["doc_id"])
    assert token_align.rate_links(none, token_align.pair_counts(none)).count() == 0
