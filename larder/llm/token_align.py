"""Cross-tokenizer alignment from the spans that two tokenizer libraries report.

Tokenizer A (byte-level BPE, the tokenizers library) reads a space and the text, tokenizer B
(sentencepiece with byte fallback) the text, to which it adds that space itself. Where tokens of A
and B end on the same byte, both sequences are cut; what lies between two cuts is a group.

1. A's character offsets and the spans of B's protobuf result (the library has renamed its
   immutable proto: ``return_type="proto"``, whose offsets count bytes) are the coarse cuts. A span
   tells where its token ends unless several tokens share a character: then A gives all of them
   the character's span and B gives all but the last an empty one, and the ends are refined by the
   lengths of the decoded bytes.
2. Neither tokenizer lets a token go on after a single blank or line feed into the next word, so a
   text is put together from its chunks' alignments. New chunks are aligned many at a time, joined
   to one text, and a worker remembers the chunks it met last, some ``MEMO_ENTRIES`` in each of two
   generations. A vocabulary with a piece that spans a blank is aligned text by text.
3. Each group links the A token and the B token that end with it. Links are counted over the whole
   corpus. One of two linked tokens' bytes ends with the other's, so there are at most as many
   kinds of pair as both vocabularies have bytes: about half a million for the given ones, 6 MB.
   That table alone goes to the driver and back to the tasks.

Edge cases: a text that is null, empty, or not given back byte by byte by both tokenizers (say, one
that holds U+2581) has no tokens; the strings of special tokens are plain text; a very long text is
one row of one task; repeated rows count as often as they occur; an empty table gives an empty
result. Of a table's own columns, those of ``keep`` stay; result columns replace them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.chunks import plain_spaces
from larder.llm.common import documents, stored, worker_tool

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
MEMO_ENTRIES = 200_000
LEARN = 4096  # new chunks that are aligned in one text
GROUP_CHARS = 1 << 18  # of texts whose chunks are looked up together
MEMO_CHARS = 48
PAIR_BASE = 1 << 16  # a link is stored as b * PAIR_BASE + a
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
SPAN_OF_BLANK = re.compile("[^▁]▁")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for, by that scheme's rule:
    printable bytes are themselves, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns one text, or chunks of it, at a time."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_level_alphabet()
        known = {i: self._a_bytes(t, alphabet) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(known, default=0) >= PAIR_BASE:
            raise ValueError("links are stored for A vocabularies of up to 65,536 tokens")
        self.a_bytes = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in known]) for known in (self.a_bytes, self.b_bytes))
        marks = ",|,;"  # after a token of A, the group's last of A, a token of B, the group's last of B
        self.spelled = pa.array([f"{i}{m}" for i in range(max(len(self.a_bytes), len(pieces))) for m in marks])
        with open(a_path, encoding="utf-8") as f:
            splits = json.load(f).get("pre_tokenizer") or {}
        self.by_chunk = splits.get("type") == "ByteLevel" and not any(SPAN_OF_BLANK.search(p) or "\n" in p for p in pieces)
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    @staticmethod
    def _a_bytes(token: str, alphabet: dict[str, int]) -> bytes:
        known = [alphabet.get(c) for c in token]
        return token.encode() if None in known else bytes(known)

    @staticmethod
    def _ends(spans: np.ndarray, to_byte: np.ndarray | None, sizes: np.ndarray, lead: int) -> np.ndarray:
        """The byte at which each token ends: its span's end, or, where tokens share a character,
        the last such end before and the decoded bytes since."""
        start, end = spans[:, 0], spans[:, 1]
        alone = start < end
        alone[:-1] &= start[1:] >= end[:-1]
        alone[1:] &= end[:-1] <= start[1:]
        coarse = lead + (end if to_byte is None else to_byte[end])
        if alone.all():
            return coarse
        sums = np.cumsum(sizes)
        known = np.maximum.accumulate(np.where(alone, np.arange(len(alone)), -1))
        return sums + np.where(known < 0, 0, coarse[known] - sums[known])

    def tokens(self, text: str) -> tuple | None:
        """Both tokenizers' ids of a space and ``text`` with the byte at which each token ends;
        None when one doesn't give the bytes back."""
        whole = " " + text
        raw = whole.encode()
        seen = self.a.encode(whole, add_special_tokens=False)
        a_ids, a_spans = seen.ids, np.array(seen.offsets)
        b_spans = np.array([(p.id, p.begin, p.end) for p in self.b.encode(text, return_type="proto").pieces])
        b_ids = b_spans[:, 0].tolist()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return None
        to_byte = None
        if len(raw) != len(whole):
            points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
            to_byte = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
        a_ends = self._ends(a_spans, to_byte, self.a_sizes[a_ids], 0)
        b_ends = self._ends(b_spans[:, 1:], None, self.b_sizes[b_ids], 1)
        if a_ends[-1] != len(raw) or b_ends[-1] != len(raw):
            raise ValueError("spans and decoded bytes disagree")
        return a_ids, a_ends, b_ids, b_ends

    def align(self, text: str, borders: np.ndarray | None = None) -> list[bytes] | None:
        """The alignment of a space and ``text``, or of each part of it where ``borders`` gives the bytes
        at which parts end: its tokens as 32-bit integers, group by group, A's before B's, each an id
        and two bits, the lower for the last of its side in the group and the upper for B."""
        found = self.tokens(text)
        if found is None:
            return None
        a_ids, a_ends, b_ids, b_ends = found
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        sides = []
        for ids, ends, side in ((a_ids, a_ends, 0), (b_ids, b_ends, 2)):
            group = np.searchsorted(cuts, ends)
            sides.append((2 * group + side // 2, np.array(ids, dtype=np.int32) << 2 | side | (cuts[group] == ends)))
        order = np.argsort(np.concatenate([place for place, _ in sides]), kind="stable")
        data = np.concatenate([marked for _, marked in sides])[order].astype(np.int32).tobytes()
        if borders is None:
            return [data]
        if not np.isin(borders, cuts).all():
            return None
        upto = 4 * (np.searchsorted(a_ends, borders, side="right") + np.searchsorted(b_ends, borders, side="right"))
        upto = [0, *upto.tolist()]
        return [data[i:j] for i, j in zip(upto, upto[1:], strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Aligns chunks in one text and remembers them; None stands for one that has no tokens."""
        if chunks[0][0] == "\n":  # a text begins with a word
            chunks = ["a", *chunks]
        parts = [c if c[0] == "\n" else " " + c for c in chunks]
        found = self.align("".join(parts)[1:], np.cumsum([len(x.encode()) for x in parts]))
        if found is None and len(chunks) > 1:
            half = (len(chunks) + 1) // 2
            if chunks[0] == "a" and len(chunks) == 2:
                found = [b"", None]
            else:
                self._learn(chunks[:half])
                self._learn(chunks[half:])
                return
        self.young.update(zip(chunks, found or [None], strict=True))

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Words without the blank before them, and line feeds with the word after them."""
        if plain_spaces(text):
            return text.replace("\n", " \n").split(" ")
        first, *rest = CUT.split(text)
        return [first, *(c[1:] if c[0] == " " else c for c in rest)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The alignment of each text; empty for one without tokens."""
        if not self.by_chunk:
            return [(self.align(t) or [b""])[0] if t else b"" for t in texts]
        split = [self._chunks(t) if t and not t[0].isspace() else None for t in texts]
        if len(self.young) >= MEMO_ENTRIES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = set().union(*(c for c in split if c)).difference(young)
        young.update((c, old[c]) for c in new if c in old)
        new = [c for c in new if c not in young]
        for at in range(0, len(new), LEARN):
            self._learn(new[at:at + LEARN])
        out = []
        for text, chunks in zip(texts, split, strict=True):
            parts = list(map(young.__getitem__, chunks)) if chunks else [None]
            if None in parts:  # rare: the whole text decides
                out.append((self.align(text) or [b""])[0] if text else b"")
            else:
                out.append(b"".join(parts))
        for c in new:
            if len(c) > MEMO_CHARS:
                del young[c]
        return out

    def columns(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, groups and links of the texts."""
        found = self(texts)
        marked = np.frombuffer(b"".join(found), dtype=np.int32)
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        kind, ids = marked & 3, (marked >> 2).astype(np.int64)
        counts = []
        for mine in (kind < 2, kind >= 2, kind == 3):
            counts.append(np.diff(np.append(0, np.cumsum(mine))[ends]))
        links = ids[kind == 3] * PAIR_BASE + ids[kind == 1]
        spelled = self.spelled.take(pa.array(marked))
        data, at = spelled.buffers()[2], np.frombuffer(spelled.buffers()[1], dtype=np.int32)[:len(marked) + 1][ends].tolist()
        data = data.to_pybytes() if data is not None else b""
        groups = [data[i:max(i, j - 1)].decode() for i, j in zip(at, at[1:], strict=False)]  # no mark after the last
        upto = np.append(0, np.cumsum(counts[2])).astype(np.int32)
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(upto), pa.array(links))]


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``n_a, n_b, n_groups``, ``groups`` in the form
    ``a1,a2|b1;a3|b2`` and ``links``, one of ``b * 65536 + a`` for each group."""
    made = ["n_a", "n_b", "n_groups", "groups", "links"]
    keep = [c for c in keep if c.lower() not in made]

    def rows(aligner, part, texts):
        return pa.RecordBatch.from_arrays([*part.columns[:-1], *aligner.columns(texts)], names=[*part.schema.names[:-1], *made])

    def run(batches):
        aligner = worker_tool(("token spans", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            texts, start, chars = [], 0, 0
            for i, text in enumerate(batch.column(batch.num_columns - 1), 1):
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars >= GROUP_CHARS or i == batch.num_rows:  # groups are several times as long as texts
                    yield rows(aligner, batch.slice(start, i - start), texts)
                    texts, start, chars = [], i, 0

    kinds = ["long", "long", "long", "string", "array<long>"]
    schema = docs.select(*keep, *[F.lit(None).cast(k).alias(n) for n, k in zip(made, kinds, strict=True)]).schema
    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, n): how often each kind of link occurs; summed in every task before the shuffle."""

    def run(batches):
        known, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            links = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            found, n = np.unique(links, return_counts=True)
            known, at = np.unique(np.concatenate([known, found]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"link": pa.array(known), "n": pa.array(counts)})

    return aligned.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def rate_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links at their B id's highest count) and
    ``count_sum``; the counts, bounded by the vocabularies, are looked up in every task."""
    rows = counts.toArrow().sort_by("link")
    link, n = rows["link"].to_numpy(), rows["n"].to_numpy()
    side, at = np.unique(link // PAIR_BASE, return_inverse=True)
    most = np.zeros(len(side), dtype=np.int64)
    np.maximum.at(most, at, n)
    table = aligned.sparkSession.sparkContext.broadcast((link, n, n == most[at]))
    keep = [c for c in aligned.columns if c.lower() not in ("n_links", "n_best", "count_sum", "links")]

    def run(batches):
        link, n, best = table.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = np.searchsorted(link, lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            sums, bests = np.append(0, np.cumsum(n[at])), np.append(0, np.cumsum(best[at]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (np.diff(ends), np.diff(bests[ends]), np.diff(sums[ends])))],
                names=[*keep, "n_links", "n_best", "count_sum"])

    schema = aligned.select(*keep, *[F.lit(None).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]).schema
    return aligned.select(*keep, "links").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align(documents(spark, sf_dir), *paths, keep=["doc_id"])
    aligned = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", "links", digest.alias("groups_sha256")), "aligned")
    return rate_links(aligned, pair_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
