"""Splitting text into pieces that byte-level tokenizers treat independently."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ENTRIES = 300_000
MEMO_CHARS = 48
CLOSING = (",", ".")
FAR_LETTER = "\u0250"  # letters before it are letters to any version of Unicode
LEARN = 512  # new chunks that are encoded in one text
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
LETTER, OTHER_SPACE, WIDE = (np.zeros(256, dtype=bool) for _ in range(3))  # by byte
LETTER[[*range(65, 91), *range(97, 123)]] = True
OTHER_SPACE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # white space beyond ASCII begins with one of these


class ChunkMemo(dict):
    """Remembers the ids (int32 bytes) of short chunks, in two generations of bounded size.

    When the young one is full it becomes the old one, whose entries come back when asked for; so
    frequent chunks stay and rare ones go. ``lead`` is put before the key to get the chunk.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str = ""):
        super().__init__()
        self.encode, self.lead, self.old, self.marks = encode, lead, {}, {}

    def mark(self, sign: str) -> bytes:
        ids = self.marks.get(sign)
        if ids is None:
            ids = self.marks[sign] = self.encode(sign)
        return ids

    def __missing__(self, key: str) -> bytes:
        if key[-1:] in CLOSING and key[:-1].isalpha():  # the pattern parts letters from a mark
            return self[key[:-1]] + self.mark(key[-1])
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(self.lead + key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


def plain_spaces(text: str) -> bool:
    """True when all white space is single blanks and line feeds between words.

    Then a chunk starts at each blank, which the pattern always gives to the word after it, and
    each line feed is a piece of its own.
    """
    return " ".join(text.split()) == text.replace("\n", " ") and not text.isspace()


def encode_text(text: str, bare: ChunkMemo, spaced: ChunkMemo) -> bytes:
    """The ids of ``text`` as int32 bytes, by chunk where its spaces allow it, else whole."""
    if not text:
        return b""
    if not plain_spaces(text):
        return bare.encode(text)
    out = []
    feed = bare["\n"]
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append(bare[first])
        out.extend(map(spaced.__getitem__, rest))
        out.append(feed)
    return b"".join(out[:-1])


def id_lists(parts: Iterable[bytes]) -> pa.ListArray:
    """One list of 32-bit ids per byte string, without a copy per id."""
    parts = list(parts)
    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


class JoinedMemo:
    """Encodes texts of a byte-level tokenizer from remembered chunks; new ones are encoded many at a
    time, joined to one text, which costs a library far less than a call for each.

    A chunk is a word with the blank or line feed before it, or the comma or point that ends one after a
    letter; no piece of the pattern goes on from one into the next. Chunks are cut in bytes, all texts at
    once, and equal ones are found by Arrow, so that each is looked up once a call. ``encode`` gives the
    ids of any text and ``sizes`` the bytes of every id. Of chunks of up to ``MEMO_CHARS`` characters two
    generations are kept, each of ``2 * MEMO_ENTRIES`` and what one call adds.
    """

    def __init__(self, encode: Callable[[str], list[int]], sizes: np.ndarray):
        self.encode, self.sizes = encode, sizes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.feed = self._whole("\n")
        self.marks = {m: self._whole(m) for m in CLOSING}

    def _whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype=np.int32).tobytes()

    def _learn(self, chunks: list[str], borders: np.ndarray) -> list[bytes]:
        ids = np.array(self.encode("".join(chunks)), dtype=np.int32)
        ends = np.cumsum(self.sizes[ids])
        at = np.searchsorted(ends, borders)
        if not len(ends) or ends[-1] != borders[-1] or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], borders):
            return [self._whole(c) for c in chunks]  # a tokenizer that doesn't keep its text's bytes
        data, at = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _learn_all(self, chunks: list[str]) -> list[bytes]:
        """The ids of new ``chunks``, of a letter and a mark after it those of the two parts that the pattern makes of them."""
        parted = [c for c in chunks if c[-1] in CLOSING and len(c) > 2 and c[-2].isalpha() and c[-2] < FAR_LETTER]
        bare = {c[:-1] for c in parted}
        new = [c for c in bare.union(set(chunks).difference(parted)) if c not in self.young] if parted else chunks
        offsets, ids = np.append(0, np.cumsum(pc.binary_length(pa.array(new, pa.string())).to_numpy().astype(np.int64))), []
        for at in range(0, len(new), LEARN):
            part = new[at:at + LEARN]
            ids += self._learn(part, offsets[at + 1:at + 1 + len(part)] - offsets[at])
        found = dict(zip(new, ids, strict=True))
        if parted:
            found.update([(c, (found.get(c[:-1]) or self.young[c[:-1]]) + self.marks[c[-1]]) for c in parted])
            ids = [found[c] for c in chunks]
        if found and max(map(len, found)) > MEMO_CHARS:
            found = {c: x for c, x in found.items() if len(c) <= MEMO_CHARS}
        self.young.update(found)
        return ids

    @staticmethod
    def _fed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, a line feed before each, and where the line feeds are."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
        at = offsets[:-1] - offsets[0]
        return np.insert(data, at, 10), at + np.arange(len(at))

    @staticmethod
    def _plain(raw: np.ndarray, space: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which texts have no white space but single blanks and line feeds between words."""
        odd = OTHER_SPACE[raw]
        odd[:-1] |= space[:-1] & space[1:]
        odd[-1] |= space[-1]
        wide = np.flatnonzero(WIDE[raw])
        one, two, three = raw[wide], raw[np.minimum(wide + 1, len(raw) - 1)], raw[np.minimum(wide + 2, len(raw) - 1)]
        odd[wide] = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        odd[wide] |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
        out = np.ones(len(begins), dtype=bool)
        out[np.searchsorted(begins, np.flatnonzero(odd), side="right") - 1] = False
        return out

    @staticmethod
    def _starts(raw: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Where the chunks of plain texts begin."""
        marks = np.flatnonzero((raw == 44) | (raw == 46))
        marks = marks[np.append(space, True)[marks + 1]]
        before, lead = raw[marks - 1], raw[marks - 2]
        latin = (before >= 0x80) & ((lead == 0xC3) & (before != 0x97) & (before != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8))
        space[marks[LETTER[before] | latin]] = True
        return np.flatnonzero(space)

    @staticmethod
    def _cut(text: str) -> tuple[bytes, np.ndarray] | None:
        """A line feed and the text, in bytes, and where its chunks begin; None where a text begins with space."""
        if not text or text[0].isspace():
            return None
        first, *rest = CUT.split(text)
        sizes = [len(c.encode()) for c in ["\n" + first, *rest]]
        return ("\n" + text).encode(), np.cumsum([0, *sizes[:-1]])

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of the texts that have them: the text's number, the chunks one after the other, and where its chunks begin."""
        raw, begins = self._fed(texts)
        space = (raw == 32) | (raw == 10)
        plain = self._plain(raw, space, begins)
        rest = []
        if not plain.all():
            raw, begins = self._fed(texts.filter(pa.array(plain)))
            space = (raw == 32) | (raw == 10)
            rest = [(i, c) for i in np.flatnonzero(~plain).tolist() if (c := self._cut(texts[i].as_py()))]
        starts = self._starts(raw, space)
        first = np.searchsorted(starts, begins)
        if rest:
            bases = np.cumsum([len(raw), *(len(data) for _, (data, _) in rest)])
            first = np.append(first, np.cumsum([len(starts), *(len(at) for _, (_, at) in rest)])[:-1])
            starts = np.concatenate([starts, *(at + base for (_, (_, at)), base in zip(rest, bases.tolist(), strict=False))])
            raw = np.concatenate([raw, *(np.frombuffer(data, dtype=np.uint8) for _, (data, _) in rest)])
        offsets = np.append(starts, len(raw)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return np.append(np.flatnonzero(plain), np.array([i for i, _ in rest], dtype=np.int64)), chunks, first

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts)).cast(pa.string()).fill_null("")
        encoded: list[bytes | None] = [None] * len(texts)
        rows, cut, first = self._chunks(texts) if len(texts) else ([], [], [])
        if len(rows):
            out, ends = self._encoded(cut)
            at = [*(4 * ends[first]).tolist(), 4 * int(ends[-1])]
            for i, start, end in zip(rows.tolist(), at, at[1:], strict=False):
                encoded[i] = out[start + len(self.feed):end]
        for i, ids in enumerate(encoded):
            if ids is None:
                text = texts[i].as_py()
                encoded[i] = self._whole(text) if text else b""
        return encoded

    def _encoded(self, cut: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all chunks, and how many come before each and in all."""
        found = cut.dictionary_encode()
        chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) >= 2 * MEMO_ENTRIES:
            self.young, self.old = {}, self.young
        young = self.young
        young.update(self.marks)
        known = list(map(young.get, chunks))
        missing = [i for i, ids in enumerate(known) if ids is None]
        if self.old:
            for i, ids in zip(missing, map(self.old.get, [chunks[i] for i in missing]), strict=True):
                if ids is not None:
                    known[i] = young[chunks[i]] = ids
            missing = [i for i in missing if known[i] is None]
        for i, ids in zip(missing, self._learn_all([chunks[i] for i in missing]), strict=True):
            known[i] = ids
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = pa.array(np.frombuffer(b"".join(known), dtype=np.int32))
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), ids)
        return lists.take(found.indices).flatten().to_numpy().tobytes(), np.append(0, np.cumsum(sizes[found.indices.to_numpy()]))
