"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The merges of a rank file are compiled into a machine that reads bytes and writes, at each byte,
the last token of the encoding up to there. A token may follow another iff the two stay apart when
their bytes are merged together, so what the machine must know is the last token at each position
where a token may still begin. These positions follow from the longest open run of bytes, a node
of the vocabulary's prefix tree; a state is that node with the last tokens at its open positions.
States and steps, what a byte does at a node, and which tokens stay apart are worked out when first
met and kept in bounded tables; the tokens at a token's edges are kept for each of the vocabulary.
A worker also remembers the ids of words, ``MEMO_ENTRIES`` in each of two generations, after a
blank and without one: at some 200 bytes an entry 120 MB for those after a blank. All open positions lie within
the longest token's length of the end, and a token is emitted once the paths back from all of them
meet behind it.

Decoding joins token bytes chunk by chunk through a UTF-8 state machine that holds back an
incomplete sequence until its rest arrives.

Edge cases: a null or empty text gives no ids and decodes to an empty text; a null list of ids is
an empty one; an id outside the vocabulary, or bytes that are no UTF-8, decode to U+FFFD; a very
long word is one piece and walks the machine once; own columns with clashing names are replaced.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.chunks import ChunkMemo, encode_text, id_lists
from larder.llm.common import documents, worker_tool

VOCABULARY = "byte_bpe_50k.tiktoken"
STATES = 50_000
CHUNK_IDS = 8192
GROUP_BYTES = 1 << 20  # of ids or text that leave a task in one batch
NEVER = 1 << 60
START, KEY = -1, -1  # no token yet; a state's own entry beside its steps by byte
SETTLE = 4096
UNKNOWN = "�".encode()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Reads one piece of text at a time; ``encode`` gives the tokens of its bytes."""

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.apart: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple] = {}
        self.shapes: dict[tuple[bytes, int], tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state(b"", (START,))

    def _state(self, node: bytes, lasts: tuple) -> dict:
        key = (node, lasts)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {KEY: key}
        return state

    def merged(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """The merges of rank under ``below`` applied one by one, lowest first: the definition."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if self.ranks.get(parts[best] + parts[best + 1], NEVER) >= below:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spines(self, token: int) -> tuple[tuple, tuple]:
        """The tokens at the left and at the right edge of ``token`` as its merges build it, with
        the rank at which each is merged into the next."""
        known = self.edges.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = (((data, NEVER),), ((data, NEVER),))
            else:
                left, right = (self.ranks[x] for x in self.merged(data, token))
                if max(left, right) > token:
                    raise ValueError("a token comes before its parts: not the ranks of byte-pair merges")
                known = tuple(
                    (*((x, min(at, token)) for x, at in self.spines(part)[side]), (data, NEVER))
                    for side, part in enumerate((left, right)))
            self.edges[token] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes together never joins the two.

        At any time the tokens at the border are one of the left token's right edge and one of the
        right token's left edge. They join if their pair ranks before the next merge on either
        side; of equal ranks the merge further left goes first.
        """
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            known = True
            ours, theirs = self.spines(left)[1], self.spines(right)[0]
            i = j = 0
            while True:
                (a, a_ends), (b, b_ends) = ours[i], theirs[j]
                both = self.ranks.get(a + b, NEVER)
                if both < a_ends and both <= b_ends and both < NEVER:
                    known = False
                    break
                if a_ends == b_ends == NEVER:
                    break
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= 2 * self.limit:
                self.apart.clear()
            self.apart[pair] = known
        return known

    def opened(self, node: bytes) -> list[int]:
        """How far back the open positions of a node lie, furthest first; the end itself is open."""
        return [n for n in range(len(node), 0, -1) if node[len(node) - n:] in self.prefixes] + [0]

    def _shape(self, node: bytes, byte: int) -> tuple:
        """What ``byte`` does at a node, whatever the last tokens are: the tokens that end here, by
        open position, the open positions that stay open, and the next node."""
        grown = node + bytes((byte,))
        ends, stay, reach = [], [], 0
        for i, back in enumerate(self.opened(node)):
            seen = grown[len(grown) - back - 1:]
            token = self.ranks.get(seen)
            if token is not None:
                ends.append((i, token))
            if seen in self.prefixes:
                stay.append(i)
                reach = max(reach, back + 1)
        return tuple(ends), tuple(stay), grown[len(grown) - reach:]

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        node, lasts = state[KEY]
        shape = self.shapes.get((node, byte))
        if shape is None:
            if len(self.shapes) >= 2 * self.limit:
                self.shapes.clear()
            shape = self.shapes[node, byte] = self._shape(node, byte)
        ends, stay, after = shape
        for i, token in ends:
            if lasts[i] == START or self.stay_apart(lasts[i], token):
                break
        if len(self.states) >= self.limit:
            self._reset()
        step = (self._state(after, (*[lasts[i] for i in stay], token)), token)
        state[byte] = step
        return step

    def _settled(self, state: dict, trail: list[int], done: int) -> int:
        """The last position through which the paths back from all open positions go."""
        ends = sorted({len(trail) - back for back in self.opened(state[KEY][0])})
        while len(ends) > 1 and ends[-1] > done:
            last = ends.pop()
            before = last - self.lengths[trail[last - 1]]
            if before not in ends:
                ends = sorted([*ends, before])
        return max(ends[0], done)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, trail, out = self.start, [], []
        for byte in piece:
            state, token = state.get(byte) or self._step(state, byte)
            trail.append(token)
            if len(trail) >= SETTLE:
                done = self._settled(state, trail, 0)
                out += self._path(trail, done)
                del trail[:done]
        return out + self._path(trail, len(trail))

    def _path(self, trail: list[int], at: int) -> list[int]:
        tokens = []
        while at > 0:
            token = trail[at - 1]
            tokens.append(token)
            at -= self.lengths[token]
        return tokens[::-1]


class Utf8Stream:
    """Decodes UTF-8 that arrives in chunks cut anywhere; its state is an unfinished sequence."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a lead byte: hold it back while it waits for more
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    keep = len(data) - back
                break
        self.held = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _encoder(path: str, pattern: str) -> tuple[ChunkMemo, ChunkMemo]:
    return worker_tool(("byte pairs", path, pattern), lambda: _new_encoder(path, pattern))


def _new_encoder(path: str, pattern: str) -> tuple[ChunkMemo, ChunkMemo]:
    machine = Transducer(read_ranks(path))
    pieces = regex.compile(pattern).findall

    def encode(chunk: str) -> bytes:
        ids = array("i")
        for piece in pieces(chunk):
            ids.extend(machine.encode(piece.encode()))
        return ids.tobytes()

    return ChunkMemo(encode), ChunkMemo(encode, " ")


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    return [tokens.get(i, UNKNOWN) for i in range(max(tokens) + 1)]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``ids``, the tokens of the whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]

    def run(batches):
        bare, spaced = _encoder(path, pattern)
        for batch in batches:
            start, size, parts = 0, 0, []
            for i, text in enumerate(batch.column(batch.num_columns - 1), 1):
                parts.append(encode_text(text.as_py() or "", bare, spaced))
                size += len(parts[-1])
                if size >= GROUP_BYTES or i == batch.num_rows:
                    columns = batch.slice(start, i - start).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*columns, id_lists(parts)], names=[*batch.schema.names[:-1], "ids"])
                    start, size, parts = i, 0, []

    slim = docs.select(*keep, F.col(text_col).alias("ids"))
    schema = docs.select(*keep, F.lit(None).cast("array<int>").alias("ids")).schema
    return slim.mapInArrow(run, schema)


def streamed(ids, tokens: list[bytes], chunk: int = CHUNK_IDS) -> str:
    stream, out = Utf8Stream(), []
    for at in range(0, len(ids), chunk):
        part = ids[at:at + chunk]
        try:
            data = b"".join(map(tokens.__getitem__, part))
            if min(part) < 0:
                raise IndexError
        except (IndexError, TypeError):
            data = b"".join(tokens[i] if i is not None and 0 <= i < len(tokens) else UNKNOWN for i in part)
        out.append(stream.feed(data))
    return "".join(out) + stream.end()


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """As ``decode`` of ``encode``, in one pass: the ids of a text are decoded by the task that made them."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]

    def run(batches):
        (bare, spaced), tokens = _encoder(path, pattern), _token_bytes(path)
        for batch in batches:
            start, size, parts, texts = 0, 0, [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1), 1):
                parts.append(encode_text(text.as_py() or "", bare, spaced))
                texts.append(streamed(memoryview(parts[-1]).cast("i").tolist(), tokens))
                size += len(parts[-1])
                if size >= GROUP_BYTES or i == batch.num_rows:
                    columns = batch.slice(start, i - start).columns[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, id_lists(parts), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "ids", "decoded"])
                    start, size, parts, texts = i, 0, [], []

    slim = docs.select(*keep, F.col(text_col).alias("decoded"))
    schema = docs.select(*keep, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema
    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids."""
    keep = [c for c in df.columns if c != "decoded"]
    at = keep.index(ids_col)

    def run(batches):
        tokens = _token_bytes(path)
        for batch in batches:
            start, size, texts = 0, 0, []
            for i, x in enumerate(batch.column(at), 1):
                texts.append(streamed(x.values.to_pylist() if x.is_valid else [], tokens))
                size += len(texts[-1])
                if size >= GROUP_BYTES or i == batch.num_rows:
                    columns = batch.slice(start, i - start).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
                    start, size, texts = i, 0, []

    schema = df.select(*keep, F.lit(None).cast("string").alias("decoded")).schema
    return df.select(*keep).mapInArrow(run, schema)


def id_text(ids="ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def query(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    both = round_trip(documents(spark, sf_dir), path, keep=["doc_id"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(id_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
