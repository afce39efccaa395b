"""Lattice scores against enumerated segmentations and brute-force counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers

from larder.llm import lattice_lm
from tests.llm.fixtures import edge_rows, empty, save

ROOT = "/root/testdata/sf0.001"


def segmentations(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in segmentations(text[n:]):
            yield [text[:n], *rest]


def test_lattice_sums_every_segmentation():
    pieces = {"▁": .1, "a": .2, "b": .1, "ab": .2, "▁a": .1, "▁ab": .05, "ba": .15, "<0xC3>": .05, "<0xA9>": .05}
    lattice = lattice_lm.Lattice(pieces, 0.25)
    for word in ("a", "ab", "abba", "babab"):
        want, used = 0.0, defaultdict(float)
        for s in segmentations("▁" + word):
            if all(p in pieces for p in s):
                mass = math.prod(pieces[p] for p in s) * 0.75 ** (len(s) - 1) * 0.25
                want += mass
                for p in s:
                    used[p] += mass
        assert lattice.log_probability(word) == pytest.approx(math.log(want))
        counts = defaultdict(float)
        lattice.expect(word, counts)
        for p, x in used.items():
            assert counts[p] == pytest.approx(x / want)
    for word in ("ab" * 30, "漢" * 20, "aé漢" * 4):  # products and logarithms agree, also where products vanish
        short, long = defaultdict(float), defaultdict(float)
        used = lattice.expect(word, short)
        assert used == pytest.approx(lattice._expect_long(lattice.arcs("▁" + word), long)) == pytest.approx(sum(short.values()))
        assert {p: pytest.approx(x) for p, x in long.items()} == short
    assert lattice.log_probability("é") == pytest.approx(math.log(.1 * .75 * .05 * .75 * .05 * .25))
    assert math.isfinite(lattice.log_probability("漢" * 4000))


@pytest.mark.parametrize("case", ["given", "edge"])
@pytest.mark.parametrize("head", [3, lattice_lm.HEAD])
def test_query(spark, case, head, tmp_path):
    rows = [(r.doc_id, r.text, None, None, 0) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] if case == "given" else edge_rows()
    docs = spark.read.parquet(save(spark, rows, tmp_path) + "/documents.parquet")
    got = lattice_lm.score(docs, public_tokenizers.path(lattice_lm.VOCABULARY), head).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]) for i, t, *_ in rows]
    counts = Counter(t for _, held, ts in tokens if not held for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), held, len(ts), sum(counts[t] > 0 for t in ts), total, round(sum(math.log10((counts[t] + .5) / (total + .5 * (kinds + 1))) for t in ts), 4)) for i, held, ts in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if case == "given":
        out = [r for r in got if r.held_out]
        print(sum(r.score for r in out) / sum(r.n_tokens for r in out), sum(r.base_score for r in out) / sum(r.n_tokens for r in out))
        assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > -7


def test_empty(spark):
    assert lattice_lm.score(empty(spark), public_tokenizers.path(lattice_lm.VOCABULARY)).count() == 0
