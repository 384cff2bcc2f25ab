import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import lengths, packing
from lodestone.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_every_common_character_in_context():
    e = encoder(PATH)
    for c in [*map(chr, range(0x180)), *map(chr, range(0x2010, 0x2030)), "中", "　", "😀", "퟿"]:
        for text in (c, f"a{c}b", f" {c} {c}{c}", f"x\n{c}\n y", f"1{c}2", f"{c}'s"):
            assert e.ids(text).tolist() == ids(text), (c, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    assert encoder(PATH).ids(text).tolist() == ids(text)


def test_special_and_empty():
    e = encoder(PATH)
    assert e.ids("a<|endoftext|>b").tolist() == ids("a<|endoftext|>b")
    assert e.count(None) == e.count("") == 0


DOCS = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (None, "x y z"), (7, "a" * 50_000)] + [(10 + i, "tok " * (i % 37)) for i in range(200)]
SCHEMA = "doc_id long, text string, length int, bucket int, number long"


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def test_histogram(spark):
    n = sorted(len(ids(t)) for _, t in DOCS)
    rows = lengths.limits(lengths.histogram(frame(spark), PATH), stride=16)
    got = {r["length"]: r for r in rows.collect()}
    assert sorted(got) == sorted(set(n))
    for length, r in got.items():
        assert r["docs"] == n.count(length) and r["docs_at_least"] == sum(x >= length for x in n) and r["docs_over"] == sum(x > length for x in n)
        assert r["kept_tokens"] == sum(min(x, length) for x in n) and r["total_tokens"] == sum(n)
        assert r["quantile"] == pytest.approx(sum(x <= length for x in n) / len(n))
    for limit in (0, 1, 20, 21, 10**6):
        assert lengths.at(rows, limit) == {"docs_over": sum(x > limit for x in n), "kept_tokens": sum(min(x, limit) for x in n), "lost_tokens": sum(n) - sum(min(x, limit) for x in n)}
    assert lengths.quantile(rows, 0.5) == n[-(-len(n) // 2) - 1]
    assert lengths.limits(lengths.histogram(frame(spark, []), PATH)).count() == 0


def test_packing_round_trip(spark):
    got = packing.report(frame(spark), PATH).collect()
    per, places = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for doc, text in {d: t for d, t in DOCS}.items():
        want = np.array([*ids(text), 2], dtype="<u4")
        copies = sum(d == doc for d, _ in DOCS)
        parts = sorted(per[doc], key=lambda r: r["piece"])[::copies]
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and sum(r["length"] for r in parts) == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
        assert all(r["length"] == 1024 for r in parts[1:])
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 1024) + 1
    assert packing.report(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_solver_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1025, 3000) if seed < 2 else rng.integers(300, 700, 3000)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(values, return_counts=True))}
    plan, held = packing.solve(histogram), {}
    for config, n in plan:
        assert sum(a * b for a, b in config.items()) <= 1024
        for a, b in config.items():
            held[a] = held.get(a, 0) + b * n
    assert held == histogram
    bins = sum(n for _, n in plan)
    assert bins <= sum(n for _, n in packing.best_fit(histogram, 1024))
    assert packing.solve_within(histogram)[1] <= bins
    assert packing.solve({}) == []


def test_weights_meet_their_bound():
    rng = np.random.default_rng(8)
    for lengths in ([171, 256, 257, 341, 512, 513, 700], [300, 400, 500, 600], [1023, 2, 340]):
        counts = np.zeros(1025, np.int64)
        for x in rng.choice(lengths, 3000):
            counts[x] += 1
        cover, bound = packing.weighted(counts)
        assert sum(n for _, n in cover) == pytest.approx(bound)
        held = sum(np.array([c.get(x, 0) for x in lengths]) * n for c, n in cover) / counts[lengths]
        assert held.min() > 0.85  # the fractional solution at the bound covers nearly all of each length
        plan, least = packing.solve_within({x: int(counts[x]) for x in lengths})
        bins = sum(n for _, n in plan)
        assert bound - 1e-6 <= least <= bins <= sum(n for _, n in packing.best_fit({x: int(counts[x]) for x in lengths}, 1024))
        assert bins <= 1.02 * least
