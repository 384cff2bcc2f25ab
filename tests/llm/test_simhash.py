import numpy as np
import xxhash

from lodestone.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string, key int, label int"


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), x in zip(rows, group) if x == g and d is not None), default=None) for g in set(group)}
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group)), key=str)


def near(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return " ".join(words)


def rows():
    rng = np.random.default_rng(3)
    long = [[f"v{rng.integers(5000)}" for _ in range(400)] for _ in range(12)]
    out = [(None, None), (None, "one two three four five"), (5, ""), (6, " \t\n"), (7, "a b"), (7, "a b"), (8, "A\x0bB"), (9, "ÉCOLE x y z"), (10, "école x y z"), (11, "a\xa0b c d")]
    out += [(100 + i, near(rng, long[i % 12], i % 4)) for i in range(150)]
    return out


def test_components(spark):
    data = rows()
    got = simhash.report(spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == brute_components(data)


def test_empty(spark):
    assert simhash.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = [centre]
    for _ in range(40):  # dense groups: up to five flips from a centre
        flips = np.zeros(30, np.uint64)
        for _ in range(rng.integers(0, 6)):
            flips ^= np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)
        fps.append(centre ^ flips)
    fps = np.unique(np.concatenate(fps))
    keys = np.zeros(len(fps), np.int64)  # all in one bucket: the large-bucket search
    u, v = simhash.links_of_buckets(keys, fps, simhash.pivots())
    assert (np.bitwise_count(u ^ v) <= 4).all() and len(u) < len(fps)

    def groups(pairs):
        parent = {int(x): int(x) for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(int(a))] = root(int(b))
        return sorted(sorted(x for x in parent if root(x) == r) for r in {root(x) for x in parent})

    all_ = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 4]]
    assert groups(zip(u, v)) == groups(all_)


def test_small_buckets_equal_all_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**10, 400).astype(np.uint64))
    keys = (fps >> np.uint64(4)).astype(np.int64)
    u, v = simhash.links_of_buckets(keys, fps, simhash.pivots())
    want = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a) >> 4 == int(b) >> 4 and (int(a) ^ int(b)).bit_count() <= 4}
    assert {tuple(sorted((int(a), int(b)))) for a, b in zip(u, v)} == want


def test_connected(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100, **{500 + i: 500 for i in range(60)}}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_similar(rows, least=0.8):
    """doc_id -> smallest doc_id that links of five-word similarity reach."""
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    return label


def test_similar_documents(spark):
    rng = np.random.default_rng(11)
    base = [[f"v{rng.integers(5000)}" for _ in range(300)] for _ in range(15)]
    rows = [(i, near(rng, base[i % 15], i % 5)) for i in range(150)]  # up to four words of 300 changed
    rows += [(200 + i, near(rng, base[i], 40)) for i in range(15)]  # a similarity of about a third
    rows += [(300, ""), (301, None), (302, "a b"), (303, "A\tb"), (304, "a c")]
    rows += [(400 + i, near(rng, base[0], 1)) for i in range(60)]  # a large group
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)).collect()}
    assert got == brute_similar(rows)
    assert simhash.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(4)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (0, 1, 3), (5, 9, 100), (30, 4, 200), (400, 900, 50), (3000, 100, 3000)]:
        common, a, b = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (both, n, m))
        x, y = np.union1d(common, a).astype(np.uint64), np.union1d(common, b).astype(np.uint64)
        apart = simhash.differing(simhash.parity(x).tobytes(), simhash.parity(y).tobytes())
        assert 0.5 * min(n + m, 200) <= apart <= n + m and (apart - n - m) % 2 == 0
        narrow = [simhash.folded(simhash.parity(s), simhash.NARROW) for s in (x, y)]
        assert np.bitwise_count(narrow[0] ^ narrow[1]).sum() <= apart


def test_parts_of_a_large_bucket_hold_all_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(15)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for i in range(60):  # pairs that link, of which no three do
        own = [f"w{rng.integers(10**9)}" for _ in range(5)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own + ["x"]))]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_similar(rows, 0.95)
    whole = simhash.similar_documents(docs, similarity=0.95).collect()
    monkeypatch.setattr(simhash, "PART", 7)
    parts = simhash.similar_documents(docs, similarity=0.95).collect()
    assert {r["doc_id"]: r["component_id"] for r in whole} == {r["doc_id"]: r["component_id"] for r in parts} == want
    assert len(set(want.values())) == 60


def test_large_families_lose_no_link(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"v{rng.integers(10**9)}"
    rows, passage = [], [word() for _ in range(60)]  # common to all, alone a similarity of about 0.7
    for i in range(150):
        own = [word() for _ in range(7)]
        rows += [(1000 + i, " ".join(passage + own + [word() for _ in range(3)])), (2000 + i, " ".join(passage + own + [word() for _ in range(3)]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_similar(rows)
    assert len(set(want.values())) == 150
    assert got == want


def test_links_of_exactly_the_least_similarity_are_found(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):  # 4 of 5 shingles to 48 of 60 in common
        n = 4 * int(rng.integers(1, 13))
        text = [f"v{rng.integers(10**9)}" for _ in range(n + n // 4 + 4)]
        rows += [(2 * i, " ".join(text[: n + 4])), (2 * i + 1, " ".join(text))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows} == brute_similar(rows)
