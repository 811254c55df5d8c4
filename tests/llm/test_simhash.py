import numpy as np
import pytest
import xxhash
from odd_texts import ODD

from graticule.llm import common, neardup, simhash


def brute_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode("utf-8", "surrogatepass"), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(near, ids):
    """Smallest id reachable for each position."""
    own, out = list(range(len(ids))), {}
    seen = {}
    for start in sorted(own, key=lambda k: ids[k]):
        if start in seen:
            continue
        stack = [start]
        seen[start] = ids[start]
        while stack:
            x = stack.pop()
            for y in own:
                if y not in seen and near(x, y):
                    seen[y] = ids[start]
                    stack.append(y)
    for k in own:
        out[ids[k]] = seen[k]
    return out


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(common.utf8(text)) == brute_fingerprint(text)


def test_query_equals_brute_force(spark, sf):
    got = {r[0]: (r[1], r[2]) for r in simhash.op8_simhash(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components(lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4, [r[0] for r in rows])
    assert got == {r[0]: (f"{f:016x}", comps[r[0]]) for r, f in zip(rows, fps)}


def test_no_link_is_lost(spark):
    """Random fingerprints with planted neighbours at every distance up to the radius; thresholds differ between groups."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    far = []
    for k, b in enumerate(base):
        flips = rng.choice(64, k % 6, replace=False)
        far.append(int(b) ^ sum(1 << int(f) for f in flips))
    fps = sorted({int(b) for b in base} | set(far))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    comps = {r[0]: r[1] for r in common.connected_components(simhash.links(df, 4)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4, signed)
    assert {f: comps.get(f, f) for f in signed} == want


def test_large_groups_are_tiled(spark, monkeypatch):
    """One value of a bit group held by more fingerprints than a tile."""
    monkeypatch.setattr(simhash, "TILE", 20)
    fps = [k << 40 for k in range(64)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comps = {r[0]: r[1] for r in common.connected_components(simhash.links(df, 4)).collect()}
    assert {f: comps.get(f, f) for f in fps} == brute_components(lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4, fps)


def test_thresholds_add_up():
    both = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for n in (10, 10_000, 10_000_000):
        for radius in (1, 4, 11):
            plan = simhash.allocate(n, both * n / 1000, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1
            bits = [b for g, _ in plan for b in g]
            assert len(bits) == len(set(bits))


def test_odd_rows(spark, docs):
    df = docs(ODD).unionByName(docs(ODD[:1]))
    got = simhash.classes(df).collect()
    assert len(got) == len(ODD) + 1
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[7] == by[8] == 7
    assert simhash.classes(docs([])).count() == 0


def test_near_copies(spark, docs):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 400))
    words = text.split()
    changed = [*words]
    changed[100], changed[300] = "other", "another"
    apart = [f"v{x}" for x in rng.integers(0, 5000, 400)]
    df = docs([text, " ".join(changed), " ".join(apart), text.upper(), None, "", "   "]).withColumnRenamed("source", "group")
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == [0, 2, 4]
    assert neardup.one_of_each(docs([])).count() == 0


def least_of_each(found):
    """Each document's smallest partner, itself included."""
    rows, least = found.collect(), {}
    for r in rows:
        least[r["group"]] = min(r["doc_id"], least.get(r["group"], r["doc_id"]))
    return {r["doc_id"]: least[r["group"]] for r in rows}


def test_near_copies_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, 9), (5, a, 9), (5, b, 9), (7, c, 9), (7, d, 9), (7, d, 9), (None, a, 9)]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, key int"))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(kept.collect(), key=repr) == sorted([(1, a, 9), (5, b, 9), (7, c, 9), (7, d, 9), (None, a, 9)], key=repr)


@pytest.mark.parametrize("rows", [40, 2000])
def test_planted_families(spark, docs, monkeypatch, rows):
    """Families of near copies round a text that is not there: hundreds within few bits of one another, some of them similar; also in blocks."""
    monkeypatch.setattr(neardup, "PART_ROWS", rows)
    rng, texts = np.random.default_rng(11), []
    for family in range(4):
        base = [f"f{family}w{x}" for x in rng.integers(0, 3000, 200)]
        for k in range(100 if family < 2 else 6):
            own = [*base]
            for at in rng.choice(200, int(rng.integers(1, 9)), replace=False):
                own[at] = f"k{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    sets = [set(neardup.shingle_hashes(t.encode().split(), 5).tolist()) for t in texts]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute_components(similar, list(range(len(texts))))
    got = least_of_each(neardup.groups(docs(texts)))
    # the clusters that fingerprints make may miss a pair right at the threshold, never add one
    assert all(want[d] == want[g] for d, g in got.items())
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b)]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.995 * len(pairs)


@pytest.mark.parametrize("apart", [False, True])
def test_links_of_many_sets(apart):
    """The forest joins what all similar pairs join, by pairs or by products of matrices, of one side or of two."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 60, 120).astype(np.uint64)
    sets = []
    for k in range(150):
        own = base.copy()
        own[rng.choice(120, int(rng.integers(3, 16)), replace=False)] = rng.integers(0, 1 << 60, 1)
        sets.append(np.unique(np.concatenate((own, rng.integers(0, 1 << 60, 3).astype(np.uint64)))))
    fps = np.zeros((150, 3), np.uint64)
    left, right = (np.arange(60), np.arange(60, 150)) if apart else (np.arange(150), np.arange(150))
    sim = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    links = [(a, b) for a in left for b in right if a != b and sim(a, b)]
    want = brute_components(lambda a, b: (a, b) in whole or (b, a) in whole, list(range(150))) if (whole := set(links)) else {}
    got = neardup.linked(sets, fps, left, right, 0.8)
    assert all(sim(a, b) for a, b in got)
    forest = common.Forest(150)
    assert all([forest.join(a, b) for a, b in got])
    assert {k: forest.find(k) for k in range(150)} == want


def test_near_copies_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sets = [set(neardup.shingle_hashes(common.space_words(common.utf8(r[1]).lower()), 5).tolist()) for r in rows]

    def near(a, b):
        x, y = sets[a], sets[b]
        return x == y or len(x & y) >= 0.8 * len(x | y)

    want = brute_components(near, [r[0] for r in rows])
    assert least_of_each(neardup.groups(spark.read.parquet(f"{sf}/documents.parquet"))) == want


def test_near_copies_in_the_crowd_of_a_shorter_text(spark, docs, monkeypatch):
    """Many copies of a text stand between longer ones, which are similar to each other but to none of those."""
    rng, texts, crowd, few = np.random.default_rng(8), [], 160, 40
    words, more = [f"w{x}" for x in range(312)], [f"s{x}" for x in range(48)]
    for k in range(crowd + few):
        own = [*words]
        if k < crowd:
            own[int(rng.integers(0, 10))] = f"k{k}"
        else:
            own += more + [f"e{x}" for x in rng.integers(0, 10**6, 38)]
        texts.append(" ".join(own))
    sets = [set(neardup.shingle_hashes(t.encode().split(), 5).tolist()) for t in texts]
    want = brute_components(lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]), list(range(len(texts))))
    assert set(want.values()) == {0, crowd}
    # every pair is a candidate and meets in the same group only, so that nothing but the comparison decides
    monkeypatch.setattr(simhash, "allocate", lambda n, both, radius: [([0], 1)])
    assert least_of_each(neardup.groups(docs(texts), radius=64, limit=128)) == want


def test_near_copies_that_repeat_lines_unequally(spark, docs):
    rng = np.random.default_rng(4)
    page, line = (" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (300, 12))
    texts = [f"{page} {line}", page + f" {line}" * 40, f"{line} " * 90 + page]
    sets = [set(neardup.shingle_hashes(t.encode().split(), 5).tolist()) for t in texts]
    assert min(len(sets[0] & s) / len(sets[0] | s) for s in sets) >= 0.9
    assert [r[0] for r in neardup.one_of_each(docs(texts)).collect()] == [0]
