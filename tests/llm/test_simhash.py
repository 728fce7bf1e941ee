import re

import numpy as np
import pyarrow as pa
import xxhash

from girder.llm import simhash
from girder.llm.common import text_buffer
from girder.llm.components import connected_components
from tests.llm.helpers import awkward, prose, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def classes(fps):
    """Root of each distinct fingerprint, by comparing all pairs."""
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_fingerprints_match_brute_force():
    texts = [t for _, t, _, _ in awkward()] + ["A b", "one two three", "x " * 5000, "word" * 30 + " " + "é" * 70 + " a b c d e"]
    got = simhash.fingerprints(*text_buffer(pa.array(texts, pa.string())), step=257)
    assert [int(x) for x in got] == [brute_fp(t) for t in texts]


def test_components_match_brute_force(spark):
    base = prose(1, 400).split(" ")
    near = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(0, 120, 3)]
    rows = awkward() + [(100 + k, t, "en", "s") for k, t in enumerate(near)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    roots = classes({brute_fp(t) for _, t, _, _ in rows})
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            r = roots[brute_fp(t)]
            least[r] = min(least.get(r, i), i)
    for r in got:
        fp = r["fp"] % (1 << 64)
        assert r["component_id"] == (None if r["doc_id"] is None else least[roots[fp]])


def test_dense_groups_keep_every_link(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for c in rng.integers(0, 1 << 63, 6):
        for _ in range(150):
            x = int(c)
            for bit in rng.integers(0, 64, int(rng.integers(0, 9))):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    got = {r["fp"]: r["root"] for r in simhash.link_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = classes(fps)
    pairs = {}
    for x, s in zip(fps, signed, strict=True):
        g = got.get(s, s)
        assert pairs.setdefault(g, want[x]) == want[x]
    assert len(pairs) == len(set(want.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len(found) == 63 and len({found[k] for k in range(61)}) == 1 and found[100] == found[101] != found[0]


def test_keep_first_and_empty(spark):
    rows = awkward()
    docs = table(spark, rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 24 not in ids and 25 not in ids and 3 in ids and 20 in ids and 21 not in ids
    assert simhash.near_duplicates(table(spark, [])).collect() == []


def test_keep_first_keeps_one_row_of_a_repeated_id(spark):
    from tests.llm.helpers import prose

    a, b, c, d, e = (prose(70 + k, 120) for k in range(5))
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (7, c, "en", "s"), (8, c, "en", "s")]
    rows += [(9, d, "en", "s"), (9, e, "en", "s"), (10, e, "en", "s"), (None, d, "en", "s"), (None, d, "en", "s")]
    docs = table(spark, rows).coalesce(1)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, c), (9, d), (10, e), (None, d), (None, d)], key=str)
