"""Runs against a search over all periods, and the query against the rule applied in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np

from girder.llm import periodic_runs, queries
from tests.llm.helpers import awkward, table


def brute(w, least):
    """Every run (start, length, period) by trying each period."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                seg = w[i : j + p]
                if not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.append((i, j - i + p, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rows(found):
    return [tuple(x) for x in found.tolist()]


def test_runs_of_random_words_equal_those_of_all_periods():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters, n = rng.choice([1, 2, 3, 8]), rng.randint(0, 60)
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([2, 4, 12])
        for w, found in zip(texts, periodic_runs.find_runs([np.array(t, np.int64) for t in texts], least), strict=True):
            assert rows(found) == brute(w, least)


def test_known_hard_sequences():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    thue_morse = [bin(i).count("1") % 2 for i in range(300)]
    for w in (b[:400], thue_morse, [0] * 200, list(range(200, 0, -1)), list(range(90)) * 3, [*range(50), *range(50, 0, -1)] * 3):
        assert rows(periodic_runs.find_runs([np.array(w)], 2)[0]) == brute(w, 2)


def test_a_long_text_of_one_word_and_one_of_a_long_period():
    n = 60_000
    assert rows(periodic_runs.find_runs([np.zeros(n, np.int64)])[0]) == [(0, n, 1)]
    half = np.random.default_rng(1).permutation(n // 2)
    assert rows(periodic_runs.find_runs([np.concatenate([half, half])])[0]) == [(0, n, n // 2)]


def planted(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    found = brute(w, 12)
    drop = {k for s, length, p in found for k in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_query_equals_the_rule_by_hand(spark, small):
    got = queries.op13_periodic_runs(spark, small).collect()
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 700]
    own = {r["doc_id"]: tuple(r) for r in got}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert sum(own[r["doc_id"]][1] > 0 for r in docs) >= 5
    for r in docs:
        assert own[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_awkward_rows_keep_their_columns(spark):
    docs = table(spark, [*awkward(), (40, "a b c d " * 5, "en", "s")])
    found = periodic_runs.periodic_runs(docs)
    assert [c for c in docs.columns if c != "start"] == [c for c in found.columns if c in docs.columns and c != "start"]
    got = found.collect()
    assert len(got) == len(awkward()) + 1
    by = {r["doc_id"]: r for r in got}
    assert (by[20]["n_words"], by[20]["n_runs"], by[20]["collapsed"], by[20]["start"]) == (0, 0, "", None)
    assert (by[40]["start"], by[40]["length"], by[40]["period"], by[40]["collapsed"]) == (0, 20, 4, "a b c d")
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_collapse_leaves_other_texts_alone(spark):
    docs = table(spark, [(1, "x\ty  z", "en", "s"), (2, "go go go " * 5 + "stop", "en", "s"), (3, None, None, None)])
    assert {r["doc_id"]: r["text"] for r in periodic_runs.collapse(docs).collect()} == {1: "x\ty  z", 2: "go stop", 3: None}
    assert periodic_runs.collapse(docs).columns == docs.columns
