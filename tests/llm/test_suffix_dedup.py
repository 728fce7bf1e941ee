import hashlib

import numpy as np

from girder.llm import suffix_dedup as sd
from tests.llm.helpers import awkward, prose, table


def brute(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def got(spark, rows):
    out = {}
    for r in sd.remove_repeats(table(spark, rows).repartition(5)).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {k: sorted(v) for k, v in out.items()}


def test_removals_match_brute_force(spark):
    shared = prose(77, 30)
    rows = awkward() + [(100 + k, f"{prose(200 + k, 5)} {shared} {k}", "en", "s") for k in range(30)]
    rows += [(200, "a" * 300, "en", "s"), (201, "a" * 49, "en", "s"), (202, "a" * 50, "en", "s"), (203, "é" * 200, "en", "s"), (204, "xé" + "é" * 90, "en", "s"), (205, "ab" * 400, "en", "s"), (206, "b" + "ab" * 40, "en", "s"), (207, prose(3, 500) * 3, "en", "s")]
    assert got(spark, rows) == brute(rows)


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    rows = [(1, prose(1, 2000), "en", "s"), (2, "start " + prose(1, 2000) + " end", "en", "s"), (3, prose(2, 100) * 40, "en", "s"), (4, prose(2, 100), "en", "s")]
    want = brute(rows)
    sender = sd.Sender(4)
    monkeypatch.setattr(sd, "BLOCK", 1000)
    b = b"".join(t.encode() for _, t, *_ in rows)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t, *_ in rows])])
    sender.add(np.array([1, 2, 3, 4]), np.frombuffer(b, np.uint8), off)
    (ids, tags, start, end), blobs = sender.flush()
    parts = [(ids, tags, start, end)] + [sd.bucket_intervals([x for k, x in blobs if k == bucket]) for bucket in {k for k, _ in blobs}]
    ids, _, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    for i, t, *_ in rows:
        s, e = sd.merged(start[ids == i], end[ids == i]) if (ids == i).any() else (np.zeros(0, int), np.zeros(0, int))
        assert (int((e - s).sum()), len(s)) == want[i][0][1:3]


def test_order_is_a_suffix_order():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 2000).astype(np.uint8)
    buf[1000:1400] = buf[:400]
    buf[1600:1700] = 97
    suffix, group = rng.permutation(1900)[:1200], rng.integers(0, 3, 1200)
    order, cls = sd.deep_shallow_sort(buf, suffix, group)
    keys = [(group[k], buf[suffix[k] : suffix[k] + 50].tobytes()) for k in order]
    assert keys == sorted(keys)
    assert all((cls[k] == cls[k - 1]) == (keys[k] == keys[k - 1]) for k in range(1, len(keys)))


def test_rows_of_one_id_lose_their_own_bytes(spark):
    shared = prose(31, 40)
    rows = [(1, shared, "en", "s"), (5, "Z" * 400, "en", "s"), (5, f"a {shared} b", "en", "s"), (5, f"a {shared} b", "en", "s"), (5, None, "en", "s"), (7, "Z" * 80, "en", "s")]
    assert got(spark, rows) == brute(rows)
    assert (400, 0, 0) in [x[:3] for x in got(spark, rows)[5]]


def test_empty_table(spark):
    assert sd.remove_repeats(table(spark, [])).collect() == []


def hot_rows():
    """A line of 60 bytes in 400 texts between words of their own, and other passages that some share."""
    line, shared = "all rights are reserved by the makers of this page since 1990", prose(8, 30)
    rows = [(k, f"{prose(3000 + k, 12)} {line} {prose(7000 + k, 12)}" + (f" {shared}" if k % 9 == 0 else ""), "en", "s") for k in range(400)]
    return rows + [(900, line * 20, "en", "s"), (901, None, "en", "s"), (5, f"x{line}", "en", "s"), (5, f"x{line}", "en", "s")]


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 60)
    monkeypatch.setattr(sd, "SEEN", 1)
    rows = hot_rows()
    docs = table(spark, rows).selectExpr("doc_id AS id", "0 AS tag", "text")
    assert len(sd.hot_anchors(docs, sum(len(t or "") for _, t, *_ in rows))) > 0
    assert got(spark, rows) == brute(rows)


def test_no_bucket_holds_all_records_of_a_hot_anchor():
    ids = np.array([i for i, t, *_ in hot_rows()[:400]])
    texts = [t.encode() for _, t, *_ in hot_rows()[:400]]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h = sd.block_records(buf, off)[3]
    which, n = np.unique(h, return_counts=True)
    assert n.max() > 300
    largest = []
    for hot in (which[:0], which[n > 60]):
        sender = sd.Sender(64, hot)
        sender.add(ids, buf, off)
        sizes = np.zeros(64)
        for bucket, blob in sender.flush()[1]:
            sizes[bucket] += len(sd.unpack(blob)[0])
        largest.append(sizes.max() / np.median(sizes))
    assert largest[1] < 2 < largest[0]
