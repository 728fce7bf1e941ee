import numpy as np
import pyarrow as pa
import pytest

from girder.llm import line_dedup as ld
from tests.llm.helpers import awkward, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line is one that a great many documents hold, in full"


def rows():
    out = awkward() + [(100 + k, f"own {k}\n {LONG.upper() if k % 2 else LONG}\t\nend\n{LONG}", "en", "s") for k in range(9)]
    out += [(200 + k, f"É{LONG[1:]}\nx" if k < 4 else f"é{LONG[1:]}", "en", "s") for k in range(8)]
    return out + [(300 + k, "y" * 39 + "\n" + "z" * 40, "en", "s") for k in range(6)]


def brute(data, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, t, *_ in data:
        for x in (t or "").split("\n") if i is not None else ():
            holders.setdefault(key(x), set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or hot.get(key(x), i) == i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_kept_lines_match_brute_force(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = table(spark, rows())
        got = ld.apply_keep_bitmaps(docs, ld.line_keep_bitmaps(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == brute(rows())


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_stream_decides_whole_keys_and_leaves_the_ends_open(size):
    key = np.repeat(np.arange(6), [3, 8, 2, 7, 1, 6])
    ids = np.concatenate([np.arange(n)[::-1] for n in (3, 8, 2, 7, 1, 6)])
    cols = [key, key * 3, ids, np.zeros(len(key), np.int32), np.zeros(len(key), np.int32), np.ones(len(key), np.int32)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in cols], names=["h1", "h2", "id", "tag", "pos", "n_lines"]) for k in range(0, len(key), size)]
    out = pa.Table.from_batches(list(ld._stream(iter(batches), 5))).to_pylist()
    assert sorted({r["h1"] for r in out if r["open"]}) == [0, 5] and sum(r["open"] for r in out) == 9
    closed = [(r["h1"], r["id"]) for r in out if not r["open"]]
    assert sorted(closed) == sorted([(1, k) for k in range(7)] + [(3, k) for k in range(6)])


def test_bitmaps_round_trip():
    keep = ld.kept_lines(11, ld.keep_bitmap(11, [0, 10, 4, 99]))
    assert keep.tolist() == [k not in (0, 4, 10) for k in range(11)]


def test_texts_of_one_id_have_their_own_bitmaps(spark):
    data = [(k, f"{LONG}\nown {k}", "en", "s") for k in range(6)] + [(2, f"first\n{LONG}\nlast", "en", "s"), (2, "one line", "en", "s"), (2, None, "en", "s"), (2, f"first\n{LONG}\nlast", "en", "s")]
    docs = table(spark, data)
    got = ld.apply_keep_bitmaps(docs, ld.line_keep_bitmaps(docs)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == brute(data)


def test_empty_table(spark):
    docs = table(spark, [])
    assert ld.apply_keep_bitmaps(docs, ld.line_keep_bitmaps(docs)).collect() == []
