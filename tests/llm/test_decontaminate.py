import re

from girder.llm import decontaminate
from tests.llm.helpers import awkward, clashing, prose, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, prose(5, 40)), (2, "Héllo short, item"), (10, prose(900, 25)), (11, None), (12, "..."), (13, prose(900, 25)), (14, "Ünï"), (15, prose(6, 12))]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute(text):
    w, hit, items = words(text), set(), set()
    for i, t in ITEMS:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    items.add(str(i))
    return len(w), len(hit), len(items), sorted(items)


def rows():
    planted = " ".join(prose(900, 25).split())
    return awkward() + [(60, f"before {planted.upper()} after", "en", "s"), (61, "so héllo; SHORT item! twice héllo short item", "en", "s"), (62, "ünï Ünï", "de", "s"), (63, planted[:60], "en", "s")]


def check(spark, **options):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, id string, at int")
    got = decontaminate.find_contamination(table(spark, rows()), items, **options).collect()
    by_id = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got}
    for i, t, _, _ in rows():
        if i is not None:
            assert by_id[i] == brute(t), i
    return items


def test_hits_match_brute_force(spark):
    check(spark)


def test_shuffled_join_gives_the_same(spark):
    check(spark, broadcast_windows=0)


def test_filters_and_spans(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, rows())
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i, t, _, _ in rows() if i is not None and not brute(t)[1])
    assert kept.where("doc_id is null").count() == 2
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert words(cut[60]) == ["before", "after"] and words(cut[61]) == ["so", "twice"] and cut[20] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(table(spark, rows()), none).collect()
    assert all(r["n_hit"] == 0 for r in got)
    assert decontaminate.find_contamination(table(spark, []), none).collect() == []


def test_a_hot_window_of_many_items(spark):
    """One passage in half the documents and in forty items, on both paths."""
    hot = " ".join(prose(901, 14).split())
    items = spark.createDataFrame([(k, hot) for k in range(40)] + [(50, prose(902, 20))], "item_id long, text string")
    docs = table(spark, [(k, (hot + " ") * 3 if k % 2 else prose(k, 40), "en", "s") for k in range(30)])
    for limit in (500_000, 0):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, items, broadcast_windows=limit).collect()}
        assert len(got) == 30
        for k in range(30):
            assert (got[k]["n_items"], got[k]["n_hit"]) == ((40, 42) if k % 2 else (0, 0))
            assert got[k]["items"] == (sorted(str(i) for i in range(40)) if k % 2 else [])


def test_rows_without_an_id_are_judged_one_by_one(spark):
    items = spark.createDataFrame([(1, prose(70, 30))], "item_id long, text string")
    bad, good = f"before {prose(70, 30)} after", prose(71, 80)
    docs, carried = clashing(table(spark, [(None, bad, "en", "s"), (None, good, "en", "s"), (None, None, "en", "s"), (None, bad, "en", "t"), (1, bad, "en", "s"), (2, good, "en", "s")]))
    for limit in (500_000, 0):
        kept = decontaminate.keep_clean(docs, items, broadcast_windows=limit)
        rows = kept.collect()
        assert kept.columns == docs.columns and carried(rows)
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, [(None, good), (None, None), (2, good)]))
