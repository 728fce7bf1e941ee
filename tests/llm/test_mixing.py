import pyarrow as pa
import pytest

from girder.llm import mixing
from girder.llm.common import text_buffer
from tests.llm.helpers import awkward, clashing, prose, table


def many():
    return [(k, prose(k, 20 + k % 40), ("en", "de", "fr")[k % 3], "hot" if k % 3 else f"s{k % 7}") for k in range(900)]


def marginals(rows, dim):
    total, out = sum(r["w"] for r in rows), {}
    for r in rows:
        out[r[dim]] = out.get(r[dim], 0.0) + r["w"] / total
    return out


@pytest.mark.parametrize("limit", [50_000, 3])
def test_raking_meets_its_targets(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "CELL_LIMIT", limit)
    monkeypatch.setattr(mixing, "ROUNDS", 6 if limit == 3 else 50)
    cells = spark.createDataFrame([(s, x, t, 100 + 37 * i) for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in ("en", "de") for t in ("prose", "table"))], "source string, lang string, topic string, n long")
    goal = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.9, "table": 0.1}}
    frames = {d: spark.createDataFrame(list(g.items()), "value string, target double") for d, g in goal.items()}
    got = mixing.rake(cells, frames).collect()
    assert len(got) == 8
    for d, g in goal.items():
        for v, share in marginals(got, d).items():
            assert share == pytest.approx(g[v], abs=1e-3)


def test_kept_tokens_follow_the_budget(spark):
    docs = table(spark, many())
    rows = mixing.mix(docs, budget=0.5).select("__n", "__p", "__kept", "source").collect()
    assert len(rows) == 900
    total = sum(r["__n"] for r in rows)
    assert sum(r["__n"] * r["__p"] for r in rows) == pytest.approx(0.5 * total, rel=1e-3)
    assert sum(r["__n"] for r in rows if r["__kept"]) == pytest.approx(0.5 * total, rel=0.15)
    share = lambda s: sum(r["__p"] for r in rows if r["source"] == s) / sum(1 for r in rows if r["source"] == s)
    assert share("hot") < share("s3")


def test_sampling_is_stable_and_keeps_columns(spark):
    docs = table(spark, awkward())
    one, two = mixing.sample(docs), mixing.sample(docs.repartition(3))
    assert one.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert ids.count(25) in (0, 2)


def test_topics_and_tokens():
    rows = [("a | b | c", "table"), ("### x $$$", "marked"), ("123 456 7", "numeric"), ('"who?" "me?"', "dialogue"), ("plain words", "prose"), (None, "prose"), ("", "prose"), (" \n", "prose"), ("é è|ê ü", "table")]
    n, forms = mixing.form_of(*text_buffer(pa.array([t for t, _ in rows], pa.string())))
    assert forms == [x for _, x in rows] and n.tolist() == [5, 3, 3, 2, 2, 0, 0, 0, 3]


def test_empty_table(spark):
    assert mixing.mix(table(spark, [])).collect() == []


def test_unreachable_targets_are_warned_of(spark):
    import pytest

    docs = table(spark, [(k, prose(k, 50), "en" if k % 2 else "de", "s1" if k % 2 else "s2") for k in range(40)])
    goal = lambda **share: spark.createDataFrame(list(share.items()), "value string, target double")
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.mix(docs, targets={"source": goal(s1=0.9, s2=0.1), "lang": goal(en=0.1, de=0.9)}).count()
    with pytest.warns(UserWarning, match="'none' is off by 0.5000"):
        mixing.mix(docs, targets={"source": goal(s1=0.25, s2=0.25, none=0.5)}).count()
    cells = spark.createDataFrame([("a", "x", "t", 30), ("a", "y", "t", 10), ("b", "x", "t", 20)], "source string, lang string, topic string, n long")
    targets = {"source": goal(a=0.5, b=0.5), "lang": goal(x=0.8, y=0.2), "topic": goal(t=1.0)}
    assert mixing.achieved(mixing.rake(cells, targets), targets).agg({"gap": "max"}).first()[0] < 1e-5


def test_clashing_names_are_carried(spark):
    docs, carried = clashing(table(spark, awkward()))
    got = mixing.sample(docs)
    rows = got.collect()
    assert got.columns == docs.columns and rows and carried(rows)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in mixing.sample(table(spark, awkward())).collect())
    assert mixing.mix(docs).count() == docs.count()
    by_topic = mixing.sample(docs, topic=docs["__topic"])
    assert by_topic.columns == docs.columns and carried(by_topic.collect())
