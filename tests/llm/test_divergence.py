"""The audit against plain Python, with ties, empty groups and awkward rows."""

import re
from collections import Counter, defaultdict

import pyarrow as pa

from girder.llm.divergence import divergence
from tests.llm.helpers import awkward, table


def brute(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))
        groups[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (l, s), c in groups.items() if l == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        whole = share(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            term = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if own[s][t] > 0 and p[s][t] > whole[t]]
            for part, found, most in (("pair", pair, 10**9), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if k < most}
    return out


def test_equals_plain_python(spark):
    rows = [*awkward(), (50, None, "xx", "a"), (51, "Ünder Über ÜBER über", "xx", "b"), (52, "", "yy", "only")]
    for top in (200, 3):
        got = divergence(table(spark, rows), top=top).collect()
        assert {tuple(r) for r in got} == brute(rows, top=top)
        assert len(got) == len({tuple(r) for r in got})


def test_every_term_kept_and_no_rows(spark):
    rows = [(k, f"one two{'b' * (k % 5)} three", "en", f"s{k % 3}") for k in range(40)]
    assert {tuple(r) for r in divergence(table(spark, rows), min_docs=1).collect()} == brute(rows, min_docs=1)
    assert divergence(table(spark, rows).limit(0)).count() == 0


def test_counts_beyond_a_long_product(spark):
    from pyspark.sql import functions as F

    from girder.llm.divergence import _share

    n, total, v = 9 * 10**15, 10**16, 1000
    row = spark.range(1).select(_share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v)


def test_batches_of_texts_give_the_counts_of_a_plain_loop(spark, monkeypatch):
    """Terms are counted in numbers, batch by batch: awkward texts, groups whose names run together, and no explode of terms."""
    import random

    from girder.llm import divergence as module

    rng = random.Random(4)
    parts = ["Ä", "ä", "É9x", "İ", "\U0001f600", "A", "b", "Zz", " ", "\x00", "\n", "@", "[", "`", "{", "\x7f", "\x80", " ", "-", "word", "Word"]
    texts = [None, "", " 12 "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(t, rng.choice(["a", "ab", None]), rng.choice(["bc", "c", "", None])) for t in texts]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2)
    n, held = Counter(), Counter()
    for t, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        found = [(lang or "", source or "", x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)]
        n.update(found)
        held.update(set(found))
    got = module.term_counts(docs)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(module, "ROWS", 7)
    assert {(r["lang"], r["source"], r["term"]): (r["n"], r["n_docs"]) for r in got.collect()} == {k: (n[k], held[k]) for k in n}


def test_pairs_are_summed_as_matrices_cut_anywhere(spark, monkeypatch):
    """Terms and heads run over the batches' ends and the matrices' size; no term is joined with the sources it lacks."""
    import random

    from girder.llm import divergence as module

    rng = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Ä", "\U0001f600", "ﬀ"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["en", "de", "é", None]), rng.choice(["a", "b", "c", "d\U0001f600", "", None])) for k in range(400)]
    rows += [(900, "lonely", "xx", "a"), (901, "", "xx", "b"), (902, None, "xx", "c")]
    want = brute(rows)
    for batch in (1, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            got = divergence(table(spark, rows))
            assert {tuple(r) for r in got.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "term#" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in x)

    dealt, want = [], Counter()
    for lang, salt, sources in (("de", 0, "abc"), ("de", 1, "abc"), ("en", 0, "z"), ("en", 4, "xy")):
        dealt += [(lang, salt, "", s, 3 + k) for k, s in enumerate(sources)]
        for t in range(rng.randrange(1, 12)):
            p = {s: 3 + k for k, s in enumerate(sources)} | {s: rng.randrange(1, 10**9) for s in sources if rng.random() < 0.5 or s == sources[-1]}
            dealt += [(lang, salt, f"t{t:02}", s, p[s]) for s in sources if p[s] != 3 + sources.index(s)]
            want.update({(lang, s, o): (p[s] - p[o]) ** 2 // p[o] for s in sources for o in sources if s != o})
    whole = pa.Table.from_pylist([dict(zip(("lang", "salt", "term", "source", "p"), r, strict=True)) for r in dealt])
    for cells, batch in ((1, 1), (7, 2), (1 << 18, 5), (6, 1000)):
        monkeypatch.setattr(module, "CELLS", cells)
        found = Counter()
        for r in pa.Table.from_batches(module._met(iter(whole.to_batches(max_chunksize=batch)))).to_pylist():
            found[r["lang"], r["source"], r["item"]] += r["f"]
        assert found == want
