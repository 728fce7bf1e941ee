import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from girder.llm import quality
from girder.llm.common import text_buffer
from tests.llm.helpers import awkward, clashing, prose, table


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n, hit = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            hit |= set(range(k, k + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ["\n\na b\n\na b\n", "a b c d e f g h " * 5 + "zé", "### $$$ x\n x\n x\nx", "one", "a b c d e f g h", "\n", "x\x0by\x0cz"]


def test_base_rules_match_brute_force():
    texts = [t for _, t, _, _ in awkward()] + EXTRA
    got = quality.base_rules(*text_buffer(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in NAMES) == brute(t), t
        n, rep = brute(t)[0], brute(t)[4]
        assert bool(got["base_failed"][k]) == (n < 20 or 100 * rep > 30 * n)


def keys_of(t):
    """The grams of one text, by hand."""
    s = [0] * (quality.ORDER - 1) + [max(32 if c in " \t\n\x0b\x0c\r" else ord(c) & 4095, 1) for c in t]
    return [sum(x << (12 * (quality.ORDER - 1 - k)) for k, x in enumerate(s[i : i + quality.ORDER])) for i in range(len(t))]


def test_gram_keys_match_brute_force():
    texts = [t or "" for _, t, _, _ in awkward()] + EXTRA + ["abc", "", "de", "\U0001f600é漢字\x00"]
    key, off = quality.gram_keys(*text_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        assert key[off[k] : off[k + 1]].tolist() == keys_of(t), t


def counted(texts):
    n = Counter(k for t in texts for k in keys_of(t))
    return [("en", k, v) for k, v in n.items()]


def brute_model(rows, left_out):
    """Modified Kneser-Ney by dictionaries."""
    level = {quality.ORDER: Counter({k: n for _, k, n in rows})}
    for o in range(quality.ORDER - 1, 0, -1):
        level[o] = Counter(k & ((1 << 12 * o) - 1) for k in level[o + 1])
    p = {}
    for o in range(1, quality.ORDER + 1):
        d = [0.0, *quality.discounts([sum(v == k for v in level[o].values()) for k in (1, 2, 3, 4)])]
        total, mass = Counter(), Counter()
        for k, v in level[o].items():
            total[k >> 12] += v
            mass[k >> 12] += d[min(v, 3)]
        for k, v in level[o].items():
            below = p[o - 1, k & ((1 << 12 * (o - 1)) - 1)] if o > 1 else 1 / 4096
            n, w = v - left_out, total[k >> 12] - left_out
            m = mass[k >> 12] - d[min(v, 3)] + d[min(n, 3)]
            p[o, k] = (max(n - d[min(n, 3)], 0) + m * below) / w if w > 0 else below
    return {k: p[quality.ORDER, k] for k in level[quality.ORDER]}


@pytest.mark.parametrize("left_out", [0, 1])
def test_model_matches_brute_force(spark, left_out):
    rows = counted([prose(k, 200) for k in range(8)] + ["zq xj 1234", "é"])
    model = quality.kneser_ney(spark.createDataFrame(rows, "lang string, key long, n long"), left_out)
    got, want = {r["key"]: r["p"] for r in model.collect()}, brute_model(rows, left_out)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    sums = Counter()
    for k, x in want.items():
        sums[k >> 12] += x
    assert max(sums.values()) <= 1 + 1e-9


def test_counts_come_from_every_document(spark, monkeypatch):
    rows = awkward()
    rows = [*rows, (60, "a # b | c $ d", "en", "s"), (61, "tags #one here and then many words more than ten of them", "en", "s")]
    want, plain = Counter(), Counter()
    for _, t, lang, _ in rows:
        own = Counter((lang or "", k) for k in keys_of(t or ""))
        want += own
        n_words, _, n_symbols, _, _ = brute(t)
        plain += own if n_symbols <= quality.MARKED * n_words else Counter()
    for held in (quality.HELD, 50):  # tasks that send many times, too
        monkeypatch.setattr(quality, "HELD", held)
        got = {(r["lang"], r["key"]): (r["n"], r["plain"]) for r in quality.gram_counts(table(spark, rows).repartition(3)).collect()}
        assert got == {k: (n, plain[k]) for k, n in want.items()}


@pytest.fixture(scope="module")
def corpus():
    good = [(1000 + k, prose(k, 150 + k % 50), "en" if k % 2 else "de", "s") for k in range(300)]
    draw = np.random.default_rng(4)
    junk = [(900 + k, " ".join("".join(chr(x) for x in draw.integers(33, 126, 9)) for _ in range(60)), "en", "s") for k in range(4)]
    return good + junk + awkward()[12:]


def test_verdicts(spark, corpus):
    got = {r["doc_id"]: r for r in quality.quality_rules(table(spark, corpus)).collect() if r["doc_id"] is not None}
    assert all(not got[900 + k]["kept"] and not got[900 + k]["base_failed"] for k in range(4))
    assert sum(got[1000 + k]["kept"] for k in range(300)) >= 297
    assert not got[20]["kept"] and got[20]["n_words"] == 0


def test_keep_good_agrees_and_keeps_columns(spark, corpus):
    docs = table(spark, corpus)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in quality.quality_rules(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == want


def test_large_models_are_joined_with_the_same_result(spark, corpus):
    docs = table(spark, corpus)
    pick = ("doc_id", "n_words", "base_failed", "kept")
    one, two = (sorted(((*[str(r[c]) for c in pick], round(r["cost"], 5)) for r in quality.quality_rules(docs, limit=n).collect())) for n in (quality.BROADCAST_GRAMS, 0))
    assert one == two
    ids = [sorted(str(r["doc_id"]) for r in quality.keep_good(docs, limit=n).collect()) for n in (quality.BROADCAST_GRAMS, 0)]
    assert ids[0] == ids[1]


def test_empty_table(spark):
    assert quality.quality_rules(table(spark, [])).collect() == []
    assert quality.keep_good(table(spark, [])).collect() == []


def test_each_side_of_the_band_rejects_and_mixed_languages_stay(spark):
    """Junk of low perplexity that repeats no window, junk above the band, and clean text of two languages."""
    draw = np.random.default_rng(9)
    other = "der und nicht wald haus baum fluss stein wolke regen sonne winter sommer abend morgen nacht licht".split()

    def german(n):
        return " ".join(other[k] + (str(draw.integers(0, 97)) if draw.integers(0, 3) == 0 else "") for k in draw.integers(0, len(other), n))

    def few(n):  # four words in random order: cheap for the model, and hardly a window of eight comes twice
        return " ".join(("upsilon", "omicron", "epsilon", "lambda")[k] for k in draw.integers(0, 4, n))

    good = [(k, prose(k, 300), "en", "s") for k in range(300)] + [(1000 + k, german(300), "de", "s") for k in range(300)]
    mixed = [(2000 + k, prose(5000 + k, 150) + "\n" + german(150), "en", "s") for k in range(5)]
    low = [(3000 + k, few(300), "en", "s") for k in range(5)]
    high = [(4000 + k, " ".join("".join(chr(x) for x in draw.integers(97, 123, 7)) for _ in range(300)), "en", "s") for k in range(5)]
    docs = table(spark, good + mixed + low + high)
    for limit in (quality.BROADCAST_GRAMS, 0):
        got = {r["doc_id"]: r for r in quality.quality_rules(docs, limit=limit).collect()}
        assert all(got[k]["kept"] for k, *_ in mixed) and sum(got[k]["kept"] for k, *_ in good) >= 595
        assert not any(got[k]["base_failed"] or got[k]["kept"] for k, *_ in low + high)
        assert all(got[k]["deviation"] < -quality.LOW for k, *_ in low) and all(got[k]["above"] > quality.HIGH for k, *_ in high)
        assert sorted(r["doc_id"] for r in quality.keep_good(docs, limit=limit).select("doc_id").collect()) == sorted(k for k, r in got.items() if r["kept"])


def test_texts_full_of_marks_are_rejected_although_they_are_many(spark):
    """A third of the corpus is table rows or marked words, made of the same words as the good texts."""
    good = [(k, prose(k, 200), "en", "s") for k in range(200)]
    rows = [(1000 + k, " | ".join(prose(9000 + k, 120).split()), "en", "s") for k in range(50)]
    marked = [(2000 + k, " ".join(f"{w}{'#$%&*'[len(w) % 5] * 3}" for w in prose(8000 + k, 120).split()), "en", "s") for k in range(50)]
    got = {r["doc_id"]: r for r in quality.quality_rules(table(spark, good + rows + marked)).collect()}
    assert all(got[k]["kept"] for k, *_ in good)
    assert not any(got[k]["kept"] or got[k]["base_failed"] for k, *_ in rows + marked)


def test_verdict_matches_brute_force(spark, corpus):
    """Rules, model, bands and verdict of every row by dictionaries and sorted lists (exact quartiles, so a hair apart)."""
    rows = [r for r in corpus if r[0] is not None]
    counts: dict[str, Counter] = {}
    for _, t, lang, _ in rows:
        n_words, _, n_symbols, _, _ = brute(t)
        if n_symbols <= quality.MARKED * n_words:
            counts.setdefault(lang or "", Counter()).update(keys_of(t or ""))
    models = {lang: brute_model([(lang, k, n) for k, n in c.items()], 1) for lang, c in counts.items()}
    costs, base = {}, {}
    for k, (_, t, lang, _) in enumerate(rows):
        keys = keys_of(t or "")
        own = models.get(lang or "", {})
        costs[k] = sum(-np.log(max(own[g], 1e-6)) if g in own else quality.UNSEEN for g in keys) / max(len(keys), 1)
        n, chars, _, _, rep = brute(t)
        base[k] = (n < 20 or 100 * rep > 30 * n, chars)
    bands = {}
    for lang in {r[2] or "" for r in rows}:
        own = list({(base[k][1], round(costs[k], 6)): k for k, r in enumerate(rows) if (r[2] or "") == lang and not base[k][0]}.values())
        if own:
            mid = float(np.quantile([costs[k] for k in own], 0.5, method="inverted_cdf"))
            q = float(np.quantile([(mid - costs[k]) * np.sqrt(base[k][1]) for k in own], 0.75, method="inverted_cdf"))
            bands[lang] = (mid, max(q / 0.6745, quality.LEAST_UNIT))
    got = {}
    for r in quality.quality_rules(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], r)
    for k, (i, _, lang, _) in enumerate(rows):
        assert abs(got[i]["cost"] - costs[k]) < 1e-4
        failed, chars = base[k]
        assert got[i]["base_failed"] == failed
        if failed or lang is None or lang == "fr":
            continue
        mid, unit = bands[lang]
        deviation = (costs[k] - mid) * np.sqrt(max(chars, 1)) / unit
        assert abs(got[i]["deviation"] - deviation) < 0.01 * max(1, abs(deviation))
        if deviation < -quality.LOW:
            assert not got[i]["kept"]
        elif deviation <= quality.HIGH:
            assert got[i]["kept"]
        else:  # by stretches, each under its cheapest language
            keys, total = keys_of(rows[k][1]), 0.0
            for x in range(0, len(keys), quality.STRETCH):
                part = keys[x : x + quality.STRETCH]
                total += min((sum(-np.log(max(models[m][g], 1e-6)) if g in models[m] else quality.UNSEEN for g in part) - bands[m][0] * len(part)) / bands[m][1] for m in bands)
            assert got[i]["kept"] == (total / len(keys) * np.sqrt(chars) <= quality.HIGH)


def test_clashing_names_are_carried(spark):
    plain = table(spark, awkward())
    docs, carried = clashing(plain)
    for limit in (quality.BROADCAST_GRAMS, 0):
        got = quality.keep_good(docs, limit=limit)
        rows = got.collect()
        assert got.columns == docs.columns and rows and carried(rows)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in quality.keep_good(plain, limit=limit).collect())
