import math
import zlib

import numpy as np
import pyarrow as pa

from girder.llm import toxicity
from girder.llm.common import text_buffer
from tests.llm.helpers import awkward, prose, table


def planted(n):
    rows, labels = [], []
    for k in range(n):
        words = prose(k, 40 + 9 * (k % 30)).split(" ")
        bad = k % 4 == 0
        if bad:
            for j in range(3):
                words.insert((k * 7 + 31 * j) % len(words), ("vilegrub", "vilemok", "vilesar")[(k + j) % 3])
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in toxicity.fresh().items() if not k.startswith("emb")}
    mask = (np.arange(toxicity.WINDOW) < np.array([48, 5, 20])[:, None]).astype(float)
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.WIDTH)) * mask[:, :, None]
    _, saved = toxicity.forward(p, x, mask, keep=True)
    grads, _ = toxicity.backward(p, x, mask, saved, np.ones(3))
    for name in ("wx_f", "wx_b", "wh_f", "wh_b", "att", "out"):
        at = tuple(int(rng.integers(0, n)) for n in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-4
        up = toxicity.forward(p, x, mask).sum()
        p[name][at] = old - 1e-4
        down = toxicity.forward(p, x, mask).sum()
        p[name][at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def plain_logit(p, words):
    """A window's logit word by word, unit by unit."""
    width, hidden = toxicity.WIDTH, toxicity.HIDDEN

    def sig(v):
        return 1 / (1 + math.exp(-v))

    states = []
    for d in "fb":
        wx, wh, bias = p[f"wx_{d}"], p[f"wh_{d}"], p[f"bias_{d}"]
        h, own = [0.0] * hidden, {}
        for t in range(len(words)) if d == "f" else reversed(range(len(words))):
            gx = [sum(words[t][i] * wx[i][j] for i in range(width)) + bias[j] for j in range(3 * hidden)]
            gh = [sum(h[i] * wh[i][j] for i in range(hidden)) for j in range(3 * hidden)]
            new = []
            for j in range(hidden):
                z, r = sig(gx[j] + gh[j]), sig(gx[hidden + j] + gh[hidden + j])
                c = math.tanh(gx[2 * hidden + j] + r * gh[2 * hidden + j])
                new.append((1 - z) * h[j] + z * c)
            h = own[t] = new
        states.append(own)
    both = [states[0][t] + states[1][t] for t in range(len(words))]
    weight = [math.exp(sum(a * b for a, b in zip(p["att"], h, strict=True))) for h in both]
    pooled = [sum(w * h[j] for w, h in zip(weight, both, strict=True)) / sum(weight) for j in range(2 * hidden)]
    return sum(a * b for a, b in zip(pooled, p["out"], strict=True)) + p["out_bias"][0]


def test_forward_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    p = toxicity.fresh(2)
    p |= {k: rng.normal(0, 0.3, p[k].shape).astype(np.float32) for k in ("bias_f", "bias_b", "out_bias")}
    sizes = np.array([toxicity.WINDOW, 1, 17])
    mask = (np.arange(toxicity.WINDOW) < sizes[:, None]).astype(np.float32)
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.WIDTH)).astype(np.float32) * mask[:, :, None]
    got = toxicity.forward(p, x, mask)
    for k, n in enumerate(sizes):
        assert abs(got[k] - plain_logit(p, x[k, :n].tolist())) < 1e-4


def test_cut_has_the_greatest_expected_f1():
    rng = np.random.default_rng(3)
    logit, weight = rng.normal(-1, 2, 400), rng.choice([0.3, 2.0], 400)
    p = 1 / (1 + np.exp(-logit))

    def f1(cut):
        said = logit >= cut
        return 2 * (p * weight)[said].sum() / (weight[said].sum() + (p * weight).sum())

    best = max(f1(c) for c in logit)
    assert abs(f1(toxicity.best_cut(logit, weight)) - best) < 1e-9


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 500, 5000):
        first, size, doc = toxicity.windows(np.array([3, n]))
        own = doc == 1
        seen = np.zeros(n, bool)
        for f, s in zip(first[own] - 3, size[own], strict=True):
            seen[f : f + s] = True
        assert seen.all() and own.sum() >= 1


def test_held_out_accuracy(spark):
    rows, labels = planted(420)
    docs = table(spark, rows + [(1000 + k, t, x, s) for k, (_, t, x, s) in enumerate(awkward())] + [(None, "vilegrub", "en", "s")])
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    good = sum((got[i] >= 0.7) == bool(y) for i, y in held)
    assert good / len(held) > 0.9


def test_without_labels_or_rows(spark):
    docs = table(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(k, 1, 1) for k in range(12)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}
    assert toxicity.score(table(spark, []), {"share": 0.0}).collect() == []


def test_rows_do_not_depend_on_their_batch():
    p = toxicity.fresh()
    texts = [t for _, t, _, _ in awkward()]
    together = toxicity.text_logits(p, *text_buffer(pa.array(texts, pa.string())))
    alone = [toxicity.text_logits(p, *text_buffer(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


def test_every_character_of_a_word_counts():
    p = toxicity.fresh()
    word = "abcdefghijklmnop"
    texts = [word] + [word[:k] + "z" + word[k + 1 :] for k in range(len(word))]
    ids, _, vocab = toxicity.word_ids(*text_buffer(pa.array(texts, pa.string())))
    chars = toxicity.characters(p, vocab)[ids[:, -1]]
    assert all(np.abs(chars[k] - chars[0]).max() > 1e-3 for k in range(1, len(texts)))
    grams, bounds = vocab
    for k, t in enumerate(texts):
        rows = grams[bounds[ids[k, -1]] : bounds[ids[k, -1] + 1]]
        assert len(rows) == len(t)
        assert np.allclose(chars[k], p["emb_gram"][rows].sum(axis=0) / len(t) ** 0.5, atol=1e-6)


def test_training_texts_are_bounded_by_bytes(spark, monkeypatch):
    rows, labels = planted(60)
    rows += [(3, "least text of its id", "en", "s")]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, prior: seen.append((texts, y)) or {"share": 0.0})
    toxicity.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample_bytes=3000)
    texts, y = seen[0]
    assert all(0 < sum(len(t.encode()) for t, own in zip(texts, y, strict=True) if own == k) <= 3000 for k in (0, 1))
    assert set(texts) <= {t for _, t, _, _ in rows}
