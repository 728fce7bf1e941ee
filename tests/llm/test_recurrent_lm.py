"""Counts against plain Python, the network against numeric gradients and a step-by-step pass, probabilities that sum to one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import queries
from girder.llm import recurrent_lm as lm
from tests.llm.helpers import awkward, table


def by_hand(rows):
    """(doc, n_tokens, n_known, total, base) of each row, from the contract's words."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*(t or "").translate(lower).encode().split(), b"\n"] for _, t in rows]
    c = Counter(x for (i, _), own in zip(rows, tokens, strict=True) if crc(i) != 1 for x in own)
    n, v = sum(c.values()), len(c)
    z = n + 0.5 * (v + 1)
    return [(i, crc(i) == 1, len(own), sum(c[x] > 0 for x in own), n, sum(math.log10((c[x] + 0.5) / z) for x in own)) for (i, _), own in zip(rows, tokens, strict=True)]


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_query_counts_equal_plain_python_and_the_network_beats_them(spark, small):
    got = queries.op11_recurrent_lm(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    close([r[:6] for r in got], by_hand([tuple(r) for r in docs]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("hot", [0, 5, 10**6])
def test_rare_tokens_are_joined_with_the_same_result(spark, hot):
    rows = awkward()
    docs = table(spark, rows)
    got = lm.score_texts(docs, trains=lm.remainder("doc_id", 5) != 1, hot=hot, rounds=1)
    close(got.select("doc_id", ~F.col("trains"), "n_tokens", "n_known", "train_tokens", "base_score").collect(), by_hand([(r[0], r[1]) for r in rows]))


def test_no_training_text_and_no_rows(spark):
    docs = table(spark, awkward())
    got = lm.score_texts(docs, trains=F.lit(False)).collect()
    assert len(got) == len(awkward()) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in got)
    assert lm.score_texts(docs.limit(0)).count() == 0


def network():
    rng = np.random.default_rng(3)
    net = lm.Network.fresh(rng.integers(1, 99, lm.HEAD).astype(float), np.ones(lm.TAIL_CLASSES))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net, rng


def test_gradients_equal_differences():
    net, rng = network()
    x = rng.integers(0, lm.HEAD + lm.TAIL_CLASSES, (6, 3))
    x[0, 0], x[1, 0] = 5, 9
    fresh, weight, h = np.ones((6, 3)), np.full((6, 3), 1 / 18), np.zeros((3, lm.HIDDEN))
    fresh[0], fresh[3, 1] = 0, 0
    _, _, g = net.window(h, x, fresh, weight)
    for k, at in [("u", (3, 5)), ("u", (3, 20)), ("u", (3, 40)), ("b", (4,)), ("c", (2, 0)), ("cb", (0,)), ("w", (9, 3)), ("wb", (5,)), ("x", (5, 7)), ("x", (5, 20)), ("x", (5, 40))]:
        own, loss = net.p[k][at], []
        for step in (1e-4, -1e-4):
            net.p[k][at] = own + step
            loss.append(net.window(h, x, fresh, weight)[1])
        net.p[k][at] = own
        found = g["x"][1][list(g["x"][0]).index(at[0])][at[1]] if k == "x" else g[k][at]
        assert abs((loss[0] - loss[1]) / 2e-4 - found) < 1e-5


def test_scores_of_dealt_texts_equal_a_plain_loop():
    net, rng = network()
    texts = [rng.integers(0, lm.HEAD + lm.TAIL_CLASSES, n).astype(np.int16) for n in (1, 70, 3, 200, 1, 45) * 20]
    p, size = net.p, lm.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    for text, got in zip(texts[:6], net.score(texts)[:6], strict=True):
        h, total = np.zeros(size), 0.0
        for t in text.tolist():
            e = np.exp(h @ p["c"] + p["cb"])
            per = lm.HEAD // lm.HEAD_CLASSES
            k = t // per if t < lm.HEAD else t - lm.HEAD + lm.HEAD_CLASSES
            total += math.log(e[k] / e.sum())
            if t < lm.HEAD:
                e = np.exp(p["w"][k * per : (k + 1) * per] @ h + p["wb"][k * per : (k + 1) * per])
                total += math.log(e[t % per] / e.sum())
            x, u = p["x"][t], h @ p["u"]
            z, r = sig(x[:size] + u[:size]), sig(x[size : 2 * size] + u[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * (u[2 * size :] + p["b"]))
            h = z * h + (1 - z) * n
        assert abs(total - got) < 1e-3


def test_training_reads_every_token():
    net, rng = network()
    for n in (1, 5, 8, 513, 4097, 10_000):
        assert net.train(rng.integers(0, lm.HEAD, n)) == n


def test_probabilities_of_all_tokens_and_unseen_ones_sum_to_one():
    tokens = [b"w%d" % k for k in range(lm.HEAD + 300)]
    counts = [2000 - k for k in range(len(tokens))]
    tail, kinds = np.zeros(lm.TAIL_CLASSES), np.zeros(lm.TAIL_CLASSES)
    for t, n in zip(tokens[lm.HEAD :], counts[lm.HEAD :], strict=True):
        tail[lm.tail_class(t)] += n
        kinds[lm.tail_class(t)] += 1
    v = lm.Vocabulary(tokens, counts, sum(counts), len(tokens), tail, kinds)
    number, count = v.look_up(tokens)
    net = lm.Network.fresh(v.head_counts, v.tail_counts)
    logs, _ = net.predict(np.full((len(tokens), lm.HIDDEN), 0.3, np.float32), number.astype(np.int64))
    inner = np.where(number >= lm.HEAD, np.log10(count + 0.5) - v.tail_log[np.maximum(number - lm.HEAD, 0)], 0.0)
    unseen, _ = net.predict(np.full((lm.TAIL_CLASSES, lm.HIDDEN), 0.3, np.float32), lm.HEAD + np.arange(lm.TAIL_CLASSES))
    rest = (np.exp(unseen) * 0.5 / 10**v.tail_log).sum()
    assert abs((np.exp(logs) * 10**inner).sum() + rest - 1) < 1e-4
