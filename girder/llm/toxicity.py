"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a word embedding, embeddings of its leading 4, 5 and 6 and trailing 3 characters, and the sum of
the embeddings of all its character trigrams, divided by the root of their number, so that every character is seen (a trigram
stands around each character, with a mark beyond the word's ends). Characters are UTF-8 bytes, tables are hashed. Overlapping windows of WINDOW words, one every STRIDE words, cover the whole
text; each window's states are pooled by attention into one logit. A text's logit is its highest window's, and
a logistic curve turns it into a score; it is fitted on a fifth of each class's training texts, from which the network does not learn
(on all of them where a class has under five). The curve is moved so that CUT is where, at the labels' own share of label 1, the expected F1 of
those texts is greatest; scores order texts by how likely label 1 is, but 0.7 is a decision's bound and not a share of 0.7.

Training texts carry one label for many windows, so training alternates: score all windows, then learn from each
text's highest one (and from random windows of clean texts). It uses at most `sample` labelled texts of each class, chosen by
a hash of the id, and of these whole texts as many, in that order, as fit in `sample_bytes` a class; scoring covers every window of every text, in Arrow batches, with no shuffle.

Defined cases: null, empty and wordless texts get the score of one empty window; without both labels the score is the
share of label 1 (0 without labels) for every text; repeated rows are scored each, and the least text of an id is learned from; rows without an id are scored
and held out by the hash of null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import LOWER, ByteHash, mix, pieces, runs, staged, text_buffer

WINDOW, STRIDE = 48, 36
WIDTH, HIDDEN = 16, 8
TABLES = {"word": 1 << 15, "lead4": 1 << 13, "lead5": 1 << 13, "lead6": 1 << 13, "tail3": 1 << 12}
GRAMS = 1 << 14
SAMPLE, SAMPLE_BYTES = 2_500, 32 << 20
#: The score from which a text counts as toxic.
CUT = 0.7
#: Optimizer steps at least, in all and on random windows, for small samples.
STEPS, WARM = 300, 120

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True

# ---------------------------------------------------------------- inputs


def word_ids(buf: np.ndarray, off: np.ndarray):
    """For every word a row number in each table and its place in the vocabulary (n x 6), the words of each text, and the
    vocabulary: the trigrams of its words, one after the other, and where each word's begin."""
    low = LOWER[buf]
    starts, ends = runs(_WORD[low], off)
    h = ByteHash(low)
    lead = [h(starts, np.minimum(starts + k, ends)) for k in (4, 5, 6)]
    keys = [h(starts, ends), *lead, h(np.maximum(ends - 3, starts), ends)]
    cols = [(k & np.uint64(n - 1)).astype(np.int32) for k, n in zip(keys, TABLES.values(), strict=True)]
    _, first, place = np.unique(keys[0], return_index=True, return_inverse=True)
    doc = np.searchsorted(off, starts, side="right") - 1
    vocab = word_grams(low, starts[first], ends[first])
    return np.stack([*cols, place.astype(np.int32)], axis=1), np.bincount(doc, minlength=len(off) - 1), vocab


def word_grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all trigrams of the words low[start:end], and the bounds of each word's."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
    left = np.where(at > np.repeat(starts, size), low[at - 1], 0).astype(np.uint64)
    right = np.where(at + 1 < np.repeat(ends, size), low[np.minimum(at + 1, len(low) - 1)], 0).astype(np.uint64)
    code = left | low[at].astype(np.uint64) << np.uint64(8) | right << np.uint64(16)
    return (mix(code + np.uint64(1)) & np.uint64(GRAMS - 1)).astype(np.int32), bounds


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; a text has one at least, and its last one ends it."""
    n = np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k * STRIDE, np.maximum(counts[doc] - WINDOW, 0))
    first = (np.cumsum(counts) - counts)[doc] + at
    return first, np.minimum(counts[doc], WINDOW), doc


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {f"emb_{k}": rng.normal(0, 0.05, (n, WIDTH)) for k, n in {**TABLES, "gram": GRAMS}.items()}
    for d in "fb":
        p |= {f"wx_{d}": rng.normal(0, 0.3, (WIDTH, 3 * HIDDEN)), f"wh_{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"bias_{d}": np.zeros(3 * HIDDEN)}
    p |= {"att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def characters(p: dict, vocab: tuple[np.ndarray, np.ndarray], step: int = 1 << 15) -> np.ndarray:
    """The character input of each word of a vocabulary."""
    grams, bounds = vocab
    out = np.zeros((len(bounds) - 1, WIDTH), np.float32)
    for k in range(0, len(out), step):
        b = bounds[k : k + step + 1]
        total = np.add.reduceat(p["emb_gram"][grams[b[0] : b[-1]]], b[:-1] - b[0])
        out[k : k + step] = total / np.sqrt(np.diff(b)).astype(np.float32)[:, None]
    return out


def embed(p: dict, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Inputs of words; chars are the character inputs of their vocabulary."""
    x = p["emb_word"][ids[:, 0]]
    for k, name in enumerate(list(TABLES)[1:], 1):
        x = x + p[f"emb_{name}"][ids[:, k]]
    return x + chars[ids[:, -1]] if len(ids) else x


def scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums (n x WIDTH) of the values of equal rows."""
    at = (rows.astype(np.int64)[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(at, values.ravel(), n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def _gru(p: dict, d: str, gx: np.ndarray, mask: np.ndarray, keep: bool):
    """States (n, T, H) of one direction; gx: input gates (n, T, 3H) with the bias, mask (n, T)."""
    n, steps = mask.shape
    w, h = p[f"wh_{d}"], np.zeros((n, HIDDEN), np.float32)
    out, past = np.empty((n, steps, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = h @ w
        zr = _sigmoid(gx[:, t, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gx[:, t, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        m = mask[:, t, None]
        new = h + m * z * (c - h)
        if keep:
            past.append((t, h, z, r, c, g[:, 2 * HIDDEN :], m))
        h = new
        out[:, t] = h
    return out, past


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows x (n, T, WIDTH); with keep, also what backward() needs."""
    sides = [_gru(p, d, x @ p[f"wx_{d}"] + p[f"bias_{d}"], mask, keep) for d in "fb"]
    h = np.concatenate([s[0] for s in sides], axis=2)
    a = np.where(mask > 0, h @ p["att"], -30.0)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", a, h)
    logit = pooled @ p["out"] + p["out_bias"]
    return (logit, (h, a, pooled, sides)) if keep else logit


def backward(p: dict, x: np.ndarray, mask: np.ndarray, saved, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    h, a, pooled, sides = saved
    g = {"out": pooled.T @ dlogit, "out_bias": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * p["out"]
    dh = a[:, :, None] * dpooled[:, None, :]
    da = np.einsum("nth,nh->nt", h, dpooled)
    ds = a * (da - (a * da).sum(axis=1, keepdims=True)) * (mask > 0)
    g["att"] = np.einsum("nt,nth->h", ds, h)
    dh += ds[:, :, None] * p["att"]
    dx = np.zeros_like(x)
    for side, d in enumerate("fb"):
        w = p[f"wh_{d}"]
        dw, dgx = np.zeros_like(w), np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        carry = np.zeros((len(x), HIDDEN), np.float32)
        for t, before, z, r, c, gc, m in reversed(sides[side][1]):
            dnew = dh[:, t, side * HIDDEN : (side + 1) * HIDDEN] + carry
            dc = dnew * m * z * (1 - c * c)
            dz = dnew * m * (c - before) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dgates = np.concatenate([dz, dr, dc], axis=1)
            dhidden = np.concatenate([dz, dr, dc * r], axis=1)
            dgx[:, t] = dgates
            dw += before.T @ dhidden
            carry = dnew * (1 - m * z) + dhidden @ w.T
        g |= {f"wh_{d}": dw, f"bias_{d}": dgx.sum(axis=(0, 1)), f"wx_{d}": np.tensordot(x, dgx, axes=([0, 1], [0, 1]))}
        dx += dgx @ p[f"wx_{d}"].T
    return g, dx


def _window_inputs(x: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Embeddings (n, T, WIDTH) and mask of windows over the words' embeddings x."""
    t = np.arange(WINDOW)
    mask = (t < size[:, None]).astype(np.float32)
    at = np.minimum(first[:, None] + t, max(len(x) - 1, 0))
    return (x[at] if len(x) else np.zeros((len(first), WINDOW, x.shape[1]), np.float32)) * mask[:, :, None], mask


def window_logits(p: dict, ids: np.ndarray, vocab, first: np.ndarray, size: np.ndarray, step: int = 2048) -> np.ndarray:
    chars = characters(p, vocab)
    out = [np.zeros(0, np.float32)]
    for k in range(0, len(first), step):  # windows are in order, so a step's words are one slice
        f, n = first[k : k + step], size[k : k + step]
        lo, hi = int(f[0]), int((f + n).max())
        out.append(forward(p, *_window_inputs(embed(p, ids[lo:hi], chars), f - lo, n)))
    return np.concatenate(out)


def text_logits(p: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The highest window's logit of each text."""
    ids, counts, vocab = word_ids(buf, off)
    first, size, doc = windows(counts)
    logit = window_logits(p, ids, vocab, first, size)
    return np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(counts)))) if len(counts) else logit


# ---------------------------------------------------------------- training


def best_cut(logit: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on label 1 is to be said for the greatest expected F1, if the logits are those of true probabilities."""
    order = np.argsort(-logit, kind="stable")
    p, w = 1 / (1 + np.exp(-np.clip(logit[order], -30, 30))), weight[order]
    found, said = np.cumsum(p * w), np.cumsum(w)
    f1 = (2 * found / (said + found[-1])).max()
    return float(np.log(f1 / 2) - np.log(1 - f1 / 2))  # the best cut is half of the best F1


def train(texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 192, rate: float = 0.006, seed: int = 5, prior: float | None = None) -> dict:
    """Fit the network and the curve (`slope`, `shift`) on whole texts.

    prior: the share of label 1 where the texts come from, if the sample's own differs.
    """
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return {"share": share}
    rng = np.random.default_rng(seed)
    made = [word_ids(*text_buffer(pa.array(texts[k : k + 32], pa.large_string()))) for k in range(0, len(texts), 32)]
    ids, counts, vocabs = zip(*made, strict=True)
    before = np.cumsum([0] + [len(b) - 1 for _, b in vocabs])
    for part, n in zip(ids, before, strict=False):
        part[:, -1] += n
    ids, counts, grams = np.concatenate(ids), np.concatenate(counts), np.concatenate([g for g, _ in vocabs])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in vocabs]))])
    pace = max(1, 3 * len(texts) // batch)
    epochs, warm = max(epochs, -(-STEPS // pace)), max(2, -(-WARM // pace))
    first, size, doc = windows(counts)
    begin = np.searchsorted(doc, np.arange(len(texts)))
    n_win = np.bincount(doc, minlength=len(texts))
    p = fresh(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(labels > 0, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum())).astype(np.float32)
    aside = np.zeros(len(labels), bool)
    for y in (0, 1):
        of_class = rng.permutation(np.flatnonzero(labels == y))
        aside[of_class[: len(of_class) // 5]] = True
    for epoch in range(epochs):
        if epoch < warm:  # any window
            pick = np.concatenate([begin + rng.integers(0, n_win) for _ in range(3)])
        else:
            logit = window_logits(p, ids, (grams, bounds), first, size)
            order = np.lexsort((logit, doc))
            best = order[begin + n_win - 1]
            clean = np.flatnonzero(labels == 0)
            pick = np.concatenate([best, (begin + rng.integers(0, n_win))[clean]])
        pick = rng.permutation(pick[~aside[doc[pick]]])
        for k in range(0, len(pick), batch):
            w = pick[k : k + batch]
            y = labels[doc[w]]
            t = np.arange(WINDOW)
            mask = (t < size[w][:, None]).astype(np.float32)
            at = np.minimum(first[w][:, None] + t, max(len(ids) - 1, 0))
            own = ids[at.ravel()]
            x = p["emb_word"][own[:, 0]] * (rng.random((len(own), 1)) < 0.5)  # words are dropped half the time
            keep_word = (x != 0).any(axis=1, keepdims=True)
            x = x * 2
            for j, name in enumerate(list(TABLES)[1:], 1):
                x = x + p[f"emb_{name}"][own[:, j]]
            used, place = np.unique(own[:, -1], return_inverse=True)
            n_grams = bounds[used + 1] - bounds[used]
            ends = np.cumsum(n_grams)
            own_grams = grams[np.repeat(bounds[used] - (ends - n_grams), n_grams) + np.arange(n_grams.sum())]
            if len(ids):
                x = x + characters(p, (own_grams, np.concatenate([[0], ends])))[place]
            x = x.reshape(len(w), WINDOW, WIDTH).astype(np.float32) * mask[:, :, None]
            logit, saved = forward(p, x, mask, keep=True)
            d = (_sigmoid(logit) - y) * weight[doc[w]] / len(w)
            g, dx = backward(p, x, mask, saved, d.astype(np.float32))
            dx = (dx * mask[:, :, None]).reshape(-1, WIDTH)
            for j, name in enumerate(TABLES):
                e = scattered(own[:, j], dx * (2 * keep_word if j == 0 else 1), len(p[f"emb_{name}"]))
                g[f"emb_{name}"] = e + 1e-5 * p[f"emb_{name}"]
            of_words = scattered(place, dx, len(used)) / np.sqrt(n_grams).astype(np.float32)[:, None]
            g["emb_gram"] = scattered(own_grams, np.repeat(of_words, n_grams, axis=0), GRAMS) + 1e-5 * p["emb_gram"]
            step += 1
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    top = np.maximum.reduceat(window_logits(p, ids, (grams, bounds), first, size), begin).astype(float)
    if len(np.unique(labels[aside])) == 2:
        top, labels = top[aside], labels[aside]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # the logistic curve, by damped Newton steps
        q = 1 / (1 + np.exp(-np.clip(slope * top + shift, -30, 30)))
        r, c = q - (labels * 0.98 + 0.01), q * (1 - q) + 1e-4
        hess = np.array([[(c * top * top).sum() + 1e-3, (c * top).sum()], [(c * top).sum(), c.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(r * top).sum(), r.sum()])
        slope, shift = slope - 0.5 * move[0], shift - 0.5 * move[1]
    share = float(labels.mean())
    if prior is not None and 0 < prior < 1:
        shift += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    else:
        prior = share
    weight = np.where(labels > 0, prior / share, (1 - prior) / (1 - share))
    shift += np.log(CUT / (1 - CUT)) - best_cut(slope * top + shift, weight)
    return {k: x.astype(np.float32) for k, x in p.items()} | {"slope": slope, "shift": shift}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Train on at most `sample` labelled texts of each class that are not held out, chosen by a hash of the id.

    Whole texts are taken in that order while they fit in `sample_bytes`; one that does not fit is passed over.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    own = own.groupBy(id_col).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64(F.lit(3), id_col))
    some = [own.where(F.col("y") == y).orderBy("h", id_col).limit(sample) for y in (0, 1)]
    picked = some[0].union(some[1]).select(F.col(id_col).alias("id"), "y", "h")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prior = own.agg(F.avg(F.col("y").cast("double")).alias("p")).first()["p"]
    texts = staged(texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h")), "labelled")
    left, ids = {0: sample_bytes, 1: sample_bytes}, []
    for i, y, n in texts.orderBy("h", "id").select("id", "y", F.octet_length("text")).collect():
        if n <= left[y]:
            left[y] -= n
            ids.append((i,))
    chosen = docs.sparkSession.createDataFrame(ids, texts.select("id").schema)
    rows = sorted((r["id"], r["text"], r["y"]) for r in texts.join(F.broadcast(chosen), "id").collect())
    return train([r[1] for r in rows], np.array([r[2] for r in rows]), prior=prior)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                if "share" in p:
                    found = np.full(b.num_rows, p["share"])
                else:
                    logit = text_logits(p, *text_buffer(b.column("text"))).astype(float)
                    found = 1 / (1 + np.exp(-np.clip(p["slope"] * logit + p["shift"], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found)], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
