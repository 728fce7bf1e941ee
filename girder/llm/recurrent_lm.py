"""Language-model scoring by a gated recurrent network over words, with a class-factored softmax, trained in numpy.

Tokens are the words of a text with A-Z lower-cased, then one end. The HEAD most frequent tokens of the training texts are known to the network by
themselves, in HEAD_CLASSES classes by frequency. Every other word is known by a tail class, one of TAIL_CLASSES by a checksum of its last three bytes;
inside its class a word has the probability (c + 0.5) / (N_k + 0.5 * (V_k + 1)), from its count c and the class's counts, so that words never seen have
one too. log P(token) = log P(class | state) + log P(token | class, state or counts).

Training covers every training text. Texts are written once as arrays of token numbers. In each of ROUNDS rounds, the texts of that round (by
a hash of the row) are dealt to the tasks that read them; a task starts from the round's parameters, cuts its tokens into lanes, and goes
through them in windows of STEPS tokens with truncated backpropagation (the state is carried from window to window, the gradient is not). The
parameters are then averaged by tokens trained, in two steps: slots of tasks, then the slots on the driver, which gets SLOTS parameter sets
at most. Class and word biases start at the unigram.

Scoring reads whole texts: a piece of a batch is dealt to lanes of about even length, a text stays in one lane, and its state is
carried over all its windows. The counts of the HOT most frequent tokens are sent to the tasks; the counts of the others are
joined by Spark (few of all tokens, none of them frequent in the training texts), so nothing that is broadcast grows with the vocabulary.

base_score is the log10 probability under counts alone: the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Defined cases: a null or empty text is its end token alone; a row without an id belongs to the training texts; repeated rows and ids are each learned
from and scored on their own; without any training text all counts are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import pieces, staged

#: The end token; no word holds a line feed.
END = b"\n"
HEAD, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 1024, 16, 48, 16
HOT = 200_000
ROUNDS, WORKERS, SLOTS = 4, 1024, 32
LANES, STEPS, RATE = 512, 8, 0.05
#: Bytes of text or of token numbers that are worked on at a time, and distinct tokens that a counting task holds.
PIECE, NUMBERS, HELD = 2 << 20, 4 << 20, 400_000
_PER_CLASS = HEAD // HEAD_CLASSES
_CLASSES = HEAD_CLASSES + TAIL_CLASSES
_A2Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def remainder(id_col: str, of: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words, then the end. bytes.split() cuts at space and 9 to 13."""
    words = (text or b"").translate(_A2Z).split()
    words.append(END)
    return words


def _bytes(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.binary()).to_pylist()


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAIL_CLASSES


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        keys = list(held)
        for k in range(0, len(keys), 1 << 16):
            own = keys[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([held[x] for x in own], pa.int64())], names=["token", "n"])
        held.clear()

    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            for text in _bytes(part.column("text")):
                held.update(tokens_of(text))
            if len(held) > HELD:
                yield from flush()
    yield from flush()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n, tail): how often each token occurs, and its tail class."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return rows.withColumn("tail", (F.crc32(F.expr("substring(token, -3, 3)")) % TAIL_CLASSES).cast("int"))


class Vocabulary:
    """What a task needs to number tokens: the hot tokens (head tokens first, in order) with their counts, and the sums of the tail classes."""

    def __init__(self, tokens: list[bytes], counts: list[int], total: int, distinct: int, tail_total: np.ndarray, tail_distinct: np.ndarray):
        self.tokens, self.total, self.distinct = tokens, total, distinct
        self.counts = np.append(np.array(counts, np.int64), -1)
        number = np.array([k if k < HEAD else HEAD + tail_class(t) for k, t in enumerate(tokens)], np.int16)
        self.numbers = np.append(number, np.int16(-1))
        self.tail_log = np.log10(tail_total + 0.5 * (tail_distinct + 1))
        self.head_counts = np.zeros(HEAD)
        self.head_counts[: min(HEAD, len(tokens))] = counts[:HEAD]
        self.tail_counts = tail_total
        self.places: dict[bytes, int] = {}

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number, count): the head's number or HEAD + tail class, and the count, -1 where the token is not hot."""
        if len(self.places) != len(self.tokens):
            self.places = {t: k for k, t in enumerate(self.tokens)}
        at = np.fromiter(map(self.places.get, tokens, repeat(-1)), np.int64, len(tokens))
        number = self.numbers[at]
        rest = np.flatnonzero(at < 0)
        number[rest] = [HEAD + tail_class(tokens[k]) for k in rest.tolist()]
        return number, self.counts[at]


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """Head and hot tokens, most frequent first (ties: the lesser token), of a counted table."""
    by_tail = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    least = counts.groupBy("n").count().orderBy(F.desc("n")).limit(hot).collect()  # which counts are frequent enough: `hot` rows at most
    took, limit = 0, 0
    for r in least:
        if took + r["count"] > max(hot, 1):
            break
        took, limit = took + r["count"], r["n"]
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "n").collect()
    sums = np.array([by_tail.get(k, (0, 0)) for k in range(TAIL_CLASSES)], np.int64).reshape(TAIL_CLASSES, 2)
    total, distinct = int(sums[:, 0].sum()), int(sums[:, 1].sum())
    tail = sums.copy()
    for r in top:
        tail[tail_class(bytes(r["token"]))] -= (r["n"], 1)
    frequent = {bytes(r["token"]): r["n"] for r in top}
    if limit:
        rows = counts.where(F.col("n") >= limit).select("token", "n").toArrow()
        frequent |= dict(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return Vocabulary(list(frequent), list(frequent.values()), total, distinct, tail[:, 0].astype(float), tail[:, 1].astype(float))


# ---------------------------------------------------------------- texts as numbers

_NUMBERED = "doc_id {id}, row long, trains boolean, n_tokens long, numbers binary, n_known long, logs double, tail_logs double, rare array<binary>"


def _number(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v: Vocabulary = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = [tokens_of(t) for t in _bytes(part.column("text"))]
                tokens = [t for x in texts for t in x]
                number, count = v.look_up(tokens)
                off = np.zeros(len(texts) + 1, np.int64)
                np.cumsum([len(x) for x in texts], out=off[1:])
                hot = count >= 0
                log = np.where(hot, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                logs, tails = np.add.reduceat(log, off[:-1]), np.add.reduceat(np.where(number >= HEAD, log, 0.0), off[:-1])
                known = np.add.reduceat((count > 0).astype(np.int64), off[:-1])
                rare = np.flatnonzero(~hot)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, off), pa.int32()), pa.array([tokens[k] for k in rare.tolist()], pa.binary()))
                raw = [number[off[k] : off[k + 1]].tobytes() for k in range(len(texts))]
                rows = pa.array(np.arange(row, row + len(texts)))
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), rows, part.column("trains"), pa.array(np.diff(off)), pa.array(raw, pa.binary()), pa.array(known), pa.array(logs), pa.array(tails), rare],
                    names=["doc_id", "row", "trains", "n_tokens", "numbers", "n_known", "logs", "tail_logs", "rare"],
                )

    return work


def numbered(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: its token numbers, sums over its hot tokens, and its other tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("trains"))
    return rows.mapInArrow(_number(shared), _NUMBERED.format(id=docs.schema[id_col].dataType.simpleString()))


# ---------------------------------------------------------------- the network


class Network:
    """One-hot gated recurrent cell; class scores and head-word scores from the state. Adagrad."""

    SHAPES = {"x": (HEAD + TAIL_CLASSES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, _CLASSES), "cb": (_CLASSES,), "w": (HEAD, HIDDEN), "wb": (HEAD,)}

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.sums = {k: np.full(v.shape, 1e-7, np.float32) for k, v in p.items()}

    @classmethod
    def fresh(cls, head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; biases at the unigram."""
        rng = np.random.default_rng(seed)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in cls.SHAPES.items()}
        classes = np.concatenate([head_counts.reshape(HEAD_CLASSES, -1).sum(axis=1), tail_counts]) + 0.5
        p["b"][:] = 0
        p["cb"] = np.log(classes / classes.sum()).astype(np.float32)
        p["wb"] = np.log(head_counts + 0.5).astype(np.float32)
        return cls(p)

    def packed(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Network:
        flat, at, p = np.frombuffer(raw, np.float32), 0, {}
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            p[k], at = flat[at : at + n].reshape(s).copy(), at + n
        return cls(p)

    def cell(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from h and the inputs' rows x, and what the way back needs."""
        hu = h @ self.p["u"]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = hu[:, 2 * HIDDEN :] + self.p["b"]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
        return n + z * (h - n), z, r, n, inner

    def predict(self, h: np.ndarray, number: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class) and, for head tokens, of P(token | class) too; with grads also the gradient by h."""
        k = np.where(number < HEAD, number // _PER_CLASS, number - HEAD + HEAD_CLASSES)
        at = np.arange(len(h))
        e = h @ self.p["c"] + self.p["cb"]
        e -= e.max(axis=1, keepdims=True)
        own = e[at, k]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        out = own - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[at, k] -= 1
            e *= weight[:, None]
            grads["c"] += h.T @ e
            grads["cb"] += e.sum(axis=0)
            dh = e @ self.p["c"].T
        by = np.argsort(k.astype(np.int16), kind="stable")
        bounds = np.searchsorted(k[by], np.arange(HEAD_CLASSES + 1))
        for c in range(HEAD_CLASSES):
            own = by[bounds[c] : bounds[c + 1]]
            if not len(own):
                continue
            words = slice(c * _PER_CLASS, (c + 1) * _PER_CLASS)
            w, hs, j, at = self.p["w"][words], h[own], number[own] - c * _PER_CLASS, np.arange(len(own))
            e = hs @ w.T + self.p["wb"][words]
            e -= e.max(axis=1, keepdims=True)
            first = e[at, j]
            np.exp(e, out=e)
            total = e.sum(axis=1)
            out[own] += first - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[at, j] -= 1
                e *= weight[own, None]
                grads["w"][words] += e.T @ hs
                grads["wb"][words] += e.sum(axis=0)
                dh[own] += e @ w
        return out, dh

    def window(self, h: np.ndarray, numbers: np.ndarray, fresh: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, dict]:
        """Goes through numbers (steps x lanes): the state after them, the loss, and its gradients. fresh: 0 where a text begins."""
        steps, lanes = numbers.shape
        g = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items() if k != "x"}
        rows = self.p["x"][numbers]
        before, kept = np.empty((steps, lanes, HIDDEN), np.float32), []
        for t in range(steps):
            h = h * fresh[t][:, None]
            before[t] = h
            h, *rest = self.cell(h, rows[t])
            kept.append(rest)
        logs, dh = self.predict(before.reshape(-1, HIDDEN), numbers.ravel(), g, weight.ravel())
        dh = dh.reshape(steps, lanes, HIDDEN)
        dx = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        du = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        after = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, n, inner = kept[t]
            own = before[t]
            dn = after * (1 - z) * (1 - n * n)
            dx[t, :, :HIDDEN] = after * (own - n) * z * (1 - z)
            dx[t, :, HIDDEN : 2 * HIDDEN] = dn * inner * r * (1 - r)
            dx[t, :, 2 * HIDDEN :] = dn
            du[t, :, : 2 * HIDDEN] = dx[t, :, : 2 * HIDDEN]
            du[t, :, 2 * HIDDEN :] = dn * r
            after = (after * z + du[t] @ self.p["u"].T + dh[t]) * fresh[t][:, None]
        flat = du.reshape(-1, 3 * HIDDEN)
        g["u"] = before.reshape(-1, HIDDEN).T @ flat
        g["b"] = flat[:, 2 * HIDDEN :].sum(axis=0)
        by = np.argsort(numbers.ravel(), kind="stable")
        sorted_ = numbers.ravel()[by]
        head = np.flatnonzero(np.diff(sorted_, prepend=-1))
        g["x"] = (sorted_[head], np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[by], head, axis=0))
        return h, -float((logs * weight.ravel()).sum()), g

    def learn(self, g: dict, rate: float = RATE) -> None:
        for k, d in g.items():
            if k == "x":
                at, d = d
                self.sums[k][at] += d * d
                self.p[k][at] -= rate * d / np.sqrt(self.sums[k][at])
            else:
                self.sums[k] += d * d
                self.p[k] -= rate * d / np.sqrt(self.sums[k])

    def train(self, numbers: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> int:
        """One pass over a row of whole texts' numbers; what does not fill the lanes follows in fewer lanes. Returns the tokens trained."""
        done = 0
        fresh = np.ones(len(numbers), np.float32)
        fresh[:1] = 0
        fresh[1:][_is_end(numbers[:-1], self.end)] = 0
        while done < len(numbers):
            left = len(numbers) - done
            own = max(1, min(lanes, left // steps))
            length = left // own
            x = numbers[done : done + own * length].reshape(own, length).T
            f = fresh[done : done + own * length].reshape(own, length).T.copy()
            f[0] = 0
            h = np.zeros((own, HIDDEN), np.float32)
            for t in range(0, length, steps):
                part = np.ascontiguousarray(x[t : t + steps])
                h, _, g = self.window(h, part, f[t : t + steps], np.full(part.shape, 1.0 / part.size, np.float32))
                self.learn(g)
            done += own * length
        return done

    end = -1

    def score(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text (of its classes and head words), the state carried from its first to its last token."""
        sizes = np.array([len(x) for x in numbers], np.int64)
        lanes = int(np.clip(sizes.sum() // max(int(sizes.max(initial=1)), 1), 64, 512))
        load = [(0, k) for k in range(min(lanes, len(numbers)))]
        dealt: list[list[int]] = [[] for _ in load]
        for k in np.argsort(-sizes, kind="stable").tolist():
            n, lane = heapq.heappop(load)
            dealt[lane].append(k)
            heapq.heappush(load, (n + int(sizes[k]), lane))
        dealt.sort(key=lambda own: -sum(int(sizes[k]) for k in own))
        length = [sum(int(sizes[k]) for k in own) for own in dealt]
        steps = max(length, default=0)
        x = np.zeros((steps, len(dealt)), np.int16)
        owner = np.full((steps, len(dealt)), -1, np.int32)
        fresh = np.ones((steps, len(dealt)), np.float32)
        for lane, own in enumerate(dealt):
            at = 0
            for k in own:
                x[at : at + sizes[k], lane], owner[at : at + sizes[k], lane], fresh[at, lane] = numbers[k], k, 0
                at += sizes[k]
        width = np.searchsorted(-np.array(length), -np.arange(steps), side="left")  # lanes that still have a token
        out, h, window = np.zeros(len(numbers)), np.zeros((len(dealt), HIDDEN), np.float32), 32
        for t in range(0, steps, window):
            states, found, whose = [], [], []
            for s in range(t, min(t + window, steps)):
                w = int(width[s])
                own = h[:w] * fresh[s, :w, None]
                states.append(own)
                found.append(x[s, :w])
                whose.append(owner[s, :w])
                h = self.cell(own, self.p["x"][x[s, :w]])[0]
            logs, _ = self.predict(np.concatenate(states), np.concatenate(found).astype(np.int64))
            out += np.bincount(np.concatenate(whose), weights=logs, minlength=len(numbers))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _is_end(numbers: np.ndarray, end: int) -> np.ndarray:
    return numbers == end


def _as_numbers(array: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in array.to_pylist()]


# ---------------------------------------------------------------- training and scoring on Spark


def _train(raw: bytes, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, trained = Network.unpacked(raw), 0
        net.end = end
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for own in _as_numbers(batch.column("numbers")):
                held.append(own)
                size += own.nbytes
                if size >= NUMBERS:
                    trained += net.train(np.concatenate(held).astype(np.int64))
                    held, size = [], 0
        if held:
            trained += net.train(np.concatenate(held).astype(np.int64))
        if trained:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([trained]), pa.array([net.packed()], pa.binary())], names=["slot", "n", "p"])

    return work


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of parameter sets, weighted by tokens."""
    total = np.zeros(len(pdf["p"].iloc[0]) // 4)
    for n, p in zip(pdf["n"], pdf["p"], strict=True):
        total += float(n) * np.frombuffer(p, np.float32)
    mean = (total / float(pdf["n"].sum())).astype(np.float32)
    return pd.DataFrame({"slot": [0], "n": [int(pdf["n"].sum())], "p": [mean.tobytes()]})


def fit(rows: DataFrame, net: Network, end: int, rounds: int = ROUNDS) -> Network:
    """Trains on all rows (numbers of training texts), a part of them in each round, averaging the tasks' parameters after it."""
    schema, raw = "slot long, n long, p binary", net.packed()
    for k in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("numbers").coalesce(WORKERS)
        found = part.mapInArrow(_train(raw, end), schema).groupBy("slot").applyInPandas(_average, schema).toPandas()  # SLOTS rows at most
        if len(found):
            raw = _average(found.sort_values("slot"))["p"].iloc[0]
    return Network.unpacked(raw)


def _score(raw: bytes, tail_log: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(raw)
        for batch in batches:
            for part in pieces(batch, "numbers", NUMBERS):
                numbers = _as_numbers(part.column("numbers"))
                logs = net.score(numbers) / np.log(10)
                rest = np.array([tail_log[x[x >= HEAD] - HEAD].sum() for x in numbers])
                names = [n for n in part.schema.names if n != "numbers"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(logs - rest)], names=[*names, "net"])

    return work


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trains: Column | None = None, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """(id, trains, n_tokens, n_known, train_tokens, base_score, score) of every text, learned from the rows where `trains` holds (all by default)."""
    spark: SparkSession = docs.sparkSession
    if id_col == text_col:
        raise ValueError("id and text are two columns")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(True) if trains is None else F.coalesce(trains, F.lit(True))).alias("trains"))
    counts = staged(token_counts(docs.where("trains")), "tokens")
    v = vocabulary(counts, hot)
    rows = staged(numbered(docs, spark.sparkContext.broadcast(v)), "numbers")
    end = int(v.look_up([END])[0][0])
    net = fit(rows.where("trains"), Network.fresh(v.head_counts, v.tail_counts), end, rounds)
    return _scored(rows, counts, net, v).withColumnRenamed("doc_id", id_col)


def _scored(rows: DataFrame, counts: DataFrame, net: Network, v: Vocabulary) -> DataFrame:
    names = ["doc_id", "row", "trains", "n_tokens", "n_known", "logs", "tail_logs"]
    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "net double"])
    scored = rows.select(*names, "numbers").mapInArrow(_score(net.packed(), v.tail_log), schema)
    rare = rows.select("row", F.explode("rare").alias("token"))
    seen = rare.join(counts.select("token", "n"), "token", "left").select("row", F.coalesce("n", F.lit(0)).alias("c"))
    more = seen.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("more_known"))
    both = scored.join(more, "row", "left").fillna({"more": 0.0, "more_known": 0})
    scale = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    base = F.col("logs") + F.col("more") - F.col("n_tokens") * scale
    return both.select("doc_id", "trains", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("net") + F.col("tail_logs") + F.col("more")).alias("score"))
