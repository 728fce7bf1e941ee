"""Periodic runs: maximal stretches of words that repeat with a smallest period, by the runs theorem.

Every run holds a Lyndon root: under one of two opposite orders of the words, the longest Lyndon word that starts at a place in its first
period is as long as the period. So for each text:

1. the suffixes of its words are ranked (prefix doubling; only suffixes that are still tied are sorted again),
2. the longest Lyndon word at each place ends before the next smaller rank, and under the opposite order before the next greater one,
3. common prefixes of neighbouring suffixes are compared where they can't be derived from the place before (that sums to n log n at most),
4. each root is extended right by the range minimum of those prefixes (a sparse table that is built level by level, each question is
   answered at its level, so a table takes no more room than one level) and left in the same way over the reversed text.

A root is kept where it is the first of its run, which needs the word one period later to be equal; the few texts whose roots can reach a full run by
that and by samples of the words to the left are the ones that are reversed. Words get numbers by a table within each text, so no two words are taken for each other.

The texts of a batch are worked on together in arrays, PIECE bytes of text at a time and a text as a whole at least; nothing is
shuffled, and a text's runs stay in its own row. A longest text takes about 200 bytes a word.

Defined cases: a null or empty text has no words and no run; repeated rows and ids are judged each on its own, and ids are never read;
an empty table gives an empty result; other columns of any name are kept, a column named as one of the results is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import pieces

LEAST_WORDS = 12
PIECE = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- suffixes


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """The rank of the suffix at each place. s: numbers; the last one of each text is its own, so that no comparison leaves a text."""
    n = len(s)
    order = np.argsort(s)
    place = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = s[order[1:]] != s[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    active, step = order[~(head & np.append(head[1:], True))], 1
    while len(active):
        low, high = rank[active], rank[active + step]
        by = np.argsort((low << 32) | high)
        active, low, high = active[by], low[by], high[by]
        place = np.arange(len(active))
        group = np.append(True, low[1:] != low[:-1])
        head = group | np.append(True, high[1:] != high[:-1])
        rank[active] = low + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        active = active[~(head & np.append(head[1:], True))]
        step *= 2
    return rank


def common_prefixes(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each rank, how many words its suffix has in common with the suffix before it."""
    n = len(s)
    at = np.empty(n, np.int64)
    at[rank] = np.arange(n)
    before = np.full(n, -1)
    before[at[1:]] = at[:-1]
    has = before >= 0
    back = np.maximum(before, 1) - 1
    derived = has & (before > 0)
    derived[0] = False
    derived[1:] &= s[:-1] == s[back[1:]]
    x = np.flatnonzero(has & ~derived)
    y, found = before[x], np.zeros(n, np.int64)
    left, width = np.arange(len(x)), 4
    got = np.zeros(len(x), np.int64)
    while len(left):
        span = np.arange(width)
        i, j = x[left, None] + got[left, None] + span, y[left, None] + got[left, None] + span
        differs = s[np.minimum(i, n - 1)] != s[np.minimum(j, n - 1)]
        any_ = differs.any(axis=1)
        got[left] += np.where(any_, differs.argmax(axis=1), width)
        left = left[~any_]
        width = min(max(4, (1 << 16) // max(len(left), 1)), 1 << 12)
    found[x] = got + x
    first = np.zeros(n, np.int64)
    first[x] = x
    source = np.maximum.accumulate(first)
    plcp = np.where(has, found[source] - np.arange(n), 0)
    return plcp[at]


def next_smaller(rank: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each place that is asked for, the next one with a smaller rank (there is one); the place after it for the others.

    Pointers jump over places that are known to be larger, all at once; the few that are left after some rounds are walked from the right.
    """
    n = len(rank)
    to = np.minimum(np.arange(1, n + 1), n - 1)
    left = np.flatnonzero(asked & (rank[to] > rank))
    for _ in range(48):
        if len(left) * 256 < n:
            break
        to[left] = to[to[left]]
        left = left[rank[to[left]] > rank[left]]
    for i in left[::-1].tolist():
        j, own = int(to[i]), rank[i]
        while rank[j] > own:
            j = int(to[j])
        to[i] = j
    return to


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) of each question, high > low."""
    level = np.frexp((high - low).astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, asked = values, np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[asked], np.arange(int(level.max(initial=-1)) + 2))
    for k in range(len(bounds) - 1):
        own = asked[bounds[k] : bounds[k + 1]]
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        if k + 2 < len(bounds):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _shared(rank: np.ndarray, prefixes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at i and j have in common."""
    a, b = rank[i], rank[j]
    return range_minimum(prefixes, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


# ---------------------------------------------------------------- runs


def find_runs(texts: list[np.ndarray], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each text (its words as numbers), its runs of at least `least` words as rows (start, length, period), by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros((0, 3), np.int64)
    own = np.flatnonzero(sizes >= max(2, least))
    out = [none] * len(texts)
    if not len(own):
        return out
    starts, lengths, periods, owner = _runs(*_laid(texts, own), least)
    owner = own[owner]
    order = np.lexsort((periods, starts, owner))
    rows = np.stack([starts, lengths, periods], axis=1)[order]
    bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    for k in np.unique(owner).tolist():
        out[k] = rows[bounds[k] : bounds[k + 1]]
    return out


def _laid(texts: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each closed by a number of its own that is less than its words; and where each begins."""
    off = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(texts[k]) + 1 for k in own], out=off[1:])
    s, base = np.empty(off[-1], np.int64), 0
    for k, text in enumerate(own):
        words = texts[text]
        s[off[k] : off[k + 1] - 1] = words + (base + 1)
        s[off[k + 1] - 1] = base
        base += int(words.max()) + 2
    return s, off


def _runs(s: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    rank = suffix_ranks(s)
    end = off[1:] - 1
    n = len(s)
    # the end of a text is less than all words; under the opposite order it is greater, so a root that would reach it there is none
    last = np.repeat(end, np.diff(off))
    place = np.arange(n)
    word = place < last
    less = next_smaller(rank, word)
    turned = -rank
    turned[end] = -n - 1
    more = next_smaller(turned, word)
    i = np.concatenate([place[word], place[word & (more < last)]])
    p = np.concatenate([less[word], more[word & (more < last)]]) - i
    begin, close = np.repeat(off[:-1], np.diff(off)), last
    # the first root of a run is followed by an equal word one period later
    ok = (i + p < close[i]) & (s[np.minimum(i + p, n - 1)] == s[i])
    i, p = i[ok], p[ok]
    if not len(i):
        return (np.zeros(0, np.int64),) * 4
    prefixes = common_prefixes(s, rank)
    right = _shared(rank, prefixes, i, i + p)
    lack = np.maximum(p - right, least - p - right)  # words that are needed on the left; a first root has fewer than p there
    ok = (lack < p) & (i - np.maximum(lack, 0) >= begin[i])
    i, p, right, lack = i[ok], p[ok], right[ok], np.maximum(lack[ok], 0)
    for part in (1.0, 0.0, 0.5):
        at = i - np.where(lack > 0, np.maximum((lack * part).astype(np.int64), 1), 0)
        ok = s[at] == s[at + p]
        i, p, right, lack = i[ok], p[ok], right[ok], lack[ok]
    left = _to_the_left(s, off, i, p)
    ok = (left < p) & (left >= lack)
    i, p, right, left = i[ok], p[ok], right[ok], left[ok]
    start, length = i - left, left + p + right
    both = np.unique(np.stack([start, p, length], axis=1), axis=0)
    start, p, length = both.T
    owner = np.searchsorted(off, start, side="right") - 1
    return start - off[owner], length, p, owner


def _to_the_left(s: np.ndarray, off: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How many words before i equal those before i + p: prefixes of the reversed texts."""
    if not len(i):
        return np.zeros(0, np.int64)
    owner = np.searchsorted(off, i, side="right") - 1
    own, owner = np.unique(owner, return_inverse=True)
    size = off[own + 1] - off[own]
    new = np.zeros(len(own) + 1, np.int64)
    np.cumsum(size, out=new[1:])
    inner = np.arange(new[-1]) - np.repeat(new[:-1], size)
    length = np.repeat(size - 1, size)
    back = s[np.repeat(off[own], size) + np.where(inner < length, length - 1 - inner, length)]
    rank = suffix_ranks(back)
    at = i - off[own][owner]
    x = new[:-1][owner] + (size[owner] - 1) - at  # the reversed place of the word before i
    return _shared(rank, common_prefixes(back, rank), x, x - p)


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- the operator

#: run: the longest one (ties: the least start, then period); collapsed: the words that no run holds after its first period.
FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.string()]


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _row(words: list[bytes], runs: np.ndarray) -> tuple:
    if not len(runs):
        return len(words), 0, None, None, None, None, "", b" ".join(words).decode()
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    kept = np.flatnonzero(~dropped_words(len(words), runs)).tolist()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    return len(words), len(runs), start, length, period, 1000 * length // period, lines, b" ".join([words[k] for k in kept]).decode()


def _detect(text_col: str, least: int):
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                words = [(t or "").encode().split() for t in part.column(text_col).to_pylist()]  # bytes.split() cuts at these six spaces
                found = find_runs([_numbered(w) for w in words], least)
                rows = [_row(w, r) for w, r in zip(words, found, strict=True)]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                keep = [k for k, name in enumerate(part.schema.names) if name not in names]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *columns], names=[*[part.schema.names[k] for k in keep], *names])

    return work


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs with n_words, n_runs, the longest run, all runs as lines `start,length,period`, and the text without repeated periods."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kept = [f for f in docs.schema.fields if f.name not in names]
    if text_col in names:
        raise ValueError(f"the text column may not be named {text_col}")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], FIELDS])
    return docs.mapInArrow(_detect(text_col, least), schema)


def collapse(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs, with texts that hold a run cut to one period of each; other texts stay as they are, white space included."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("words"))
    found = periodic_runs(inner, "words", least)
    cut = F.when(F.col("n_runs") > 0, F.col("collapsed")).otherwise(F.col("row").getField(text_col))
    return found.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in names or c != text_col])


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_tail(text: Column, key: Column) -> Column:
    """A text that repeats a part of itself to its end where key % 10 is 0: known runs, to measure detection against.

    With n words and g = key / 10, the words from a = g % n on become repetitions of the first 1 + (n - a) / (3 + g % 8) of them. A null key leaves
    the text as it is.
    """
    words = words_of(text)
    n = F.size(words)
    g = F.floor(key / 10).cast("long")
    a = (g % F.when(n > 0, n)).cast("int")
    times = (F.lit(3) + g % 8).cast("int")
    period = (F.floor((n - a) / times) + 1).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), times + 1)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), rest), " ")
    return F.when((key % 10 == 0) & (n > 0), made).otherwise(text)
