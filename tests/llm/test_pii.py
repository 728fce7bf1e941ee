import hashlib
import random
import re

import numpy as np

from girder.llm import pii
from tests.llm.helpers import awkward, table

TRICKY = "a@b.c%d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 +1 (2 3)45-6789a 4111 1111 1111 1111 00.01.2.3 é a@b 4111-1111-1111-1112 x@y.z.w. 5@@a.b +123 q.r@s-t.u_v 999.1.1.1 "
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def rows():
    extra = [(50 + k, t, "en", "s") for k, t in enumerate([TRICKY, TRICKY * 30, "1 " * 3000 + "a.b@c", "@" * 40 + "a" * 2000 + "@b.co", "+1 555 010 9999" * 3, "x" * 5000])]
    return awkward() + extra


def test_base_spans_match_brute_force(spark):
    docs = table(spark, rows())
    found = pii.find_pii(docs, pii.Model([], {})).collect()
    assert len(found) == len(rows())
    want = sorted((i if i is not None else -1, brute(t)) for i, t, _, _ in rows())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(s) for s in r["base"]]) for r in found) == want
    assert all(r["added"] == [] for r in found)


def test_added_spans_touch_no_base_span(spark):
    keep_all = pii.Model([(1.0, 5.0)], {k: 0.5 for k in pii.KINDS})
    docs = table(spark, [(1, "call (555) 123-4567 or mail jane[at]site[dot]org, ip 10.0.0.1 or 1.2.3.999", "en", "s")])
    r = pii.find_pii(docs, keep_all).collect()[0]
    text = docs.first()["text"]
    added = [(pii.KINDS[s["k"]], text[s["start"] : s["end"]]) for s in r["added"]]
    assert ("email", "jane[at]site[dot]org") in added
    assert any(k == "phone" and "123-4567" in s for k, s in added)
    assert [pii.KINDS[s["k"]] for s in r["base"]] == ["ip"]
    cut = pii.redact(docs, pii.find_pii(docs, keep_all)).collect()[0]["text"]
    assert "jane" not in cut and "10.0.0.1" not in cut and cut.startswith("call ")


def test_model_learns_and_scores(spark):
    many = [(k, f"mail user{k}@host{k}.org now or +1 555 010 {1000 + k} and 4111 1111 1111 111{k % 10} v {k}.{k}.2000.1", "en", "s") for k in range(400)]
    docs = table(spark, many)
    model = pii.fit(docs, trees=3)
    assert model.trees and "email" in model.thresholds
    r = pii.find_pii(docs, model).collect()
    assert len(r) == 400 and all(len(x["base"]) >= 2 for x in r)


def planted(n):
    """Texts with strict forms to learn from, and loose forms, decoys and plain numbers to judge."""
    draw = random.Random(5)
    name = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    digit = lambda m: "".join(draw.choice("0123456789") for _ in range(m))

    def card():
        head = "4" + digit(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    secret = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    strict = [(k, f"the mail {name()}@{name()}.org and ip 10.{k % 250}.3.{k % 199} then card {card()} or call +1 555 010 {digit(4)} with token = \"{secret()}\" end", "en", "s") for k in range(n)]
    loose, decoys = [], []
    for k in range(40):
        c = card()
        dotted = ".".join(c[i : i + 4] for i in range(0, 16, 4))
        loose.append((1000 + k, f"write to {name()} [at] {name()} [dot] org or pay {dotted} or call 555 010 {digit(4)} with key {secret()} end", "en", "s"))
        decoys.append((2000 + k, f"order {digit(4)} of {name()}{name()}{name()}{name()} in row {digit(3)}, total {digit(2)} of {digit(5)}; next 999.{digit(2)}.{digit(2)}.7 here", "en", "s"))
    return strict, loose, decoys


def test_a_fitted_model_finds_loose_forms_and_leaves_decoys(spark):
    strict, loose, decoys = planted(300)
    docs = table(spark, strict + loose + decoys)
    model = pii.fit(docs)
    assert set(model.thresholds) == set(pii.ALL)
    got = {r["doc_id"]: [pii.ALL[s["k"]] for s in r["added"]] for r in pii.find_pii(docs, model).collect()}
    for kind, least in (("email", 36), ("card", 36), ("secret", 36), ("phone", 30)):
        assert sum(kind in got[i] for i, *_ in loose) >= least, kind
    assert sum("secret" in got[i] for i, *_ in strict) >= 285  # the others hold a base card by chance
    assert sum(bool(got[i]) for i, *_ in decoys) <= 2


def features(kind, s, before, after):
    d, letters = re.sub("[^0-9]", "", s), re.sub("[^A-Za-z]", "", s)
    octets = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", re.sub(":.*", "", s)) and all(int(x) <= 255 for x in re.sub(":.*", "", s).split("."))
    secret, has = kind == "secret", lambda p, t: float(bool(re.search(p, t)))
    return [
        float(pii.ALL.index(kind)), float(len(s)), float(len(d)), float(len(letters)), float(len(s) - len(d) - len(letters)), float(len(re.sub("[^0-9]+", " ", s).split(" "))), float(ord(d[0]) if d else 0),
        float(kind == "card" and luhn(d)), float(kind == "ip" and bool(octets)), has("[A-Za-z0-9]$", before), has("^[A-Za-z0-9]", after), has(pii.KEYWORDS, before),
        secret * has(pii.CREDENTIALS, before), secret * has("[=:][ \"']*$", before), secret * has("^[0-9a-f]+$|^[0-9A-F]+$", s), float(secret and all(re.search(p, s) for p in ("[0-9]", "[a-z]", "[A-Z]"))),
    ]


def brute_added(text, model):
    def walk(node, f):
        while isinstance(node, tuple):
            k, at, left, right = node
            node = left if f[k] <= at else right
        return node

    base, picked = brute(text), []
    for k, kind in enumerate(pii.ALL):
        end = 0
        for m in re.finditer(pii.LOOSE[kind], text):
            s, e = m.span()
            before, after, end = text[end:s][-pii.CONTEXT :], text[e:], e
            nxt = re.compile(pii.LOOSE[kind]).search(text, e)
            after = text[e : nxt.start() if nxt else len(text)][: pii.CONTEXT]
            if any(s < y and x < e for _, x, y in base) or kind not in model.thresholds:
                continue
            f = features(kind, m[0], before, after)
            score = round(1 / (1 + np.exp(-2 * sum(w * walk(t, f) for w, t in model.trees))), 3)
            if score >= model.thresholds[kind]:
                picked.append((-score, s, e, k))
    taken = []
    for c in sorted(picked):
        if not any(c[1] < e and s < c[2] for _, s, e, _ in taken):
            taken.append(c)
    return sorted((k, s, e) for _, s, e, k in taken)


def test_added_spans_match_brute_force(spark):
    strict, loose, decoys = planted(60)
    both = [(3000, "pay 4111.1111.1111.1111 4111 1111 1111 1111 or 555.010.1234 call 555 010 1234 555 010 1234", "en", "s")]
    rows_ = strict + loose + decoys + both + rows()
    docs = table(spark, rows_)
    model = pii.fit(docs)
    want = sorted((i if i is not None else -1, brute_added(t or "", model)) for i, t, _, _ in rows_)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(s) for s in r["added"]]) for r in pii.find_pii(docs, model).collect()) == want


def test_ties_go_to_the_first_start(spark):
    equal = pii.Model([(1.0, 5.0)], {"phone": 0.5, "card": 0.5})
    docs = table(spark, [(1, "x 5555 1234 5678 9999 y", "en", "s")])
    found = [(s["k"], s["start"], s["end"]) for s in pii.find_pii(docs, equal).collect()[0]["added"]]
    assert found == brute_added("x 5555 1234 5678 9999 y", equal) and len(found) == 1


def test_empty_table(spark):
    docs = table(spark, [])
    assert pii.find_pii(docs).collect() == []


def test_digest_columns(spark, tmp_path):
    from girder.llm.queries import op1_pii

    table(spark, rows()[:6] + [(50, TRICKY, "en", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    r = {x["doc_id"]: x for x in op1_pii(spark, str(tmp_path)).collect()}
    names = list(PATTERNS)
    want = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in brute(TRICKY))
    assert set(want.split(",")) <= set(r[50]["spans"].split(","))
    assert r[50]["n_spans"] == len(want.split(",")) + r[50]["n_added"]
    assert [x for x in r[50]["spans"].split(",") if x in want.split(",")] == want.split(",")
    assert r[50]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_every_example_is_used(spark, monkeypatch):
    """More examples of a kind than SHARE: each still weighs, equal ones are one row, and a kind's weight is SHARE at most."""
    from pyspark.ml.classification import GBTClassifier

    seen = []
    real = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows) or real(self, rows))
    docs = spark.createDataFrame([(k, f"write to user{k}@host{k % 7}.example.org or call +44 20 7946 {k:04d} now, part {k} of 10.20.30.{k % 250}") for k in range(400)], "doc_id long, text string")
    pii.fit(docs, share=50, trees=2)
    weights = seen[0].agg({"weight": "sum", "*": "count"}).first()
    total = pii._examples(pii._spans(docs, "doc_id", "text"))
    kinds = total.groupBy("kind", "label").count().collect()
    assert max(r["count"] for r in kinds) > 400 and weights["count(1)"] < total.count() / 4
    assert weights["sum(weight)"] <= 50 * len(kinds)
    whole = total.select("label", "f").distinct().count()
    both = spark.read.parquet(seen[0].inputFiles()[0].rsplit("/", 1)[0])
    assert both.select("label", "f").distinct().count() == whole and both.agg({"n": "sum"}).first()[0] == total.count()
