"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict patterns give the base spans (e-mail, IP address, card, phone). High-recall generators propose further, overlapping
spans: loosely written forms of the four kinds, and secrets (long runs of letters, digits and marks). Boosted trees (Spark ML) score
each candidate from its format and context.

The trees learn from examples that are more than the strict patterns. Seeds are the corpus's own base spans, and candidates for a secret
that a credential word introduces. Each seed gives positive examples as it stands, rewritten loosely (an e-mail with [at] and [dot],
a card with dots, a phone without its country, an address with a port), and rewritten without its context; and negative ones with its digits
or letters spoilt (wrong check digit, octets over 255, a phone cut short, a run without digits). Candidates that touch no seed are unknown
and count as negative with the weight UNKNOWN, for some of them are what is looked for. All examples of the whole table are used: equal ones are one row with their weights added up,
and where a kind and label has more than SHARE of them, their weights are scaled down to SHARE, so that no kind outweighs the others.

Scores are calibrated on the half of the examples that the trees have not seen: a kind's threshold is the lowest score, 0.5 at least, from which
PRECISION of its examples are positive. Candidates over it are taken greedily, best score first (ties: first start, then kind), as long as
they touch neither a base span of any kind nor a span taken before.

The trees are arrays that one SQL expression walks, so scoring happens beside the text in the scan's stage: nothing is shuffled, and a
text's spans are arrays in its own row. Offsets are in code points, ends exclusive. Passes over a text's spans are by start with a small state, in
blocks, so that a text of very many matches takes time about in proportion to them; only candidates that overlap in one long chain are compared with
all that were taken of their chain.

Defined cases: a null text has no spans; rows without an id and repeated rows are each judged on their own; a corpus without any
seed or without any negative example adds no span, and a kind without examples adds none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds come after those of the base spans.
ALL = (*KINDS, "secret")
#: Runs are possessive and start where a run can start, which finds the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@|[\\[(](?:at|AT)[\\])]", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20./-]?[0-9]", "phone": "[0-9][\\x20().-]*[0-9]", "secret": "[A-Za-z0-9_+/-]{20}"}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:@|[\[(](?:at|AT)[\])])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?+",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{1,7}",
    "phone": r"(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+=?+=?+",
}
CONTEXT = 24
#: So many examples of a kind and label weigh in full.
SHARE = 2_000
PRECISION, UNKNOWN = 0.98, 0.1
KEYWORDS = r"(?i)\b(?:e-?mail|mail|call|phone|tel|fax|contact|mobile|card|visa|account|ip|host|server|address)\b"
CREDENTIALS = r"(?i)(?:token|secret|api.?key|access.?key|private.?key|passwo?r?d|credential|bearer)"
FEATURES = ("kind", "length", "digits", "letters", "others", "groups", "first", "luhn", "octets", "joined_left", "joined_right", "keyword", "credential", "assigned", "hex", "mixed")


SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, zero: Column, step, kind: str) -> Column:
    """Goes through items with a state: step(state, item) gives the next state and an array (of elements of type `kind`) to send out.

    Items are taken in blocks of about the root of their number, so that an array that grows is never copied for each of many items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    def blocks(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own))).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / w).cast("int")), lambda k: F.slice(own, k * w + 1, w)))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda own: F.when(F.size(own) == 0, none).otherwise(F.flatten(F.aggregate(blocks(own), start, block, lambda acc: acc["out"]))))


def find_all(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs (start, end, s, before, after), leftmost and non-overlapping."""

    def spans(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g, h: F.struct(g.alias("g"), F.left(h, F.lit(CONTEXT)).alias("after")))
        pairs = F.zip_with(found, around, lambda m, g: F.struct(m.alias("m"), g["g"].alias("g"), g["after"].alias("after")))

        def step(at: Column, p: Column) -> tuple[Column, Column]:
            start = at + F.char_length(p["g"])
            end = start + F.char_length(p["m"])
            return end, F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("s"), F.right(p["g"], F.lit(CONTEXT)).alias("before"), p["after"].alias("after")))

        return scan(pairs, F.lit(0), step, SPAN)

    matched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps)))
    return F.when(text.rlike(NEEDS[kind]), matched).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    places = F.transform(F.split(F.reverse(digits(s)), ""), lambda c, i: F.when(i % 2 == 1, F.try_to_number(c, F.lit("9")).cast("int") * 2).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(places, F.lit(0), lambda t, d: t + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.char_length(digits(s))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & luhn(s)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(find_all(text, BASE[kind], kind), lambda m: valid(kind, m["s"]))


def _features(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    d = digits(s)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    letters = F.char_length(F.regexp_replace(s, "[^A-Za-z]", ""))
    n = F.char_length(d)
    secret = kind == "secret"
    return [
        F.lit(float(ALL.index(kind))), F.char_length(s).cast("double"), n.cast("double"), letters.cast("double"), (F.char_length(s) - n - letters).cast("double"),
        F.size(F.split(F.regexp_replace(s, "[^0-9]+", " "), " ", -1)).cast("double"), F.coalesce(F.ascii(d), F.lit(0)).cast("double"),
        flag(luhn(s)) if kind == "card" else F.lit(0.0), flag(F.regexp_replace(s, ":.*", "").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")) if kind == "ip" else F.lit(0.0),
        flag(before.rlike("[A-Za-z0-9]$")), flag(after.rlike("^[A-Za-z0-9]")), flag(before.rlike(KEYWORDS)),
        flag(before.rlike(CREDENTIALS)) if secret else F.lit(0.0), flag(before.rlike(r"[=:][\x20\"']*$")) if secret else F.lit(0.0),
        flag(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$")) if secret else F.lit(0.0), flag(s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")) if secret else F.lit(0.0),
    ]


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base_<kind>, free_<kind>): arrays of base spans, and of candidates that touch no base span of any kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    cols = {f"base_{k}": base_spans(F.col("text"), k) for k in KINDS}
    cols |= {f"loose_{k}": find_all(F.col("text"), LOOSE[k], k) for k in ALL}
    found = rows.select("id", *[c.alias(n) for n, c in cols.items()])
    every = F.concat(*[F.transform(f"base_{k}", _event) for k in KINDS])
    found = found.withColumn("events", every)
    return found.select("id", *[f"base_{k}" for k in KINDS], *[_free(f"loose_{k}").alias(f"free_{k}") for k in ALL])


_EVENT = f"struct<start:int,loose:int,end:int,span:{SPAN}>"


def _event(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(0).alias("loose"), s["end"].alias("end"), F.lit(None).cast(SPAN).alias("span"))


def _free(loose: str) -> Column:
    """The candidates that touch no base span: one pass by start from the left (does a base span reach in?), one from the right (does one begin inside?)."""
    own = F.transform(loose, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("loose"), c["end"].alias("end"), c.alias("span")))
    none = F.array().cast(f"array<{_EVENT}>")

    def right(reach: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["loose"] == 0, F.greatest(reach, e["end"])).otherwise(reach), F.when((e["loose"] == 1) & (reach > e["start"]), none).otherwise(F.array(e))

    def left(begin: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["loose"] == 0, e["start"]).otherwise(begin), F.when((e["loose"] == 1) & (begin >= e["end"]), F.array(e)).otherwise(none)

    ordered = F.array_sort(F.concat(F.col("events"), own).cast(f"array<{_EVENT}>"))
    kept = scan(F.reverse(scan(ordered, F.lit(0), right, _EVENT)), F.lit((1 << 31) - 1), left, _EVENT)
    return F.when((F.size(loose) == 0) | (F.size("events") == 0), F.col(loose)).otherwise(F.reverse(F.transform(kept, lambda e: e["span"])))


# ---------------------------------------------------------------- examples


def _named(c: Column) -> Column:
    """A candidate for a secret that a credential word introduces, with digits and letters."""
    return c["before"].rlike(CREDENTIALS + r"[\x20\"']*[=:][\x20\"']*$") & c["s"].rlike("[0-9]") & c["s"].rlike("[A-Za-z]")


def loosened(kind: str, s: Column) -> Column:
    """A seed as it might be written to be read by people."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(s, "@", " [at] "), r"\.(?=[A-Za-z0-9-]+$)", " [dot] ")
    if kind == "ip":
        return F.concat(s, F.lit(":8080"))
    if kind == "card":
        return F.regexp_replace(digits(s), "([0-9]{4})(?=[0-9])", "$1.")
    if kind == "phone":
        return F.regexp_replace(s, r"^\+[0-9]{1,3}[\x20.-]*(?=[(0-9])", "")
    return s


def spoilt(kind: str, s: Column) -> Column:
    """A seed of like form that is none of its kind."""
    turned = F.translate(s, "0123456789", "1234567890")
    if kind == "email":
        return F.regexp_replace(s, r"@.*$", " at large")
    if kind == "ip":
        return F.regexp_replace(s, r"^[0-9]+", "999")
    if kind == "card":
        return F.concat(F.regexp_replace(turned, "[0-9]$", ""), (F.lit(9) - F.try_to_number(F.right(turned, F.lit(1)), F.lit("9")).cast("int")).cast("string"))
    if kind == "phone":
        return F.regexp_replace(F.regexp_replace(s, r"^\+[0-9]+", ""), "[0-9]{2}$", "")
    return F.translate(s, "0123456789", "aeioutnrsl")


def _examples(spans: DataFrame) -> DataFrame:
    """(id, f, label, weight, kind, start): examples of every kind from each document."""
    return spans.select("id", F.inline(F.concat(*[x for k in ALL for x in _examples_of(k)])))


def _examples_of(kind: str) -> list[Column]:
    none = F.lit("")

    def one(label: float, rewrite=None, context: bool = True, weight: float = 1.0):
        def make(c: Column) -> Column:
            s = rewrite(kind, c["s"]) if rewrite else c["s"]
            f = _features(kind, s, c["before"] if context else none, c["after"] if context else none)
            return F.struct(F.array(*f).alias("f"), F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"), c["start"].alias("start"))

        return make

    free = F.col(f"free_{kind}")
    seeds = F.filter(free, _named) if kind == "secret" else F.col(f"base_{kind}")
    rest = F.filter(free, lambda c: ~_named(c)) if kind == "secret" else free
    made = [one(1.0), one(1.0, loosened), one(1.0, loosened, False), one(0.0, spoilt), one(0.0, spoilt, False)]
    return [*[F.transform(seeds, m) for m in made], F.transform(rest, one(0.0, weight=UNKNOWN))]


# ---------------------------------------------------------------- boosted trees


class Model:
    """Boosted trees as arrays that an expression walks, and a threshold for each kind."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds
        depth = lambda node: 1 + max(depth(node[2]), depth(node[3])) if isinstance(node, tuple) else 0
        self.depth = max([depth(tree) for _, tree in trees], default=0)
        #: Each tree as a full one: the children of place k are 2 k + 1 and 2 k + 2, a leaf that ends early is its own children.
        self.features, self.limits = [], []
        for _, tree in trees:
            level = [tree]
            for d in range(self.depth + 1):
                inner = [x if isinstance(x, tuple) else (0, x, x, x) for x in level]
                self.features += [x[0] for x in inner]
                self.limits += [float(x[1]) for x in inner]
                level = [child for x in inner for child in x[2:]]

    def margin(self, f: Column) -> Column:
        if not self.trees:
            return F.lit(0.0)
        fixed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")  # noqa: E731  one literal, once folded
        features, limits, weights = fixed(self.features, "int"), fixed(self.limits, "double"), fixed([float(w) for w, _ in self.trees], "double")
        size = (1 << (self.depth + 1)) - 1

        def walk(own: Column, tree: Column) -> Column:
            down = lambda at, _: 2 * at + F.when(F.get(own, F.get(features, tree * size + at)) <= F.get(limits, tree * size + at), 1).otherwise(2)
            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down, lambda at: F.get(limits, tree * size + at)) if self.depth else F.get(limits, tree)

        return let(f, lambda own: F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(0.0), lambda total, t: total + F.get(weights, t) * walk(own, t)))

    def score(self, f: Column) -> Column:
        return F.lit(1.0) / (1.0 + F.exp(-2.0 * self.margin(f)))


def _tree(node):
    """A Spark ML tree node as nested tuples (feature, threshold, left, right), leaves as numbers."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, precision: float = PRECISION, trees: int = 20, depth: int = 4) -> Model:
    """Fit on all examples. Features are counts and flags, so equal examples are many: a row for each that occurs, with the sum of their weights.

    Halves are by a hash of an example's place, so that both hold the same share of each kind and label.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    half = F.pmod(F.xxhash64(F.lit(7), "id", "kind", "start", "label", F.hash("f")), F.lit(2)).alias("half")
    rows = _examples(_spans(docs, id_col, text_col)).groupBy("kind", "label", half, "f").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("weight") * 1000).cast("long")) / 1000).alias("weight"))
    rows = staged(rows, "examples")
    held = rows.groupBy("kind", "label").agg(F.sum("n").alias("held"))  # two rows a kind
    rows = rows.join(F.broadcast(held), ["kind", "label"]).withColumn("weight", F.col("weight") * F.least(F.lit(1.0), F.lit(float(share)) / F.col("held")))
    counts = {r["label"] for r in rows.where("half = 0").groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model([], {})
    train = rows.where("half = 0").select(array_to_vector("f").alias("features"), "label", "weight")
    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(train)
    java = model._java_obj.trees()
    found = Model([(float(w), _tree(java[k].rootNode())) for k, w in enumerate(model.treeWeights)], {})
    graded = rows.where("half = 1").withColumn("score", F.round(found.score(F.col("f")), 3)).groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n"))
    by_kind: dict[str, list] = {}
    for r in graded.collect():  # 1,001 scores a kind at most
        by_kind.setdefault(r["kind"], []).append((r["score"], r["hits"], r["n"]))
    for kind, scores in by_kind.items():
        hits = n = 0
        for score, h, m in sorted(scores, reverse=True):
            hits, n = hits + h, n + m
            if hits and hits >= precision * n:
                found.thresholds[kind] = max(score, 0.5)
    return found


# ---------------------------------------------------------------- the operator

_SCORED = "array<struct<cost:double,start:int,end:int,k:int>>"
_PLACED = "array<struct<start:int,end:int,cost:double,k:int>>"
_PLACE = "array<struct<k:int,start:int,end:int>>"


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end) for each document, by kind and start; kinds as in ALL."""
    model = model or fit(docs, id_col, text_col)
    spans = _spans(docs, id_col, text_col)
    base = F.concat(*[F.transform(f"base_{k}", _labelled(k)) for k in KINDS])
    picked = [F.filter(F.transform(f"free_{k}", _with_cost(k, model)), _under(-t)) for k, t in model.thresholds.items()]
    rows = spans.select("id", base.cast(_PLACE).alias("base"), (F.concat(*picked) if picked else F.array()).cast(_PLACED).alias("picked"))
    added = F.transform(_best(F.col("picked")), lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(added.cast(_PLACE)).alias("added"))


def _best(picked: Column) -> Column:
    """The candidates taken greedily. Those that touch, directly or through others, form a group; groups are found in one pass by start."""

    def cut(state: Column, c: Column) -> tuple[Column, Column]:
        apart = c["start"] >= state["end"]
        own = F.when(apart, F.array(c)).otherwise(F.concat(state["own"], F.array(c)))
        grown = F.struct(F.when(apart, c["end"]).otherwise(F.greatest(state["end"], c["end"])).alias("end"), own.alias("own"))
        return grown, F.when(apart & (F.size(state["own"]) > 0), F.array(state["own"])).otherwise(F.array().cast(f"array<{_PLACED}>"))

    def take(got: Column, c: Column) -> Column:
        return F.when(F.exists(got, lambda o: _overlaps(o, c)), got).otherwise(F.concat(got, F.array(c)))

    last = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit((1 << 31) - 1).alias("end"), F.lit(0.0).alias("cost"), F.lit(-1).alias("k"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(_PLACED).alias("own"))
    groups = scan(F.array_sort(F.concat(picked, F.array(last).cast(_PLACED))), zero, cut, _PLACED)
    best_first = lambda g: F.array_sort(F.transform(g, lambda c: F.struct(c["cost"].alias("cost"), c["start"].alias("start"), c["end"].alias("end"), c["k"].alias("k"))))
    chosen = F.transform(groups, lambda g: F.when(F.size(g) == 1, best_first(g)).otherwise(F.aggregate(best_first(g), F.array().cast(_SCORED), take)))
    return F.when(F.size(picked) == 0, F.array().cast(_SCORED)).otherwise(F.flatten(chosen))


def _labelled(kind: str):
    return lambda c: F.struct(F.lit(ALL.index(kind)).alias("k"), c["start"].alias("start"), c["end"].alias("end"))


def _with_cost(kind: str, model: Model):
    """Candidates with their negative score, so that they sort best first by it."""

    def scored(c: Column) -> Column:
        cost = -F.round(model.score(F.array(*_features(kind, c["s"], c["before"], c["after"]))), 3)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), cost.alias("cost"), F.lit(ALL.index(kind)).alias("k"))

    return scored


def _under(limit: float):
    return lambda c: c["cost"] <= limit


def span_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    spans = found.select(F.col(id_col).alias("__id"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))).alias("spans"))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(spans, F.col(id_col) == F.col("__id"), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in ALL])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        cut = F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"]))
        return F.struct(F.when(fresh, cut).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.char_length("t"))))
    return rows.select(id_col, F.coalesce(cut, F.col("t")).alias(text_col))
