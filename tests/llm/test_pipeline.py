"""All five stages on a small corpus: each stage's rows are those that its rule, applied by hand to its own input, keeps."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from girder.llm import mixing
from girder.llm.common import staged
from tests.llm.helpers import awkward, prose, table
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_quality import brute as rules
from tests.llm.test_simhash import brute_fp, classes


def test_every_stage_keeps_what_its_rule_keeps(spark, tmp_path):
    base = prose(1, 300).split(" ")
    copies = [(200 + k, " ".join([*base[:k], "changed", *base[k + 1 :]]), "en", "s1") for k in range(6)]
    leaks = [(300 + k, prose(300 + k, 80) + " " + " ".join(prose(900, 25).split()), "de", "s2") for k in range(5)]
    junk = [(400 + k, " | ".join(prose(400 + k, 90).split()), "en", "s3") for k in range(6)]
    rows = awkward() + copies + leaks + junk + [(500 + k, prose(500 + k, 120), ("en", "de")[k % 2], f"s{k % 3}") for k in range(120)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = staged(stage(spark, docs, d), name)
        assert docs.columns == columns
        seen[name] = before, [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert set(seen[name][1]) <= set(before)

    before, after = seen["quality_rules"]
    failed = [t for _, t in before if (n := rules(t))[0] < 20 or 100 * n[4] > 30 * n[0]]
    assert not set(failed) & {t for _, t in after} and not {i for i, _ in after} & {i for i, *_ in junk}
    assert {i for i, *_ in copies + leaks} | set(range(500, 620)) <= {i for i, _ in after}

    before, after = seen["simhash_near_dedup"]
    roots = classes({brute_fp(t) for _, t in before})
    groups = {}
    for i, t in before:
        if i is not None:
            groups.setdefault(roots[brute_fp(t)], set()).add(i)
    assert sorted(i for i, _ in after if i is not None) == sorted(min(g) for g in groups.values())

    before, after = seen["decontamination"]
    assert sorted(map(str, after)) == sorted(str((i, t)) for i, t in before if i is None or not hits(t)[1])
    assert {i for i, *_ in leaks} & {i for i, _ in before} and not {i for i, *_ in leaks} & {i for i, _ in after}

    before, after = seen["mixing"]
    kept = mixing.mix(table(spark, [r for r in rows if (r[0], r[1]) in set(before)]).dropDuplicates(["doc_id", "text"])).where("__kept")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _ in after}

    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    texts = dict(after)
    out = sorted(cp.STAGES[-1][1](spark, docs, d).collect(), key=lambda r: r["start"])
    assert len(out) == len(after)
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] is not None:
            want = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert sorted(map(tuple, cp.run(spark, d).collect()), key=str) == sorted(map(tuple, out), key=str)
