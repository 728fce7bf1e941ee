import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from girder.llm import token_output as to
from girder.llm.common import fresh_path, staged
from tests.llm.helpers import awkward, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a b", " \n x", "a  b   c\n\n d ", "a\t b", "<|endoftext|> hi", "x \x1c y", "don't  it's 12 34", "ñ ß çé — x", "¿qué? «hola» ²", "\r\n  x\n\n", "w" * 300 + " z", "日本 語", "é", "a b \u0085 c", "¡x! ½ µ ª"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library(library):
    enc = to.Encoder(PATH, cache=50)
    for t in ODD + [t or "" for _, t, _, _ in awkward()]:
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 3], [1, 2, 3, 10**6], list(range(0, 5000, 3)), [7] * 600])
def test_elias_fano(values):
    ef = to.EliasFano.build(np.array(values, np.int64))
    assert ef.all().tolist() == values
    assert [ef.select(k) for k in range(len(values))] == values
    for first, last in ((0, len(values)), (1, len(values) - 1), (255, 257), (256, 512), (300, 301), (511, 1400)):
        if 0 <= first < last <= len(values):
            assert ef.select(first, last).tolist() == values[first:last]


def test_files_round_trip(spark, library):
    rows = awkward() + [(500 + k, t, "en", "s") for k, t in enumerate(ODD)]
    folder = fresh_path(spark, "tokens")
    manifest = staged(to.write_tokens(table(spark, rows), folder, PATH, shard_bytes=2000), "manifest")
    got = sorted(to.read_tokens(spark, folder, manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 3 and len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == [None, None, *sorted(i for i, *_ in rows if i is not None)]
    by_id = {i: t for i, t, *_ in rows if i is not None}
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] is not None:
            want = [*library.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
            assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())


def test_single_documents_are_read_by_select(spark, library):
    rows = awkward() + [(500 + k, t, "en", "s") for k, t in enumerate(ODD)]
    folder = fresh_path(spark, "tokens")
    staged(to.write_tokens(table(spark, rows), folder, PATH, shard_bytes=2000), "manifest")
    wanted = spark.createDataFrame([(3,), (500,), (503,), (21,), (9999,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in to.documents_at(spark, folder, wanted).collect()}
    by_id = {i: t for i, t, *_ in rows if i is not None}
    assert got == {i: [*library.encode(by_id[i] or "", add_special_tokens=False).ids, 0] for i in (3, 500, 503, 21)}


def test_rows_of_one_id_have_one_order(spark):
    rows = [(7, f"text {k % 13} {'x' * (k % 5)}", "en", "s") for k in range(40)] + [(None, f"none {k}", "en", "s") for k in range(9)]
    found = set()
    for k, width in enumerate((1, 3, 8)):
        folder = fresh_path(spark, "tokens")
        dealt = table(spark, rows[k * 7 :] + rows[: k * 7]).repartition(width)
        manifest = staged(to.write_tokens(dealt, folder, PATH, shard_bytes=200), "manifest")
        got = sorted(map(tuple, to.read_tokens(spark, folder, manifest).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [None] * 9 + [7] * 40 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
        found.add(tuple(got))
    assert len(found) == 1


@pytest.mark.parametrize(
    "change",
    [
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}},
        {"normalizer": {"type": "Lowercase"}},
        {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
    ],
)
def test_other_tokenizers_go_to_the_library(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        made = json.load(f) | change
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    enc = to.Encoder(path)
    for t in [*ODD, "Some Words of 1234 here"]:
        assert enc.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids, t


def test_empty_table(spark):
    import os

    folder = fresh_path(spark, "tokens")
    manifest = staged(to.write_tokens(table(spark, []), folder, PATH), "manifest")
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    assert to.read_tokens(spark, folder, manifest).collect() == []


def test_queries_encode_as_the_library_does_by_default(spark, tmp_path):
    import corpus_pipeline
    from girder.llm.queries import op7_token_output

    plain = Tokenizer.from_file(PATH)
    texts = [*ODD, "a b <|endoftext|> c", "<|endoftext|><|endoftext|>", "é <|endoftext|>", "<|ENDOFTEXT|>"]
    docs = table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op7_token_output(spark, str(tmp_path)), corpus_pipeline.token_ids(spark, docs, str(tmp_path))):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rows.collect()}
        for k, t in enumerate(texts):
            want = [*plain.encode(t, add_special_tokens=False).ids, 0]
            assert got[k] == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), t
