"""Token files: ids against the library text by text, Elias-Fano codes against plain lists, files read back."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skymesh.llm import queries, tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", " ", "\n", "'s", "'", "é", "ß", "日", " ", "　", "1", "23", "!", "<|endoftext|>", "_", "\t", "\r", "\u0085", " ", "😀", "\x00", "İ", ". ", "-", "×"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=20), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(library, texts):
    ids, count = tokens.encoded(pa.array(texts, pa.string()), PATH)
    assert ids.tolist() == [x for t in texts for x in plain(library, t)] and count.tolist() == [len(plain(library, t)) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1500])
@pytest.mark.parametrize("most", [0, 1, 7, 1000, 10**12, 2**63])
def test_elias_fano(n, most):
    values = np.sort(np.random.default_rng(n).integers(0, most + 1, n, dtype=np.uint64))
    data = tokens.EliasFano.of(values).to_bytes()
    own = tokens.EliasFano.from_bytes(data)
    assert own.values().tolist() == values.tolist() == [own[i] for i in range(n)]
    assert 8 * (len(data) - 16) <= n * (2 + max(0, np.log2(max(1, most) / n))) + 16
    with pytest.raises(IndexError):
        own[n]


def wanted(library, rows):
    out, start = {}, 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain(library, t)
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_by_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_elias_fano_ids"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == wanted(library, rows)


def test_odd_tables(spark, library, tmp_path):
    random.seed(5)
    rows = [(i * 7 - 40, "".join(random.choices(PARTS, k=i))) for i in range(60)]
    rows += [(None, "no id"), (-(2**63), None), (2**63 - 1, ""), (1000, "日本語" * 40_000), (1001, "long text " * 30_000), (1002, "<|endoftext|>")]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"path": F.lit("x"), "value": F.lit(1), "start": F.lit(None)}).repartition(5)
    got = tokens.binary_ids(df, PATH, size=3000)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == wanted(library, rows)
    assert tokens.binary_ids(df.limit(0), PATH).count() == 0


def test_equal_ids_follow_each_other(spark, library):
    rows = [(1, "a"), (1, "b c"), (1, "a"), (2, None), (2, None)]
    got = tokens.binary_ids(spark.createDataFrame(rows, "doc_id long, text string"), PATH).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(plain(library, t))) for i, t in rows)


def test_a_document_by_selection(spark, library, tmp_path):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(700)]
    tokens.write_ids(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "ids"), PATH)
    files = [tokens.Shard(r.content) for r in spark.read.format("binaryFile").load(str(tmp_path / "ids")).collect() if r.length > tokens.HEADER]
    seen = [own.doc_id(i) for own in sorted(files, key=lambda x: (x.task, x.file)) for i in range(own.documents) if own.document(i).tolist() == plain(library, rows[own.doc_id(i)][1])]
    assert seen == list(range(700))


def test_other_tokenizers_get_whole_texts(library):
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.loaded(other)[1] is None
    texts = ["Some Words here, and more.", "", "x"]
    ids, count = tokens.encoded(pa.array(texts), other)
    assert ids.tolist() == [x for t in texts for x in plain(Tokenizer.from_file(other), t)]


def test_files_of_many_tasks_follow_each_other(spark, library):
    rows = [(i * 3 % 211, f"text {i} " * (i % 9)) for i in range(211)]
    keys = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = tokens.binary_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, size=100)
        assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == wanted(library, rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
