"""Encoding, counting and token files against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import _pretokens, bpe, token_counts, token_files
from shelfmark.session import work_folder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  \t", "It's we've I'LL they'd 'tis ''s", "Ünïcode ÀÉÎ ß ÿ ǅ İstanbul ıI Σίγμας ς", "日本語 テキスト", "ábc é ́",
    "x\x1cy\x1dz\x85w v\xa0u", "½ ² ³ Ⅷ ٣٤ 1234567890", "a×b÷c ªº µ", "<|endoftext|>", "a <|endoftext|>b<|startoftext|><|endoftext|> c", "<|endoftext", "tabs\t\tand   spaces  ", "  lead",
    "price: $5,000.00!!! --- ... (x_y) [z]", "emoji 👍🏽 👨‍👩‍👧", "\x00\x01\x7f", "﻿bom​zero", "w" * 5000, "the quick brown fox " * 30_000, "trail\n", "\r\n a\r\n", "LOREM Ipsum DOLOR",
]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def noise(seed):
    random.seed(seed)
    alphabet = "abcXYZ'’stve  \n\t0129é߀,.!<|>_ñΩ日́\xa0\x1f"
    return ["".join(random.choices(alphabet, k=random.choice([3, 30, 300]))) for _ in range(150)]


TEXTS = ODD + noise(1) + noise(2)


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "y"), (3, TEXTS[3], "again"), (3, "other text", "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(5)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_bpe_matches_the_library(docs):
    tokenizer = library(WORD)
    wanted = []
    for i, text in rows_of(docs):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        wanted.append((i, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    found = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.bpe_round_trip(docs, WORD).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_latin_letters_are_cut_as_by_the_library():
    splitter, tokenizer = bpe._splitter(WORD), library(WORD)
    for code in range(0xC0, 0x250):
        for text in (f"a{chr(code)}b", chr(code), f"{chr(code)}{chr(code)} x{chr(code)}"):
            normal = tokenizer.normalizer.normalize_str(text)
            assert splitter.split(text) == [normal[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)], hex(code)


def test_bpe_with_many_blocks_and_groups(docs, monkeypatch):
    split = bpe._Block
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(bpe, "GROUP_WORDS", 50)
    assert split is bpe._Block
    batches = docs.select("doc_id", "text").toArrow().to_batches(max_chunksize=7)
    lists = sorted((r for b in bpe._split(iter(batches), WORD, 7) for r in b.to_pylist()), key=lambda r: (r["block"], r["kind"], r["bucket"], r["row"]))
    assert len({r["block"] for r in lists}) > 5
    import pyarrow as pa

    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])
    asked = sorted((r for r in lists if r["kind"] == bpe.WORDS), key=lambda r: r["bucket"])
    asked = [{k: r[k] for k in ("block", "bucket", "data")} for r in asked]
    answers = [r | {"kind": bpe.WORDS, "row": 0, "ids": []} for b in bpe._encode(iter([pa.RecordBatch.from_pylist(asked, schema)]), WORD) for r in b.to_pylist()]
    together = sorted(answers + [r for r in lists if r["kind"] != bpe.WORDS], key=lambda r: (r["block"], r["kind"], r["bucket"], r["row"]))
    batch = pa.RecordBatch.from_pylist(together, bpe._schema(pa.int64()))
    found = [(r["id"], r["decoded"]) for b in bpe._join(iter([batch]), WORD) for r in b.to_pylist()]
    tokenizer = library(WORD)
    wanted = [(i, tokenizer.decode(tokenizer.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows_of(docs)]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_counts_match_the_library(docs):
    tokenizer = library(BYTE)
    wanted = []
    for i, text in rows_of(docs):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        wanted.append((i, len(text.encode()), n, n > 512))
    found = [tuple(r) for r in token_counts.token_counts(docs, BYTE).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_counting_with_small_tables(docs, monkeypatch):
    """The frequent table and the caches change speed only."""
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    table = token_counts.frequent_lengths(docs.select("text"), BYTE)
    assert len(table) == 3
    assert token_counts.unpacked(token_counts.packed(table)) == table and token_counts.unpacked(token_counts.packed({})) == {}
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 2)
    lengths = token_counts.Lengths(_pretokens.Pieces(library(BYTE)), table)
    tokenizer = library(BYTE)
    for piece in [b" the", b"zqx", b" word", b"zqx", b"qqqq", b" the"] * 3:
        assert lengths[piece] == len(tokenizer.encode(piece.decode(), add_special_tokens=False).ids)
        assert len(lengths) <= 3 + 2 and set(table) <= set(lengths)


def test_bounded_counter_keeps_what_is_frequent(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(token_counts, "COUNTED", 8)
    counter = Counter({b"often": 100, **{bytes([i]): 1 for i in range(65, 75)}})
    assert token_counts._shrink(counter) == Counter({b"often": 99})


def test_token_files(docs, spark):
    tokenizer = library(BYTE)
    found = token_files.token_round_trip(spark, docs, BYTE).orderBy("start").collect()
    assert len(found) == docs.count()
    ids = [r.doc_id for r in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start = 0
    texts = {}
    for i, text in rows_of(docs):
        texts.setdefault(i, []).append(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in found:
        assert r.start == start
        texts[r.doc_id].remove(bytes(r.ids))
        start += len(r.ids) // 4


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.bpe_round_trip(none, WORD).collect() == []
    assert token_counts.token_counts(none, BYTE).collect() == []
    assert token_files.token_round_trip(spark, none, BYTE).collect() == []


def test_blocks_round_trip():
    random.seed(1)
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 10_000), np.zeros(300), rng.zipf(1.3, 5000) % 2**32, np.array([2**32 - 1, 0, 7]), np.arange(256)):
        ids = ids.astype("<u4")
        blocks = token_files.encode_blocks(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (token_files.decode_blocks(b"".join(blocks), starts)[: len(ids)] == ids).all()
    assert token_files.encode_blocks(np.zeros(0, "<u4")) == []


def test_outliers_are_exceptions():
    ids = np.full(256, 5, "<u4")
    ids[[3, 200]] = 40_000
    (block,) = token_files.encode_blocks(ids)
    least, width, exceptions = struct.unpack_from("<IBH", block)
    assert (least, width, exceptions) == (5, 0, 2) and len(block) == 7 + 2 * 2 + 2 * 4


@pytest.mark.parametrize("width", [0, 1, 7, 16, 17, 31, 32])
def test_bits(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (3, token_files.BLOCK))
    assert (token_files.unpack_bits(token_files.pack_bits(values, width), width) == values).all()


def test_a_damaged_file_is_refused(docs, spark):
    folder = work_folder(spark, "test")
    manifest = token_files.write_token_files(docs, folder, BYTE)
    path = manifest.first().path
    with open(path, "r+b") as f:
        f.write(b"oops")
    with pytest.raises(Exception, match="no token file"):
        token_files.read_token_files(manifest).collect()
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_a_file_with_other_counts_than_its_manifest_is_an_error(docs, spark):
    from pyspark.sql import functions as F

    manifest = token_files.write_token_files(docs, work_folder(spark, "test"), BYTE)
    for column in ("documents", "ids"):
        with pytest.raises(Exception, match="manifest says"):
            token_files.read_token_files(manifest.withColumn(column, F.col(column) + 1)).collect()
