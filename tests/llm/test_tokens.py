"""Token files, against the library on whole texts."""

import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from voxloom.llm import queries, token_files
from voxloom.llm.pieces import Encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def data(name=NAMES[0]):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library():
    return Encoder(data(), 2).library


def whole(library, text, end=2):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def ids_of(encoder, texts):
    found = list(encoder.batches(pa.array(texts, pa.string())))
    flat = np.concatenate([i for i, _ in found]).tolist()
    ends = np.cumsum(np.concatenate([c for _, c in found])).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


ODD = ["", None, " ", "\n", "it's 're we'll've '' ''s 's's  's \n's\t's a'sb 'Start 'tis 'll'", "  two  spaces \n\n x\n y \r\n z  q ẃ ½ ² x² 1a 12  ",
       "a\x00b\x00", "日本語 テキスト 한국어 ٣٤ 🎉🎉 'd'", "\x85a\x1cb\x1f", "<|endoftext|>", "one <|endoftext|> two", "'", "''", "'r", "'re", " 're", "x'", "Ⅷ ǅ ʰ ªº", "word " * 4000]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_equal_whole_texts(name):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choices("ab '\n\t srevlmtd1½é!日́   ", k=draw.randint(0, 30))) for _ in range(3000)]
    encoder = Encoder(data(name), 2)
    assert encoder.by_piece == (name == NAMES[0])
    assert ids_of(encoder, texts) == [whole(encoder.library, t) for t in texts]
    assert ids_of(Encoder(data(name), 70_000), texts[:9]) == [whole(encoder.library, t, 70_000) for t in texts[:9]]


def test_a_full_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr("voxloom.llm.pieces.REMEMBERED", 5)
    encoder = Encoder(data(), 2)
    for text in ("one two three four", "five six one", "a b c d e f g h"):
        assert ids_of(encoder, [text]) == [whole(library, text)]


def test_round_trip(spark, odd, library, tmp_path):
    folder = token_files.write_files(odd.repartition(3), public_tokenizers.path(NAMES[0]), str(tmp_path / "tokens"))
    found = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.position)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in found) == sorted((i if i is not None else -1, whole(library, t)) for i, t in rows)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in found] == np.cumsum([0, *(len(r.ids) for r in found)])[:-1].tolist()
    assert not [f for f in os.listdir(folder) if f.startswith(".part")]
    flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted(glob.glob(f"{folder}/part-*.ids"))])
    assert flat.tolist() == [i for r in found for i in r.ids]


def test_wide_ids_and_other_places(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id int, text string")
    folder = token_files.write_files(docs, public_tokenizers.path(NAMES[0]), f"file://{tmp_path}/wide", end=70_000)
    assert [r.ids[-1] for r in token_files.read_ids(spark, folder).collect()] == [70_000, 70_000]
    with pytest.raises(ValueError, match="no mounted folder"):
        token_files.write_files(docs, public_tokenizers.path(NAMES[0]), "hdfs://store/tokens")


def test_one_id_on_most_rows_and_none(spark, library):
    rows = [(None if i % 3 else i, f"text {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = token_files.write_files(docs, public_tokenizers.path(NAMES[0]))
    found = sorted(token_files.read_files(spark, folder).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in found] == [None] * 200 + list(range(0, 300, 3))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    empty = token_files.write_files(docs.where("doc_id < 0"), public_tokenizers.path(NAMES[0]))
    assert token_files.read_files(spark, empty).collect() == []


def test_registered_query_equals_the_library(spark, sf, library):
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = whole(library, r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, sf).collect())) == want
