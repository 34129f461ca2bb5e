"""Token frames and piece codec against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from licspark.llm import queries, shared_files
from licspark.llm.chunks import HashedChunkTable
from licspark.llm.piece_codec import decode_pieces, encode_pieces
from licspark.llm.token_frames import FrameReader, read_token_frames, write_token_frames

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "the", "Don", "'s", "'t", "'", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!!", "1", "23", "é", "ß", "×", "÷", "…", " ", "　", " ", "日本", "🙂", "\x1c", "\x00", "<|endoftext|>", "<s>", "▁", "ﬁ", "́", "_", "#"]


def random_texts(n=600, seed=3):
    rng = random.Random(seed)
    fixed = [None, "", " ", "   ", "\n", "word", " word", "word ", "a  b   c", "x" * 5000, "ab " * 4000, "🙂" * 300]
    return fixed + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40))) for _ in range(n)] + ["", "word"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 1000003 if k else None, text, "x") for k, text in enumerate(random_texts())]
    rows.append((6, "same id, other text", "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)


def test_frames_hold_what_the_library_gives(spark, docs, tmp_path):
    shards = write_token_frames(docs, BPE, 2, str(tmp_path / "frames"), frame_ids=500)
    rows = docs.withColumn("hash", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash))
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for row in rows:
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        want.append((row.doc_id, start, len(ids), ids))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_frames(shards).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = read_token_frames(shards, [6, 9]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [(d, s) for d, s, *_ in want if d in (6, 9)]
    assert sum(r.n_docs for r in shards.collect()) == len(rows)


def test_chunk_table_forgets_and_survives_equal_hashes():
    rng = random.Random(5)
    calls = []

    def encode(chunks):
        calls.append(len(chunks))
        return np.concatenate([np.frombuffer(c, np.uint8) for c in chunks]).astype(np.uint32) + 1000, np.array([len(c) for c in chunks])

    table = HashedChunkTable(encode, np.uint32, 60)
    for round_ in range(200):
        chunks = [bytes(rng.choices(b"abc", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 25))]
        data = np.frombuffer(b"".join(chunks), np.uint8)
        cuts = np.concatenate(([0], np.cumsum([len(c) for c in chunks])))
        middle = rng.randrange(len(chunks) + 1)
        hashes = np.array([int.from_bytes(hashlib.sha1(c).digest()[: 1 if round_ % 10 == 0 else 8], "little") for c in chunks], np.uint64)
        ids, bounds = table.joined(data, cuts, np.array([0, middle, len(chunks)]), hashes)
        assert ids.tolist() == [b + 1000 for b in data.tolist()] and bounds.tolist() == [0, cuts[middle], len(data)]
        assert len(table.newer.hashes) <= 30 and len(table.older.hashes) <= 30
    assert sum(calls) < 200 * 12


def test_reader_opens_only_the_frames_it_needs_and_sees_damage(spark, docs, tmp_path):
    shard = write_token_frames(docs.coalesce(1), BPE, 2, str(tmp_path / "frames"), frame_ids=200).orderBy("shard").first()
    with shared_files.open_at_will(shard.path) as file:
        reader = FrameReader(file)
        assert len(reader.seek) > 3
        opened = []
        frame = reader.frame
        reader.frame = lambda number: opened.append(number) or frame(number)
        list(reader.documents([0, 1, len(reader.index) - 1]))
        assert opened == [0, len(reader.seek) - 1]
    data = bytearray(open(shard.path, "rb").read())
    data[20] ^= 255
    bad = tmp_path / "bad"
    bad.write_bytes(data)
    with pytest.raises(Exception):
        list(FrameReader(open(bad, "rb")).documents())


def test_pieces_are_those_of_the_library(spark, docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = decode_pieces(encode_pieces(docs, PIECES), PIECES).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = []
    for row in docs.collect():
        ids = processor.encode(row.text or "", add_bos=True, add_eos=True)
        want.append((row.doc_id, ids, processor.decode(ids)))
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_empty_table(spark, docs, tmp_path):
    none = docs.limit(0)
    assert read_token_frames(write_token_frames(none, BPE, 2, str(tmp_path / "none"))).collect() == []
    assert decode_pieces(encode_pieces(none, PIECES), PIECES).collect() == []


def test_registered_digests(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokenizer, start, want = Tokenizer.from_file(BPE), 0, {}
    for doc_id in sorted(rows):
        ids = np.array(tokenizer.encode(rows[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_frames(spark, sf_dir).collect()} == want
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op9_sentencepiece(spark, sf_dir).collect():
        ids = processor.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
