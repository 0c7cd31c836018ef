"""Token operators against the libraries they follow, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edge_cases import TEXTS, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetledger.llm import forced_boundary_bpe as bpe
from fleetledger.llm import token_counts, token_files, unicode_classes
from fleetledger.session import shared_folder

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def random_texts(seed, n=300):
    rng = random.Random(seed)
    parts = ["the", " The", "'s", "'ll", "1234", " ", "  ", "\n", "\t", "é", "Σ", "İ", "日本", "🙂", "e\u0301", "\u00a0", "\u2028", "<|endoftext|>", "<|startoftext|>", "▁", "!?", "_", "ﬁ", "\x1c"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


def test_pieces_split_every_code_point_as_the_library_does(byte_library):
    symbols = unicode_classes.byte_symbols()
    for code in [*range(0, 0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 101)]:
        text = f"a{chr(code)}a {chr(code)}1{chr(code)}."
        own = ["".join(symbols[b] for b in piece.encode()) for piece in unicode_classes.pieces(unicode_classes.BYTE_LEVEL, text)]
        assert own == [x for x, _ in byte_library.pre_tokenizer.pre_tokenize_str(text)], hex(code)


def test_forced_boundaries_lie_inside_no_entry(byte_library):
    coder = bpe.ForcedBoundaryBpe(BYTE)
    for entry in coder.texts[:-1]:
        assert coder.cut(entry) == [entry]
    assert any(len(coder.cut(x)) > 1 for x in (b"\xff\xfe", b"q\x00", b"zq!x"))


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + random_texts(1))
def test_byte_level_ids_and_decoding(byte_library, text):
    coder = bpe.coder(BYTE)
    ids = byte_library.encode(text, add_special_tokens=False).ids
    packed = coder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert coder.decode(packed).decode() == byte_library.decode(ids, skip_special_tokens=False)


def test_decoding_of_broken_sequences(byte_library):
    coder, rng = bpe.coder(BYTE), random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert coder.decode(np.array(ids, "<u4").tobytes()).decode() == byte_library.decode(ids, skip_special_tokens=False)


def test_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr("fleetledger.llm.piece_cache.CACHE_ENTRIES", 2)
    coder, texts = bpe.ForcedBoundaryBpe(BYTE), random_texts(5, 50)
    assert [coder.encode(t) for t in texts] == [bpe.coder(BYTE).encode(t) for t in texts]


def test_columns_and_round_trip(spark, byte_library):
    docs = bpe.encode_documents(documents(spark), BYTE)
    done = docs.select("text", "n_words", "ids", bpe.decode_column(F.col("ids"), BYTE).alias("back"), bpe.round_trip_column(F.col("text"), BYTE).alias("r")).collect()
    assert len(done) == len(TEXTS) + 2
    for row in done:
        ids = byte_library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.back == (row.text or "") and row.n_words == "x"
        assert tuple(row.r) == (len(ids), hashlib.sha256(row.ids).hexdigest(), hashlib.sha256(row.back.encode()).hexdigest())
    assert bpe.encode_documents(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("share", [4, 2**21])
def test_token_counts(spark, monkeypatch, share):
    monkeypatch.setattr(token_counts, "FREQUENT_SHARE", share)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for t in TEXTS] + random_texts(7, 100) + ["a  ", "▁▁a", " "]
    docs = spark.createDataFrame([(i % 40 if i % 9 else None, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = token_counts.count_tokens(docs, PIECE, limit=20).collect()
    expected = [(i % 40 if i % 9 else None, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(expected, key=key)
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts.count_tokens(empty(spark), PIECE).count() == 0


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + random_texts(11))
def test_word_end_ids(text):
    assert np.frombuffer(token_files.coder(WORD).encode(text), "<u2").tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids if len(text) < 40 else True


def test_token_files(spark, monkeypatch):
    folder = shared_folder(spark, "test-token-files")
    docs = documents(spark)
    token_files.write_token_files(docs, folder, WORD, end_id=1)
    back = token_files.read_token_files(spark, folder).collect()
    library, start = Tokenizer.from_file(WORD), 0
    assert len(back) == docs.count()
    for row in sorted(back, key=lambda r: r.start):
        assert row.start == start
        start += len(row.ids) // 4
    ids = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    expected = sorted(zlib.crc32(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect())
    assert sorted(zlib.crc32(r.ids) for r in back) == expected
    token_files.write_token_files(empty(spark), folder + "-empty", WORD)
    assert token_files.read_token_files(spark, folder + "-empty").count() == 0


def test_reader_takes_only_the_frames_it_needs_and_tests_them(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 64)
    place, _ = token_files._place(str(tmp_path))
    path, rng = str(tmp_path / "one.tokens"), np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in (0, 5, 200, 1, 0, 31, 33)]
    with place.open_output_stream(path) as sink:
        writer = token_files.TokenFileWriter(sink, 2)
        for i, ids in enumerate(docs):
            writer.add(i if i != 3 else None, ids.tobytes())
        writer.finish()
    file = token_files.TokenFile(place, path)
    assert file.of(1)[0].tolist() == docs[1].tolist() and file.frames_read == 1
    assert all(file.document(k).tolist() == ids.tolist() for k, ids in enumerate(docs)) and file.of(3) == []
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == b"".join(d.tobytes() for d in docs)
    data = bytearray((tmp_path / "one.tokens").read_bytes())
    data[10] ^= 255
    (tmp_path / "one.tokens").write_bytes(data)
    with pytest.raises(Exception):
        token_files.TokenFile(place, path).document(1)
