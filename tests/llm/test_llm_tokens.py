"""Token files (1), the transducer (6), packing (9): round trips against the public libraries."""

import codecs
import contextlib
import gc
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskweave.llm import bpe_transducer, packing, pieces, queries, token_files
from riskweave.llm.pieces import Cache, PieceEncoder
from riskweave.sources.shared import fresh_dir

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = st.lists(
    st.sampled_from(list("ab é日👍́ \n\t \x1c\x85'.!123") + [" ", " ", "th", "ing", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "ΑΣ", "İ"]),
    max_size=25,
).map("".join)


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return bpe_transducer.Codec(MULTI, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={}
    )


def test_the_cycle_collector_rests_while_texts_are_encoded():
    encoder, seen = PieceEncoder(BYTES), []
    encoder.at_added = lambda text: seen.append(gc.isenabled()) or [text]
    encoder.encode("a b <|endoftext|>")
    assert seen == [False] and gc.isenabled()
    gc.disable()
    encoder.encode("a b")
    assert not gc.isenabled()
    gc.enable()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_like_the_whole_text(path, documents):
    encoder, expected = PieceEncoder(path, cached=50), whole(path)
    for _, text in documents[:60]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text)

    @settings(max_examples=300, deadline=None)
    @given(ODD)
    def check(text):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text)

    check()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_held_piece_is_looked_up_once(path):
    """Also where the cache begins anew within a portion, and where pieces cannot be taken alone."""
    texts = ["Ärger über das Ende,\nthe end; abc... ABC", " a  b\t c\n\n", "", "the end\x85 of It's", "ÀÖØößøÿ é\nÉclair! " + "x" * 70] * 3
    encoder, expected = PieceEncoder(path, cached=4), whole(path)
    for _ in range(3):
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode_all(texts)] == [expected(t) for t in texts]
    encoder, wanted = PieceEncoder(path), []
    learn = encoder.learn
    encoder.learn = lambda pieces: wanted.append(set(pieces)) or learn(pieces)
    encoder.encode_all(["some plain words here"])
    encoder.encode_all(["some plain words here", "and here some more words"])
    # The first piece of a text has a cache of its own where spaces matter.
    assert wanted[1] <= {"and", "more", "some"}


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("cached", [3, 20, 1000])
def test_columns_encode_like_each_text(path, cached, monkeypatch):
    """Nulls, parts of a column, generations of the cache, and pieces whose hashes are all the same."""
    expected = whole(path)
    texts = ["skip", "Ärger über, the end.", None, "", "the\nEnd; of the (end)...", "two  spaces\t", "the end. <|endoftext|> the", "é!" * 40 + " " + "y" * 99]
    column = pa.array(texts).slice(1)
    for same in (False, True):
        if same:
            monkeypatch.setattr(pieces, "MIX", np.zeros_like(pieces.MIX))
        encoder = PieceEncoder(path, cached=cached)
        for part in (column, column.slice(0, 4), column.slice(3), column, column.slice(0, 0)):
            counts, ids = encoder.encode_column(part)
            want = [expected(text) for text in part.to_pylist()]
            assert counts.dtype == np.int64
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert max(map(len, encoder.held.pieces.to_pylist())) <= pieces.LONGEST_CACHED


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_letters_are_kept_once(path):
    """However many signs follow them, they are tokenised in bulk and only when they are new."""
    encoder, asked = PieceEncoder(path), []
    tokens = encoder.tokens
    encoder.tokens = lambda words: asked.append(sorted(words.to_pylist())) or tokens(words)
    for texts in (["a tree, tree; tree. (tree) leaf"], ["a leaf, leaf! tree? root"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [whole(path)(t) for t in texts]
    assert [w for words in asked for w in words if w != "a"] == ["leaf", "tree", "root"]


def test_texts_come_in_portions(monkeypatch):
    monkeypatch.setattr(token_files, "PORTION", 4)
    texts = ["abc", None, "defgh", "", "i", "jklmnopqr", "s"]
    got = [part.to_pylist() for part in token_files.text_portions(pa.array(["x", *texts]).slice(1))]
    assert [text for part in got for text in part] == texts and len(got) > 2
    assert list(token_files.text_portions(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_strings_of_special_tokens_are_tokens(path):
    encoder, expected = PieceEncoder(path), whole(path)
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [
        f"hi {end} you", end, end * 3, f"{end} ", f" {end}", f"a{end}b", f"a {end}\n{end} b  ", f"{start}x{end}", end[:-1],
        f"<|endof{end}text|>", end.upper(), f"<{end}>", f"e\u0301{end}\u0301e", f"it{end}'s", "plain words", "", f"\n{end}\n",
    ]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [expected(t) for t in texts]
    assert 50256 in expected(end) or 49407 in expected(end)


def test_cache_is_bounded():
    cache = Cache(len, 10)
    assert [cache["x" * (i % 37)] for i in range(500)] == [i % 37 for i in range(500)]
    assert len(cache) <= 10 and len(cache.old) <= 10


def expected_files(rows, encode):
    """(doc_id, start, n_tokens, crc) for rows in file order."""
    start, out = 0, []
    for key, text in rows:
        ids = np.array([*encode(text), 2], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op1_reads_back_what_the_library_encodes(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in queries.op1_token_files(spark, sf_dir).collect())
    assert got == expected_files(documents, whole(BYTES))


def test_token_files_find_by_metadata(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_files.write_token_files(docs, fresh_dir(spark, "t"), BYTES, None)
    found = files.find([documents[3][0], -5])
    assert [r["ids"] for r in found.collect()] == [whole(BYTES)(documents[3][1])]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    assert "PushedFilters: [In(doc_id" in out.getvalue()
    manifest = files.manifest().orderBy("part").collect()
    assert [m["start"] for m in manifest] == np.cumsum([0, *(m["tokens"] for m in manifest)])[:-1].tolist()
    assert all(a["max_id"] < b["min_id"] for a, b in zip(manifest, manifest[1:], strict=False))


def test_token_files_edges(spark, edge_docs, no_docs):
    files = token_files.write_token_files(edge_docs, fresh_dir(spark, "t"), BYTES, 2)
    rows = token_files.with_crc32(files.documents()).collect()
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    encoded = {(k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in ((k, [*whole(BYTES)(t), 2]) for k, t in texts)}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows} == encoded and len(rows) == len(texts)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert [a for a, _ in ends] == [0, *(b for _, b in ends)][:-1]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    none = token_files.write_token_files(no_docs, fresh_dir(spark, "t"), BYTES, 2)
    assert none.documents().count() == 0


def check_packed(rows, texts):
    encode = whole(WORDS)
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(np.array([*encode(text), 2], dtype="<u4"))
    at = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 4096 + r["offset"] == at
        at += r["length"]
        pieces = (x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert r["ids_crc32"] in {zlib.crc32(p.tobytes()) for p in pieces}
    assert at == sum(len(x) for own in ids.values() for x in own)


def test_op9_packs_every_id_once(spark, sf_dir, documents):
    check_packed(queries.op9_packing(spark, sf_dir).collect(), documents)


def test_packing_edges_and_sequences(spark, edge_docs, no_docs):
    files = token_files.write_token_files(edge_docs, fresh_dir(spark, "t"), WORDS, 2)
    check_packed(packing.pieces(files).collect(), [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    rows = packing.sequences(packing.pieces(files, with_ids=True), pad_id=7).orderBy("sequence_id").collect()
    assert [r["n_tokens"] for r in rows[:-1]] == [4096] * (len(rows) - 1) and all(len(r["ids"]) == 4096 for r in rows)
    kept = [i for r in rows for i in r["ids"][: r["n_tokens"]]]
    inside = files.documents().orderBy("start").collect()
    assert kept == [i for r in inside for i in r["ids"]]
    none = token_files.write_token_files(no_docs, fresh_dir(spark, "t"), WORDS, 2)
    assert packing.pieces(none).count() == 0


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op6_equals_tiktoken(spark, sf_dir, documents, tik):
    got = {r[0]: tuple(r)[1:] for r in queries.op6_bpe_transducer(spark, sf_dir).collect()}
    for key, text in documents:
        ids = tik.encode_ordinary(text)
        assert got[key] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))


def test_transducer_on_odd_texts(codec, tik):
    @settings(max_examples=400, deadline=None)
    @given(ODD, st.integers(1, 5))
    def check(text, portion):
        ids = tik.encode_ordinary(text)
        assert codec.encode(text) == ids and "".join(codec.decode(ids, portion)) == text

    check()
    for text in ("a" * 5000, "ab" * 3000 + "!" * 2000, "é" * 3000, "1" * 4000):
        assert codec.encode(text) == tik.encode_ordinary(text)


def test_transducer_with_full_tables(codec, tik, monkeypatch, documents):
    monkeypatch.setattr(bpe_transducer, "STATES", 50)
    monkeypatch.setattr(bpe_transducer, "NEIGHBOURS", 50)
    fresh = bpe_transducer.Transducer(codec.transducer.ranks)
    for word in set(documents[0][1].split()):
        ids = fresh.encode(word.encode())
        assert b"".join(map(fresh.token_bytes.get, ids)) == word.encode()
        assert ids == tik._core_bpe.encode_single_piece(word.encode()) or len(ids) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=4), max_size=12))
def test_decoder_equals_the_incremental_codec(portions):
    table = dict(enumerate(portions))
    ours, theirs = bpe_transducer.StreamDecoder(table), codecs.getincrementaldecoder("utf-8")("replace")
    got = [ours.feed([i]) for i in table] + [ours.end()]
    want = [theirs.decode(p) for p in portions] + [theirs.decode(b"", True)]
    assert "".join(got) == "".join(want)


def test_documents_encode_and_decode(spark, edge_docs, no_docs, tik):
    encoded = bpe_transducer.encode_documents(edge_docs, MULTI, public_tokenizers.PATTERN)
    texts = sorted((r["text"] or "") for r in edge_docs.collect())
    assert sorted(tuple(r["ids"]) for r in encoded.collect()) == sorted(tuple(tik.encode_ordinary(t)) for t in texts)
    assert sorted(r["text"] for r in bpe_transducer.decode_documents(encoded, MULTI).collect()) == texts
    assert bpe_transducer.round_trip(no_docs, MULTI, public_tokenizers.PATTERN).count() == 0
    assert bpe_transducer.encode_documents(no_docs, MULTI, public_tokenizers.PATTERN).count() == 0
