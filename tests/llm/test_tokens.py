"""Token files, byte-level BPE and trie counts against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD_TEXTS, none, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from shardloom.llm import byte_bpe, queries, token_blocks, trie_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- token files -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=1500), max_size=6))
def test_token_file_round_trip(lists):
    arrays = [np.array(x, np.uint32) for x in lists]
    ids = np.concatenate([np.zeros(0, np.uint32), *arrays])
    keys = [None if k == 1 else k - 3 for k in range(len(arrays))]
    read = token_blocks.TokenFile(token_blocks.write_file(ids, keys, [len(a) for a in arrays]))
    assert [(k, a.tolist()) for k, _, a in read.documents(stretch=700)] == [(k, a.tolist()) for k, a in zip(keys, arrays)]
    if len(ids) > 5:
        assert read.ids(3, len(ids) - 2).tolist() == ids[3:-2].tolist()


def test_exceptions_keep_blocks_narrow():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[::100] = 2**31
    assert len(token_blocks.encode_blocks(ids)[0]) < 1024  # 4 bits each and eleven exceptions
    assert token_blocks.TokenFile(token_blocks.write_file(ids, [1], [1024])).ids(0, 1024).tolist() == ids.tolist()


def test_a_torn_file_is_refused():
    data = token_blocks.write_file(np.arange(10, dtype=np.uint32), [1], [10])
    with pytest.raises(ValueError):
        token_blocks.TokenFile(data[:-3])


def _library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_blocks.VOCABULARY))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def _expected_files(rows):
    encode, start, out = _library(), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(encode(text), "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def test_op1_equals_the_library(spark, documents):
    got = queries.op1_token_blocks(spark, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _expected_files(documents)


def test_word_codec_equals_the_library():
    codec, encode, rnd = token_blocks.word_codec(public_tokenizers.path(token_blocks.VOCABULARY)), _library(), random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "é", "ß", "　", "1", "'s", "\x1c", "The", "\t", "🎉", "½", ".", ".,", "İ", "Σ", "한", "ᄒ", "ᅡ", "́", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|EndOfText|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == encode(text), text


def test_token_files_of_odd_rows(spark, monkeypatch):
    named = [(10, "see <|endoftext|> here", 0.1, 1, "en"), (11, "x<|startoftext|>,<|endoftext|>!\n<|endoftext|> <|END", 0.1, 1, "en")]
    rows = odd(spark).union(spark.createDataFrame(named, odd(spark).schema))
    assert _library()("see <|endoftext|> here")[1] == 49407
    folder, manifest = token_blocks.encode_corpus(rows)
    got = sorted(map(tuple, token_blocks.read_token_files(spark, folder, manifest).collect()), key=lambda r: r[1])
    want = _expected_files([r[:2] for r in ODD_TEXTS + named])
    assert [r[:4] for r in got] == want
    assert all(zlib.crc32(r[4]) == r[3] for r in got)
    folder, manifest = token_blocks.encode_corpus(none(spark))
    assert manifest.count() == 0


# --- byte-level BPE --------------------------------------------------------------------------------------------------


def _tiktoken():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _round_trip(rows):
    library, out = _tiktoken(), []
    for key, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        out.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_op6_equals_the_library(spark, documents):
    assert sorted(map(tuple, queries.op6_byte_bpe(spark, SF).collect()), key=str) == _round_trip(documents)


def test_byte_bpe_of_odd_rows(spark):
    assert sorted(map(tuple, byte_bpe.round_trip(odd(spark)).collect()), key=str) == _round_trip([r[:2] for r in ODD_TEXTS])
    assert byte_bpe.round_trip(none(spark)).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(odd(spark)))
    assert back.columns == ["doc_id", "text", "score", "lang", "ids", "n_tokens", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehilnorst '\n.,!1 ", max_size=80)))
def test_byte_bpe_equals_the_library(text):
    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == _ENCODING.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


_ENCODING = _tiktoken()


# --- trie counts -----------------------------------------------------------------------------------------------------


def _unigram():
    scores = trie_counts.piece_scores(public_tokenizers.path(trie_counts.VOCABULARY))
    tokenizer = Tokenizer(models.Unigram([("<unk>", min(scores.values())), *scores.items()], unk_id=0, byte_fallback=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=trie_counts.MARK, prepend_scheme="always", split=True)

    def count(word):
        made = tokenizer.encode(word)
        return sum(1 if i else len(word[a:b].encode()) for i, (a, b) in zip(made.ids, made.offsets))

    return count


def test_op9_equals_the_library(spark, documents):
    count = _unigram()
    known = {}
    want = []
    for key, text in documents:
        words = (text or "").split()
        want.append((key, sum(known[w] if w in known else known.setdefault(w, count(w)) for w in words), len(words)))
    assert sorted(map(tuple, queries.op9_trie_counts(spark, SF).collect())) == sorted(want)


def test_trie_counts_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_pretokens"]): r["n_tokens"] for r in trie_counts.count_tokens(odd(spark)).collect()}
    count = _unigram()
    assert got[3, 0] == got[2, 0] == got[8, 0] == 0
    assert got[6, 60_000] == 60_000 * count("word")
    assert got[7, 1] == count("x" * 50_000)
    assert got[5, 5] == sum(map(count, ODD_TEXTS[5][1].split()))
    assert trie_counts.count_tokens(none(spark)).count() == 0


def test_prefixes_are_shared_and_the_trie_stays_bounded(monkeypatch):
    trie = trie_counts.PreTokenTrie(trie_counts.piece_scores(public_tokenizers.path(trie_counts.VOCABULARY)))
    trie["prefixes"]
    nodes = len(trie.best)
    trie["prefixed"]
    assert len(trie.best) == nodes + 1
    monkeypatch.setattr(trie_counts, "NODES", 50)
    count = _unigram()
    words = ["".join(random.Random(k).choices("abcde", k=9)) for k in range(40)]
    assert [trie[w] for w in words] == [count(w) for w in words]
    assert len(trie.best) < 80
