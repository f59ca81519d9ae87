import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridsquall.llm import textnum
from gridsquall.llm.queries import vocabulary
from gridsquall.llm.tokens import ChunkEncoder
from gridsquall.llm.wavelet import Shard, pack_shard, read_token_shards, token_shards

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n a", "a\n b", "a \n b", "a\n  \nb", "it's we'll  they'd", "x  y", "a\x1c b\x85 c", "é ́a", "Σας ΟΔΟΣ", "日本 語  テスト", "<|endoftext|> a", "12 345,6 !!", "\t\t x", "trail \n ", "a" * 5000, "🙂 🙂🙂", "hello <|endoftext|> world", "x<|startoftext|>y", "a\ue000b \ue000", "a.\nB", "a.\n\nB", "a.\r\nB", "l'a.'s d'!x", "e\u0301. =\u0338", "a\u3000 b", "a\u00a0 b", "à \nb", "ab--cd \n", "\n", "\n\n", "x\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_whole_text_encoding(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "1", "é", "\t", ".", "Z", "\u00a0", "!?", "'", "\u0301", "\u2003", "\ue000", "<|"]) for _ in range(60)) for _ in range(300)]
    t = Tokenizer.from_file(vocabulary(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ChunkEncoder(vocabulary(name)).encode_texts(texts) == want
    assert ChunkEncoder(vocabulary(name), remember=3).encode_texts(texts) == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000, 70_000])
def test_shard_round_trip_and_lookup(n):
    a = np.random.default_rng(n).integers(0, 40, n).astype("<u4")
    s = Shard(pack_shard([3, None], np.array([n // 2, n - n // 2]), a))
    assert s.ids == [3, None] and s.offsets.tolist() == [0, n // 2, n]
    assert s.tokens().tolist() == a.tolist()
    for i in range(0, n, max(97, n // 40)):
        assert s.access(i) == a[i]
        assert s.rank(7, i) == (a[:i] == 7).sum()
    where = np.flatnonzero(a == 7)
    assert s.count(7) == len(where) and s.count(1 << 20) == 0
    assert [s.select(7, k) for k in range(0, len(where), max(1, n // 1000))] == where[:: max(1, n // 1000)].tolist()
    with pytest.raises(IndexError):
        s.select(7, len(where))


def test_planes_are_compressed():
    a = np.minimum(np.random.default_rng(5).zipf(1.5, 200_000), 49_000).astype("<u4")
    assert len(pack_shard([1], np.array([len(a)]), a)) < 1.2 * len(a)  # plain 16-bit ids take 2


def test_query_form(spark):
    rows = [(5, "b c", 0), (2, None, 0), (9, "a " * 3000, 0), (None, "x", 0), (2, "dup", 0), (2, "dup", 0), (7, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = read_token_shards(token_shards(docs, vocabulary("word_bpe_49k.json"), shard_tokens=1000)).orderBy("start").collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert [r.doc_id for r in got] == [None, 2, 2, 2, 5, 7, 9]
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
        at += len(ids)
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x, _ in rows)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == want
    assert read_token_shards(token_shards(docs.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


def overlap_free(n):
    """The Thue-Morse string and its complement: polynomial hashes modulo 2**64 cannot tell them apart from 1,024 letters on."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n], s[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_self_similar_words_have_the_ids_of_the_library(name):
    path = vocabulary(name)
    library = Tokenizer.from_file(path)
    encoder = ChunkEncoder(path)
    texts = [t for n in (64, 512, 1024, 2048) for t in overlap_free(n)] + ["ab" * 700, "ba" * 700, "a" * 300, "a" * 301]
    for text, ids in zip(texts, encoder.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_hashes_of_structured_stretches_are_distinct():
    texts = {t for n in (8, 9, 64, 191, 192, 193, 1024, 4096) for t in overlap_free(n)}
    texts |= {"a" * n for n in range(1, 600)} | {"ab" * n for n in range(1, 300)} | {"a" * k + "b" + "a" * (40 - k) for k in range(40)} | {"\x00" * n for n in range(1, 40)}
    w = textnum.read(pa.array(sorted(texts)), textnum.BLANK_PARTED)
    assert len(set(w.of_words().tolist())) == len(texts)
    a, z = np.array([0, 3, 5, 5]), np.array([0, 3, 4, 6])
    assert len(set(textnum.stretch_hashes(w.raw, a, z).tolist())) == 2
