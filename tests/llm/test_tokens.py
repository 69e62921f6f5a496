import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe_codec, byte_tokens, token_binary, token_counts
from tesserae.llm.common import fresh_folder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
BITS = [" ", "  ", "\n", " \n", "\t", "a", "Zé", "ß", "'s", "'", "'ll", "12", ".", "!?", "<|endoftext|>", "<|startoftext|>", "\xa0", "\x1c", "\x85", "漢", "ă", "́",
        "😀", "don't", "²", "ª", "-", "\r\n", "Σ", "ΑΣ", "x'y", "٣", "İ", "ﬁ", "​"]


def reader(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def scraps(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_byte_tokens_equal_the_library():
    ours, theirs = byte_tokens.ByteTokens(BYTE), reader(BYTE)
    for text in scraps(4000):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
        assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids)


def test_remembered_is_bounded():
    made = []
    r = byte_tokens.Remembered(lambda k: made.append(k) or len(k), 10)
    for i in range(100):
        assert r[f"{i}"] == len(f"{i}")
        assert r["hot"] == 3
        assert len(r) + len(r.older) <= 10
    assert made.count("hot") == 1


def test_bpe_equals_the_library():
    ours, theirs = bpe_codec.BpeCodec(WORD), reader(WORD)
    for text in scraps(4000, 2):
        ids = theirs.encode(text, add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == decoded
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert ours.summary(text) == (len(ids), digest(" ".join(map(str, ids))), digest(decoded))


def test_bpe_word_merges_by_rank():
    vocab = {x: i for i, x in enumerate(["a", "b", "c", "ab", "bc", "abc", "aab"])}
    bpe = bpe_codec.Bpe(vocab, ["b c", "a b", "a bc", "a ab"])
    assert bpe.encode_word("abc") == [vocab["abc"]]
    assert bpe.encode_word("aab") == [vocab["aab"]]
    assert bpe.encode_word("") == []
    assert bpe.encode_word("aaabcb") == [vocab["a"], vocab["a"], vocab["abc"], vocab["b"]]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_token_counts(spark, table, request, monkeypatch):
    df, cache, theirs = request.getfixturevalue(table), fresh_folder(spark, "cache"), reader(BYTE)
    out = token_counts.token_counts(df, BYTE, cache)
    size = lambda t: len(theirs.encode(t or "", add_special_tokens=False).ids)
    want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text), size(r.text) > 1024) for r in df.select("doc_id", "text").collect())
    assert multiset(out.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    assert spark.read.parquet(cache).count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    # A second run finds all counts stored; a third table adds its own contents only.
    token_counts.token_counts(df, BYTE, cache).count()
    assert spark.read.parquet(cache).count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(99, "new text")], "doc_id long, text string"))
    again = token_counts.token_counts(more, BYTE, cache)
    assert again.count() == df.count() + 1 and again.where("n_tokens IS NULL").isEmpty()
    assert spark.read.parquet(cache).where(F.col("digest") == F.unhex(F.sha2(F.lit("new text"), 256))).count() == 1


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_bpe_query(table, request):
    df, theirs = request.getfixturevalue(table), reader(WORD)
    rows = df.select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False)))] += 1
    assert multiset(bpe_codec.digests(df, WORD)) == want
    full = bpe_codec.encode_decode(df, WORD).collect()
    assert Counter((r.doc_id, len(r.ids), digest(" ".join(map(str, r.ids))), digest(r.decoded)) for r in full) == want


def test_bpe_encodes_copies_in_a_row_once(monkeypatch):
    ours, seen = bpe_codec.BpeCodec(WORD), []
    plain = ours.summary
    monkeypatch.setattr(ours, "summary", lambda t: seen.append(t) or plain(t))
    monkeypatch.setitem(bpe_codec._open, WORD, ours)
    texts = [None, "", "a copy", "a copy", "a copy", "another", None, None, "a copy"]
    batches = [pa.record_batch([pa.array(range(len(x))), pa.array(x, pa.string())], ["doc_id", "text"]) for x in (texts[:4], texts[4:])]
    got = [tuple(r.values())[1:] for b in bpe_codec._summaries(WORD)(iter(batches)) for r in b.to_pylist()]
    assert got == list(map(plain, texts))
    assert seen.count("a copy") == 2


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
@pytest.mark.parametrize("table", ["odd", "docs"])
def test_token_files(spark, table, encoding, request):
    df, theirs, path = request.getfixturevalue(table), reader(BYTE), fresh_folder(spark, "ids")
    token_binary.write_tokens(df, path, BYTE, end_id=2, partitions=3, encoding=encoding)
    back = token_binary.read_tokens(spark, path)
    rows = df.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).collect()
    want, start = [], 0
    for r in rows:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids) for r in back.orderBy("start").collect()] == want
    got = multiset(back.mapInArrow(token_binary.checksum, "doc_id long, start long, n_tokens long, ids_crc32 long"))
    assert got == Counter((i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want)
    # Metadata are read without the pages of ids.
    plan = spark.read.parquet(path).select("doc_id", "n_tokens").where("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.partition("ReadSchema")[2] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan


def test_empty_tables(spark, empty):
    assert token_counts.token_counts(empty, BYTE, fresh_folder(spark, "cache")).count() == 0
    assert bpe_codec.digests(empty, WORD).count() == 0
    path = fresh_folder(spark, "ids")
    token_binary.write_tokens(empty, path, BYTE)
    assert token_binary.read_tokens(spark, path).count() == 0
