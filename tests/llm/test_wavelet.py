import zlib

import numpy as np
import pytest

from quizmill.llm import wavelet
from quizmill.llm.tokens import END, default_path
from quizmill.llm.wavelet import WaveletMatrix, from_file, lookup, read_documents, to_file, write_shards


@pytest.mark.parametrize("n,bits", [(0, 4), (1, 1), (700, 4), (5000, 16), (150_000, 16)])
def test_access_rank_select_and_round_trip(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, min(1 << bits, 40), n).astype("<u2")
    docs, lengths, m = from_file(to_file(np.arange(2), np.array([n, 0]), WaveletMatrix.build(ids, bits)))
    assert (m.decode(np.dtype("<u2")) == ids).all() and docs.tolist() == [0, 1] and lengths.tolist() == [n, 0]
    for at in rng.integers(0, max(n, 1), 30)[: n and 30]:
        assert m.access(int(at)) == ids[at]
        assert m.rank(int(ids[at]), int(at)) == (ids[:at] == ids[at]).sum()
        assert m.select(int(ids[at]), int((ids[:at] == ids[at]).sum())) == at
    assert m.rank(1, 0) == 0
    for value in range(min(1 << bits, 41)):
        assert m.occurrences(value).tolist() == np.flatnonzero(ids == value).tolist()
    with pytest.raises(ValueError):
        m.select(0, n)


def test_one_access_reads_a_piece_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 50_000, 200_000).astype("<u2")
    _, _, m = from_file(to_file(np.arange(1), np.array([len(ids)]), WaveletMatrix.build(ids, 16)))
    assert m.access(123_456) == ids[123_456]
    assert len(m.planes[0]) > 2 * wavelet.PIECE and all(len(p.read) <= 2 for p in m.planes)


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    out, start = [], 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_in_many_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    shards = write_shards(docs)
    assert sorted(map(tuple, read_documents(shards).collect())) == brute(rows)
    token = 262
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    expected = [(d, k) for d, x in rows for k, i in enumerate(t.encode(x, add_special_tokens=False).ids) if i == token]
    assert sorted(map(tuple, lookup(shards, token).collect())) == expected


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(None, "abc"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "word " * 9000), (5, "hello <|endoftext|> x<|endoftext|>"), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, start int, file string").repartition(3)
    got = sorted(map(tuple, read_documents(write_shards(docs)).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert read_documents(write_shards(docs.limit(0))).collect() == []
