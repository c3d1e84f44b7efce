"""Encoding, chunk reuse, packing and Simple-8b shards against the tokenizers library and exact round trips."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelframe.llm import chunk_bpe, packing, simple8b
from pixelframe.llm.tokenizing import WordEncoder, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def ids(library, rows):
    return [(r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids, dtype="<u4")) for r in rows]


TEXT = st.text(alphabet=st.sampled_from("abcéßÅ İΣς'.,!?-_#|<>/ \n\t ́̉0159日ﬁ") | st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_word_encoder_is_the_library(library, texts):
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    raws = [t.encode() for t in texts]
    assert WordEncoder(default_path(), memo_words=4).encode(raws) == expected
    assert chunk_bpe.ChunkEncoder(WordEncoder(default_path()), memo_chunks=3).encode([r * 3 for r in raws]) == WordEncoder(default_path()).encode([r * 3 for r in raws])


def test_chunks_are_content_defined():
    text = " ".join(f"w{k * k % 977}" for k in range(4000)).encode() + "é".encode() * 700
    cuts = chunk_bpe.cut_points(text)
    assert cuts[-1] == len(text) and cuts == sorted(set(cuts))
    for cut in cuts:
        text[:cut].decode()
    moved = chunk_bpe.cut_points(b"12345678 " + text)
    assert len({c - 9 for c in moved} & set(cuts)) > 0.8 * len(cuts)
    coder = chunk_bpe.ChunkEncoder(WordEncoder(default_path()))
    rng = np.random.default_rng(0)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)).encode()
    coder.encode([long])
    first = coder.encoded
    coder.encode([b"other start " + long])
    assert first > 50 and coder.encoded - first < 0.1 * first  # all but the edges are reused


class Late(WordEncoder):
    """Its library's windows inside a text are wrong up to a length, as if tokens reached across them."""

    def library_batch(self, texts):
        return [(b"\7\0\0\0" if len(t) < 60 and not any(x.startswith(t) for x in self.texts) else b"") + i for t, i in zip(texts, super().library_batch(texts))]


def test_joins_grow_until_both_sides_agree():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) for _ in range(900)).encode() for _ in range(4)]
    plain, late = WordEncoder(default_path()), chunk_bpe.ChunkEncoder(Late(default_path()))
    late.words.texts = texts
    assert late.encode(texts) == plain.library_batch(texts) and late.grown > 20
    straight = chunk_bpe.ChunkEncoder(plain)
    assert straight.encode(texts) == plain.library_batch(texts) and straight.grown == 0


@pytest.mark.parametrize("unit", ["x", "日本語テキスト", "é1", "ab12 "])
def test_very_long_texts_take_linear_time(unit):
    coder, took = chunk_bpe.ChunkEncoder(WordEncoder(default_path())), []
    for size in (250_000, 1_000_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        found = coder.encode([text.encode()])
        took.append(time.perf_counter() - began)
    assert found == coder.words.library_batch([text.encode()])
    assert took[1] < 12 * took[0] + 1


def test_other_tokenizers_give_the_library_s_ids(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    expected = {i: np.array(other.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for i, t, *_ in rows if i is not None and i != 300}
    assert not WordEncoder(path).by_word
    chosen = docs.where("doc_id IS NOT NULL AND doc_id <> 300")
    for row in chunk_bpe.encode_and_decode(chosen, path).collect():
        assert row["ids"] == expected[row["doc_id"]].tobytes() and row["decoded"] == other.decode(expected[row["doc_id"]].tolist(), skip_special_tokens=False)
    for row in simple8b.round_trip(chosen, path).collect():
        assert row["ids"] == np.append(expected[row["doc_id"]], 2).astype("<u4").tobytes()


def test_op6_equals_library(docs, ids, library):
    found = Counter(tuple(r) for r in chunk_bpe.digest(chunk_bpe.encode_and_decode(docs)).collect())
    expected = Counter((i, len(v), hashlib.sha256(v.tobytes()).hexdigest(), hashlib.sha256(library.decode(v.tolist(), skip_special_tokens=False).encode()).hexdigest()) for i, v in ids)
    assert found == expected


def test_piece_lengths():
    assert packing.piece_lengths(2 * 4096 + 1 + 8) == [4096, 4096, 8, 1]
    assert packing.piece_lengths(0) == []
    for n in range(1, 300):
        assert sum(packing.piece_lengths(n, 64)) == n


def test_buckets_hold_equal_lengths(spark, docs, tmp_path):
    pieces = packing.pack(docs)
    back = packing.write_buckets(pieces, f"file://{tmp_path}/buckets")
    assert back.where("length <> shiftleft(1, bucket)").count() == 0
    assert sorted(p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()) == sorted(f"bucket={r['bucket']}" for r in pieces.select("bucket").distinct().collect())
    assert back.groupBy().sum("length").first()[0] == pieces.groupBy().sum("length").first()[0]


def test_op4_holds_every_id_once(docs, ids):
    pieces = packing.digest(packing.pack(docs)).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    assert all(p["offset"] == 0 and p["length"] & (p["length"] - 1) == 0 and p["length"] <= 4096 and p["bucket"] == p["length"].bit_length() - 1 for p in pieces)
    found = Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)
    expected = Counter()
    for i, v in ids:
        whole, at = np.append(v, 2).astype("<u4"), 0
        for n in packing.piece_lengths(len(whole)):
            expected[i, at, n, zlib.crc32(whole[at : at + n].tobytes()), len(whole)] += 1
            at += n
    assert found == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.just(0), max_size=400))
def test_simple8b_round_trip(values):
    array = np.array(values, dtype=np.uint64)
    words, escapes = simple8b.encode_block(array)
    assert np.array_equal(simple8b.decode_words(words, escapes), array)
    assert escapes == sum(v >= 1 << 60 for v in values)


@pytest.mark.parametrize(("count", "width"), simple8b.SELECTORS)
def test_simple8b_packs_full_words(count, width):
    array = np.full(count * 5, (1 << width) - 1, dtype=np.uint64)
    words, _ = simple8b.encode_block(array)
    assert len(words) == 5 and np.array_equal(simple8b.decode_words(words), array)


def test_shards_with_escapes_and_blocks():
    values = np.arange(50_000, dtype=np.uint64) * np.uint64(7919)
    values[::9973] = np.uint64(2**63 + 5)
    blob = simple8b.pack_shard([None, 4], [49_000, 1_000], values)
    doc_ids, lengths, back = simple8b.unpack_shard(blob)
    assert doc_ids == [None, 4] and lengths == [49_000, 1_000] and np.array_equal(back, values)
    with pytest.raises(ValueError, match="shard"):
        simple8b.unpack_shard(b"XXXX" + blob[4:])


@pytest.mark.parametrize("stretches", [None, 37])
def test_op5_reads_back_in_order(spark, docs, ids, rows, stretches):
    if stretches:  # many small stretches of ids, of which a task gets several
        spark.conf.set("spark.sql.shuffle.partitions", stretches)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_order(docs, ids, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(docs, ids, rows):
    found = simple8b.digest(simple8b.round_trip(docs)).orderBy("start").collect()
    order = sorted(zip(ids, rows), key=lambda x: (x[0][0] is not None, x[0][0] or 0, (x[1][1] or "").encode()))
    start = 0
    assert len(found) == len(rows)
    for row, ((i, v), _) in zip(found, order):
        whole = np.append(v, 2).astype("<u4")
        assert tuple(row) == (i, start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_empty_tables(empty):
    for frame in (packing.digest(packing.pack(empty)), simple8b.digest(simple8b.round_trip(empty)), chunk_bpe.digest(chunk_bpe.encode_and_decode(empty))):
        assert frame.count() == 0


def test_odd_sequence_length(docs):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, seq_len=1000)


def test_rows_without_ids_are_spread(spark):
    """Many rows of one id share no task, and come in the order of their texts."""
    texts = [f"text number {i * 7919 % 1000:03d} of many" for i in range(1000)]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = simple8b.round_trip(frame).orderBy("start").collect()
        shards = simple8b.Workspace(spark, "t").new_path("s")
        simple8b.write_corpus(frame, shards)
        assert spark.read.parquet(shards).select("part").distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    coder = WordEncoder(default_path())
    expected = [coder.encode([t.encode()])[0] + b"\2\0\0\0" for t in sorted(texts)]
    assert [bytes(r["ids"]) for r in found] == expected
