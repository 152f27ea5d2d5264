import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, packing, segments, store
from strandline.llm.common import Scratch, lookup, portions

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def expected(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ordered(rows):
    return sorted(rows, key=repr)


def test_chunks_stitch_to_the_scan_of_the_whole_text():
    import random

    encoder = bpe.rank_encoder(RANKS, PATTERN)
    draw = random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice("ab 'sd  \n\t1é.!’ 　") * draw.choice([1, 1, 1, 2, 9]) for _ in range(draw.randint(0, 80)))
        size = draw.randint(6, 20)
        chunks = [(s, c, bpe.ends_of(encoder.pieces(c))) for s, c in bpe.chunked(text, size, draw.randint(1, size - 2))]
        whole, ends = bpe.stitched(encoder.scan, chunks)
        assert whole == text
        assert bpe.cut(whole, ends) == encoder.pieces(text)


def test_bpe_equals_the_library_and_round_trips(odd_documents):
    encoded = bpe.encode_documents(odd_documents, RANKS, PATTERN, chunk_chars=4096, overlap=256)
    found = [(r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.decode_documents(encoded, RANKS, PATTERN).collect()]
    own = bpe.rank_encoder(RANKS, PATTERN).merges
    assert isinstance(own, tiktoken.Encoding)
    assert ordered(found) == ordered([(i, own.encode_ordinary(t), t.encode()) for i, t in expected(odd_documents)])


def test_store_rebuilds_every_document(spark, odd_documents):
    path = Scratch(spark, "test-store").path("store")
    store.write_store(odd_documents, path, public_tokenizers.path("byte_bpe_50k.json"), 2, block_docs=3)
    encode = library("byte_bpe_50k.json")
    docs = sorted(((i is None, i, [*encode(t), 2]) for i, t in expected(odd_documents)), key=lambda d: (d[0], d[1] or 0))
    want, at = [], 0
    for _, i, ids in docs:
        want.append((i, at, ids))
        at += len(ids)
    assert ordered((r.doc_id, r.start, list(r.ids)) for r in store.read_ids(spark, path).collect()) == ordered(want)
    digests = store.read_digests(spark, path).collect()
    assert ordered((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digests) == ordered((i, s, len(ids), crc(ids)) for i, s, ids in want)
    chunks = store.read_chunks(spark, path).collect()
    assert len({bytes(c.digest) for c in chunks}) == len(chunks)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(m.n_tokens for m in manifest) == at and len(manifest) == 3


def rewritten(spark, path, table, change):
    """The store's table after ``change``, in place."""
    kind = spark.read.parquet(f"{path}/{table}").schema
    changed = change(spark.read.parquet(f"{path}/{table}")).select(kind.names).collect()
    by = ["kind"] if table == "written" else []
    spark.createDataFrame(changed, kind).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{table}")


@pytest.mark.parametrize("table, change", [
    ("written", lambda t: t.where("kind <> 'chunk' or n < 100")),  # chunks removed
    ("written", lambda t: t.withColumn("payload", F.when(F.col("n") > 100, F.expr("overlay(payload placing X'0707' from 11)")).otherwise(F.col("payload")))),
    ("recipes", lambda t: t.where("doc_id is null or doc_id <> 6")),  # a document removed
    ("recipes", lambda t: t.withColumn("digests", F.when(F.size("digests") > 2, F.reverse("digests")).otherwise(F.col("digests")))),
    ("recipes", lambda t: t.where("block <> 1")),
    ("manifest", lambda t: t.where("block <> 1")),
    ("manifest", lambda t: t.withColumn("root", F.sha2("root", 256).cast("binary"))),
])
def test_a_changed_store_is_an_error(spark, odd_documents, table, change):
    path = Scratch(spark, "test-store").path("store")
    root = store.write_store(odd_documents, path, public_tokenizers.path("byte_bpe_50k.json"), 2, block_docs=3)
    assert root == store.store_root(spark, path) and len(root) == 64
    rewritten(spark, path, table, change)
    for read in (store.read_digests, store.read_ids):
        with pytest.raises(Exception, match="digest|chunk|manifest|recipe|block"):
            read(spark, path, root).collect()


def test_another_stores_root_is_an_error(spark, odd_documents):
    path = Scratch(spark, "test-store").path("store")
    store.write_store(odd_documents, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    with pytest.raises(ValueError, match="root"):
        store.read_digests(spark, path, "00" * 32)


def test_special_tokens_in_a_text_are_the_librarys(spark):
    texts = ["hello <|endoftext|> x", "<|STARTOFTEXT|> a <|startoftext|>b<|endoftext|>", "<|endoftext|>", "plain  text\nwith <| marks |>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = Scratch(spark, "test-store").path("store")
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    found = {r.doc_id: list(r.ids) for r in store.read_ids(spark, path).collect()}
    assert found == {i: [*library("byte_bpe_50k.json")(t), 2] for i, t in enumerate(texts)}
    assert 50256 in found[0]
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1).collect()}
    assert packed == {i: crc([*library("word_bpe_49k.json")(t), 1]) for i, t in enumerate(texts)}


def test_hot_keys_are_looked_up_like_others(spark):
    many = spark.range(5000).selectExpr("if(id < 4000, -1L, id) as k", "id").unionByName(spark.sql("select cast(null as long) as k, -5L as id"))
    one = spark.range(4500).selectExpr("id as k", "id * 2 as v").unionByName(spark.sql("select -1L as k, 7L as v"))
    found = {r.id: r.v for r in lookup(many, one, "k").collect()}
    assert found == {i: 7 if 0 <= i < 4000 else 2 * i if 0 <= i < 4500 else None for i in range(-5, 5000) if i >= 0 or i == -5}
    assert lookup(many, one, "k", "inner").count() == 4500


def test_store_of_an_empty_table(spark, odd_documents):
    path = Scratch(spark, "test-store").path("store")
    store.write_store(odd_documents.limit(0), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert store.read_digests(spark, path).collect() == []


def test_chunk_ends_resynchronise_after_an_insertion():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000)
    digests = lambda x: {hashlib.sha1(x[i:j].tobytes()).digest() for i, j in zip([0, *store.chunk_ends(x)], store.chunk_ends(x))}
    assert len(digests(ids) & digests(np.insert(ids, 5_000, 7))) >= len(digests(ids)) - 3


def test_packing_holds_every_token_once(odd_documents):
    encode = library("word_bpe_49k.json")
    want = []
    for i, text in expected(odd_documents):
        ids = [*encode(text), 1]
        want += [(i, p, s, len(ids[s : s + 512]), crc(ids[s : s + 512])) for p, s in enumerate(range(0, len(ids), 512))]
    least = -(-sum(w[3] for w in want) // 512)
    for group_pieces in (16_384, 20, 3):
        found = packing.pack_documents(odd_documents, public_tokenizers.path("word_bpe_49k.json"), 1, capacity=512, group_pieces=group_pieces).collect()
        assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == ordered(want)
        bins = {}
        for r in found:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= 512
        assert len(bins) == least or group_pieces == 3
    assert packing.pack_documents(odd_documents.limit(0), public_tokenizers.path("word_bpe_49k.json"), 1).collect() == []


def fills(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_every_change_raises_the_squared_fill_and_bins_empty():
    search = packing.Search([6, 3, 7, 2, 5, 4, 3], [[0, 1], [2, 3], [4, 5], [6]], 10)
    before = search.squares()
    while search.step():
        assert search.squares() > before
        before = search.squares()
    assert len(search.bins()) == 3 and sum(search.accepted.values()) > 0


def test_an_exchange_of_each_kind():
    # Only a move, a one-for-one or a two-for-one exchange, in this order, brings the bins from three to two.
    for lengths, bins, kind in (
        ([6, 4, 3, 7], [[0], [1, 2], [3]], "move"),
        ([6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]], "exchange"),
    ):
        search = packing.Search(lengths, bins, 10)
        search.run()
        assert len(search.bins()) == 2 and search.accepted[kind] > 0
    lengths = [3, 3, 5, 4]
    search = packing.Search(lengths, [[0, 1], [2, 3]], 10)
    assert search._improve(0)  # 3 + 3 for 5 fills the other bin
    assert search.accepted["two for one"] == 1 and sorted(sum(lengths[i] for i in b) for b in search.bins()) == [5, 10]


def brute_best_change(lengths, bins, capacity):
    """The largest rise of the squared fill that a move or exchange from the emptiest bins gives."""
    import itertools

    fill, best = [sum(lengths[i] for i in b) for b in bins], 0
    for d, b in itertools.permutations(range(len(bins)), 2):
        if fill[d] >= capacity or fill[b] >= capacity or not bins[b]:
            continue
        for given in [(i,) for i in bins[d]] + list(itertools.combinations(bins[d], 2)):
            for taken in [()] + [(j,) for j in bins[b]]:
                gain = sum(lengths[i] for i in given) - sum(lengths[j] for j in taken)
                if len(given) == 2 and not taken:
                    continue
                if 0 < gain <= capacity - fill[b]:
                    best = max(best, (fill[b] + gain) ** 2 + (fill[d] - gain) ** 2 - fill[b] ** 2 - fill[d] ** 2)
    return best


def test_the_search_ends_where_no_change_helps():
    import random

    draw = random.Random(3)
    for _ in range(150):
        lengths = [draw.randint(1, 100) for _ in range(draw.randint(1, 40))]
        search = packing.Search(lengths, packing.arrival_fit(lengths, 100), 100)
        search.run()
        bins = search.bins()
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) == -(-sum(lengths) // 100) or brute_best_change(lengths, bins, 100) == 0


def test_the_search_reaches_the_bound_from_a_start_far_from_it():
    lengths = np.random.default_rng(4).integers(300, 2500, 2000).tolist()
    start, least = packing.arrival_fit(lengths, 4096), -(-sum(lengths) // 4096)
    search = packing.Search(lengths, start, 4096)
    search.run()
    assert len(start) >= least + 10 and len(search.bins()) <= least + 1
    assert len(search.bins()) <= len(packing.arrival_fit(sorted(lengths, reverse=True), 4096))
    assert all(search.accepted[kind] > 0 for kind in ("move", "exchange", "two for one"))


def column_ids(encoder, texts, end=b"\2\0"):
    data, begins = encoder.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)
    assert begins[0] == 0 and begins[-1] == len(data)
    return [np.frombuffer(data[i:j], encoder.kind).tolist() for i, j in zip(begins, begins[1:])]


def test_a_line_end_makes_no_new_stretch_of_two_known_words():
    encoder = segments.ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [a + b + mark for a in ("Stein", "größ", "when", "qu") for b in ("ar", "ton", "é", "xyl", "e") for mark in ("", ".")]
    texts = [f"of {a}\n{b} on" for a in words for b in words]
    encode = library("byte_bpe_50k.json")
    assert column_ids(encoder, texts) == [[*encode(t), 2] for t in texts]
    # Each once after a space and once after a line end, and three others; cut at spaces alone, it was one for each of 1,600 pairs.
    assert len(encoder.known) <= 2 * len(words) + 3


def test_ids_of_columns_are_the_librarys():
    import random

    encoder = segments.ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"), room=2_000)
    encode, draw = library("byte_bpe_50k.json"), random.Random(5)
    signs = [*"abÉß'st$!1.,_²ª中😀", "ll", "the", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "\x1c", "\u200b", "\u180e", "“"]
    spaces = [*"   \n\n\t\x0b\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000", "\r\n"]
    texts = ["", "\n", " ", "\n\nx", "a\n\n  b\n", "", " 's 'tis dogs' don't ''", "x" * 300 + " " + "y!" * 200, "é" * 100]
    texts += ["".join(draw.choice(signs if draw.random() < 0.6 else spaces) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    want = [[*encode(t), 2] for t in texts]
    assert column_ids(encoder, texts) == want
    column = pa.array(texts, pa.string())
    assert [ids for at in range(0, len(texts), 50) for ids in column_ids(encoder, column.slice(at, 50))] == want
    assert 100 < len(encoder.known) <= 2_000 and max(map(len, encoder.known)) <= segments.LONG
    assert column_ids(encoder, []) == [] and column_ids(encoder, ["", ""], b"") == [[], []]
    assert column_ids(encoder, ["a b", "c"], b"") == [encode("a b"), encode("c")]


def test_portions_hold_every_row_and_their_chunks_are_those_of_single_documents():
    draw = np.random.default_rng(4)
    texts = ["", "x" * 1100, *("é" * n for n in draw.integers(0, 90, 200).tolist()), "", "y" * 101]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.large_string())], names=["row", "text"])
    parts = list(portions(iter([batch.slice(0, 0), batch, batch.slice(2, 50)]), "text", 1000))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts + texts[2:52]
    assert [r for p in parts for r in p["row"].to_pylist()] == [*range(len(texts)), *range(2, 52)]
    assert len(parts) < 50 and all(p["text"].type == pa.string() and (p.num_rows == 1 or sum(len(t.encode()) for t in p["text"].to_pylist()) <= 1000) for p in parts)

    docs = [draw.integers(0, 50_000, n) for n in (1, 3000, 63, 65, 20_000, 15, 700, 9000)]
    begins = np.cumsum([0, *map(len, docs)])
    marks = store.chunk_marks(np.concatenate(docs))
    for doc, first, last in zip(docs, begins, begins[1:]):
        assert store.ends_at((marks[(marks > first) & (marks <= last)] - first).tolist(), len(doc)) == store.chunk_ends(doc)
