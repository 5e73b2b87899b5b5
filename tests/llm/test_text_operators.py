"""The byte, token and near-duplicate operators against brute force, on ordinary and odd inputs."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from flowpanel.llm import bpe, line_dedup, ngram_join, suffix_array, suffix_dedup, token_files
from flowpanel.llm.common import components
from flowpanel.llm.pretokens import pieces, word_pieces
from tokenizers import Tokenizer

# A clashing column for most helpers' names.
ODD = "doc_id bigint, text string, uid int, id string, h int, n int, k int, t string, z int, key int, root int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, 3, 4, "y", 5, 6, 7) for d, t in rows], ODD)


def word_text(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def near(rnd, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows, passage = [], word_text(rnd, 60)
    for g in range(12):
        base = word_text(rnd, rnd.randint(30, 200))
        for _ in range(rnd.randint(1, 6)):
            t = near(rnd, base, rnd.randint(0, 4))
            rows.append(t if rnd.random() < 0.7 else f"{t}\n{passage}\n{word_text(rnd, 20)}")
    rows += [None, "", " \t\n", "one", "One", "a b c d", "A b c d", "the end " * 400, "x" * 5000, rows[0], rows[0], "é ü\n" * 50, "Ünïcode 中文 text"]
    rows.append("\n".join(rows[:3]) + word_text(rnd, 30_000, 10_000))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_suffix_array_orders_all_suffixes():
    rnd = random.Random(3)
    for _ in range(150):
        letters = rnd.choice([b"a", b"ab", b"abc\x00\xff"])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 5))]
        depth = rnd.choice([1, 3, 7, 8, 14, 20])
        t, _ = suffix_array.codes(texts)
        order = suffix_array.suffix_array(t, depth)
        keys = [t[i : i + depth].tolist() for i in order]
        keys = [k[: k.index(0)] if 0 in k else k for k in keys]  # up to a separator
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)


def test_suffix_dedup(spark, corpus):
    for options in ({}, {"max_segments": 1}, {"length": 60, "k": 16}):
        length = options.get("length", 200)
        got = {r["doc_id"]: r for r in suffix_dedup.dedup(odd_docs(spark, corpus), **options).collect()}
        texts = [(t or "").encode() for _, t in corpus]
        for (d, _), t, mask in zip(corpus, texts, brute.removed_bytes(texts, length), strict=True):
            r = got[d]
            spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), sum(mask), spans), (d, options)
            assert bytes(r["kept"]) == bytes(b for b, m in zip(t, mask, strict=True) if not m)


def test_suffix_dedup_pieces_of_a_long_text(spark, monkeypatch):
    rnd = random.Random(8)
    part = bytes(rnd.choice(b"abcdefgh ") for _ in range(700)).decode()
    text = part + "".join(rnd.choice("abcdefgh ") for _ in range(3000)) + part + "q" * 900
    docs = spark.createDataFrame([(1, text), (1, part[50:400]), (None, "z")], "doc_id bigint, text string")
    want = [sum(m) for m in brute.removed_bytes([text.encode(), part[50:400].encode(), b"z"], 200)]
    for piece in (500, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        parts = [p for p, _ in suffix_dedup._pieces([1], [text.encode()], 200)]
        assert sum(len(p) for p in parts) == -(-len(text) // piece)
        found = []
        for p, buffer in suffix_dedup._pieces([1], [text.encode()], 200):
            arr = np.array(p, dtype=np.int64)
            data = np.frombuffer(buffer, dtype=np.uint8)
            place, part_no, lo, hi = suffix_dedup._anchors(data, arr, suffix_dedup.Hashes(data), 200, 40)
            shift = arr[part_no, 1] - arr[part_no, 2]
            found += zip((place + shift).tolist(), (lo + shift).tolist(), (hi + shift).tolist(), strict=True)
        first = sorted(found) if piece == 500 else first
        assert sorted(found) == first
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup(docs).collect()) == sorted(want)


def test_line_dedup(spark, corpus):
    docs = [(d, t) for d, t in corpus]
    gone = brute.line_keepers(docs)
    got = {r["doc_id"]: r for r in line_dedup.dedup(odd_docs(spark, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
        assert (got[d]["n_lines"], got[d]["n_removed"], got[d]["text"], got[d]["uid"]) == (len(lines), len(gone[d]), kept, 1), d


def test_line_dedup_links_chains_and_large_groups(spark):
    rnd = random.Random(2)
    line = word_text(rnd, 60)
    chain = [line]
    for _ in range(12):  # each similar to the one before, the ends far apart
        chain.append(near(rnd, chain[-1], 2))
    rows = [(i, x) for i, x in enumerate(chain)] + [(100 + i, near(rnd, line, 1)) for i in range(60)]
    rnd.shuffle(rows)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = brute.line_keepers(sorted(rows))
    assert got == {d: len(gone[d]) for d, _ in rows}


def test_line_recall_of_the_bands():
    rnd = random.Random(4)
    pairs = hits = 0
    for _ in range(300):
        a = word_text(rnd, 40)
        b = near(rnd, a, 1)
        sa, sb = ({x[i : i + 8] for i in range(len(x) - 7)} for x in (a, b))
        if 0.8 <= len(sa & sb) / len(sa | sb) < 0.95:
            keys = line_dedup.band_keys([a, b])
            pairs, hits = pairs + 1, hits + bool((keys[0] == keys[1]).any())
    assert pairs > 100 and hits >= 0.98 * pairs


def test_spark_hash_of_a_line_is_the_one_in_python(spark):
    import xxhash
    from pyspark.sql import functions as F

    lines = ["", "a", "abcdefgh", "é" * 20, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(F.xxhash64("l")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(x.encode(), line_dedup.HASH_SEED) for x in lines]


def test_token_files(spark, corpus, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    parts = token_files.write_tokens(odd_docs(spark, corpus), path, str(tmp_path / "tokens"), end_id=2, parts=5)
    got = sorted(token_files.read_tokens(parts, str(tmp_path / "tokens")).collect())
    start = 0
    assert len(got) == len(corpus)
    for (d, t), r in zip(sorted(corpus, key=lambda x: x[0]), got, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), d
        start += len(ids)


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (1, None)], "doc_id bigint, text string")
    parts = token_files.write_tokens(docs, path, str(tmp_path / "t"), end_id=2)
    got = token_files.read_tokens(parts, str(tmp_path / "t")).collect()
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in got) == [(-1, 0, 3), (1, 3, 1), (3, 4, 2), (3, 6, 2)]
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), path, str(tmp_path / "e"), 2), str(tmp_path / "e")).count() == 0


def test_token_files_take_added_tokens_as_a_plain_call_does(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(12)
    bits = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "\n\n", "\t", "x", "word's", "é中", "\x1c", "\xa0", "\u2028", "!", "1", "don't", " \n"]
    texts = ["x <|endoftext|> y"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for end in (2, 70_000):  # the second needs 32 bits
        folder = str(tmp_path / f"added-{end}")
        got = sorted(token_files.read_tokens(token_files.write_tokens(docs, path, folder, end, parts=3), folder).collect())
        start = 0
        for r, t in zip(got, texts, strict=True):
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, end]
            assert tuple(r)[1:] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), t
            start += len(ids)
    assert got[0]["n_tokens"] == 5


def test_token_files_split_one_id_that_holds_many_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"null {i}") for i in range(300)] + [(i, "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    for parts in (1, 8):
        folder = str(tmp_path / f"hot-{parts}")
        table = token_files.write_tokens(docs, path, folder, 2, parts=parts)
        found.append(sorted(map(str, token_files.read_tokens(table, folder).collect())))
        largest = table.agg({"n_docs": "max"}).first()[0]
    assert found[0] == found[1] and largest < 200


def test_pieces_join_to_the_text():
    rnd = random.Random(6)
    for _ in range(2000):
        t = "".join(rnd.choice("ab  \n\t.\x1c ") for _ in range(rnd.randint(0, 30)))
        assert "".join(pieces(t)) == t
        assert "".join(word_pieces(t)) == t


def test_matches_of_a_piece_are_those_of_the_pattern():
    rnd = random.Random(16)
    for _ in range(20_000):
        piece = "".join(rnd.choice(["a", "B", "é", "ß", "中", "ª", "²", "Ⅷ", "7", "'s", "'", ".", ",", "!", "-", "_", "\u0301", " "]) for _ in range(rnd.randint(1, 6)))
        assert token_files._matches(piece) == token_files._BYTE_LEVEL.findall(piece), piece


def test_bpe_equals_tiktoken():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.loaded(path, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rnd = random.Random(1)
    letters = [*"ab'st 1  \n\n\t.!é  \x1c\x1f\x85　ßK中́", "'re", "'ll", " the", "<|endoftext|>", "hello"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 20_000, "ab" * 9000, " " * 500, "the" * 5000, ""]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_bpe_rows(spark, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.loaded(path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.encode_rows(odd_docs(spark, corpus), path, public_tokenizers.PATTERN).collect()}
    for d, t in corpus:
        assert bytes(got[d]["decoded"]) == (t or "").encode() and got[d]["n_tokens"] * 4 == len(got[d]["ids"])
        assert bytes(got[d]["ids"]) == ours.encode([t or ""])[0]
    digests = {r["doc_id"]: r for r in bpe.encode_rows(odd_docs(spark, corpus), path, public_tokenizers.PATTERN, digests=True).collect()}
    assert all(digests[d]["ids_sha256"] == hashlib.sha256(bytes(got[d]["ids"])).hexdigest() for d, _ in corpus)


def test_ngram_join(spark, corpus):
    sets = [brute.shingles(t) for _, t in corpus]
    root = brute.components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(odd_docs(spark, corpus)).collect()}
    assert got == {d: (len(s), root[i]) for i, ((d, _), s) in enumerate(zip(corpus, sets, strict=True))}


def test_ngram_join_loses_no_link_between_members_far_from_the_leader(spark):
    rnd = random.Random(12)
    rows = []
    for g in range(6):
        base = word_text(rnd, 150, 5000)
        level = [base]
        for _ in range(25):  # a tree of edits: neighbours are similar, others are not
            level.append(near(rnd, rnd.choice(level), 2))
        rows += level
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    sets = [brute.shingles(t) for _, t in rows]
    root = brute.components(sets)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: root[d] for d, _ in rows}


def test_ngram_join_of_repeated_and_null_ids(spark):
    t = word_text(random.Random(1), 50)
    docs = spark.createDataFrame([(5, t), (5, "other words are here now"), (7, t), (None, t), (9, "other words are here now")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.join(docs).collect())
    assert got == [(-1, None), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    empty = odd_docs(spark, []).limit(0)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert suffix_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0
    assert bpe.encode_rows(empty, path, public_tokenizers.PATTERN).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(7, i) for i in range(100, 200)] + [(3, 3), (4, 5), (5, 4), (4, 5)]
    rnd.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "test").collect()}
    assert {got[i] for i in range(1000, 1061)} == {1000} and {got[i] for i in range(100, 200)} == {7}
    assert got[5] == 4 and 3 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "none").count() == 0
