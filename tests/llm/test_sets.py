"""Operators over many documents at once, and files, against brute force and exact round trips."""

import hashlib
import io
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty_like, odd_documents, prose  # noqa: E402

from wickerwork.llm import near_dup, packing, range_coder, token_output, tokens, warc  # noqa: E402
from wickerwork.session import scratch_path  # noqa: E402


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    def load(name):
        return Tokenizer.from_file(tokens.tokenizer_path(name))
    return load


# tokens

@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_pieces_give_the_tokenizers_ids(tokenizer, name, spaces):
    rng = random.Random(4)
    alphabet = ["a", "Zz", "é", "é", "ß", "İ", "Σ", "ª", "1", "23", ".", ",", "'", "'ll", " ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1d", "<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>", "😀", "中", "-", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)] + ["", None, "I'll we've it's", "word, word. Word!"]
    whole = tokenizer(name)
    for _ in range(2):  # the second time from the cache
        got = tokens.CachedEncoder(tokens.tokenizer_path(name), spaces, most=50).encode([t if t is None else t.encode() for t in texts])
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


# packing

def check_packing(rows, docs, whole, end, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, tokenizer):
    docs = {i: prose(i, int(n)) for i, n in enumerate(np.random.default_rng(1).integers(1, 3000, 150))} | {1000: None, 1001: "", 1002: prose(5, 20_000)}
    rows = packing.packed_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    used = check_packing(rows, docs, tokenizer(packing.TOKENIZER), 2, 4096)
    assert sum(r.length for r in rows) > 0.97 * 4096 * used


def test_literal_special_tokens(tokenizer):
    name = "byte_bpe_50k.json"
    whole = tokenizer(name)
    plain = tokens.CachedEncoder(tokens.tokenizer_path(name), True).encode([b"a <|endoftext|> b"])[0]
    literal = tokens.CachedEncoder(tokens.tokenizer_path(name), True, literal=True).encode([b"a <|endoftext|> b"])[0]
    assert 50256 in np.frombuffer(plain, "<u4") and np.frombuffer(plain, "<u4").tolist() == whole.encode("a <|endoftext|> b", add_special_tokens=False).ids
    whole.encode_special_tokens = True
    assert np.frombuffer(literal, "<u4").tolist() == whole.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_packing_keeps_ids_beyond_doubles(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    rows = packing.packed_documents(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 2**60 + 1, 2**60 + 3]


def test_packing_of_odd_tables(spark):
    docs = odd_documents(spark)
    rows = packing.packed_documents(docs).collect()
    assert len([r for r in rows if r.doc_id == 7]) == 2 and [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.packed_documents(empty_like(docs)).count() == 0


def test_differencing():
    place = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(place, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]  # what the method gives; the best is 15, 15
    place = packing.difference(np.array([5, 5, 5, 5, 5, 5]), 3)
    assert np.bincount(place).tolist() == [2, 2, 2]
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        lengths = np.sort(rng.integers(1, 400, n))[::-1]
        place = packing.pack_lengths(lengths, 1000)
        assert np.bincount(place, weights=lengths).max() <= 1000 and place.min() >= 0
    assert packing.pack_lengths(np.array([600, 600, 600]), 1000).tolist() in ([0, 1, 2], [2, 1, 0], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1])


# range coder and token files

@pytest.mark.parametrize("n", [1, 2, 127, 128, 1000, 70_000])
@pytest.mark.parametrize("most", [1, 2, 300, 60_000])
def test_blocks_round_trip(n, most):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), most).astype("<u4") - 1
    block = range_coder.encode_block(ids)
    size = range_coder.HEADER.size
    assert (range_coder.decode_block(block[:size], block[size:]) == ids).all()
    for damaged in (block[:-1] + bytes([block[-1] ^ 1]), block[:-1]):
        with pytest.raises(ValueError):
            range_coder.decode_block(damaged[:size], damaged[size:])


def test_coder_uses_its_contexts():
    cycle = np.tile(np.random.default_rng(0).integers(0, 50_000, 500), 200).astype("<u4")
    assert len(range_coder.encode_block(cycle)) < 0.2 * 2 * len(cycle)


def test_shards_cross_blocks():
    rng = np.random.default_rng(3)
    docs = [(i if i != 5 else None, rng.integers(0, 900, int(n)).astype("<u4").tobytes()) for i, n in enumerate(rng.integers(1, 700, 40))]
    out = io.BytesIO()
    writer = token_output.ShardWriter(out, block_tokens=1000)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    assert writer.close() == (40, sum(len(x) // 4 for _, x in docs))
    reader = token_output.ShardReader(pa.BufferReader(out.getvalue()))
    place = 0
    for (doc_id, ids), got in zip(docs, reader.documents(), strict=True):
        assert got == (doc_id, place, len(ids) // 4, zlib.crc32(ids))
        place += len(ids) // 4
    all_ids = b"".join(x for _, x in docs)
    assert reader.block(2).tobytes() == all_ids[8000:12000]  # without the blocks before it


def test_token_files(spark, tokenizer):
    docs = {i * 3: prose(i, 1 + i * 5) for i in range(60)} | {1000: None, 1001: ""}
    rows = token_output.token_files(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), shard_bytes=4000).collect()
    whole, start = tokenizer(token_output.TOKENIZER), 0
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(docs)
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.array([*whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = odd_documents(spark)
    assert token_output.token_files(odd).count() == 10 and token_output.token_files(empty_like(odd)).count() == 0


# near duplicates

def brute_components(docs, n, percent):
    sets = {}
    for i, text in docs.items():
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(n)
    docs, i = {}, 0
    for family in range(40):
        body = prose(family, rng.randrange(60, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(body)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
            docs[i] = " ".join(copy)
            i += 1
    body = prose("dense", 150).split()
    for k in range(150):  # a dense family: each differs from its centre by a few words, so not all are alike
        copy = list(body)
        for _ in range(k % 7):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        docs[1000 + k] = " ".join(copy)
    docs |= {3000: None, 3001: "", 3002: " \n", 3003: "one", 3004: "ONE", 3005: "one two", 3006: docs[1000]}
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), n, percent).collect()
    want = brute_components(docs, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_within_a_family_below_the_threshold(spark):
    body = prose("template", 150)
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    docs, want = {}, {}
    for i in range(3000):  # 146 common shingles of 168 to 170: any two are 0.75 to 0.77 alike
        docs[i] = f"{body} {own(i, 22 + i % 3)}"
        want[i] = i
    for i in range(0, 300, 2):  # (146 + 5) / (146 + 44 - 5): 0.816
        docs[i], docs[i + 1] = f"{body} {own(i, 5)} {own(f'a{i}', 17)}", f"{body} {own(i, 5)} {own(f'b{i}', 17)}"
        want[i + 1] = i
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = [*zip(order, order[1:]), (900, 901), (901, 900), (950, 950)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "node long, other long")).collect()}
    assert got == {i: 0 for i in range(300)} | {900: 900, 901: 900}


def test_near_duplicates_of_odd_tables(spark):
    docs = odd_documents(spark)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 7, 8]  # 4 repeats 3; rows of one id are one document
    assert near_dup.near_duplicates(empty_like(docs)).count() == 0


# archives

def test_archives(spark):
    big = "<p>" + prose(1, 50)
    pages = {1: big, 2: big, 3: None, 4: "", 5: "small", 6: "small", 7: "é" * 50, 8: "é" * 50, 9: "é" * 49 + "x", 10: "\r\n\r\nWARC/1.1\r\n" * 20, 11: prose(2, 200_000)}
    rows = [(i, None if i == 4 else f"http://h/{i}\r\nX: y", html, "x") for i, html in pages.items()]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = {r.page_id: r for r in warc.archived_pages(table).collect()}
    assert len(got) == len(pages)
    first = {}
    for i, html in pages.items():
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        refers = first.get(digest) if len(payload) >= 100 else None
        first.setdefault(digest, i)
        assert tuple(got[i]) == (i, len(payload), digest, "revisit" if refers else "response", refers)
    assert warc.archived_pages(empty_like(table)).count() == 0
    repeated = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", big), (2, "u", big)], "page_id long, url string, html string")
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived_pages(repeated).collect())
    assert kinds == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 1)]


def test_archives_are_bounded(spark):
    table = spark.createDataFrame([(i, "u", prose(i, 400)) for i in range(60)] + [(100, "u", prose(7, 30_000))], "page_id long, url string, html string").coalesce(2)
    folder = scratch_path(spark, "bounded")
    archives = warc.write_archives(warc.with_revisits(table), folder, archive_bytes=20_000)
    sizes = [sum(len(x) for x in warc.inflate(pa.BufferReader(Path(r.archive.removeprefix("file:")).read_bytes()))) for r in archives.collect()]
    assert len(sizes) > 8 and sorted(sizes)[-2] < 40_000 and max(sizes) > 150_000  # the long page ends its archive
    assert warc.read_records(warc.normalise_archives(archives, scratch_path(spark, "bounded-members"))).count() == 61


def test_normaliser_reads_whole_streams_and_members():
    made = [warc.build_record(i, "http://h/", "response", prose(i, 300).encode(), "0", None) for i in range(5)]
    engine = zlib.compressobj(wbits=31)
    whole = engine.compress(b"".join(made[:3])) + engine.flush()
    for record in made[3:]:
        engine = zlib.compressobj(wbits=31)
        whole += engine.compress(record) + engine.flush()
    out = io.BytesIO()
    index = warc.normalise(pa.BufferReader(whole), out)
    assert [zlib.decompress(out.getvalue()[a:a + n], 31) for _, _, a, n in index] == made
    assert b"".join(x for x in warc.inflate(pa.BufferReader(whole), chunk=7)) == b"".join(made)
    with pytest.raises(ValueError):
        warc.normalise(pa.BufferReader(whole[:-20]), io.BytesIO())
