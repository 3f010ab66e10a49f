"""WARC archives, token files, shards and packing."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from crawlmill.llm import packing, sharding, warc
from crawlmill.llm.bitplanes import FileWriter, pack_planes, read_file, read_tokens, token_index, unpack_planes, write_tokens
from crawlmill.llm.common import shared_path
from crawlmill.llm.encoding import byte_bpe_path, encoder
from crawlmill.llm.packing import Capacity, encode_pieces, pack_documents, vector_best_fit
from crawlmill.llm.sharding import minimax_cuts, shard_by_bytes

ODD = [None, "", " ", "a  b", "<|endoftext|> x", "é \n\n 中文 😀", "x" * 30_000, "the cat sat on the mat. " * 3000]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in pairs], "doc_id long, text string, shard string, size int, start int")


def test_warc(spark):
    big, other = "p" * 1500, "é" * 600
    data = [(1, "http://h/1", big), (2, "http://h/2", big), (7, None, big), (3, "http://h/3", "small"), (4, "http://h/4", "small"), (5, "u r\nl", None), (6, "http://h/6", other), (9, "http://h/9", other), (9, "http://h/9", other), (None, "http://h/n", big), (8, "x", "q" * 999)]
    df = spark.createDataFrame([(*r, "extra") for r in data], "page_id long, url string, html string, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.deduplicated_archives(df).collect())
    want = []
    for i, _, html in data:
        p = (html or "").encode()
        same = [j for j, _, h in data if h == html and j is not None] if len(p) >= 1000 else []
        refers = max(same) if same and i != max(same) else None
        want.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=lambda r: r[:2] + (r[2], r[3], r[4]))
    assert warc.deduplicated_archives(df.limit(0)).count() == 0


def test_archives_are_cut_by_bytes(spark):
    rng = random.Random(4)
    data = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=rng.choice([10, 5000, 60_000])))) for i in range(300)]
    path = shared_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), path, row_bytes=10_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    assert len(sizes) > 4 and max(sizes) < warc.ROWS_PER_FILE * 50_000
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: (len(h), "response") for i, _, h in data}


def test_warc_records_are_standard():
    import gzip

    data = warc.member(warc.record(1, "http://h/", b"<p>\r\n\r\nWARC/1.1\r\n", hashlib.sha1(b"<p>\r\n\r\nWARC/1.1\r\n").hexdigest(), None, None, False, "2026-01-01T00:00:00Z"))
    assert data[-1] == 0 and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert warc.parse(next(warc.records(data)))["payload_bytes"] == 17
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(data).replace(b"<p>", b"<q>"))


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1000, 50_257), (70_000, 1 << 32)])
def test_planes(bits, n, top):
    ids = np.random.default_rng(n).integers(0, top, n, np.uint64).astype("<u4")
    assert (unpack_planes(pack_planes(ids, bits)) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_file(bits):
    rng = np.random.default_rng(5)
    docs = [(None if i == 0 else i, rng.integers(0, 50_000, int(rng.integers(0, 900)), np.uint32).tobytes()) for i in range(60)]
    out, rows = FileWriter(bits, block=1000), []
    for d in docs:
        rows += out.add(*d)
    rows += out.close()
    got = list(read_file(b"".join(r + b"\n" for r in rows)))
    assert [(d, ids) for d, _, ids in got] == docs
    assert [s for _, s, _ in got] == [sum(len(x) // 4 for _, x in docs[:i]) for i in range(len(docs))]


@pytest.mark.parametrize("sizes", [[100] * 60, [5000], [1, 9000, 1], [40] * 10 + [5000] + [40] * 90])
def test_token_files_end_with_whole_documents(sizes):
    docs = [(i, (np.arange(n, dtype="<u4") * 7 + i).tobytes()) for i, n in enumerate(sizes)]
    out, rows, files = FileWriter(block=100, chunks=4), [], []
    for d in docs:
        rows += out.add(*d)
    rows += out.close()
    for i in range(0, len(rows), 5):  # as the writer's maxRecordsPerFile cuts them
        files.append(b"".join(r + b"\n" for r in rows[i : i + 5]))
    assert [(d, ids) for f in files for d, _, ids in read_file(f)] == docs
    assert len(files) > 1 or len(sizes) < 4


def test_files_of_a_hot_range(spark):
    pairs = [(7, f"a text of its own {i} " * 9) for i in range(40)] + [(i, "other words here") for i in range(8, 60)]
    path = shared_path(spark, "tokens")
    write_tokens(frame(spark, pairs), path, byte_bpe_path(), block=50, chunks=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_index(spark, path).collect())
    assert [r[1] for r in got] == sorted(i for i, _ in pairs)
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert spark.read.format("binaryFile").load(path).count() > 20


def test_segments_of_long_texts():
    from crawlmill.llm.encoding import segments

    text = "ab  cd\n ef " * 500 + "x" * 3000 + " y" * 40
    for size in (1, 7, 64):
        parts = segments(text, size)
        assert "".join(parts) == text and b"".join(encoder(byte_bpe_path()).encode(parts)) == library_ids(text).tobytes()


def library_ids(text, end=()):
    return np.array(encoder(byte_bpe_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + list(end), "<u4")


def test_encoder_equals_the_library():
    rng = random.Random(3)
    parts = [" ", "  ", "a", "B", "'s", "\n", "\t", " ", "\x1c", "é", "7", "!", "<|endoftext|>", "　", "\x85", "😀", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + [t or "" for t in ODD]
    assert encoder(byte_bpe_path()).encode(texts) == [library_ids(t).tobytes() for t in texts]


def test_token_files_in_order(spark):
    pairs = [(90 - i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (90, "again")]
    path = shared_path(spark, "tokens")
    write_tokens(frame(spark, pairs).repartition(4), path, byte_bpe_path())
    got = {}
    for r in token_index(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    ids = {i: [library_ids(t, [2]) for j, t in pairs if j == i] for i, _ in pairs}
    want = {i: sorted((len(x), zlib.crc32(x.tobytes())) for x in xs) for i, xs in ids.items()}
    assert {i: sorted(x[1:] for x in xs) for i, xs in got.items()} == want
    at = 0
    for i in sorted(got, key=lambda x: -1 if x is None else x):
        for start, n, _ in sorted(got[i]):
            assert start == at
            at += n
    assert sum(len(r.ids) for r in read_tokens(spark, path).collect()) == 4 * at
    empty = shared_path(spark, "tokens")
    write_tokens(frame(spark, []), empty, byte_bpe_path())
    assert token_index(spark, empty).count() == 0


def brute_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def test_minimax_cuts_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        sizes, shards = [rng.randint(1, 30) for _ in range(rng.randint(0, 12))], rng.randint(1, 6)
        capacity, cuts = minimax_cuts(sizes, shards)
        assert capacity == brute_capacity(sizes, shards) and len(cuts) == shards and cuts[-1] == len(sizes) and cuts == sorted(cuts)
        assert all(sum(sizes[a:b]) <= capacity for a, b in zip([0, *cuts], cuts))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 50)
    rng = random.Random(9)
    pairs = [(i, "hot " * 20) for i in range(300)] + [(i, "w" * rng.randint(0, 60) + str(i)) for i in range(300, 900)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "n"), (5, "dup"), (5, "dup")]
    got = shard_by_bytes(frame(spark, pairs)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    by_text, slots, sizes = {}, {}, {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    large = {30_016, 24 * 3000 + 16, 300 * 96}
    rest = [s for s in sizes.values() if s not in large]
    assert len(rest) == 37 and max(rest) - min(rest) <= 3 * 120
    assert shard_by_bytes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cap", [Capacity(100), Capacity(100, rule="dot"), Capacity(100, documents=3), Capacity(100, attention=10_000, documents=5, weights=(1, 0.5, 0.5)), Capacity(100, attention=10_000, rule="dot", weights=(0.2, 1, 1))])
def test_vector_best_fit(cap):
    lengths = np.random.default_rng(1).integers(1, 101, 500)
    seq, off = vector_best_fit(lengths, cap)
    for s in range(seq.max() + 1):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(off[own])]
        assert (off[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        assert lengths[own].sum() <= cap.tokens and len(own) <= cap.documents and (lengths[own] ** 2).sum() <= cap.attention
    with pytest.raises(ValueError):
        vector_best_fit(np.array([101]), cap)


def test_best_fit_takes_what_brute_force_takes():
    cap = Capacity(50, documents=4, attention=2000, weights=(1.0, 0.3, 0.3))
    lengths = np.random.default_rng(2).integers(1, 41, 200)
    bins, want = [], np.empty(200, int)
    w = np.array(cap.weights) / np.array([cap.tokens, cap.documents, cap.attention]) ** 2
    for at in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[at], 1, lengths[at] ** 2])
        fits = [(float((w * (b - need) ** 2).sum()), i) for i, b in enumerate(bins) if (b >= need).all()]
        if not fits:
            bins.append(np.array([cap.tokens, cap.documents, cap.attention]))
            fits = [(0.0, len(bins) - 1)]
        want[at] = min(fits)[1]
        bins[want[at]] = bins[want[at]] - need
    seq, _ = vector_best_fit(lengths, cap)
    assert seq.max() + 1 == len(bins)
    assert sorted(np.bincount(seq, lengths)) == sorted(np.bincount(want, lengths))


def test_weights_matter_and_cost_no_sequence():
    lengths = np.random.default_rng(6).choice([40, 90, 300, 700, 1025, 2048], 4000, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]) + np.random.default_rng(7).integers(-39, 1, 4000)
    both, tokens = vector_best_fit(lengths, Capacity())[0], vector_best_fit(lengths, Capacity(weights=(1.0, 0.0, 0.0)))[0]
    assert (both != tokens).any() and both.max() <= tokens.max()
    equal = np.array([1025] * 32_768 + [100] * 32_768)
    began = time.time()
    assert vector_best_fit(equal, Capacity())[0].max() + 1 == 32_768 and time.time() - began < 20


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 8)
    pairs = list(enumerate(ODD)) + [(None, "n"), (3, "again"), (3, "again")]
    got = pack_documents(frame(spark, pairs)).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    want = []
    for i, t in pairs:
        ids, start = library_ids(t, [0]), 0
        first = len(ids) % 2048 or 2048
        for p, n in enumerate([min(first, len(ids))] + [2048] * ((len(ids) - 1) // 2048 if first == len(ids) % 2048 and len(ids) > 2048 else max(0, len(ids) // 2048 - 1))):
            want.append((str(i), p, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
        assert start == len(ids)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert pack_documents(frame(spark, [])).count() == 0
    whole = encode_pieces(frame(spark, pairs[:6]), byte_bpe_path(), 16, None, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)
