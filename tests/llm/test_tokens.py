import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from duskwatch.llm import arrowids, packing, queries
from duskwatch.llm.bpe import WordCache
from duskwatch.llm.common import table

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path, spell=False):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = spell
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("spell", [False, True])
def test_cached_ids_are_the_librarys(path, spell):
    cache, want, dice = WordCache(path, most=300, spell=spell), plain(path, spell), random.Random(3)
    signs = [*"ab Zé\n.,'!9 \t\ŕΣJ̌　\x00\x1c\x85\xa0ß中—🙂", "  ", " \n", "\n\n", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " <|", " the", "The,", "don't"]
    for _ in range(3000):
        text = "".join(dice.choice(signs) for _ in range(dice.randint(0, 25)))
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == want(text), repr(text)


def test_lengths_are_powers_of_two():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        got = packing.lengths(n, 2048)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)


def check_pieces(rows, pieces):
    want = plain(WORDS)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    expected = {}
    for doc, text in rows:
        ids = [*want(text), 1]
        cuts, at = [], 0
        for size in packing.lengths(len(ids), 2048):
            cuts.append((at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), 0))
            at += size
        expected.setdefault(doc, []).extend(cuts)
    got = {d: sorted((p["start"], p["length"], zlib.crc32(p["ids"]), p["doc_tokens"], p["offset"]) for p in ps) for d, ps in by_doc.items()}
    assert got == {d: sorted(c) for d, c in expected.items()}


def test_packing_edges(spark, edges, edge_rows, nothing, tmp_path):
    pieces = packing.pack(edges, WORDS)
    check_pieces([r[:2] for r in edge_rows], [r.asDict() for r in pieces.collect()])
    assert packing.pack(nothing, WORDS).count() == 0
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    assert {p.name for p in (tmp_path / "buckets").glob("length=*")} == {f"length={r['length']}" for r in pieces.select("length").distinct().collect()}
    with pytest.raises(ValueError):
        packing.pack(edges, WORDS, longest=1000)


def test_op2_query(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    full = packing.pack(table(spark, small, "documents"), WORDS).collect()
    check_pieces(docs, [r.asDict() for r in full])
    got = {tuple(r) for r in queries.op2_packing(spark, small).collect()}
    assert got == {(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in full}


def test_sequences_come_from_buckets(spark, small, nothing):
    for frame in (queries.op2_packing(spark, small), corpus_pipeline.packed(spark, table(spark, small, "documents"), small)):
        files = frame.inputFiles()
        assert files and all(re.search(r"/length=\d+/", f) for f in files)
        for r in frame.select("length", "_metadata.file_path").distinct().collect():
            assert f"/length={r['length']}/" in r["file_path"]
    assert packing.bucketed(packing.pack(nothing, WORDS)).count() == 0


def hash_of(text):
    code = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return code - (1 << 64) if code >> 63 else code


def check_documents(rows, got):
    want, at, expected = plain(BYTES), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1] or ""))):
        ids = [*want(text), 0]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected


def test_arrow_edges(spark, edges, edge_rows, nothing):
    found = arrowids.documents_in_files(edges, BYTES, length=16, rows=4)
    check_documents([r[:2] for r in edge_rows], [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found.collect()])
    assert arrowids.documents_in_files(nothing, BYTES).count() == 0


def test_arrow_files_random_access(spark, edges, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files = arrowids.write_sequences(edges, BYTES, folder, length=8, rows=4).orderBy("part").collect()
    stream = []
    for f in files:
        sequences = arrowids.Sequences(folder, f["ids_file"])
        assert f["start"] == len(stream) and sequences.tokens() == f["tokens"]
        whole = sequences.ids(0, f["tokens"])
        for row in (0, f["tokens"] // 8 // 2, (f["tokens"] - 1) // 8):
            ids, mask = sequences.row(row)
            assert len(ids) == len(mask) == 8 and ids[mask].tolist() == whole[8 * row : 8 * row + 8].tolist()
        with pytest.raises(ValueError):
            sequences.ids(0, f["tokens"] + 10_000)
        stream += whole.tolist()
    assert sum(f["documents"] for f in files) == edges.count()


def test_op5_query(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    check_documents(docs, [tuple(r) for r in queries.op5_arrow_ids(spark, small).collect()])
