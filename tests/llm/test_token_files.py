"""Token files: pieces, grammar, random access and read-back against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import token_files as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
SAVED = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SAVED)
ODD = ["", " ", "  a  b \n c", " lead", "trail ", "a　b", "it's don't", "<|endoftext|> x<|endoftext|>", "1a2b " * 10,
       "\t\t a", "a᠎ b", "é à", "\n\nA.\n\nB\n C\nD", "a..b, c!?\n", "x\r\ny", "日本 語。\n ", "\x1c a\x85b"]


def reference(text):
    return np.append(LIBRARY.encode(text or "", add_special_tokens=False).ids, t.END).astype("<u4")


@pytest.mark.parametrize("part", [7, 64, 1 << 20])
def test_pieces_give_the_library_s_ids(monkeypatch, part):
    monkeypatch.setattr(t, "PART", part)
    monkeypatch.setattr(t, "PIECES", 300)  # forgets on the way
    rnd, encoder = random.Random(part), t.Encoder(SAVED)
    for _ in range(30):
        texts = [rnd.choice(ODD) + "".join(rnd.choice("ab 1.,\n\té à日　'!x") for _ in range(rnd.randrange(60))) for _ in range(20)]
        found = list(encoder.slices(x.encode() for x in texts))
        assert np.concatenate([ids for ids, _ in found]).tolist() == np.concatenate([reference(x) for x in texts]).tolist()
        assert sum(len(ends) for _, ends in found) == len(texts)


def test_grammar_expands_to_its_ids_and_never_joins_documents():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (5000, 1), (20_000, 12), (20_000, 3000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        last = rng.random(n) < 0.01
        symbols, rules = t.grammar(ids, last, 50_257)
        block = t.pack(ids, last, 50_257)
        assert (t.unpack(block) == ids).all()
        for _ in range(20):
            start, count = rng.integers(0, n), rng.integers(0, 700)
            assert (t.unpack(block, int(start), int(count)) == ids[start:start + count]).all()
        size = t._lengths(rules, 50_257)
        ends = np.cumsum(np.where(symbols >= 50_257, size[np.maximum(symbols - 50_257, 0)] if len(size) else 1, 1))
        assert set(np.flatnonzero(last) + 1) <= set(ends.tolist())  # each document ends with a symbol
        if kinds <= 12 and n > 1000:
            assert len(block) < 1.5 * n


def test_a_wide_vocabulary_takes_four_bytes():
    ids = np.arange(1000, dtype=np.uint32) % 50 + 100_000
    block = t.pack(ids, np.zeros(1000, bool), 200_000)
    assert (t.unpack(block) == ids).all()


def test_files_read_back_in_order(spark, monkeypatch):
    for name, value in (("BLOCK", 500), ("FILE", 900), ("PART", 300)):
        monkeypatch.setattr(t, name, value)
    rows = [(k * 3, ODD[k % len(ODD)] + " word" * (k % 40), "x") for k in range(60)]
    rows += [(7, "same"), (7, "same"), (7, "other"), (None, "no id"), (500, None), (501, "long, " * 3000)]
    docs = spark.createDataFrame([(*r, "x")[:3] for r in rows], "doc_id long, text string, start string")
    manifest = t.write(docs.repartition(5), PATH)
    got = t.read_documents(manifest).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    wanted = sorted((r[0] is not None, r[0] or 0, len(reference(r[1])), zlib.crc32(reference(r[1]).tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == wanted
    files = manifest.orderBy("start").collect()
    assert len(files) > 1 and sum(f.ids for f in files) == total and sum(f.docs for f in files) == len(rows)
    # random access across blocks
    for f in files:
        reader = t.Reader(f.path)
        whole = np.concatenate([x for _, _, parts in reader.documents() for x in parts])
        assert len(whole) == f.ids
        for start in range(0, f.ids, 97):
            assert (reader.read(start, 333) == whole[start:start + 333]).all()
        reader.close()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert t.read_documents(t.write(empty, PATH)).count() == 0


def test_registered_query_holds_every_document(spark):
    from barloom.llm import queries
    from conftest import SF
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    start = 0
    for r in sorted(queries.op11_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = reference(docs.pop(r.doc_id))
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not docs
