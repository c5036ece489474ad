"""Phrases against plain counting, with whole and with narrow fingerprints."""

import random
import re
from collections import Counter

import pytest

from barloom.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, share=50, top=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        found, longer = [], Counter()
        for p, a in own.items():
            if len(p) > 2 and a >= least:
                for size in range(2, len(p)):
                    for i in range(len(p) - size + 1):
                        longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        for p, a in own.items():
            if len(p) > 1 and a >= least and not (p in longer and 100 * longer[p] >= share * a):
                score, _, l, r = min((10 ** 6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, n long, phrase string, row string").repartition(3)
    return sorted(tuple(r) for r in c.collocations(docs, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    some = ["New", "york", "of", "the", "a", "Äb", "b-c", "日本", "x"]
    texts = [("".join(rnd.choice(some) + rnd.choice([" ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(rnd.randrange(90))),
              rnd.choice(["en", "fr", None, "und"])) for _ in range(80)]
    return texts + [(None, "en"), ("", None), ("new york " * 4000, "en"), (" .. ;", "de")] + [("copied text of some words", "en")] * 300


@pytest.mark.parametrize("slice_bytes", [1 << 18, 64])
def test_phrases_equal_plain_counting(spark, monkeypatch, rows, slice_bytes):
    monkeypatch.setattr(c, "SLICE", slice_bytes)
    for name in ("_POWERS", "_INVERSES"):
        monkeypatch.setattr(c, name, [p[:slice_bytes] for p in getattr(c, name)])
    assert mined(spark, rows) == plain(rows)


def test_full_counters_are_shipped_early(spark, monkeypatch, rows):
    monkeypatch.setattr(c, "HELD", 40)
    monkeypatch.setattr(c, "BLOCK_ROWS", 7)
    monkeypatch.setattr(c, "RANGE_BYTES", 100)
    assert mined(spark, rows, longest=4, least=4, share=80, top=25) == plain(rows, 4, 4, 80, 25)


@pytest.mark.parametrize("bits", [3, 9])
def test_colliding_fingerprints_are_told_apart_by_text(spark, rows, bits):
    assert mined(spark, rows, hash_bits=bits) == plain(rows)


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("one", "en")]) == []
