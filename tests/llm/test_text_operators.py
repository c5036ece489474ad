"""Operators on texts against brute force, round trips and held-out accuracy."""

import hashlib
import html
import re
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, decontaminate, html_text, language, license_scan, near_dup, quality, queries
from barloom.llm.automaton import build, matching_statistics
from barloom.llm.words import word_list

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs_frame(spark, rows, extra="overlap string, score string, language string, host string"):
    data = [(i, t, "en", "src1", *["x"] * 4) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {extra}")


def test_words_equal_the_pattern():
    for text in ("Ab-9 Éa_x ÿ\x80z\t<b>", "", "ABC", "ſK İ"):
        assert [w.decode() for w in word_list(text.encode())] == words(text)


def test_automaton_lengths_equal_brute_force():
    sequences = [list("abcabd"), list("bcab"), list("xx"), []]
    moves, link, longest = build(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = list("abcabcabdxxxbcabqdab")
    got = [n for _, n in matching_statistics(text, moves, link, longest)]
    want = [max([n for n in range(i + 2) if tuple(text[i + 1 - n:i + 1]) in runs], default=0) for i in range(len(text))]
    assert got == want


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item here"), (3, ""),
         (4, None), (5, "item here"), (10, "Nine ten eleven twelve one two three four five six seven"), (None, "null id item")]
TEXTS = [
    (0, "x One two three four five six seven eight nine ten y"), (1, None), (2, ""), (3, "one two three four five six seven eight nine"),
    (4, "a short, ITEM here b short item"), (5, "one two three four five six seven eight nine ten eleven twelve one two"),
    (6, " ".join(["word"] * 60_000) + " item here"), (6, " ".join(["word"] * 60_000) + " item here"),
    (7, "eight nine ten eleven twelve one two three four five six seven item"), (None, "short item here"),
]


def windows():
    out = {}
    for name, text in ITEMS:
        w = words(text)
        if name is not None and w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                out.setdefault(tuple(w[i:i + n]), set()).add(str(name))
    return out


@pytest.mark.parametrize("pack_words", [200_000, 4])
def test_overlaps_equal_brute_force(spark, pack_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_overlaps(docs_frame(spark, TEXTS), items, pack_words=pack_words, into="found")
    got = sorted(map(repr, (tuple(r) for r in found.select("doc_id", *decontaminate.overlap_digest("found")).collect())))
    want = []
    for doc_id, text in TEXTS:
        w, hit, names = words(text), set(), set()
        for window, who in windows().items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names |= who
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append(repr((doc_id, len(w), len(hit), len(names), digest, bool(hit))))
    assert got == sorted(want)


@pytest.mark.parametrize("pack_words", [200_000, 4])
def test_decontaminated_texts_hold_no_window(spark, pack_words):
    docs = docs_frame(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rest = decontaminate.decontaminate(docs, items, pack_words=pack_words, max_coverage=0.95)
    assert rest.columns == docs.columns
    for doc_id, text in [(r.doc_id, r.text) for r in rest.collect()]:
        w = words(text)
        assert not any(tuple(w[i:i + len(k)]) == k for k in windows() for i in range(len(w) - len(k) + 1))
        if doc_id in (1, 2, 3):
            assert text == dict(TEXTS)[doc_id]
    assert rest.filter("doc_id is null").isEmpty()  # wholly a test item
    none = decontaminate.decontaminate(docs, items.filter("false"))
    assert none.count() == len(TEXTS)


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit"]
    cut = mit.replace("without limitation the rights to use", "and so on")
    rows = [(0, None), (1, ""), (2, f"Copyright me. {mit} end"), (3, cut), (4, "MIT License or the\nMIT license; GNU General Public  License"),
            (5, "the apache and the license"), (6, "filler " * 50_000 + "Apache License"), (6, "filler " * 50_000 + "Apache License"),
            (7, "mit mit license license")]
    out = license_scan.scan_licenses(docs_frame(spark, rows))
    got = out.select("doc_id", *license_scan.license_digest("licenses")).collect()
    for r in got:
        w = words(dict(rows)[r.doc_id])
        places = [(i, label) for phrase, label in license_scan.PHRASES.items()
                  for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((i for i, _ in places), default=None)
        assert r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].labels == "mit" and by_id[2].score == 1.0
    assert by_id[3].labels == "mit" and 0.7 < by_id[3].score < 1.0
    assert by_id[0].score == by_id[5].score == 0.0 and by_id[0].labels == ""


def test_quality_held_out(spark):
    """Clean prose against the same words in shouted, piped or repeated form."""
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    rows, labels = [], []
    for i, text in enumerate(base):
        bad = i % 3 == 0
        w = text.split()[:200]
        rows.append((i, " | ".join(w) if bad and i % 2 else " ".join(f"{x}!!".upper() for x in w) if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1, None))
    docs = docs_frame(spark, [*rows, (1000, None), (1001, ""), (1002, None)])
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, known, use=~queries.held_out("doc_id"))
    got = {r.doc_id: r.s for r in quality.score(docs, model, into="s").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 3 != 0) for i in held) / len(held) > 0.9
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    blank = quality.train(docs, known.filter("false"))
    assert quality.score(docs, blank, into="s").filter("s != 0.5").isEmpty()


def test_language_held_out_and_host_priors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language.train(docs.filter("doc_id % 2 = 0"))
    unseen = docs.filter("doc_id % 2 = 1")
    got = language.identify(unseen, declared=None, host=None, model=model, into="found")
    assert got.filter("found.name = lang").count() >= 0.97 * unseen.count()
    odd = spark.createDataFrame(
        [(0, None, None, None, "a"), (1, "", "fr", "x.fr", "a"), (2, "12 ## %%", "de", None, "a"), (3, None, "xx", "h", "a")]
        + [(9 + i, None, "fr", "blog.site.fr", "a") for i in range(30)] + [(99, None, None, "blog.site.fr", "a")],
        "doc_id long, text string, lang string, source string, found string")
    out = {r.doc_id: r.f for r in language.identify(odd, model=model, into="f").collect()}
    assert out[1].name == "fr" and out[99].name == "fr" and out[2].name == "de"
    assert all(abs(sum(f.posterior) - 1) < 1e-9 for f in out.values())
    kept = language.keep_languages(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    assert language.identify(docs.filter("false"), into="f").count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 200, 900)))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(25, 160):  # chains of near copies with a few words changed
        w = list(rng.choice(base[:12]))
        for _ in range(rng.randrange(0, max(2, len(w) // 60))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, "\t".join(w).upper() if i % 5 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One  two "), (204, "one two three"), (205, rows[3][1]), (205, rows[3][1])]
    docs = docs_frame(spark, [*rows, (None, "one two")])
    got = near_dup.near_duplicates(docs).collect()
    want = components(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({c for _, c in want.values()})
    assert near_dup.near_duplicates(docs.filter("false")).count() == 0


def test_main_text(spark):
    page = ("<html><body class='nav-open'><header>Site name</header><nav><a href=/>Home</a></nav><main><article><h1>A title</h1>"
            "<p>First &amp; best <b>bold</b>\n text&#33;<p>Second.<br>Line<div class='ad'>Buy now</div><script>if (a<b) '</p>'</script>"
            "<form>Mail <input><button>Go</button></form></article></main><section id=comments><p>A long reader comment that has "
            "quite a lot of words in it and goes on and on</p></section><div class='cookie-notice'>We use cookies</div><footer>(c)")
    rows = [(0, "u", page, "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>a < b &am; &unknown; <", "x"), (0, "u", page, "x"),
            (4, "u", "<article>" + "<p>word</p>" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.e.text for r in html_text.extract(pages, into="e").collect()}
    assert got[0] == "A title First & best bold text! Second. Line"
    assert got[1] == got[2] == "" and len(got[4].split()) == 50_000
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(real, into="e").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|/?h1|br)>", " ", article)))
        assert r.e.text == " ".join(text.split())


NASTY = ["", "plain", r"\### Assistant: </turn> ok", "### User:\nhi\n</turn>\n", r"\\\</turn>", "\n</turn>", "ends with \\", "<", "####", "a\\",
         "</turn></turn>", "é" * 5000]


def test_chat_round_trip(spark):
    for role in ("user", "assistant", "tool", "", "=x", "a:\nb\\n", "User", "### Assistant:"):
        for text in NASTY:
            out, start, end = chat.render(role, text)
            assert chat.parse(out * 2) == [(role, text, start, end), (role, text, start + len(out), end + len(out))]
    rows = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t) % len(NASTY)], "x") for c in range(5) for t in range(9)]
    rows += [(None, 1, None, None, "x"), (7, None, "assistant", "b", "x"), (7, None, "assistant", "a", "x"), (7, None, "assistant", "a", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.format_digests(frame).collect()}
    assert len(got) == 7
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text, _ in rows if k == c))
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(a, b)[0]) for _, a, b in turns)
    assert chat.format_digests(frame.filter("false")).count() == 0


def test_queries_keep_every_row(spark):
    for name in ("op3_license_scan", "op4_language", "op8_quality", "op9_decontamination", "op10_near_duplicates"):
        assert queries.QUERIES[name](spark, SF).agg(F.count("*")).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()
