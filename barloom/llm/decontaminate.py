"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items streams over the words of each text and gives the longest run of item
words that ends at each word. Runs of at least ``window`` words, and whole items that are shorter,
are hits. Test items are packed into automata of bounded size; a text passes one automaton at a
time, so the memory of a task does not grow with the number of items. Texts are never shuffled.

Defined cases: null and empty texts have no words and no hits; items without id or without words
are left out; rows with equal item ids count as one item; repeated documents give repeated rows;
an empty table on either side gives no hits; further columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, stage
from .automaton import build, home_states, inherited, run_states
from .words import free_name, text_bytes, word_list, word_spans

FOUND = "struct<n_words: long, spans: array<struct<first: long, last: long>>, items: array<string>>"
CLEANED = "struct<n_words: long, n_hit: long, text: string>"


def prepare(items: list[tuple[str, bytes]], window: int) -> tuple:
    """Automaton of one pack of items, with what a task needs to name the items of a hit."""
    sequences = [(name, word_list(text)) for name, text in items]
    moves, link, longest = build(words for _, words in sequences)
    home = home_states(link, longest, window)
    long_items: dict[int, set] = {}
    short_items: dict[int, dict[int, set]] = {}
    for name, words in sequences:
        states = run_states(words, moves)
        for state in states[window - 1:]:
            long_items.setdefault(home[state], set()).add(name)
        if 0 < len(words) < window:
            short_items.setdefault(states[-1], {}).setdefault(len(words), set()).add(name)
    short = inherited(link, longest, {
        state: tuple((size, tuple(names)) for size, names in by_size.items())
        for state, by_size in short_items.items()})
    return moves, link, longest, home, {k: tuple(v) for k, v in long_items.items()}, short


def hits(words: list[bytes], pack: tuple, window: int) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words (first, last) and the ids of the items with occurring windows."""
    moves, link, longest, home, long_items, short = pack
    spans: list[tuple[int, int]] = []
    homes, names = set(), set()
    state = length = 0
    for i, word in enumerate(words):
        to = moves[state].get(word)
        while to is None and state:
            state = link[state]
            length = longest[state]
            to = moves[state].get(word)
        if to is None:
            length = 0
            continue
        state = to
        length += 1
        first = i + 1
        if length >= window:
            first = i - length + 1
            homes.add(home[state])
        if state in short:
            for size, who in short[state]:
                if size <= length:
                    first = min(first, i - size + 1)
                    names.update(who)
        if first <= i:
            while spans and spans[-1][1] >= first - 1:
                first = min(first, spans.pop()[0])
            spans.append((first, i))
    for h in homes:
        names.update(long_items[h])
    return spans, names


def item_packs(items: DataFrame, item_id: str, text: str, window: int, pack_words: int) -> list:
    """Broadcast automata; each holds the items of about ``pack_words`` words."""
    spark = items.sparkSession
    bound_batches(spark)
    rows = items.select(F.col(item_id).cast("string").alias("name"), text_bytes(text).alias("text")) \
        .filter(F.col("name").isNotNull())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + int(size // (8 * pack_words))  # words with their gaps have about eight bytes
    part = F.pmod(F.xxhash64("name"), F.lit(count))
    return [spark.sparkContext.broadcast(prepare([tuple(r) for r in rows.filter(part == k).collect()], window))
            for k in range(count)]


def _overlaps(docs: DataFrame, packs: list, window: int, text: str, into: str) -> DataFrame:
    def search(pack):
        @F.arrow_udf(FOUND)
        def found(texts: pa.Array, earlier: pa.Array) -> pa.Array:
            out = []
            for value, before in zip(texts, earlier):
                words = word_list(value.as_py())
                spans, names = hits(words, pack.value, window)
                if before := before.as_py():
                    spans = merged(spans + [(s["first"], s["last"]) for s in before["spans"]])
                    names = names.union(before["items"])
                out.append({"n_words": len(words), "spans": [{"first": a, "last": b} for a, b in spans],
                            "items": sorted(names)})
            return pa.array(out, type=_FOUND_ARROW)
        return found

    found = F.lit(None).cast(FOUND)
    for k, pack in enumerate(packs):
        docs = docs.withColumn(into, search(pack)(text_bytes(text), found))
        found = F.col(into)
        if k + 1 < len(packs):
            docs = stage(docs)
    return docs


def find_overlaps(docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", pack_words: int = 200_000,
                  into: str = "overlap") -> DataFrame:
    """``docs`` with a struct column: words, hit spans (word positions, merged) and item ids."""
    return _overlaps(docs, item_packs(items, item_id, item_text, window, pack_words), window, text, into)


_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the words of the spans."""
    offsets = word_spans(text)
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at:offsets[first][0]].strip())
        at = offsets[last][1]
    return b" ".join([*kept, text[at:].strip()]).strip()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5,
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  pack_words: int = 200_000) -> DataFrame:
    """Texts without the spans that repeat test items; same columns.

    A span goes if a run of ``window`` item words (or a whole shorter item) covers it. A cut brings
    words together that may make another hit, so the rest is searched again until there is none. A
    document goes when the cuts took more than ``max_coverage`` of its words. Others are unchanged.
    """
    def cleaner(pack):
        @F.arrow_udf(CLEANED)
        def cleaned(texts: pa.Array) -> pa.Array:
            out = []
            for value in texts:
                rest, n_words, gone = value.as_py(), None, 0
                while True:
                    words = word_list(rest)
                    n_words = len(words) if n_words is None else n_words
                    spans, _ = hits(words, pack.value, window)
                    if not spans:
                        break
                    gone += sum(last - first + 1 for first, last in spans)
                    rest = cut(rest, spans)
                out.append({"n_words": n_words, "n_hit": gone, "text": rest.decode("utf-8", "replace") if gone else None})
            return pa.array(out, type=_CLEANED_ARROW)
        return cleaned

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(t.as_py(), [(s["first"], s["last"]) for s in own.as_py()]).decode("utf-8", "replace")
                         if len(own) else None for t, own in zip(texts, spans)], type=pa.string())

    columns = docs.columns
    found, words, gone = (free_name(docs, c) for c in ("cleaned", "words_before", "words_gone"))
    packs = item_packs(items, item_id, item_text, window, pack_words)
    if len(packs) == 1:
        # Declared nondeterministic, or Spark searches all texts a second time below the filter.
        docs = docs.withColumn(found, cleaner(packs[0]).asNondeterministic()(text_bytes(text)))
        fits = F.col(f"{found}.n_hit") <= max_coverage * F.col(f"{found}.n_words")
        return docs.filter(fits).select(*[
            F.coalesce(F.col(f"{found}.text"), F.col(c)).alias(c) if c == text else F.col(c) for c in columns])
    docs = docs.withColumns({words: F.lit(None).cast("long"), gone: F.lit(0).cast("long")})
    while True:  # each round looks at all packs before it cuts
        docs = stage(_overlaps(docs, packs, window, text, found))
        if docs.filter(F.size(f"{found}.spans") > 0).isEmpty():
            fits = F.col(gone) <= max_coverage * F.coalesce(F.col(words), F.col(f"{found}.n_words"))
            return docs.filter(fits).select(*columns)
        short = shortened(text_bytes(text), F.col(f"{found}.spans"))
        docs = docs.select(*[F.coalesce(short, F.col(c)).alias(c) if c == text else F.col(c) for c in columns],
                           F.coalesce(F.col(words), F.col(f"{found}.n_words")).alias(words),
                           (F.col(gone) + _n_hit(found)).alias(gone))


_CLEANED_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("text", pa.string())])


def _n_hit(overlap: str) -> Column:
    return F.aggregate(f"{overlap}.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def overlap_digest(overlap: str) -> list[Column]:
    """Numbers and digest of a struct of ``find_overlaps``."""
    n_hit = _n_hit(overlap)
    items = F.array_sort(f"{overlap}.items")
    return [F.col(f"{overlap}.n_words").alias("n_words"), n_hit.alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")]
