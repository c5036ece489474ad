"""Phrase collocations by Rabin-Karp fingerprints.

A task hashes the words of its texts from prefix polynomials over bytes, and every n-gram from prefix
polynomials over its words: a fingerprint of 50 bits and an independent check of 24. It adds up equal ones and ships
(fingerprint, count, check, pointer to the row of one occurrence), sorted and packed by ranges of
fingerprints: about ten bytes each. One task adds up a range over all tasks; only what was seen often enough
becomes a row.

Only frequent fingerprints become text: the rows their pointers name are read again, once. Where checks
differ, different phrases share a fingerprint: those n-grams are read everywhere and counted by their text.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each
time; an empty table gives an empty result; a text of any length is hashed in slices of ``SLICE`` bytes, so
that a task needs memory for a slice, the text itself and ``HELD`` counters. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stage
from .words import text_bytes, text_parts

SLICE = 1 << 18           # bytes hashed at once
HELD = 1 << 16            # counters a task gathers before it adds them up; it ships 11 times as many
FP_BITS, CHECK_BITS = 50, 24
RANGE_BYTES = 2 << 20     # text for each range of fingerprints
BLOCK_ROWS = 1 << 16      # rows that a packed pointer tells apart
TABLE_BITS = (20, 27)     # log2 of the least and most bits of the table of shared fingerprints
BROADCAST_ROWS = 1_000_000
UNKNOWN = "und"

_RANDOM = np.random.default_rng(20_260_301)
_VALUES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)   # of a byte, in fingerprint and check
_VALUES[:, 65:91] = _VALUES[:, 97:123]                              # A-Z as a-z
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)                   # odd, so that they have inverses
_KIND = np.zeros(256, np.uint8)                                     # 0 word, 1 space, 2 end of a piece
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = bytes(range(256)).lower()

_PACKED_ARROW = pa.schema([("range", pa.int32()), ("base", pa.int64()), ("packed", pa.binary())])
PHRASES = "lang string, phrase string, f long"
_PHRASES_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_POWERS = [_powers(b, SLICE) for b in _BASES]
_INVERSES = [_powers(pow(b, -1, 1 << 64), SLICE) for b in _BASES]


def words_of(data: np.ndarray):
    """Words of a buffer, slice by slice: start, end, piece number, fingerprint, check (arrays).

    A word's hash is (P[end] - P[start]) / base**start with P the prefix sums of value * base**place; sums
    and an unfinished word are carried from slice to slice.
    """
    carry, pieces, pending = [0, 0], 0, None
    for at in range(0, len(data), SLICE):
        part = data[at:at + SLICE]
        n = len(part)
        kind = _KIND[part]
        word = kind == 0
        edge = np.flatnonzero(np.diff(word, prepend=pending is not None))
        starts, ends = edge[word[edge]], edge[~word[edge]]
        piece = pieces + np.cumsum(kind == 2)
        at_start, at_end = [], []
        for k, base in enumerate(_BASES):
            up, down = pow(base, at, 1 << 64), pow(base, -at, 1 << 64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[k][part] * _POWERS[k][:n])))
            sums = sums * np.uint64(up) + np.uint64(carry[k])
            at_start.append((sums[starts], _INVERSES[k][starts] * np.uint64(down)))
            at_end.append(sums[ends])
            carry[k] = int(sums[-1])
        begin = starts + at
        number = piece[starts]
        if pending is not None:
            begin = np.concatenate((pending[0], begin))
            number = np.concatenate((pending[1], number))
            at_start = [tuple(np.concatenate(x) for x in zip(old, new)) for old, new in zip(pending[2], at_start)]
        done = len(ends)
        pending = None
        if len(begin) > done:
            pending = begin[done:], number[done:], [(p[done:], f[done:]) for p, f in at_start]
        pieces = int(piece[-1])
        yield (begin[:done], ends + at, number[:done],
               *((end - p[:done]) * f[:done] for end, (p, f) in zip(at_end, at_start)))


def _hashed(words: np.ndarray, base: int, first: np.ndarray, size: int, salt: np.ndarray, bits: int) -> np.ndarray:
    """Hash of ``size`` words from each of ``first``, by prefix polynomials over the words."""
    n = len(words)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(words) * _powers(base, n))))
    value = (sums[first + size] - sums[first]) * _powers(pow(base, -1, 1 << 64), n)[first]
    return (_mix((value ^ salt) * np.uint64(2 * size + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(texts: list[bytes], salts: np.ndarray, longest: int, bits: int):
    """n-grams of whole texts, slice by slice, n from 1 to ``longest``: n, text number, begin and end in the
    text, fingerprint and check."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    for found in words_of(data):
        old = min(len(held[0]), longest - 1)
        begin, end, piece, fp, check = held = [np.concatenate((a[len(a) - old:], b)) for a, b in zip(held, found)]
        if len(begin) == old:
            continue
        owner = np.searchsorted(begins, begin, side="right") - 1
        for n in range(1, longest + 1):
            first = np.arange(max(0, old - n + 1), len(begin) - n + 1)  # those that end in a new word
            first = first[piece[first] == piece[first + n - 1]]
            if len(first):
                text = owner[first]
                yield (n, text, begin[first] - begins[text], end[first + n - 1] - begins[text],
                       _hashed(fp, _BASES[0], first, n, salts[text], bits), _hashed(check, _BASES[1], first, n, salts[text], CHECK_BITS))


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _parts_of(batch: pa.RecordBatch):
    """(texts, langs, rows) of about a slice each, or of one long text."""
    langs, rows, at = batch.column("lang").to_pylist(), batch.column("row").to_numpy(), 0
    for texts in text_parts(batch.column("text"), SLICE):
        yield texts, langs[at:at + len(texts)], rows[at:at + len(texts)]
        at += len(texts)


def _added_up(fp: np.ndarray, check: np.ndarray, n: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Counters in order of fingerprint and check, equal ones made one with their smallest row."""
    order = np.argsort(fp)
    whole = fp, check
    fp, check = fp[order], check[order]
    at = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    if (np.minimum.reduceat(check, at) != np.maximum.reduceat(check, at)).any():  # hardly ever
        order = np.lexsort(whole[::-1])
        fp, check = whole[0][order], whole[1][order]
        at = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1]))))
    return [fp[at], check[at], np.add.reduceat(n[order], at), np.minimum.reduceat(row[order], at)]


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, all their first bytes, then all their second bytes, ..."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of natural numbers of one length; the first, which rises, as gaps."""
    first, *rest = columns
    return len(first).to_bytes(4, "little") + b"".join(map(_bytes, (np.diff(first, prepend=0), *rest)))


def unpack(packed: bytes) -> list[np.ndarray]:
    size, at, out = int.from_bytes(packed[:4], "little"), 4, []
    while at < len(packed):
        width = packed[at]
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(packed, np.uint8, size * width, at + 1).reshape(width, size).T
        out.append(wide.view("<i8").ravel())
        at += 1 + size * width
    return [np.cumsum(out[0]), *out[1:]]


def _counter(longest: int, bits: int, ranges: int):
    """Task function: n-grams of whole texts to packed counters, one block for each range of fingerprints."""
    def count(batches):
        new, runs, base = [], [], 0  # counters as they come; sorted runs of distinct ones

        def added(parts):
            return [_added_up(*(np.concatenate(x) for x in zip(*parts)))] if parts else []

        def size(parts):
            return sum(len(x[0]) for x in parts)

        def shipped(held):
            part = held[0] >> (bits - ranges)
            edge = (np.flatnonzero(np.diff(part)) + 1).tolist()
            for a, b in zip([0, *edge], [*edge, len(part)]):
                k = int(part[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([base]),
                     pa.array([pack([held[0][a:b] - (k << bits - ranges), *(c[a:b] for c in held[1:])])], pa.binary())], schema=_PACKED_ARROW)

        for batch in batches:
            for texts, langs, rows in _parts_of(batch):
                # A pointer is the place in a block of rows: the parts end with a block.
                place = rows - rows % BLOCK_ROWS
                edge = (np.flatnonzero(np.diff(place)) + 1).tolist()
                for a, b in zip([0, *edge], [*edge, len(texts)]):
                    if place[a] != base:
                        for held in added(runs + added(new)):
                            yield from shipped(held)
                        new, runs, base = [], [], int(place[a])
                    for _, owner, _, _, fp, check in _grams(texts[a:b], np.array([_salt(x) for x in langs[a:b]], np.uint64), longest, bits):
                        new.append((fp, check.astype(np.int32), np.ones(len(fp), np.int32), (rows[a:b][owner] - base).astype(np.uint16)))
                        if size(new) >= HELD:
                            runs, new = runs + added(new), []
                            if size(runs) >= 16 * HELD:
                                runs = added(runs)
                                if size(runs) >= 11 * HELD:
                                    yield from shipped(runs.pop())
        for held in added(runs + added(new)):
            yield from shipped(held)
    return count


def _frequent_of(least: int, bits: int, ranges: int):
    """Group function: the fingerprints of a range that were seen ``least`` times over all tasks, with their
    count, one row that holds them, and whether their checks differ."""
    def frequent(key, table):
        blocks = []
        for base, packed in zip(table.column("base").to_pylist(), table.column("packed")):
            *rest, row = unpack(packed.as_py())
            blocks.append((*rest, row + base))
        fp, check, n, row = _added_up(*map(np.concatenate, zip(*blocks)))
        at = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
        total, differ = np.add.reduceat(n, at), np.diff(np.append(at, len(fp))) > 1
        kept = total >= least
        return pa.table({"fp": fp[at][kept] + (key[0].as_py() << bits - ranges), "n": total[kept], "row": row[at][kept], "shared": differ[kept]})
    return frequent


def _word_counts(batches):
    """Words of each language, one row for each language of a task."""
    words: Counter = Counter()
    for batch in batches:
        for texts, langs, _ in _parts_of(batch):
            data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
            start = np.flatnonzero((_KIND[data] == 0) & (_KIND[np.concatenate((data[-1:], data[:-1]))] != 0))
            ends = np.cumsum([len(t) + 1 for t in texts])
            for lang, n in zip(langs, np.diff(np.searchsorted(start, ends), prepend=0).tolist()):
                words[lang] += n
    yield pa.RecordBatch.from_arrays([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["lang", "n"])


def _phrase(text: bytes, begin: int, end: int) -> str:
    return b" ".join(text[begin:end].translate(_LOWER).split()).decode("utf-8", "replace")


def _finder(longest: int, bits: int):
    """Task function: texts with the fingerprints that point to them, to (lang, phrase, f)."""
    def find(batches):
        for batch in batches:
            wanted, at = batch.column("wanted"), 0
            for texts, langs, rows in _parts_of(batch):
                own = wanted.slice(at, len(texts))
                at += len(texts)
                items = own.flatten()
                fps, counts = (items.field(c).to_numpy() for c in ("fp", "n"))
                where = np.repeat(np.arange(len(texts)), own.value_lengths().to_numpy())
                order = np.argsort(fps)
                fps, counts, where = fps[order], counts[order], where[order]
                left = np.ones(len(fps), bool)
                for _, owner, begin, end, fp, _ in _grams(texts, np.array([_salt(x) for x in langs], np.uint64), longest, bits):
                    place = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
                    hit = np.flatnonzero((fps[place] == fp) & (where[place] == owner) & left[place])
                    place, first = np.unique(place[hit], return_index=True)
                    hit = hit[first]
                    left[place] = False
                    if len(hit):
                        phrases = [_phrase(texts[o], b, e) for o, b, e in zip(owner[hit].tolist(), begin[hit].tolist(), end[hit].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([langs[o] for o in owner[hit]], pa.string()), pa.array(phrases, pa.string()),
                                                          pa.array(counts[place])], schema=_PHRASES_ARROW)
    return find


def _reader(longest: int, bits: int, table):
    """Task function: the n-grams as text whose fingerprint may be in the table."""
    schema = pa.schema([("fp", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])

    def read(batches):
        known = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for texts, langs, _ in _parts_of(batch):
                for _, owner, begin, end, fp, _ in _grams(texts, np.array([_salt(x) for x in langs], np.uint64), longest, bits):
                    place = _place(fp, len(known).bit_length() + 2)
                    hit = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    for at in range(0, len(hit), 1 << 14):
                        some = hit[at:at + (1 << 14)]
                        phrases = [_phrase(texts[o], b, e) for o, b, e in zip(owner[some], begin[some], end[some])]
                        yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array([langs[o] for o in owner[some]], pa.string()),
                                                          pa.array(phrases, pa.string())], schema=schema)
    return read


def _place(fp: np.ndarray, bits: int) -> np.ndarray:
    """Bit of a fingerprint in a table of 2^bits bits."""
    return (_mix(fp.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _bit_table(marked: DataFrame):
    """Broadcast bit table over fingerprints, 16 bits for each within ``TABLE_BITS``; the driver gets its words.

    What it lets through in excess is dropped by a join, so its size costs shuffle only.
    """
    spark = marked.sparkSession
    bits = max(TABLE_BITS[0], min((marked.count() * 16).bit_length(), TABLE_BITS[1]))

    def word_and_bit(batches):
        for batch in batches:
            place = _place(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))],
                                             names=["word", "bit"])

    words = marked.select("fp").mapInArrow(word_and_bit, "word long, bit long") \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10,
                     hash_bits: int = FP_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of phrases of up to ``longest`` words seen ``least`` times or more,
    (lang, n) with all words).

    ``hash_bits`` narrows the fingerprints, for tests of collisions.
    """
    texts = stage(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_bytes(text).alias("text"),
                              F.monotonically_increasing_id().alias("row")))
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = min(30, hash_bits, (size // RANGE_BYTES).bit_length())
    frequent = stage(texts.mapInArrow(_counter(longest, hash_bits, ranges), "range int, base long, packed binary")
                     .groupBy("range").applyInArrow(_frequent_of(least, hash_bits, ranges), "fp long, n long, row long, shared boolean"))
    wanted = frequent.filter("not shared").groupBy("row").agg(F.collect_list(F.struct("fp", "n")).alias("wanted"))
    named = texts
    rows = wanted.select("row")
    if rows.count() <= BROADCAST_ROWS:
        named = texts.join(F.broadcast(rows), "row", "left_semi")
    phrases = named.join(wanted, "row").select("lang", "text", "row", "wanted").mapInArrow(_finder(longest, hash_bits), PHRASES)
    shared = frequent.filter("shared").select("fp")
    if not shared.isEmpty():
        table = _bit_table(shared)
        phrases = stage(phrases.unionByName(
            texts.mapInArrow(_reader(longest, hash_bits, table), "fp long, lang string, phrase string").join(shared, "fp", "left_semi")
            .groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least)))
        table.destroy()
    totals = stage(texts.mapInArrow(_word_counts, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    phrases = stage(phrases.withColumn("words", F.size(F.split("phrase", " "))))
    discard(texts)
    return phrases, totals


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10,
                 share: int = 50, top: int = 2000, hash_bits: int = FP_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    a, l and r count the phrase, its first part and the rest; the score is floor(10^6 a^2 / (l r)) at the
    cut where it is lowest. A phrase goes if a longer one that holds it has ``share`` percent of its count.
    """
    phrases, totals = frequent_phrases(docs, text=text, lang=lang, longest=longest, least=least, hash_bits=hash_bits)
    found = phrases.select("lang", "words", "phrase", "f").filter("words > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")

    def joined(first, size):
        return F.array_join(F.slice(words, first, size), " ")

    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    count = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.withColumn("head", joined(F.lit(1), F.col("k"))).withColumn("part", joined(F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(count.withColumnRenamed("f", "r"), ["lang", "part"]).drop("part").withColumnRenamed("head", "part") \
        .join(count.withColumnRenamed("f", "l"), ["lang", "part"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    cuts = cuts.withColumn("above", (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", l * r) \
        .withColumn("score", F.expr("above div below"))
    # Of equal scores the smallest k; l and r of that cut go along packed behind it.
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.filter("words > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), "
        "p -> array_join(slice(split(phrase, ' '), p, s), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= top)
    return ranked.join(totals, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
