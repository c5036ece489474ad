"""Near-duplicates by an LSH forest: neighbours in several sorted orders of MinHash signatures.

Each text becomes the set of its distinct 4-word shingles. Texts with equal sets are one class.
A class has a signature of ``TREES * BASE`` minima, two bytes of each; tree t sorts all classes by the
signature rotated to start at its own BASE values. Classes that stand near each other in an order and
share at least the BASE leading values are candidates; how deep their common prefix goes follows from
how dense the region is. An estimate on four bits of each minimum drops hopeless candidates, full sets
confirm the rest, and confirmed links are joined to components. Further rounds look, in every
order, for the nearest neighbours of *other* components, until a round adds no link; so what is alike
in a crowded region comes together at a bounded number of comparisons for each member.

Where more classes share leading minima than the first round compares, and not all are of one
component by then, an exact join follows: two sets that reach the similarity share one of their rarest
shingles, so only classes of different components that do so are compared.

Orders are range-partitioned by their full sort key, so equal prefixes do not meet in one task.

Defined cases: null and empty texts, and texts without words, have no shingles and no links; fewer
than four words are one shingle; repeated documents fall into one class; a null doc_id belongs to
no component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, stage
from .components import merge_roots
from .words import text_bytes, text_parts

WIDTH = 4           # words of a shingle
TREES, BASE = 16, 3  # sorted orders; leading minima that neighbours must share
VALUES = TREES * BASE
DEPTH = 6           # minima that an order sorts by
BACK = 3            # neighbours looked at in the first round
NEED = 80           # percent of the union that the intersection must reach
LEAST = 0.55        # estimated similarity below which a candidate is dropped
PARITIES = 16       # words of 64 parity bits of a set in the exact join
BROADCAST_ROWS = 1_000_000
PIECES = 8          # broadcasts of so many keys before wide rows are shuffled

_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FLIP = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of many texts: text number and hash, sorted by both."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)))))
    words = _mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data))[starts])
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    owner = np.searchsorted(begins, starts, side="right") - 1
    many = np.bincount(owner, minlength=len(texts))
    m = np.uint64(0xD6E8FEB86659FD93)
    if len(words) >= WIDTH:
        h = words[:-WIDTH + 1].copy()
        for k in range(1, WIDTH):
            h = h * m + words[k:len(words) - WIDTH + 1 + k]
        whole = owner[:-WIDTH + 1] == owner[WIDTH - 1:]
        who, h = owner[:-WIDTH + 1][whole], _mix(h[whole])
    else:
        who, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((many > 0) & (many < WIDTH))
    if len(few):
        first = np.concatenate(([0], np.cumsum(many)))
        own = []
        for t in few:
            value = np.uint64(many[t])
            for w in words[first[t]:first[t + 1]]:
                value = (value * m + w) ^ np.uint64(0x5555)
            own.append(value)
        who, h = np.concatenate((who, few)), np.concatenate((h, _mix(np.array(own, np.uint64))))
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    if len(h):
        new = np.concatenate(([True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])))
        who, h = who[new], h[new]
    return who, h


SIGNED = "struct<n: long, key: binary, signature: binary, sketch: binary>"
_SIGNED_ARROW = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("sketch", pa.binary())])


def _sign():
    @F.arrow_udf(SIGNED)
    def signed(texts: pa.Array) -> pa.Array:
        n_all, keys, signatures, sketches = [], [], [], []
        with np.errstate(over="ignore"):
            for part in text_parts(texts):
                who, h = shingle_sets(part)
                n = np.bincount(who, minlength=len(part))
                full = np.flatnonzero(n)
                n_all.append(n)
                own = [None] * len(part), [None] * len(part), [None] * len(part)
                if len(full):
                    at = np.concatenate(([0], np.cumsum(n[full])))[:-1]
                    key = np.column_stack([np.add.reduceat(h, at), np.add.reduceat(_mix(h + np.uint64(77)), at)])
                    minima = np.column_stack([np.minimum.reduceat(((h ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32), at)
                                              for k in range(VALUES)])
                    order = (minima & np.uint64(0xFFFF)).astype(">u2")
                    bits = (minima & np.uint64(15)).astype(np.uint8)
                    sketch = bits[:, ::2] << 4 | bits[:, 1::2]
                    for i, t in enumerate(full):
                        own[0][t], own[1][t], own[2][t] = key[i].tobytes(), order[i].tobytes(), sketch[i].tobytes()
                for out, add in zip((keys, signatures, sketches), own):
                    out += add
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_all) if n_all else [], pa.int64()), pa.array(keys, pa.binary()),
             pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())], fields=list(_SIGNED_ARROW))
    return signed


# A row of an order is one binary value, so that it sorts as it stands: tree, leading minima, sketch, key.
_TREE, _ORDER, _SKETCH, _KEY = 1, 2 * DEPTH, VALUES // 2, 16
ROW = _TREE + _ORDER + _SKETCH + _KEY
_ALIKE = np.array([[((x ^ y) & 240 == 0) + ((x ^ y) & 15 == 0) for y in range(256)] for x in range(256)], np.uint8)
NEIGHBOUR = "a binary, b binary, same double, row binary, part binary"
_NEIGHBOUR_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("same", pa.float64()), ("row", pa.binary()),
                              ("part", pa.binary())])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _neighbours(back: int, border: bool):
    """Candidates among the rows of a sorted partition; with ``border`` also its first and last rows.

    A row is compared with the ``back`` rows before it, and with the nearest row of another
    component on either side.
    """
    def near(batches):
        kept = head = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["row", "part"])
            if head is None:
                head = rows.slice(0, back)
            seen = 0 if kept is None else len(kept)
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            n = len(rows)
            part = _matrix(rows["part"], _KEY)
            if n > 1:
                yield from _pairs(_matrix(rows["row"], ROW), part, seen, back)
            # the last rows, and the last one of another component, for the next batch
            other = np.flatnonzero((part != part[-1]).any(1))[-1:]
            kept = rows.take(sorted({*range(max(0, n - back), n), *other.tolist()})).combine_chunks()
        if border and head is not None:
            ends = pa.concat_tables([head, kept.slice(max(0, len(kept) - back))])
            nulls = {c: pa.nulls(len(ends), _NEIGHBOUR_ARROW.field(c).type) for c in ("a", "b", "same")}
            yield from pa.table({**nulls, "row": ends["row"], "part": ends["part"]}, schema=_NEIGHBOUR_ARROW).to_batches()

    def _pairs(rows, part, seen, back):
        n = len(rows)
        base = rows[:, :_TREE + 2 * BASE]
        change = np.concatenate(([True], (part[1:] != part[:-1]).any(1)))
        run = np.maximum.accumulate(np.where(change, np.arange(n), 0))        # first row of the run
        following = np.append(np.flatnonzero(change)[1:], n)[np.cumsum(change) - 1]  # first row after it
        here = np.arange(n)
        tries = [(here, here - s) for s in range(1, back + 1)] + [(here, run - 1), (here, following)]
        i = np.concatenate([x for x, _ in tries])
        j = np.concatenate([y for _, y in tries])
        ok = (j >= 0) & (j < n)
        i, j = i[ok], j[ok]
        ok = ((i >= seen) | (j >= seen)) & (part[i] != part[j]).any(1) & (base[i] == base[j]).all(1)
        pairs = np.unique(np.column_stack([np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])]), axis=0)
        sketch, key = rows[:, _TREE + _ORDER:-_KEY], rows[:, -_KEY:]
        for at in range(0, len(pairs), 1 << 14):
            i, j = pairs[at:at + (1 << 14)].T
            alike = _ALIKE[sketch[i], sketch[j]].sum(1) / VALUES
            same = (alike - 1 / 16) / (15 / 16)  # four bits agree by chance once in sixteen
            good = np.flatnonzero(same >= LEAST)
            if len(good):
                ab = [sorted((key[i[g]].tobytes(), key[j[g]].tobytes())) for g in good]
                k = len(good)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in ab], pa.binary()), pa.array([y for _, y in ab], pa.binary()),
                     pa.array(same[good]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=_NEIGHBOUR_ARROW)
    return near


def candidates(classes: DataFrame, part: str, back: int) -> DataFrame:
    """(a, b, same): keys of classes of different ``part`` that are neighbours in some order."""
    turned = F.expr(f"concat(substring(signature, {2 * BASE} * tree + 1), substring(signature, 1, {2 * BASE} * tree))")
    tree = F.unhex(F.lpad(F.hex("tree"), 2, "0"))
    rows = (
        classes.select("key", F.col(part).alias("part"), "signature", "sketch",
                       F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select(F.concat(tree, F.substring(turned, 1, _ORDER), "sketch", "key").alias("row"), "part")
    )
    found = stage(rows.repartitionByRange("row").sortWithinPartitions("row").mapInArrow(_neighbours(back, True), NEIGHBOUR))
    # Where two partitions meet, their last and first rows are neighbours: a few rows of each partition,
    # once each, as a repeated row would take the place of a neighbour.
    seams = found.filter(F.col("row").isNotNull()).select("row", "part").distinct().repartition(1).sortWithinPartitions("row") \
        .mapInArrow(_neighbours(back, False), NEIGHBOUR)
    return found.filter(F.col("a").isNotNull()).select("a", "b", "same") \
        .unionByName(seams.select("a", "b", "same")).groupBy("a", "b").agg(F.max("same").alias("same"))


def _set_of():
    @F.arrow_udf("struct<key: binary, hashes: array<long>>")
    def sets(texts: pa.Array) -> pa.Array:
        keys, values, ends = [], [], [0]
        with np.errstate(over="ignore"):
            for part in text_parts(texts):
                who, h = shingle_sets(part)
                at = np.searchsorted(who, np.arange(len(part) + 1))
                values.append(h.view(np.int64))
                mixed = _mix(h + np.uint64(77))
                for t in range(len(part)):
                    own = slice(at[t], at[t + 1])
                    keys.append(np.array([h[own].sum(), mixed[own].sum()], np.uint64).tobytes())
                ends += (ends[-1] + at[1:]).tolist()
        hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), hashes], names=["key", "hashes"])
    return sets


def selected(wide: DataFrame, keys: DataFrame, by: str, how: str = "left_semi") -> DataFrame:
    """Rows of a table of texts or sets, by keys (or, ``left_anti``, without them), none of them shuffled.

    The keys are broadcast; where they are many, in pieces by hash, for each of which the table is read once.
    Beyond PIECES of them a shuffle costs less than so many reads.
    """
    pieces = max(1, -(-keys.count() // BROADCAST_ROWS))
    if pieces == 1:
        return wide.join(F.broadcast(keys), by, how)
    if pieces > PIECES:
        return wide.join(keys, by, how)
    of = F.pmod(F.xxhash64(by), F.lit(pieces))
    return reduce(DataFrame.unionByName, [wide.filter(of == i).join(F.broadcast(keys.filter(of == i)), by, how) for i in range(pieces)])


def _ends(pairs: DataFrame) -> DataFrame:
    """(key): each end of the pairs once."""
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    n, m = F.size("x"), F.size("y")
    both = F.size(F.array_intersect("x", "y"))
    close = F.least(n, m) * 100 >= F.greatest(n, m) * NEED  # else the sizes alone rule it out
    return pairs.select("a", "b").join(left, "a").join(right, "b") \
        .filter(F.when(close, both * 100 >= (n + m - both) * NEED).otherwise(False)).select("a", "b")


def _sets_of(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, hashes), staged: the full set of each of these classes, from the text of its ``rep``."""
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    return stage(selected(texts, reps, "doc_id").select(_set_of()("text").alias("s")).select("s.*")
                 .groupBy("key").agg(F.any_value("hashes").alias("hashes")).join(classes.select("key"), "key", "left_semi"))


def crowded(classes: DataFrame) -> DataFrame:
    """Classes (with ``part``) that share leading minima with more than BACK others, of several parts."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("key", "part", "signature", trees) \
        .select("key", "part", "tree", F.expr(f"substring(signature, {2 * BASE} * tree + 1, {2 * BASE})").alias("base"))
    groups = rows.groupBy("tree", "base").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")) \
        .filter((F.col("n") > BACK + 1) & (F.col("lo") != F.col("hi"))).select("tree", "base")
    keys = rows.join(groups, ["tree", "base"], "left_semi").select("key").distinct()
    return classes.join(keys, "key", "left_semi")


def sharing_rare(sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of different ``part`` that can reach the similarity, by prefix, position and parity.

    All shingles have one order: first those that occur in one part only, then by rising number of
    sets. Of n shingles at least k are in the intersection, so one of the first n - k + 1 is; k follows
    from the least size of the other set, which for the smaller set of a pair is its own size. At the
    first common shingle, no set has fewer shingles left than the intersection.

    Members of a crowd meet at what they share, whatever else they hold, so rows are paired only if the
    rest allows it: shingles of one part only differ, and of the others at least as many differ as bits
    of the two parities, each bit the parity of the shingles that fall on it.
    """
    rows = sets.select("key", "part", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    live = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("many"), F.min("part").alias("lo"), F.max("part").alias("hi")) \
        .filter(F.col("lo") != F.col("hi")).select("hash", "many")
    bit = F.expr("shiftleft(1L, int(hash & 63))")
    word = F.expr(f"shiftrightunsigned(hash, 6) & {PARITIES - 1}")
    own = rows.join(live, "hash").groupBy("key", "part", "n").agg(
        F.array_sort(F.collect_list(F.struct("many", "hash"))).alias("live"),
        *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i in range(PARITIES)])
    parity = [f"p{i}" for i in range(PARITIES)]
    lone = F.col("n") - F.size("live")
    larger = F.col("n") - F.ceil(F.col("n") * NEED / 100) + 1 - lone
    smaller = F.col("n") - F.ceil(F.col("n") * 2 * NEED / (100 + NEED)) + 1 - lone
    first = stage(own.withColumn("smaller", smaller).withColumn("larger", larger).filter("larger > 0")
                  .select("key", "part", "n", "smaller", lone.alias("lone"), *parity,
                          F.posexplode(F.slice("live", F.lit(1), F.col("larger").cast("int"))).alias("at", "s"))
                  .select("key", "part", "n", "s.hash", "lone", *parity, (F.col("n") - F.col("lone") - F.col("at")).alias("left"),
                          (F.col("at") < F.col("smaller")).alias("short")))
    side = lambda rows, key, end: rows.select(
        "hash", F.col("key").alias(key), *[F.col(c).alias(c + end) for c in ("part", "n", "lone", "left", *parity)])
    x, y = side(first.filter("short"), "a", "_a"), side(first, "b", "_b")
    n = F.col("n_a") + F.col("n_b")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    near = F.col("n_a") * 100 >= F.col("n_b") * NEED
    enough = F.least("left_a", "left_b") * (100 + NEED) >= n * NEED
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in parity), F.col("lone_a") + F.col("lone_b"))
    return x.join(y, (x["hash"] == y["hash"]) & (F.col("part_a") != F.col("part_b")) & ordered & near & enough
                  & (differ * (100 + NEED) <= n * (100 - NEED))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text"))
    rows = stage(texts.withColumn("s", _sign()("text")).select("doc_id", "s.n", "s.key", "s.signature", "s.sketch"))
    classes = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("key", "signature", "sketch").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes)

    pairs = stage(candidates(classes, "key", BACK))
    alive = stage(classes.join(_ends(pairs), "key", "left_semi"))
    sets = _sets_of(texts, alive)

    # First the best candidate of each class, then all that still lie in different components.
    first = stage(pairs.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")).unionByName(
        pairs.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a"))).distinct())
    roots = merge_roots(alive.select(F.col("key").alias("node"), F.col("key").alias("root")), stage(confirmed(first, sets)))
    tried, todo = first, apart(pairs.select("a", "b"), roots)
    while True:
        parted = alive.join(roots.select(F.col("node").alias("key"), F.col("root").alias("part")), "key")
        todo = stage(todo.unionByName(candidates(stage(parted), "part", 1).select("a", "b")).distinct()
                     .join(tried, ["a", "b"], "left_anti"))
        new = stage(confirmed(todo, selected(sets, _ends(todo), "key")))
        if new.isEmpty():
            break
        roots = merge_roots(roots, new)
        tried, todo = tried.unionByName(todo), todo.filter("false")

    # What the orders cannot bring together in crowds.
    roots = stage(classes.select(F.col("key").alias("node")).join(roots, "node", "left")
                  .select("node", F.coalesce("root", "node").alias("root")))
    crowd = stage(crowded(classes.join(roots.select(F.col("node").alias("key"), F.col("root").alias("part")), "key"))
                  .select("key", "rep", "part"))
    if not crowd.isEmpty():
        sets = _sets_of(texts, crowd)
        pairs = stage(sharing_rare(sets.join(crowd.select("key", F.xxhash64("part").alias("part")), "key")))
        roots = merge_roots(roots, stage(confirmed(pairs, selected(sets, _ends(pairs), "key"))))
    members = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key")
    smallest = members.groupBy("root").agg(F.min("rep").alias("least"))
    named = members.join(smallest, "root").select("key", F.col("least").alias("component_id"))
    return (
        rows.join(named, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(left, "a").join(right, "b").filter(F.col("ra") != F.col("rb")).select("a", "b")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; same columns.

    Rows that repeat an id are reduced to one; rows without id stay.
    """
    found = stage(near_duplicates(docs, doc_id=doc_id, text=text).filter(F.col("doc_id").isNotNull()))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    rest = selected(docs, gone, doc_id, "left_anti").select(docs.columns)
    twice = found.filter("kept").groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id)
    if twice.isEmpty():
        return rest
    repeated = selected(rest, twice, doc_id).dropDuplicates([doc_id])
    return selected(rest, twice, doc_id, "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns))
