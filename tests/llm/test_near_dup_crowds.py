"""Near-duplicates in crowded regions: unrelated documents that share one long passage."""

import random

import pytest

from barloom.llm import near_dup

from test_text_operators import components, docs_frame


def crowd(documents=400, pairs=12, passage=170, own=35, seed=11):
    """Documents at about 0.7 to each other, and pairs among them at 0.8 to 0.9."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(passage)]
    rows = []
    for i in range(documents):
        rows.append((2 * i, shared + [f"u{rng.randrange(10 ** 9)}" for _ in range(own)]))
    for i in rng.sample(range(documents), pairs):
        copy = list(rows[i][1])
        copy[passage + 12:passage + 12 + rng.randrange(10, 16)] = [f"v{rng.randrange(10 ** 9)}" for _ in range(12)]
        rows.append((2 * i + 1, copy))
    return [(i, " ".join(w)) for i, w in rows]


def test_pairs_within_a_crowd_are_found(spark):
    rows = crowd()
    want = components(rows)
    assert sum(c != i for i, (_, c) in want.items()) == 12
    got = near_dup.near_duplicates(docs_frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_pairs_across_a_partition_border(spark, monkeypatch):
    """Four classes share leading minima in one order, three of them in one partition and one in the next."""
    classes = spark.createDataFrame(
        [(bytes([i]) * 16, bytes([i]) * 16, bytes(6) + bytes([0, i]) * (near_dup.VALUES - 3), bytes(near_dup.VALUES // 2)) for i in range(4)],
        "key binary, part binary, signature binary, sketch binary")
    monkeypatch.setattr(near_dup, "TREES", 1)
    frame = type(classes)

    def three_and_one(self, *columns):
        return self.repartition(1).sortWithinPartitions("row").rdd.zipWithIndex().map(lambda x: (int(x[1] == 3), x[0])) \
            .partitionBy(2, lambda k: k).map(lambda x: x[1]).toDF(self.schema)

    monkeypatch.setattr(frame, "repartitionByRange", three_and_one)
    assert near_dup.candidates(classes, "part", near_dup.BACK).count() == 6


def test_partner_deep_in_a_large_component(spark):
    """Over 50 partitions, in batches of 2 rows: documents near to one single member of a large component."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(300)]

    def changed(words, n):
        at = rng.randrange(10, len(words) - n - 10)
        return words[:at] + [f"c{rng.randrange(10 ** 9)}" for _ in range(n)] + words[at + n:]

    copies = [changed(base, 5) for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*copies, *(changed(w, 25) for w in copies[:20])])]
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_dup.near_duplicates(docs_frame(spark, rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


def rare_pairs(spark, sets):
    """Pairs of the exact join, and the links among all pairs, as number pairs; every set is a part of its own."""
    frame = spark.createDataFrame([(i.to_bytes(4, "big"), i, s) for i, s in enumerate(sets)], "key binary, part long, hashes array<long>")
    found = near_dup.sharing_rare(frame).collect()
    got = [tuple(sorted((int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")))) for r in found]
    whole = [set(s) for s in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if 100 * len(whole[i] & whole[j]) >= near_dup.NEED * len(whole[i] | whole[j])}
    return got, links


def test_crowd_makes_few_pairs(spark):
    """400 sets around one centre at about 0.75 to each other, 12 of them with a near copy."""
    rng = random.Random(3)
    number = lambda: rng.randrange(-2 ** 63, 2 ** 63)
    centre = [number() for _ in range(150)]
    sets = [[h for h in centre if rng.random() > 0.09] + [number() for _ in range(12)] for _ in range(400)]
    sets += [[*s[:-6], *(number() for _ in range(6))] for s in rng.sample(sets, 12)]
    got, links = rare_pairs(spark, sets)
    assert len(links) >= 12 and links <= set(got) and len(got) < len(sets)


def test_bounds_lose_no_link(spark):
    """Sets of 1 to 300 shingles, and variants of them about the similarity that is needed."""
    rng = random.Random(8)
    number = lambda: rng.randrange(-2 ** 63, 2 ** 63)
    sets = []
    for n in [*range(1, 21), 40, 99, 150, 300]:
        base = [number() for _ in range(n)]
        for _ in range(14):
            cut = rng.randrange(0, n // 8 + 2)
            sets.append(sorted({*rng.sample(base, max(1, n - cut)), *(number() for _ in range(rng.randrange(0, n // 8 + 2)))}))
    got, links = rare_pairs(spark, sets)
    equal = {(i, j) for i, j in links if sets[i] == sets[j]}
    assert len(links - equal) > 200 and links <= set(got)


@pytest.mark.parametrize("keys, pieces, shuffled", [(1_000_000, 8, False), (5, 8, False), (5, 1, True)])
def test_texts_stay_where_they_are(spark, monkeypatch, keys, pieces, shuffled):
    """Texts of kept documents are not shuffled, not even where their ids are too large for Spark's own broadcasts."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:20]] + [(None, rows[0][1]), (None, "one two")]
    want = {i for i, (_, c) in components([r for r in rows if r[0] is not None]).items() if i == c}
    assert len(want) == 60
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", keys)
    monkeypatch.setattr(near_dup, "PIECES", pieces)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        rest = near_dup.drop_near_duplicates(docs_frame(spark, rows))
        got = [r.doc_id for r in rest.collect()]
        plan = rest._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert sorted(got, key=str) == sorted([*want, None, None], key=str)
    assert ("SortMergeJoin" in plan) == shuffled


def test_selected_in_pieces(spark, monkeypatch):
    """Keys in several broadcasts select each row once, repeated and null ones too."""
    ids = [*range(100), 7, 7, None]
    wide = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "id long")
    for rows in (1_000_000, 4, 1):
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", rows)
        chosen = [r.id for r in near_dup.selected(wide, keys, "id").collect()]
        rest = [r.id for r in near_dup.selected(wide, keys, "id", "left_anti").collect()]
        assert sorted(chosen) == sorted(i for i in ids if i is not None and i % 7 == 0)
        assert sorted(rest, key=str) == sorted((i for i in ids if i is None or i % 7), key=str)
