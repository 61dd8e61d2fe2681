"""Joins, passages and neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from placeshare.llm import passages
from placeshare.llm.components import components
from placeshare.llm.jaccard import one_of_each, overlaps, similar_sets
from placeshare.llm.nearvectors import near_vectors
from placeshare.llm.neighbours import nearest_neighbours
from placeshare.llm.passages import repeated_passages
from tests.llm.conftest import frame, prose


def reached(ids, linked):
    """The smallest id that each reaches."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 230)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {k: v for k, v in reached({x for p in links[:-1] for x in p}, links[:-1]).items() if k != 5}
    assert got == want


def near_copies(rng, groups=12, copies=8):
    rows, doc = [], 0
    for _ in range(groups):
        base = prose(rng, rng.randrange(8, 160)).split()
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    passage = prose(rng, 60)
    return rows + [(1000 + i, f"{prose(rng, 90)} {passage} {prose(rng, 90)}") for i in range(30)] + [(2000, "a B c"), (2001, "A b C")]


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 8, 10)])
def test_similar_sets_equal_brute_force(spark, size, num, den):
    rows = near_copies(random.Random(size))
    sets = {}
    for doc, text in rows:
        w = text.lower().split()
        sets[doc] = {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))}
    linked = [(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = reached(sets, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets(frame(spark, rows), size, f"{num / den}").collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    kept = sorted(r.doc_id for r in one_of_each(frame(spark, rows), size, f"{num / den}").collect())
    assert kept == sorted(set(want.values()))


@pytest.mark.parametrize("t, sizes", [("0.5", (257, 514)), ("0.3", (130, 433)), ("0.9", (900, 1000))])
def test_sets_of_very_different_sizes_link(spark, t, sizes):
    words = [f"w{i}" for i in range(sizes[1])]
    rows = [(1, " ".join(words)), (2, " ".join(words[: sizes[0]])), (3, " ".join(words[: int(sizes[0] * float(t)) - 2]))]
    got = {r.doc_id: r.component_id for r in similar_sets(frame(spark, rows), 1, t).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_overlaps_are_a_matrix_product():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (5, 4000, 6000, 6000, 1)]
    assert (overlaps(sets) == [[len(np.intersect1d(a, b)) if i != j else overlaps(sets)[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_similar_sets_of_odd_documents(odd_docs, no_docs):
    got = similar_sets(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[8].component_id == by[7].component_id == 7 and by[7].n_shingles == 1
    assert by[4].component_id == 4 and by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.n_shingles == 0) == [(0, None)]
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id in (1, 2, 3)").count() == 1 and kept.where("text is null").count() == 2
    assert similar_sets(no_docs).count() == 0 == one_of_each(no_docs).count()


def test_rows_without_words_stay_whatever_else_is_repeated(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, " \n"), (3, "a b c d"), (4, "A b c d")]
    for more in ([], [(3, "a b c d")]):
        kept = [(r.doc_id, r.text) for r in one_of_each(frame(spark, rows + more)).collect()]
        assert Counter(kept) == Counter(rows[:6])


def spans_of(rows, words):
    counts = Counter(tuple(w[i: i + words]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - words + 1))
    out = set()
    for doc, text in rows:
        w = (text or "").split()
        inside = np.zeros(len(w) + 1, dtype=bool)
        for i in range(len(w) - words + 1):
            if counts[tuple(w[i: i + words])] > 1:
                inside[i: i + words] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(int)))
        out |= {(doc, int(a), int(b)) for a, b in edge.reshape(-1, 2)}
    return out


def test_repeated_passages_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (49, 50, 51, 64, 200)]
    rows = [(i, " ".join([prose(rng, rng.randrange(80)), rng.choice(passages), prose(rng, rng.randrange(60)),
                          rng.choice(passages), prose(rng, rng.randrange(5))])) for i in range(60)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == spans_of(rows, 50)
    odd = repeated_passages(odd_docs).collect()
    assert {r.doc_id for r in odd} == {1, 2, 3, None}
    assert repeated_passages(no_docs).count() == 0


def test_no_task_gathers_the_suffixes_of_a_common_line(spark, odd_docs):
    rng = random.Random(9)
    lines = [prose(rng, n) for n in (30, 45, 52, 90)]
    rows = [(i, " ".join([prose(rng, rng.randrange(60)), rng.choice(lines), prose(rng, rng.randrange(60)), rng.choice(lines), prose(rng, 4)]))
            for i in range(80)]
    rows += [(80 + i, rows[i][1]) for i in range(5)] + [(0, rows[0][1]), (90, None), (91, f"{lines[3]} {lines[3]}")]
    docs = frame(spark, rows)
    want = spans_of(rows, 50)
    for hot in (1, 10, 10_000):
        got = repeated_passages(docs, hot=hot).collect()
        assert {(r.doc_id, r.start_word, r.end_word) for r in got} == want
        assert len(got) == len(want)
    columns = ("doc_id", "start_word", "end_word")
    assert repeated_passages(odd_docs, hot=1).select(*columns).exceptAll(repeated_passages(odd_docs).select(*columns)).count() == 0
    assert {r.doc_id for r in repeated_passages(odd_docs, hot=1).collect()} == {1, 2, 3, None}

    sizes, compared = spark.sparkContext.accumulator(0), passages._compared

    def counting(batches, words, window):
        for batch in batches:
            sizes.add(batch.num_rows)
            yield from compared(iter([batch]), words, window)

    passages._compared = counting
    try:
        repeated_passages(docs, hot=1).count()
        assert sizes.value == 0  # every head is hot, and none is gathered
        repeated_passages(docs).count()
        assert sizes.value > 0
    finally:
        passages._compared = compared


def test_matches_come_from_the_order_of_suffixes():
    """Neighbours in the order of the words to the right are compared; in another order, matches are lost."""
    rng = random.Random(4)
    base = [rng.randrange(1, 50) for _ in range(50)]
    rows = []
    for i in range(300):
        right = base[: rng.randrange(21, 51)]
        right += [rng.randrange(50, 60) for _ in range(50 - len(right))]
        left = [rng.randrange(3) for _ in range(rng.randrange(30))]
        rows.append((right, left))
    rows = list({(tuple(r), tuple(x)): None for r, x in rows})
    code = lambda words: np.array(words, dtype=">u4").tobytes()

    def found(order):
        columns = [(5, i, 1, i, i, code(rows[i][0]), code(rows[i][1])) for i in order]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*columns)], names=["head", "context", "n", "low", "high", "right", "left"])
        return {(r["context"], r["left"], r["right"]) for b in passages._compared(iter([batch]), 50, 30) for r in b.to_pylist()}

    want = set()
    for i, (right, left) in enumerate(rows):
        fits = [a for a in range(30) if a <= len(left) and any(
            j != i and len(x) >= a and x[:a] == left[:a] and r[: 50 - a] == right[: 50 - a] for j, (r, x) in enumerate(rows))]
        if fits:
            want.add((i, max(fits), 50 - min(fits)))
    order = sorted(range(len(rows)), key=lambda i: (code(rows[i][0]), code(rows[i][1])))
    assert found(order) == want and len(want) > 30
    rng.shuffle(order)
    assert found(order) != want


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", LongType())])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 24))
    rows = [(i, [float(x) for x in centres[i % 150] + rng.standard_normal(24) * rng.choice([0.02, 0.15, 0.28])], i) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, rows[0][1], 0), (701, rows[0][1], 0), (702, None, 0), (703, [0.0] * 24, 0), (704, [], 0),
             (705, [1.0, None, *[0.0] * 22], 0), (706, [float("nan")] * 24, 0), (707, [float("inf")] * 24, 0), (708, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, VECTORS).selectExpr("*", "'clash' as node", "'clash' as shard")


def usable(rows):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows
            if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]


def test_near_vectors_find_the_links(spark, vectors):
    rows, table = vectors
    good = usable(rows)
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    got = near_vectors(table).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.93 * links.sum() <= found <= links.sum()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id in range(702, 709)} == {i: (0, i, True) for i in range(702, 709)}
    copies = [r for r in got if r.vec_id in (0, 700, 701)]
    assert {r.component_id for r in copies} == {0} and min(r.n_links for r in copies) >= 3
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest_neighbours_against_brute_force(spark, vectors):
    rows, table = vectors
    got = nearest_neighbours(table, shard_rows=200).collect()
    good = list({(i, tuple(v)): (i, v) for i, v in usable(rows)}.values())
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.where(ids == ids[q], -np.inf, x @ x[q])
        best = np.lexsort((ids, -score))[:20]
        mine = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - score[ids == r.vec_id].max()) < 1e-9 for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id for r in mine} & set(ids[best].tolist()))
        wanted += 20
    assert hits >= 0.95 * wanted
    assert nearest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -9.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(few).orderBy("rank").collect()] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert DoubleType() == nearest_neighbours(few).schema["score"].dataType

def test_nearest_neighbours_among_many_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 24)).astype(np.float32).astype(float)
    ids = [*rng.permutation(600).tolist(), *range(600, 1500)]
    rows = [(i, v.tolist()) for i, v in zip(ids, [*x, *([x[5]] * 900)])]
    rows += [rows[5], (ids[6], x[7].tolist())]  # a repeated row, and an id with two vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest_neighbours(table).collect()
    rows = list({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.where(ids == ids[q], -np.inf, x @ x[q])
        best = Counter((int(ids[k]), round(float(score[k]), 6)) for k in np.lexsort((ids, -score))[:20])
        mine = Counter((r.vec_id, round(r.score, 6)) for r in got if r.query_id == ids[q])
        hits += sum((mine & best).values())
        wanted += 20
    assert len(got) == wanted and hits >= 0.95 * wanted


@pytest.mark.parametrize("turn", [1, -1])
def test_vectors_that_differ_by_nulls_only_are_not_one(spark, turn):
    kind = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType()))])
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0, None]), (3, [None, 1.0, 2.0]), (4, [1.0, 2.0]), (5, None), (6, []), (7, [0.0, 0.0]),
            (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [2.0, 4.0]), (11, [1.0, 2.0, 0.0]), (None, None), (None, [1.0, 2.0])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows[::turn], kind)).collect()}
    linked = {(i, 3, 1, i == 1) for i in (1, 4, 10)} | {(None, 3, 1, False)}
    assert got == linked | {(i, 0, i, True) for i in (2, 3, 5, 6, 7, 8, 9, 11)} | {(None, 0, None, True)}
