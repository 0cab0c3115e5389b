import random
from functools import reduce

import pytest
from conftest import rows
from pyspark.sql import DataFrame, functions as F
from test_lifecycle import NOW, content

from stemma import model as M
from stemma.operators import analytics, lifecycle as L, series, validate as V
from stemma.plans.catalog import from_quads

B = M.BASE


# ---- sketches --------------------------------------------------------------

def test_sketches_of_loads_add_up(spark, cat, quads):
    first = analytics.counter_sketches(from_quads(quads.filter(f"g <> '{B}w2/'")))
    second = analytics.counter_sketches(from_quads(quads.filter(f"g <> '{B}w1/'")))   # w3 is in both
    got = analytics.sketched_counters(first.unionByName(second))
    assert got.collect() == analytics.counters(cat).collect()          # few things: sketches are exact
    assert got.columns == analytics.counters(cat).columns
    assert analytics.counters(cat, approximate=True).collect() == got.collect()
    none = analytics.sketched_counters(first.filter("false"))
    assert none.first() == (0,) * 6


def test_sketch_error_is_bounded(spark):
    things = spark.range(200_000).selectExpr("'c' as counter", "concat('urn:', id) as x")
    sketches = [things.filter(f"hash(x) % 3 = {k}").groupBy("counter").agg(
        F.hll_sketch_agg("x", F.lit(analytics.SKETCH_BITS)).alias("sketch")) for k in (-2, -1, 0, 1, 2)]
    union = reduce(DataFrame.unionByName, sketches).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")))
    n = union.first()[0]
    assert abs(n - 200_000) < 0.04 * 200_000


# ---- yearly series ---------------------------------------------------------

def test_series_follow_changes(spark, quads):
    quads = quads.distinct()
    state = series.references(from_quads(quads))
    new = content(spark, "w2").unionByName(spark.createDataFrame([
        (B + "w2", M.PUBLICATION_DATE, M.VOCAB + "2020", "uri", None, B + "w2/"),
        (B + "w2", M.AUTHOR_PROPS[3], B + "a1", "uri", None, B + "w2/")], M.QUAD))
    after = L.upsert_records(quads, new, M.PUBLISHED, "me@x.org", NOW)
    graph = f"g = '{B}w2/'"
    moved = series.apply_changes(state, series.changes(quads.filter(graph), after.filter(graph)))
    assert rows(moved) == rows(series.references(from_quads(after)))
    assert rows(series.counts(moved)) == rows(series.counts(series.references(from_quads(after))))
    assert {r.n for r in moved.filter(f"series = 'authors' and x = '{B}a1'").collect()} == {2}
    # The record goes: one that another work states too stays.
    left = series.apply_changes(moved, series.changes(after.filter(graph), after.filter("false")))
    assert rows(left) == rows(series.references(from_quads(L.clear_graphs(after, after.filter(graph).select("g")))))
    # Nothing changed, nothing to do.
    assert series.changes(quads, quads).count() == 0


# ---- names -----------------------------------------------------------------

def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def edited(rng, name):
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(name) + 1)
        name = rng.choice([name[:k] + rng.choice("aeimxé") + name[k:], name[:k] + name[k + 1:],
                           name[:k] + rng.choice("aeimx") + name[k + 1:]])
    return name


@pytest.mark.parametrize("percent", [55, 60, 75, 90, 100])
def test_similar_names_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    base = ["Lima, M.J.M", "Lima, Maria J.M.", "Doe, John", "Doe, Jon", "aaaa", "aaaaa", "aa", "ab", "a", "Ng", "Wu, X.",
            "Müller, Ä.", "abababab", "babababa", "International Press", "Internal Press"]
    names = [rng.choice([n, n.upper(), f" {n} "]) for n in base for _ in range(2)] + [
        edited(rng, rng.choice(base)) for _ in range(120)] + ["...", "", None]
    count, key_of = {}, {}
    for n in names:
        if n is not None:
            label = n.strip()
            count[label] = count.get(label, 0) + 1
            key_of[label] = "".join(c for c in label.lower() if c.isalnum())
    of = {}
    for label, key in key_of.items():
        if key:
            of.setdefault(key, []).append((-count[label], label.encode()))
    shown = {k: (min(v)[1].decode(), -sum(n for n, _ in v)) for k, v in of.items()}
    want = []
    for a in of:
        for b in of:
            longer = max(len(a), len(b))
            if a.encode() < b.encode() and 100 * (longer - distance(a, b)) >= percent * longer:
                want.append((a, b, distance(a, b), shown[a][0], shown[b][0], shown[a][1], shown[b][1]))
    got = V.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), percent=percent)
    assert rows(got) == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))
    if percent == 60:
        assert ("limamariajm", "limamjm") in {(a, b) for a, b, *_ in want}


def test_similar_names_edges(spark):
    none = spark.createDataFrame([], "name string")
    assert V.similar_names(none).count() == 0
    with pytest.raises(ValueError):
        V.similar_names(none, percent=50)


def test_counters_of_quads_count_rows_as_stated(spark, quads):
    """Counting makes things distinct itself, so no pass makes the links distinct before."""
    from stemma.operators import analytics as A
    from stemma.plans.catalog import from_quads

    cat = from_quads(quads.unionByName(quads))
    assert rows(A.counters(cat)) == rows(A.counters(from_quads(quads)))
    told = A._things(cat)
    assert "Aggregate" not in told._jdf.queryExecution().optimizedPlan().toString()
    sketches = A.counter_sketches(cat)
    assert rows(A.sketched_counters(sketches)) == rows(A.counters(cat))
