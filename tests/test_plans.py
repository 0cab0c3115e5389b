"""Shapes of plans, agreement of both catalogue builds, and the driver contract."""

import duckdb
import pytest
from conftest import SF, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stemma import model as M
from stemma.operators import analytics as A, browse as Q, resolve as E, transform as T
from stemma.plans.catalog import Catalog, from_quads
from stemma.sources import adapter, store
from stemma.sources.templates import standard_templates

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



@pytest.mark.parametrize("name", ["export_wide", "facet_counts", "suggest_topk", "mention_links",
                                  "label_search_batch", "records", "drop_existing", "form_quads"])
def test_no_python_and_no_cross_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for word in ("PythonUDF", "ArrowEval", "BatchEvalPython", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert word not in text


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["authors_per_year"](spark, SF))
    assert "l_extendedprice" not in text and "o_totalprice" not in text


def test_back_links_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["back_links"](spark, SF))


def test_label_update_leaves_other_quads_where_they_are(spark, monkeypatch):
    from stemma.plans import registered
    kept, write = {}, registered.written
    monkeypatch.setattr(registered, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    entry.queries()["label_update"](spark, SF)
    told = (F.col("p") == M.REFERENCED_BY) | ((F.col("p") == M.RDFS_LABEL) & (F.col("s") == F.col("g")))
    assert kept["labels"].count() > 0 and kept["labels"].filter(~told).count() == 0


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quads_of_rows_are_dealt_out_by_graph_only(spark, no_broadcast):
    text = plan(entry.queries()["rows_to_quads"](spark, SF))
    assert "Exchange hashpartitioning(g#" in text and "Exchange hashpartitioning(s#" not in text


def test_sides_of_hot_joins_come_from_files(spark, no_broadcast):
    """Spark splits hot partitions of a join only where neither side is an aggregation or another join."""
    names = spark.createDataFrame([("people", "Doe, J.")], "kind string, label string")
    known = spark.createDataFrame([("people", "Doe, J.", "urn:d")], "kind string, label string, uri string")
    slots = spark.createDataFrame([("g", "w", "people", "author", 1, "p", "Doe, J.")],
                                  "g string, work string, kind string, role string, ordinal int, property string, label string")
    resolved = T.resolve_slots(slots, E.match_entities(names, known))
    assert "Aggregate" not in plan(resolved) and rows(resolved, "target") == [("urn:d",)]
    cat = adapter.catalog(spark, SF)
    assert "min(label" not in plan(A.labelled_links(cat, "year", "primary_subject"))


def test_record_pages_deal_facts_out_by_graph_once(spark, no_broadcast):
    text = plan(entry.queries()["record_view"](spark, SF))
    assert text.count("Exchange hashpartitioning(g#") == 1
    assert "Exchange hashpartitioning(work#" not in text and "Exchange hashpartitioning(property#" not in text


def test_facets_and_fields_of_a_dump_need_no_distinct_tables(spark, quads, no_broadcast):
    dump = from_quads(quads)
    facets = Q.facet_counts(dump, ["author", "year", "container"])
    fields = Q.record_fields(dump, standard_templates(spark))
    for df in (facets, fields):
        assert "Exchange hashpartitioning(uri#" not in plan(df) and "work#" not in "".join(
            line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line and "role#" not in line)
    again = from_quads(quads.unionByName(quads))
    assert rows(Q.facet_counts(again, ["author", "year", "container"])) == rows(facets)
    assert rows(Q.record_fields(again, standard_templates(spark))) == rows(fields)


def test_labels_of_creators_are_distinct_before_they_are_dealt_out(spark, no_broadcast):
    assert "LeftSemi" not in plan(entry.queries()["record_creators"](spark, SF))


def test_pairs_of_links_are_dealt_out_once(spark, no_broadcast):
    assert "hashpartitioning(uri" not in plan(Q.link_pairs(adapter.catalog(spark, SF)))


def test_profile_deals_facts_out_once_and_counts_distinct_things(spark, no_broadcast):
    links = spark.createDataFrame(
        [("w1", "g", "r", "p", 1, "t1"), ("w1", "g", "r", "p", 2, "t1"), ("w1", "g", "r", "p", 1, "t2"),
         ("w2", "g", "r", "p", 1, "t2"), ("w2", "g", "r", "p", 1, "t2"), ("w3", "g", "r", "p", 1, None), ("w9", "g", "r", "p", 1, "t9")],
        "work string, g string, role string, property string, ordinal int, target string")
    literals = spark.createDataFrame([("w1", "g", "q", "x"), ("w1", "g", "q", "x"), ("w3", "g", "n", None)],
                                     "work string, g string, property string, value string")
    types = spark.createDataFrame([("w1", "g", "C"), ("w1", "g", "C"), ("w1", "g", "D"), ("w2", "g", "C"), ("w3", "g", "C"), ("w4", "g", "C")],
                                  "work string, g string, class string")
    got = Q.data_profile(Catalog(types, links, literals, None, None))
    assert "Expand" not in plan(got)
    assert rows(got, "class", "property", "n_works", "n_values", "fill_rate") == [
        ("C", "n", 1, 0, 0.25), ("C", "p", 3, 2, 0.75), ("C", "q", 1, 1, 0.25), ("D", "p", 1, 2, 1.0), ("D", "q", 1, 1, 1.0)]


def test_quads_and_tables_agree(spark):
    direct = adapter.catalog(spark, SF)
    rebuilt = from_quads(direct.quads().cache())
    for op in (A.counters, A.authors_per_year, A.export_wide, Q.records, Q.stage_counts):
        assert rows(op(rebuilt)) == rows(op(direct))


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append([rows(entry.queries()[q](spark, SF)) for q in
                            ("records_page", "suggest_works", "mint_uris")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_bucketed_tables_need_no_shuffle_by_record(spark):
    spark.sql("create database if not exists shelf")
    store.save_catalog(adapter.catalog(spark, SF), "shelf", 4)
    cat = store.load_catalog(spark, "shelf")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = cat.types.join(cat.state, "g").groupBy("g").count()
        assert "Exchange" not in plan(joined)
        assert rows(Q.stage_counts(cat)) == rows(Q.stage_counts(adapter.catalog(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(AnalysisException):       # a version is never written twice
        store.save_catalog(adapter.catalog(spark, SF), "shelf", 4)
    empty = Catalog(*[getattr(cat, name).limit(0) for name in store.TABLES])
    store.save_catalog(empty, "shelf", 2, version=10)
    assert store.load_catalog(spark, "shelf").types.count() == 0
    assert store.load_catalog(spark, "shelf", 1).types.count() == cat.types.count()


def test_versions_are_kept(spark, quads, tmp_path):
    store.write_version(quads, str(tmp_path), 1)
    store.write_version(quads.limit(3), str(tmp_path), 2)
    assert store.read_version(spark, str(tmp_path), 1).count() == quads.count()
    assert store.read_version(spark, str(tmp_path), 2).count() == 3


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["year", "year_uri", "count"] and got.count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["counters", "export_wide", "records", "record_view", "back_links",
                                  "suggest_topk", "rows_to_quads", "form_quads", "upsert_records",
                                  "daily_quota_stream", "label_update", "load_graph", "import_stream",
                                  "read_batch", "read_records", "read_templates", "import_vocabs",
                                  "browse_filters", "check_columns", "missing_cells"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = db.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in res.description)
    order = [[d[0] for d in res.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in res.fetchall()),
                  key=lambda r: tuple((v is None, str(v)) for v in r))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert rows(got, *columns) == want


def test_record_quads_are_the_facts_of_the_facets(spark, tmp_path, monkeypatch):
    """Repeated and missing keys, names of one URI, names that a type and a brand share."""
    from datetime import date

    from stemma.plans.catalog import to_quads

    tables = {
        "nation": ("n_nationkey int, n_name string", [(1, "Le Pays"), (2, "LE PAYS"), (3, None), (4, "Tin")]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [
            (1, "C 1", 1, "Fur"), (1, "C one", 2, "FUR"), (2, None, 3, None), (3, "C 3", 9, "Fur"), (None, "C", 4, "Oil")]),
        "supplier": ("s_suppkey long, s_name string", [(1, "S 1"), (1, "S one"), (2, None), (None, "S")]),
        "part": ("p_partkey long, p_name string, p_type string, p_brand string", [
            (1, "a b", "Tin", "tin"), (1, "a-b", "TIN", "Tin"), (2, None, None, "B#1"), (3, "c", "Pays", None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string", [
            (1, 1, "O", date(1999, 1, 2), "1-A"), (1, 1, "F", date(1999, 1, 2), "1-A"), (2, 2, "P", None, "9-?"),
            (3, 3, None, date(1998, 1, 2), None), (4, None, "O", date(1998, 1, 2), "2-B"),
            (None, 1, "F", date(1997, 1, 2), "3-C"), (None, 1, "F", date(1997, 1, 2), "3-C"), (5, 7, "F", date(1996, 1, 2), "4-D")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [
            (1, 1, 1, 1), (1, 1, 1, 1), (1, 3, 2, 2), (2, 2, 9, 3), (3, 9, None, 4), (4, 3, 1, 10), (None, 1, 1, 1),
            (None, None, 2, 2), (7, 1, 1, 5)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    cat = adapter.catalog(spark, str(tmp_path))
    monkeypatch.setattr(adapter, "LINES_PER_PARTITION", 4)
    got = cat.quads()
    assert rows(got) == rows(to_quads(cat)) and got.columns == M.QUAD_COLUMNS
    assert got.count() == got.distinct().count() > 100
    # Each source table is read a few times, not once for each kind of fact.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 15


def test_record_quads_are_dealt_by_graph_once(spark, monkeypatch):
    """What meets the quads by graph, or makes them distinct, deals none of them out again."""
    from stemma.operators import lifecycle as L

    monkeypatch.setattr(adapter, "LINES_PER_PARTITION", 500)       # as many partitions as Spark asks for at least
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quads = adapter.catalog(spark, SF).quads()
        graphs = adapter.table(spark, SF, "orders").filter("o_orderstatus = 'P'").selectExpr(f"{adapter.graph_uri()} as g")
        plan = L.clear_graphs(quads, graphs)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g#" not in plan[:plan.index("REPARTITION_BY_NUM")] and "SortMergeJoin [g#" in plan
        assert "hashpartitioning(g#" not in quads.distinct()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
