"""DM9 on stored tables: every table, a second run, a writer in between, refusals."""

import pytest
from pyspark.sql import functions as F

from tillpoint.jobs import migrations as MG
from tillpoint.sinks.versions import VersionedTables
from tillpoint.sources.schemas import SCHEMAS
from tillpoint.streaming.live_totals import scratch_path


@pytest.fixture
def store(spark):
    return VersionedTables(spark, scratch_path(spark, "migrations-test"))


def test_every_table_gets_its_missing_columns_once(spark, tables, store):
    added = {}
    for step in MG.MIGRATIONS:
        added.setdefault(step.table, set()).update(step.columns)
    old = {n: getattr(tables, n).limit(20).drop(*added.get(n, ())) for n in SCHEMAS}
    old["suppliers"] = old["suppliers"].withColumn("rating", F.lit(7))
    store.commit(0, old, "load")
    version, ran = MG.migrate(store)
    assert ran == [m.number for m in MG.MIGRATIONS] and version == 2
    view = store.at()
    assert view.manifest["schema_version"] == MG.LATEST and "categories" not in view.manifest["changed"]
    for name, schema in SCHEMAS.items():
        now = getattr(view, name)
        assert now.columns[: len(schema)] == schema.fieldNames(), name
        assert [f.dataType for f in now.schema][: len(schema)] == [f.dataType for f in schema], name
        assert now.count() == old[name].count()
    assert {r[0] for r in view.suppliers.select("rating").collect()} == {7}
    assert {tuple(r) for r in view.sales.select("employee_name", "total_amount").collect()} == {("System", 0)}
    item = view.inventory_items.first()
    assert (item["barcode"], item["status"], item["reorder_level"]) == (f"LEGACY-{item['id']}", "Out of Stock", 10)
    assert MG.migrate(store) == (2, []) and store.current() == 2
    store.commit(2, {"categories": view.categories}, "other")
    assert store.at().manifest["schema_version"] == MG.LATEST  # later commits keep it


def test_tables_with_all_columns_are_not_rewritten(spark, tables, store):
    store.commit(0, {n: getattr(tables, n).limit(5) for n in ("sales", "inventory_items")}, "load")
    assert MG.migrate(store) == (2, [])
    assert store.at().manifest["changed"] == []


def test_repeated_and_blank_barcodes_are_mended(spark, tables, store):
    items = tables.inventory_items.where("id BETWEEN 1 AND 4").withColumn("barcode", F.when(F.col("id") < 3, F.lit("A")).when(F.col("id") == 3, F.lit(" ")).otherwise(F.lit(" B ")))
    store.commit(0, {"inventory_items": items}, "load")
    assert MG.migrate(store) == (2, [3])
    codes = {r["id"]: r["barcode"] for r in store.at().inventory_items.collect()}
    assert {i: codes[i] for i in (1, 2, 3)} == {1: "A", 2: "LEGACY-2", 3: "LEGACY-3"} and codes[4].strip() == "B"


def test_a_commit_in_between_is_kept(spark, tables, store, monkeypatch):
    store.commit(0, {"sales": tables.sales.limit(5).drop("employee_name"), "categories": tables.categories.limit(9)}, "load")
    commit, once = store.commit, []

    def late(base, *args, **kwargs):
        if not once:
            once.append(commit(base, {"categories": tables.categories.limit(3)}, "other"))
        return commit(base, *args, **kwargs)

    monkeypatch.setattr(store, "commit", late)
    assert MG.migrate(store) == (3, [6])
    assert store.at().categories.count() == 3 and "employee_name" in store.at().sales.columns


def test_a_missing_key_is_refused_and_nothing_changes(spark, tables, store):
    store.commit(0, {"categories": tables.categories.select("category_name")}, "load")
    with pytest.raises(ValueError, match="categories lacks category_id"):
        MG.migrate(store)
    assert store.current() == 1
