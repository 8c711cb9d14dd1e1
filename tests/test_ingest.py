from decimal import Decimal

from tenurekit.sources import files, tables
from tenurekit.sources.casts import SOURCE_TABLES, casts_for
from tenurekit.sources.scratch import fresh_folder, shared_folder


def test_odd_text_becomes_null_and_newlines_stay(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e,n\n,nonsense,t,12.345,"two\nlines",x7\n5,2026-01-02 03:04:05+02:00,false,1,"say ""hi""",7\n')
    raw = files.read_csv_strings(spark, str(path))
    typed = files.cast_columns(raw, {"a": "integer", "b": "timestamp", "c": "boolean", "d": "decimal(18,2)", "n": "integer"})
    first, second = typed.collect()
    assert (first.a, first.b, first.c, first.d, first.e, first.n) == (None, None, True, Decimal("12.35"), "two\nlines", None)
    assert (second.a, second.c, second.e, second.n) == (5, False, 'say "hi"', 7)
    assert second.b.isoformat() == "2026-01-02T01:04:05"


def test_cast_maps_cover_nine_tables():
    assert len(SOURCE_TABLES) == 9
    assert casts_for("subscription_terms")["term_started_at"] == "timestamp"
    assert casts_for("subscription_charges")["amount_due"] == "decimal(18,2)"
    assert "subscription_id" not in casts_for("subscriptions")
    assert sum(len(casts_for(t)) for t in SOURCE_TABLES) == 180


def test_ingest_lands_a_typed_table(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("order_id,created_at\n1,2026-01-01\n2,\n")
    counts = files.ingest_csv(spark, str(path), "landed_orders", source="shop.orders", types={"created_at": "timestamp"},
                              storage_path=str(tmp_path / "landed"))
    assert counts == {"n_rows": 2, "created_at": 1}
    landed = tables.read_table(spark, "landed_orders")
    assert dict(landed.dtypes)["created_at"] == "timestamp" and dict(landed.dtypes)["order_id"] == "string"
    assert {"_ingested_at", "_source_file", "_source_table"} <= set(landed.columns)
    assert files.null_counts(landed, ["created_at"]).first().asDict() == {"n_rows": 2, "created_at": 1}


def test_overwrite_may_change_the_schema(spark, tmp_path):
    place = str(tmp_path / "t")
    tables.write_table(spark.range(3), "changing", storage_path=place)
    tables.write_table(spark.range(2).selectExpr("id AS other", "'x' AS s"), "changing", storage_path=place, sort_by=["other"])
    assert tables.read_table(spark, "changing").columns == ["other", "s"]
    assert tables.row_counts(spark, ["changing", "not_there"]).collect()[1].error == "TABLE_OR_VIEW_NOT_FOUND"


def test_scratch_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert fresh_folder(spark, "x").startswith(named)
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")
