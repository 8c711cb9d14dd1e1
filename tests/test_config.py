from datetime import date

import pytest

from tenurekit.config import Calendar, TableNames


def test_cutoffs_keep_their_distances():
    cal = Calendar()
    assert cal.cancel_flag_cutoff == date(2026, 7, 1)
    assert cal.start_cutoff == date(2026, 6, 1)
    assert cal.renewal_cutoff == date(2026, 5, 31)


def test_names_are_layered():
    names = TableNames.load(env={})
    assert names.table("silver", "subscriptions") == "spark_catalog.default.silver_subscriptions"
    assert names.table("bronze", "x").endswith("bronze_x")
    assert names.table("gold", "x").endswith("gold_x")
    assert names.landing_file("orders").endswith("/orders.csv")


def test_environment_wins_over_file(tmp_path):
    conf = tmp_path / "tables.toml"
    conf.write_text('catalog = "lake"\nschema = "study"\n[prefixes]\nsilver = "s_"\n')
    plain = TableNames.load(conf, env={})
    assert plain.table("silver", "t") == "lake.study.s_t"
    assert plain.table("gold", "t") == "lake.study.gold_t"
    env = {"TENURE_CATALOG": "mine", "TENURE_SCHEMA": "own", "TENURE_SILVER_PREFIX": "p_"}
    assert TableNames.load(conf, env=env).table("silver", "t") == "mine.own.p_t"


def test_missing_file_gives_defaults(tmp_path):
    assert TableNames.load(tmp_path / "none.toml", env={}) == TableNames()


def test_unknown_layer_is_an_error():
    with pytest.raises(KeyError):
        TableNames().table("platinum", "t")
