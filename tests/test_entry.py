"""The driver's entry with and without the training-data operators."""

import importlib.util

import __spark_entry__ as E


def test_every_shop_query_has_an_oracle(monkeypatch):
    monkeypatch.setattr(importlib.util, "find_spec", lambda *a: None)
    names, oracles = set(E.queries()), set(E.oracle_sql())
    assert names == oracles and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_entry_without_the_training_operators(monkeypatch):
    def missing(name, *a):
        raise ModuleNotFoundError(name)
    monkeypatch.setattr(importlib.util, "find_spec", missing)
    assert "dashboard_metrics" in E.queries() and "dashboard_metrics" in E.oracle_sql()
