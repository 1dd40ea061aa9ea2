"""The driver contract: registered names, twins and coverage of the inventory."""

import os
import re

import __spark_entry__ as contract
from wirelens import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_twins_belong_to_queries():
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries)
    assert set(queries) & set(catalog.load()) - set(twins) == {
        "fitted_temperature", "model_metrics", "tree_attributions", "scored_spans", "occlusion_attributions", "mode_predictions",
        "external_evaluation"}


def test_every_query_names_what_it_covers():
    assert all(e.covers and all(re.fullmatch(r"[A-Z]\d+", i) for i in e.covers) for e in catalog.load().values())


def test_entry_has_the_features(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 78 and df.count() > 0


def test_coverage_table_is_complete():
    with open(os.path.join(ROOT, "COVERAGE.md"), encoding="utf-8") as fh:
        rows = [line.split("|") for line in fh if re.match(r"\| [A-Z]\d+ \|", line)]
    assert len(rows) == 156 and all(r[3].strip() or r[4].strip() for r in rows)
