"""Every registered query with an oracle, at the smallest scale; a few per kind to stay quick."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["suppress", "assign_parents", "reading_order", "label_regions", "clean_answer", "page_report", "diagnose", "otsu", "dilate",
         "mask_subtract", "attempt_outcomes", "sweep", "note_rate", "incremental_ingest"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["page", "regions", "sfx_kept", "translated", "untranslated", "residue", "overflow", "notes"] and df.count() > 0
