from __future__ import annotations

import pytest

import __spark_entry__
from mnemora.plans import catalog, ingest_queries

from .five_notes import NOTES, NOTES_SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, same, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["id", "source_label", "target_label", "current_weight", "days_since", "days_left"]


NOTE_QUERIES = ("extract_structural", "extract_custom", "causal_sections", "mention_dedup", "note_nodes", "note_cooccurrence", "explicit_edges", "causal_edges", "temporal_edges_capped", "note_nodes_after_changes", "note_cooccurrence_after_changes", "note_memories", "note_episodes")


@pytest.mark.parametrize("name", NOTE_QUERIES)
def test_note_query_on_five_notes(spark, sf_dir, same, name):
    """The queries over the tables' notes, and their SQL, on notes that have every pattern."""
    own = spark.createDataFrame(NOTES, "file string, section string, heading string, line long, content string, date string")
    assert ingest_queries.NOTES_SQL in catalog.ORACLES[name]
    same(catalog.QUERIES[name](spark, sf_dir, own), catalog.ORACLES[name].replace(ingest_queries.NOTES_SQL, NOTES_SQL))
