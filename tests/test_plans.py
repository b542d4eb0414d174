"""What plans must not hold, and what scans must prune."""

import pytest

from glyphmill import registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    if name != "size_range_join":  # a range join against four literal rows
        assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, table, columns", [
    ("anti_unlabelled", "documents", {"doc_id", "source", "n_chars"}), ("export_partition_counts", "lineitem", {"l_returnflag", "l_linestatus", "l_quantity"}),
    ("best_marker", "events", {"event_id", "event_type", "value"}), ("split_random_80_10_10", "documents", {"doc_id"}),
])
def test_scans_read_only_what_is_used(spark, sf, name, table, columns):
    import re

    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?/(\w+)\.parquet", plan(QUERIES[name](spark, sf)))
    read = {c.split("#")[0] for cols, t in scans if t == table for c in cols.split(",") if c}
    assert read == columns


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThanOrEqual(l_discount,0.03)" in plan(QUERIES["line_clusters"](spark, sf)).partition("PushedFilters: ")[2]
