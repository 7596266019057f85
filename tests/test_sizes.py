"""What only larger tables show: pages behind the month, and plans that hold more in a task than they must."""

import datetime
import re

import duckdb
import pytest

from netlens.operators import rollup
from netlens.plans import catalog
from netlens.sources import rollups

MONDAY = datetime.datetime(2024, 1, 1)
KINDS = ("click", "view", "purchase", "signup", "error")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few users' events of a week, and pages of which the last are requested after the month."""
    root = str(tmp_path_factory.mktemp("sizes"))
    events = [(k, MONDAY + datetime.timedelta(seconds=37 * k, microseconds=k), k % 30, KINDS[k % 7 % 5], 50.0 + k % 90, "{}") for k in range(2000)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{root}/events.parquet")
    pages = [(k, f"https://h{k % 3}.example/p{k % 5}", "") for k in [*range(40), *range(44_700, 44_740)]]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(k, t, "user", "x") for k in range(30) for t in range(4)], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def equal(spark, folder, name):
    duck = duckdb.connect()
    for table in ("events", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    mine, theirs = catalog.queries()[name](spark, folder), duck.sql(catalog.oracle_sql()[name])
    order = sorted(mine.columns)
    own = sorted(map(repr, map(tuple, mine.select(*order).collect())))
    assert own and own == sorted(map(repr, theirs.select(*[f'"{c}"' for c in order]).fetchall()))
    return mine


def plan(df, kind):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_requests_behind_the_month_are_ranked(spark, folder):
    ranked = equal(spark, folder, "topn_httperrors_from_rollup")
    assert ranked.count() == catalog.queries()["topn_httperrors"](spark, folder).count()


def test_remarks_of_all_protocols_meet_the_sessions_once(spark, folder):
    out = equal(spark, folder, "raw_remarks")
    assert len(re.findall(r"Join ", plan(out, "optimizedPlan"))) == 1
    assert "ShuffledHashJoin" in plan(out, "executedPlan")


def small_tasks(monkeypatch):
    monkeypatch.setattr(rollup, "FACTS_A_TASK", 100)  # 2,000 facts: 20 tasks, more than Spark's own 4


def test_seconds_are_added_up_in_tasks_of_bounded_size(spark, folder, monkeypatch):
    small_tasks(monkeypatch)
    for name in ("rollup_ps2", "rollup_ps"):
        found = plan(equal(spark, folder, name), "executedPlan")
        assert "ShuffledHashJoin" in found and re.search(r"hashpartitioning\(session_id#\d+L?, second#\d+L?, 20\)", found), name


def test_grains_are_added_up_in_wide_rows(spark, folder, monkeypatch):
    small_tasks(monkeypatch)
    found = plan(equal(spark, folder, "rollup_grains"), "executedPlan")
    assert "Expand" not in found and "ShuffledHashJoin" in found
    assert re.search(r"hashpartitioning\(minute#\d+L?, ip#\d+L?, 20\)", found)


@pytest.mark.parametrize("name, built", [("stored_topn_bytes_service_vlan", set()), ("stored_flowcounts", {"flows"}), ("stored_dns", {"dns"}), ("stored_averagelatency_tag", {"signature_seconds"}), ("stored_bps", {"seconds"}), ("stored_topn_packets_destination_app6", {"pairs"})])
def test_a_query_builds_the_rollup_that_it_reads(spark, folder, name, built):
    rollups._made.clear()
    catalog.queries()[name](spark, folder)
    noted = {r[0].split("/")[0] for made in rollups._made.values() for r in made._noted()}
    assert noted == built


def test_stored_answers_of_all_rollups_equal_sql(spark, folder):
    for name in ("stored_flowcounts", "stored_dns", "stored_averagelatency_tag", "stored_topn_bytes_service", "stored_topn_latencies_source"):
        equal(spark, folder, name)


def test_dns_rollups_read_no_round_trips(spark, folder):
    assert "tail" not in plan(equal(spark, folder, "rollup_dns"), "optimizedPlan")
    assert "tail" in plan(equal(spark, folder, "dns_servers"), "optimizedPlan")
