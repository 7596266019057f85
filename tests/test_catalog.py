"""Every traffic query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from netlens.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


SAMPLE = [
    "bps", "pps_ignoremac", "averagelatency", "flowcounts", "bps2_bins", "tcprsts_bins", "bps_minmax", "bps_tags", "sessions_merged", "topn_timeouts_service", "topn_latencies_destination", "datastreams", "packet_loss_latency",
    "jitter", "sessionaudit", "icmpwalk_detail", "icmp6walk_summary", "icmp6walk_detail", "dns_servers", "ftp_sessions", "http_records", "httt_roots", "tls_tracker", "voip_summary", "rollup_ps", "bps_with_rollup", "events_delta", "svcd_counters", "workinghours_tags", "report_tcp_page", "probe_binned", "describe_edge", "anomaly_prepared",
    "bps_ips6", "bps_userapps", "sessions_whole", "datastreams_whole", "topn_bytes_source6", "topn_bytes_with_rollup_filtered", "rollup_ps2", "voip_jitter", "http_records_regex", "probe_latest", "report_tcp_events_tcprsts", "raw_remarks",
    "sessions_in_files", "payload_parts", "payload_heads", "datastreams_regex",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, DATA)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert {c: TYPES.get(k, k) for c, k in mine.dtypes} == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    order = sorted(mine.columns)
    assert sorted(map(repr, map(tuple, mine.select(*[f"`{c}`" for c in order]).collect()))) == sorted(map(repr, theirs.select(*[f'"{c}"' for c in order]).fetchall()))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
