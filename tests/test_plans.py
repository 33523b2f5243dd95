"""Plan-shape checks: the physical plans we rely on at scale."""

import contextlib
import io
import re

from autokpi.operators import extract, frame, insights, kpi, quality
from autokpi.plans.fixtures import fixture, table
from autokpi.plans.registry import QUERIES, load_all

from conftest import SF_SMALL

load_all()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_w1_shuffles_once_after_the_daily_aggregate(spark):
    p = plan(kpi.kpi_metrics(fixture(spark, SF_SMALL, "fx_frame")))
    exchanges = re.findall(r"Exchange \(\d+\)", p)
    # partial -> final daily sum, then one exchange by kpi_name; weekday windows reuse it
    assert len(exchanges) == 2
    assert "hashpartitioning(kpi_name" in p and "partial_sum" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p


def test_literal_as_of_reaches_the_scan(spark):
    ev = table(spark, SF_SMALL, "events").select("ts", "value")
    p = plan(frame.trailing(ev, "ts", 30, "2024-01-30"))
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThan\(ts,", p)
    p = plan(extract.daily_totals(table(spark, SF_SMALL, "orders"), "o_totalprice", "o_orderdate", "Orders",
                                  as_of="2001-08-01"))
    assert "GreaterThan(o_orderdate," in p and "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in p


def test_topk_per_group_uses_window_group_limit(spark):
    logs = fixture(spark, SF_SMALL, "fx_validation_logs")
    assert "WindowGroupLimit" in plan(quality.newest_logs(logs, 20))
    assert "WindowGroupLimit" in plan(QUERIES["j7_related_kpis"](spark, SF_SMALL))


def test_correlation_multiplies_blocks_without_pivot_or_pair_join(spark):
    p = plan(insights.kpi_correlation(fixture(spark, SF_SMALL, "fx_frame")))
    assert "Pivot" not in p and "FlatMapCoGroupsInArrow" in p and "CartesianProduct" not in p


def test_no_nested_loop_or_cartesian_join_in_library_queries(spark):
    # the only exceptions: joins on a literal (template id, department id), folded by the optimizer, and of two one-row results
    allowed = {"p13_runtime_config", "j4_department_directory", "a21_template_list", "l1_sync_combined", "l1_sync_briefing"}
    for name, fn in QUERIES.items():
        if name in allowed:
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name
