"""Golden lists of the layout maths, and the registry. Business date 2026-07-05."""

import json
from datetime import date

import pytest

from keyloom.functions import calendar as cal
from keyloom.plans import config as cfg
from keyloom.plans import diff
from keyloom.plans.layout import bound_clause, build_plan, parse_bound
from keyloom.plans.model import MAX, Segment, signature

TODAY = date(2026, 7, 5)


def rows(plan):
    return [(s.name, str(s.start), str(s.end)) for s in plan.segments]


def test_two_hot_months_leave_numbered_fillers():
    c = cfg.sliding_monthly("user_workdays", "occurred_on")
    plan = build_plan(c, TODAY, {date(2026, 9, 1): 100_000, date(2026, 12, 1): 100_000, date(2027, 1, 1): 99_999})
    assert [r[0] for r in rows(plan)] == ["user_workdays_current", "user_workdays_2026_09", "user_workdays_open", "user_workdays_2026_12", "user_workdays_open_2", "user_workdays_future"]
    assert rows(plan)[4][1:] == ("2027-01-01", "2027-07-01") and plan.segments[-1].end == MAX


def test_hot_first_bucket_has_no_current():
    plan = build_plan(cfg.sliding_monthly("t", "d", active_months=3), TODAY, {date(2026, 7, 1): 10**6})
    assert [r[0] for r in rows(plan)] == ["t_2026_07", "t_open", "t_future"]


def test_rolling_never_splits_and_year_window():
    assert len(build_plan(cfg.rolling_current("t", "d"), TODAY, {date(2026, 9, 1): 10**9}).segments) == 2
    assert rows(build_plan(cfg.calendar_year("events", "d"), TODAY, {}))[0] == ("events_current", "2026-01-01", "2028-01-01")


def test_integer_hash_and_list():
    c = cfg.integer_window("events", "id", active_id_width=5_000_000, split_row_threshold=50)
    plan = build_plan(c, TODAY, {1_000_000: 100})
    assert plan.segments[1].name == "events_ids_1000000_2000000" and bound_clause(plan.segments[1]) == "FOR VALUES FROM (1000000) TO (2000000)"
    assert bound_clause(plan.segments[-1]) == "FOR VALUES FROM (5000000) TO (MAXVALUE)"
    h = build_plan(cfg.hash_branches("p", "w", modulus=4, split_row_threshold=10), TODAY, {2: 100})
    assert [s.name for s in h.segments] == ["p_a_00", "p_a_01", "p_h_02", "p_a_03"] and bound_clause(h.segments[0]) == "FOR VALUES WITH (modulus 4, remainder 0)"
    assert [bound_clause(s) for s in build_plan(cfg.list_split("t", "b", ["cached", None]), TODAY, {}).segments] == ["FOR VALUES IN ('cached')", "FOR VALUES IN (NULL)"]


@pytest.mark.parametrize("text", ["DEFAULT", "FOR VALUES FROM ('2026-07-01') TO (MAXVALUE)", "FOR VALUES FROM (-5) TO (5)", "FOR VALUES IN ('it''s', NULL)", "FOR VALUES WITH (modulus 4, remainder 1)"])
def test_bounds_parse(text):
    out = parse_bound(text)
    assert out in ({"default": True}, {"start": date(2026, 7, 1), "end": MAX}, {"start": -5, "end": 5}, {"values": ["it's", None]}, {"modulus": 4, "remainder": 1})


def test_dedicated_child_overrides_count():
    c = cfg.integer_window("t", "id")
    assert build_plan(c, TODAY, {0: 50_000}, {0: 150_000}).hot == (0,)
    assert build_plan(c, TODAY, {0: 150_000}, {0: 50_000}).hot == ()


@pytest.mark.parametrize("bucket,name,start", [("day", "2026_07_07", date(2026, 7, 7)), ("week", "2026_W28", date(2026, 7, 6)), ("month", "2026_07", date(2026, 7, 1)), ("quarter", "2026_Q3", date(2026, 7, 1)), ("year", "2026", date(2026, 1, 1))])
def test_names_round_trip(bucket, name, start):
    assert cal.child_name("events", date(2026, 7, 7), bucket) == f"events_{name}" and cal.parse_child("events", f"events_{name}", bucket) == start


def test_calendar_edges():
    assert cal.add_months(date(2026, 7, 5), -3) == date(2026, 4, 1)
    assert cal.suffix(date(2027, 1, 1), "week") == "2026_W53"
    assert cal.parse_child("t", "t_2026_13", "month") is None and cal.normalize("nonsense") == "month"


def test_diff_gaps_and_signature():
    old = [Segment("e_current", date(2026, 7, 1), date(2027, 7, 1), "filler"), Segment("e_future", date(2027, 7, 1), MAX, "future")]
    new = [Segment("e_current", date(2026, 7, 1), date(2026, 9, 1), "filler"), Segment("e_2026_09", date(2026, 9, 1), date(2026, 10, 1), "hot_bucket"), old[1]]
    assert {o.segment.name: o.action for o in diff.operations(old, new)} == {"e_current": "reshape", "e_2026_09": "create", "e_future": "keep"}
    assert len(diff.gaps([new[0], old[1]])) == 1 and not diff.gaps(old)
    assert not diff.gaps([Segment("a", 0, 2000, "filler"), Segment("b", 2000, 10000, "filler"), Segment("c", 10000, MAX, "future")])
    assert signature([Segment("events_current", date(2026, 7, 1), date(2027, 7, 1), "filler"), Segment("events_future", date(2027, 7, 1), MAX, "future")]) == "4cb0f8109671016a"


def test_audit_warnings():
    c = cfg.sliding_monthly("events", "d")
    a = diff.audit(c, [Segment("events_current", date(2026, 7, 1), date(2026, 7, 20), "filler"), Segment("events_future", date(2026, 7, 20), MAX, "future")], 42, TODAY)
    assert a.horizon_days == 15 and a.warnings == ["default partition events_default has 42 rows", "partition horizon is 15 days ahead (below 30)"]
    assert diff.audit(c, [], None, TODAY).warnings == ["default partition is missing"]
    assert diff.audit(cfg.hash_branches("h", "w"), [], None, TODAY).warnings == []


def test_registry_documents():
    r = cfg.Registry()
    doc = {"table_name": "t", "layout": "sliding_window", "partition_key_column": "d", "conflict_key": ["id", "d"], "bucket": "week", "active_weeks": 8}
    assert r.load(json.dumps({"tables": [doc]}))[0].span == 8 and json.loads(r.export()) == [doc]
    for broken in ({"layout": "odd"}, {"surprise": 1}, {"conflict_key": []}, {"active_weeks": 1000}, {"bucket": "hour"}):
        with pytest.raises(cfg.ConfigError):
            cfg.from_document(doc | broken)
    c = cfg.composite_list_hash("packages", "branch", ["cached", {"name": "workspace", "value": "workspace", "modulus": 16}], "workspace_id", 8)
    assert [(n.table_name, n.layout, n.modulus) for n in cfg.expand(c)] == [("packages", "list_split", 32), ("packages_cached", "hash_branches", 8), ("packages_workspace", "hash_branches", 16)]
    with pytest.raises(cfg.ConfigError):
        cfg.Registry(strict=True).register(cfg.sliding_monthly("t", "d", maintenance_backend="external"))
