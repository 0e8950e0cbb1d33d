"""Routing, moves, catalog and maintenance on small tables: conservation, coverage, idempotence."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from keyloom.operators import move
from keyloom.operators.predicate import PredicateError, column_of
from keyloom.operators.route import route
from keyloom.plans import config as cfg
from keyloom.plans.layout import build_plan
from keyloom.plans.maintain import Maintenance, RunFailed
from keyloom.sources.catalog import Catalog, LockNotAcquired
from keyloom.streaming.ingest import append_batch

TODAY = date(2026, 7, 5)
C = cfg.sliding_monthly("w", "occurred_on", ("id", "occurred_on"), split_row_threshold=2)


def rows(spark, *days):
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, occurred_on date")


def test_maintenance_conserves_rolls_over_and_settles(spark, tmp_path):
    data = rows(spark, date(2024, 6, 15), date(2026, 7, 10), date(2026, 9, 1), date(2026, 9, 2), None, date(2029, 1, 1))
    cat = Catalog(spark, str(tmp_path))
    m = Maintenance(cat, date(2026, 7, 15))
    m.create(C, data)
    m.run_table(C)
    sizes = {r.child: r.rows for r in cat.children_df("w").collect()}
    assert sizes["w_2024_06"] == 1 and sizes["w_2026_09"] == 2 and sizes["w_current"] == 1 and sizes["w_default"] == 1 and sizes["w_future"] == 1
    assert not m.audit(C).gaps and m.rebalance(C)[0] == 0
    later = Maintenance(cat, date(2026, 8, 13))
    later.run_table(C)
    sizes = {r.child: r.rows for r in cat.children_df("w").collect()}
    assert sizes["w_2026_07"] == 1 and sum(sizes.values()) == 6
    assert sorted(r.id for r in cat.read("w").collect()) == list(range(6))
    assert cat.surviving("w", (date(2024, 6, 1), date(2024, 7, 1))) == ["w_2024_06"]
    assert [r.id for r in cat.read("w", key_range=(date(2026, 9, 1), date(2026, 10, 1))).orderBy("id").collect()] == [2, 3]


def test_retention_previews_then_drops(spark, tmp_path):
    from dataclasses import replace

    cat = Catalog(spark, str(tmp_path))
    m, c = Maintenance(cat, TODAY), replace(C, retention_months=12)
    m.create(c, rows(spark, date(2024, 6, 1), date(2026, 7, 1)))
    m.run_table(c)
    assert m.retention(c) == ["w_2024_06"] and cat.read("w").count() == 2
    m.retention(replace(c, retention_apply=True, retention_keep_table=True))
    assert cat.read("w").count() == 1 and "w_2024_06" in cat.manifest("w")["detached"]
    cat.attach("w", "w_2024_06")
    assert cat.read("w").count() == 2


def test_premake_and_race(spark, tmp_path):
    cat, c = Catalog(spark, str(tmp_path)), cfg.premake_monthly("p", "occurred_on", premake_months=2)
    m = Maintenance(cat, TODAY)
    m.create(c, rows(spark, TODAY, date(2026, 9, 30), date(2020, 1, 1), None))
    assert m.premake(c) == ["p_2026_07", "p_2026_08", "p_2026_09"] and m.premake(c) == []
    assert {r.child: r.rows for r in cat.children_df("p").collect()} == {"p_2026_07": 1, "p_2026_08": 0, "p_2026_09": 1, "p_default": 2}
    old = cat.manifest("p")
    cat.set_read_only("p", True)
    with pytest.raises(LockNotAcquired):
        cat.commit("p", old, old["version"])
    assert not [n for n in cat._names(f"{cat.root}/p/manifest") if n.startswith(".")]


def test_run_reports_failures_and_goes_on(spark, tmp_path):
    r = cfg.Registry()
    bad, good = cfg.sliding_monthly("bad", "no_such_column"), cfg.sliding_monthly("good", "occurred_on")
    cat = Catalog(spark, str(tmp_path))
    m = Maintenance(cat, TODAY)
    m.create(good, rows(spark, TODAY))
    cat.register("bad", rows(spark).schema, "no_such_column")
    r.register(bad), r.register(good)
    with pytest.raises(RunFailed) as e:
        m.run(r, continue_on_error=True)
    assert len(e.value.summary.errors) == 1 and e.value.summary.tables[0].table_name == "good"
    assert Maintenance(cat, TODAY).run_table(cfg.sliding_monthly("absent", "d")).skip_reason == "not_partitioned"


def test_many_segments_route_by_join_as_by_case(spark):
    c = cfg.sliding_daily("t", "occurred_on", active_days=90, split_row_threshold=1)
    data = spark.range(200).select("id", F.date_add(F.lit(date(2026, 6, 1)), F.col("id").cast("int")).alias("occurred_on")).union(spark.sql("SELECT -1L, CAST(NULL AS DATE)"))
    segs = list(build_plan(c, TODAY, {date(2026, 7, 5).replace(day=d): 1 for d in range(5, 30, 2)} | {date(2026, 8, d): 1 for d in range(1, 31, 2)} | {date(2026, 9, d): 1 for d in range(1, 30, 2)}).segments)
    assert len(segs) > 40
    joined = route(data, c, segs, TODAY)
    from keyloom.operators.route import child_of

    assert joined.where(F.col("child") != child_of(c, segs, TODAY)).count() == 0 and joined.count() == 201


def test_moves_keep_null_keys_and_upsert_is_conditional(spark):
    src = spark.createDataFrame([(1, TODAY), (1, TODAY), (2, TODAY), (None, TODAY), (None, TODAY)], "id long, occurred_on date")
    dst = spark.createDataFrame([(2, TODAY)], src.schema)
    left, out = move.moved(src, dst, F.lit(True), ["id", "occurred_on"], ["occurred_on", "id"])
    assert left.count() == 0 and sorted(str(r.id) for r in out.collect()) == ["1", "2", "None", "None"]
    with pytest.raises(move.MissingConflictKey):
        move.require_unique(src, ["id", "occurred_on"])
    at = lambda h: datetime(2026, 7, 5, h)
    s = spark.createDataFrame([(1, "new", at(5)), (2, "old", at(1)), (3, "add", at(1))], "id long, v string, updated_at timestamp")
    t = spark.createDataFrame([(1, "x", at(4)), (2, "keep", at(2)), (9, "own", at(1))], s.schema)
    assert sorted((r.id, r.v) for r in move.upserted(s, t, ["id"], "updated_at").collect()) == [(1, "new"), (2, "keep"), (3, "add"), (9, "own")]


def test_predicates_reject_what_they_must():
    for bad in ({"column": "branch; DROP TABLE", "operator": "eq"}, {"column": "branch", "operator": "like"}):
        with pytest.raises(PredicateError):
            column_of(bad)


def test_streamed_batches_are_routed_once(spark, tmp_path):
    from keyloom.streaming.ingest import append_batch, ingest

    cat = Catalog(spark, str(tmp_path / "root"))
    m = Maintenance(cat, TODAY)
    m.create(C, rows(spark, date(2026, 7, 1), date(2026, 7, 2)))
    m.run_table(C)
    late = spark.createDataFrame([(7, date(2026, 7, 3)), (8, date(2020, 1, 1)), (0, date(2026, 7, 1))], "id long, occurred_on date")
    assert append_batch(cat, C, late, TODAY, 0) == 2 and append_batch(cat, C, late, TODAY, 0) == 0
    late.where("id < 100").selectExpr("id + 50 AS id", "occurred_on").write.parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(late.schema).parquet(str(tmp_path / "in")), cat, C, TODAY, str(tmp_path / "ck")).awaitTermination(60)
    assert cat.read("w").count() == 7  # batches are counted by stream
    m.run_table(C)
    assert {r.child: r.rows for r in cat.children_df("w").collect()}["w_2020_01"] == 2 and cat.read("w").count() == 7


def test_command_line(spark, tmp_path, capsys):
    import json

    from keyloom.cli import main

    (tmp_path / "r.json").write_text(json.dumps([cfg.to_document(C)]))
    args = ["--root", str(tmp_path / "root"), "--registry", str(tmp_path / "r.json"), "--all", "--today", "2026-07-05"]
    Maintenance(Catalog(spark, str(tmp_path / "root")), TODAY).create(C, rows(spark, date(2026, 7, 1)))
    main(["plan", *args], spark)
    assert json.loads(capsys.readouterr().out)[0]["changed"]
    with pytest.raises(SystemExit):
        main(["apply", *args], spark)
    main(["apply", *args, "--confirm"], spark)
    assert json.loads(capsys.readouterr().out)["tables"][0]["rows_moved"] == 1
    main(["audit", *args], spark)
    assert json.loads(capsys.readouterr().out)[0]["gaps"] == []


def test_integer_bounds_compare_as_numbers(spark, tmp_path):
    from keyloom.streaming.ingest import append_batch

    cat, c = Catalog(spark, str(tmp_path)), cfg.integer_window("n", "id", active_id_width=10_000, current_band_size=10_000)
    m, ids = Maintenance(cat, TODAY), lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    m.create(c, ids(900, 950))
    m.run_table(c)
    append_batch(cat, c, ids(1000, 2000), TODAY, 0, "a")
    append_batch(cat, c, ids(77, 950), TODAY, 0, "b")
    got = lambda *r: sorted(x.id for x in cat.read("n", key_range=r).collect())
    assert got(1500, None) == [2000] and got(None, 950) == [77, 900] and got(950, 1001) == [950, 1000]
    assert [x.id for x in cat.read("n", key_in=[2000, 5]).collect()] == [2000]
    assert m.compact(c, over=1) == ["n_current"] and got(None, None) == [77, 900, 950, 1000, 2000] and cat.collect_garbage("n", keep_versions=1) >= 3
    assert got(None, None) == [77, 900, 950, 1000, 2000] and cat.orphans("n") == [] and cat.runs("n")[-1]["phase"] == "done"


def test_rebalance_loses_to_ingest_and_keeps_its_rows(spark, tmp_path, monkeypatch):
    from keyloom.streaming.ingest import append_batch

    cat = Catalog(spark, str(tmp_path))
    m = Maintenance(cat, TODAY)
    m.create(C, rows(spark, date(2026, 7, 1), date(2026, 7, 2)))
    write = cat.write_rows

    def late(t, routed):
        monkeypatch.setattr(cat, "write_rows", write)
        append_batch(cat, C, spark.createDataFrame([(9, date(2026, 8, 1))], "id long, occurred_on date"), TODAY, 0)
        return write(t, routed)

    monkeypatch.setattr(cat, "write_rows", late)
    assert m.run_table(C).skip_reason == "lock_not_acquired" and len(m.audit(C).warnings) > 1
    assert m.run_table(C).rows_moved == 3 and sorted(r.id for r in cat.read("w").collect()) == [0, 1, 9]


def test_planning_reads_no_archive(spark, tmp_path, monkeypatch):
    cat = Catalog(spark, str(tmp_path))
    m = Maintenance(cat, TODAY)
    m.create(C, rows(spark, date(2024, 6, 1), date(2026, 7, 10), date(2026, 9, 1), date(2026, 9, 2)))
    m.run_table(C)
    read, opened = cat.read, []
    monkeypatch.setattr(cat, "read", lambda t, **how: opened.append(how["children"]) or read(t, **how))
    assert m.plan(C).hot == (date(2026, 9, 1),) and opened == [["w_current"]]


def test_composites_are_maintained(spark, tmp_path):
    data = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, i % 3, date(2026, 7, 1 + i % 20)) for i in range(60)], "id long, kind string, owner long, day date")
    for n, c in enumerate((cfg.composite_list_hash("t", "kind", ["a", {"name": "b", "value": "b", "modulus": 2}], "owner", 4, ["id"]), cfg.composite_range_hash("t", "day", "owner", 4, ["id"]), cfg.composite_list_range("t", "kind", ["a"], "day", ["id"]))):
        cat, r = Catalog(spark, str(tmp_path / str(n))), cfg.Registry()
        r.register(c)
        m = Maintenance(cat, TODAY)
        m.create(c, data)
        assert not m.run(r).tables[0].skipped
        assert cat.read("t").count() == 60 and m.rebalance(c)[0] == 0
        sizes = {x.child: x.rows for x in cat.children_df("t").collect()}
        want = [{"t_a_a_00", "t_a_a_03", "t_b_a_01"}, {"t_current_a_00", "t_future_a_03"}, {"t_a_current", "t_a_future"}][n]
        assert want <= set(sizes) and "t_b_a_02" not in sizes and sizes["t_default"] == (12, 0, 36)[n]


def test_a_crash_before_the_rename_leaves_the_last_manifest(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register("w", rows(spark).schema, "occurred_on")
    (tmp_path / "w" / "manifest" / ".000000001.json-dead").write_text("{")
    assert cat.manifest("w")["version"] == 0 and cat.commit("w", cat.manifest("w"), 0) == 1


def test_cutover_renames_children_and_back(spark, tmp_path):
    cat, c = Catalog(spark, str(tmp_path)), cfg.sliding_monthly("w_shadow", "occurred_on", ("id", "occurred_on"), split_row_threshold=2)
    m = Maintenance(cat, TODAY)
    m.create(C, rows(spark, TODAY, None))
    m.create(c, rows(spark, TODAY, date(2024, 6, 1), None))
    m.run_table(c)
    m.run_table(C)
    before = {t: {r.child: r.rows for r in cat.children_df(t).collect()} for t in ("w", "w_shadow")}
    cat.set_read_only("w", True)
    cat.switch("w", "w_shadow")
    cat.switch("w", "w_shadow")
    live = {r.child: r.rows for r in cat.children_df("w").collect()}
    assert live == {k.replace("w_shadow", "w"): n for k, n in before["w_shadow"].items()}
    assert {r.child for r in cat.children_df("w_old").collect()} == {"w_old" + k[1:] for k in before["w"]}
    assert m.rebalance(C)[2] is False or cat.read("w").count() == 3
    assert {r.child: r.rows for r in cat.children_df("w").collect()} == live
    cat.unswitch("w", "w_shadow")
    cat.unswitch("w", "w_shadow")
    assert {t: {r.child: r.rows for r in cat.children_df(t).collect()} for t in ("w", "w_shadow")} == before


def test_sync_commits_the_delta_once(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    m, c = Maintenance(cat, TODAY), cfg.sliding_monthly("s", "occurred_on", ("id", "occurred_on"))
    schema = "id long, occurred_on date, version long"
    live = [(1, TODAY, 2), (2, TODAY, 1), (3, date(2026, 6, 1), 1), (4, date(2020, 1, 1), 9), (5, date(2026, 8, 1), 1)]
    m.create(cfg.sliding_monthly("l", "occurred_on", ("id", "occurred_on")), spark.createDataFrame(live, schema))
    m.create(c, spark.createDataFrame([(1, TODAY, 1), (2, TODAY, 3), (4, date(2020, 1, 1), 1), (6, None, 1)], schema))
    m.run_table(c)
    assert m.sync("l", c, "version") == 3 and m.sync("l", c, "version") == 0
    assert sorted((r.id, r.version) for r in cat.read("s").collect()) == [(1, 2), (2, 3), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_future_months_never_overlap(spark, tmp_path):
    cat, seen = Catalog(spark, str(tmp_path)), []
    m = Maintenance(cat, TODAY, lambda message, context: seen.append(message))
    m.create(C, rows(spark, TODAY))
    assert m.ensure_future(C, 4) == [f"w_2026_{i:02d}" for i in range(7, 12)] and seen == ["many_months_ahead"]
    assert m.ensure_future(C) == [] and not any("overlap" in g.message for g in m.audit(C).gaps)
    other = cfg.sliding_monthly("v", "occurred_on", ("id", "occurred_on"))
    m.create(other, rows(spark, TODAY))
    m.run_table(other)
    assert m.ensure_future(other) == []


def test_batches_of_range_composites_wait_in_default(spark, tmp_path):
    cat, c = Catalog(spark, str(tmp_path)), cfg.composite_range_hash("x", "occurred_on", "id", modulus=2, conflict=("id", "occurred_on"))
    m = Maintenance(cat, TODAY)
    m.create(c, rows(spark, TODAY))
    m.run_table(c)
    assert append_batch(cat, c, spark.createDataFrame([(9, TODAY)], "id long, occurred_on date"), TODAY) == 1
    m.run_table(c)
    assert cat.read("x").count() == 2 and cat.manifest("x")["children"]["x_default"]["rows"] == 0
