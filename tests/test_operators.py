"""Behaviour that the queries don't show: errors, real files, repeated runs, streams."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assetflow.operators import aggregates, blocks, incremental, joins, manifest, predicates, sets, windows, work
from assetflow.plans.pipeline import incremental_run
from assetflow.plans.template import Template
from assetflow.sources import scan, store
from assetflow.streaming.progress import LISTING, STATE, changed_assets, incremental_arrivals, manifest_sink, throttled_progress, timed_progress, write_listing

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def assets(spark, *rows):
    return spark.createDataFrame([(p, i, 1, at(t), f, {}) for i, (p, t, f) in enumerate(rows)], "path string, ord long, size long, mtime timestamp, flags long, captures map<string,string>")


def test_names_of_groups():
    assert predicates.group_names(r"(a)(?<one>b)(?:c)[(](?<two>\(d)") == {"one": 2, "two": 3}


def test_captures_skip_groups_that_took_no_part(spark):
    df = spark.createDataFrame([("ab",), ("a",)], "p string")
    got = [r[0] for r in df.select(predicates.positional_captures(F.col("p"), "(a)(b)?")).collect()]
    assert got == [{"0": "ab", "1": "a", "2": "b"}, {"0": "a", "1": "a"}]


def test_filter_values_overwrite(spark):
    df = assets(spark, ("x/in.txt", 0, 17)).withColumn("captures", F.create_map(F.lit("n"), F.lit("old"), F.lit("k"), F.lit("v")))
    assert blocks.select_inputs(df, r"x/(?<n>.*)\.txt").first()["captures"] == {"k": "v", "n": "in"}


def test_wildcards(spark):
    row = spark.range(1).select(
        predicates.wildcard_match(F.lit("file7.txt"), "file#.*"), predicates.wildcard_match(F.lit("fileX.txt"), "file#.*"), predicates.wildcard_match(F.lit("a.b"), "a?b"),
        predicates.wildcard_match(F.lit("xabcx"), "abc", partial=True), predicates.wildcard_match(F.lit("xabcx"), "*abc", partial=True), predicates.wildcard_match(F.lit("ABC"), "abc", any_case=True),
    ).first()
    assert tuple(row) == (True, False, True, True, False, True)


def test_template_chains_and_strictness(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    a = F.col("a")
    b = Template("{a:upper}").render({"a": a})
    c = Template("{b:lower}").render({"b": b})
    assert df.select(Template("{a}{b}{c}").render({"a": a, "b": b, "c": c})).first()[0] == "aAa"
    with pytest.raises(KeyError, match="last"):
        Template("{first}{last}").render({})
    with pytest.raises(Exception, match="unresolved variable: b"):
        df.select(Template("{b}").render({"b": F.col("b")})).collect()
    assert df.select(Template("{b}{x}.", strict=False).render({"b": F.col("b")})).first()[0] == "."


def test_scans_of_files(spark, tmp_path):
    for name in ("in1.txt", "in2.txt", "in10.txt", "sub/in3.txt", "other.dat"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    found = {r["path"]: r["captures"] for r in scan.scan_regex(spark, root.replace(".", r"\.") + r"/in(?<n>[0-9])\.txt").collect()}
    assert found == {f"{root}/in{i}.txt": {"0": f"{root}/in{i}.txt", "1": str(i), "n": str(i)} for i in (1, 2)}
    assert scan.scan_recursive(spark, root, r".*in[0-9]+\.txt").count() == 4
    assert {r["path"].rpartition("/")[2] for r in scan.scan_wildcard(spark, root, "in##.txt").collect()} == {"in10.txt"}
    (tmp_path / "list").write_text(f" {root}/in1.txt \n\n{root}/gone.txt\n")
    known, rejected = scan.scan_list(spark, f"{root}/list", scan.scan_recursive(spark, root, ".*"))
    assert [r["path"] for r in known.collect()] == [f"{root}/in1.txt"]
    assert [r["path"] for r in rejected.collect()] == [f"{root}/gone.txt"]


def test_literal_prefix():
    assert scan.literal_prefix(r"/data/in/(.*)\.txt") == "/data/in"
    assert scan.literal_prefix(r"[a]/b.txt") == "."


def test_combine_keeps_order_and_single_spaces(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a "), (1, "b")], "ord long, path string")
    assert df.agg(aggregates.combine_all(F.col("path"), F.col("ord"))).first()[0] == "a b c"
    assert df.agg(aggregates.combine_all_quoted(F.col("path"), F.col("ord"))).first()[0] == '"a " "b" "c"'


def test_duplicates_and_missing_dependencies_are_errors(spark):
    paths = spark.createDataFrame([("p", "output", "x"), ("p", "output", "x")], "process string, role string, path string")
    with pytest.raises(ValueError, match="x"):
        aggregates.reject_duplicates(paths)
    with pytest.raises(FileNotFoundError, match="dep"):
        joins.add_dependencies(paths, ["dep"], assets(spark, ("other", 0, 17)))
    with pytest.raises(ValueError, match="itself"):
        blocks.include_blocks("A", {"A": []}, ["A"])


def test_add_input(spark):
    own, up = spark.createDataFrame([("own",)], "path string"), spark.createDataFrame([("up",)], "path string")
    assert {r[0] for r in sets.add_input(own, up, True).collect()} == {"own", "up"}
    assert {r[0] for r in sets.add_input(own, up, False).collect()} == {"own"}


def test_nothing_runs_twice_and_touched_inputs_run_again(spark):
    inputs = assets(spark, ("in1.txt", 0, 17), ("in2.txt", 0, 17))
    steps = blocks.foreach(inputs, {"destination": "{?:file}.out"}).select("transition_id", "dependency", "output", "flags")
    empty = spark.createDataFrame([("gone.out", at(0), 16)], "path string, mtime timestamp, flags long")
    first = incremental_run(steps, inputs, empty, lambda row: row.output)
    assert {(r["dependency"], r["state"]) for r in first.log.collect()} == {("in1.txt", "FINISHED"), ("in2.txt", "FINISHED")}
    assert [r["path"] for r in first.remains.collect()] == ["gone.out"]
    again = incremental_run(steps, inputs, first.manifest, lambda row: row.output)
    assert again.log.count() == 0
    assert again.manifest.count() == 2
    far = datetime.datetime(2100, 1, 1)
    touched = inputs.withColumn("mtime", F.when(F.col("path") == "in2.txt", F.lit(far)).otherwise(F.col("mtime")))
    assert [r["dependency"] for r in incremental_run(steps, touched, first.manifest, lambda row: 1, dry=True).plan.collect()] == ["in2.txt"]
    assert incremental_run(steps, inputs, first.manifest, lambda row: 1, force=True, dry=True).plan.count() == 2


def test_temporaries_between_unchanged_files_stay_unbuilt(spark):
    edges = spark.createDataFrame([("tmp", "in", True, False), ("out", "tmp", False, True)], "output string, dependency string, out_temp boolean, dep_temp boolean")

    def decide(in_time, out_time, in_flags=17, out_flags=17):
        a = spark.createDataFrame([("in", in_flags, at(in_time)), ("tmp", 2, None), ("out", out_flags, at(out_time))], "path string, flags long, mtime timestamp")
        return incremental.decide_temporaries(a.where("path = 'tmp'"), incremental.temporary_inputs(edges, a), incremental.temporary_outputs(edges, a)).first()["flags"]

    assert decide(0, 10) == 2
    assert decide(10, 0) == 14
    assert decide(0, 10, in_flags=21) == 14
    assert decide(0, 10, out_flags=1) == 10


def test_temporary_states_are_those_of_the_closure(spark):
    pairs = [("t1", "in"), ("t2", "t1"), ("t2", "gone"), ("t3", "t1"), ("t3", "t2"), ("out", "t3"), ("t4", "in2"), ("late", "t4"), ("none", "t5")]
    temp = lambda x: x.startswith("t")
    edges = spark.createDataFrame([(o, d, temp(o), temp(d)) for o, d in pairs], "output string, dependency string, out_temp boolean, dep_temp boolean")
    rows = [("in", 21, at(5)), ("in2", 17, at(9)), ("t1", 2, at(7)), ("t3", 2, None), ("out", 17, at(1)), ("late", 25, at(3))]
    a = spark.createDataFrame(rows, "path string, flags long, mtime timestamp")
    for got, want in zip(incremental.temporary_states(edges, a), (incremental.temporary_inputs(edges, a), incremental.temporary_outputs(edges, a)), strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    cycle = spark.createDataFrame([("t1", "t2", True, True), ("t2", "t1", True, True)], edges.schema)
    with pytest.raises(ValueError, match="cycle"):
        incremental.temporary_states(cycle, a)


def test_commands_up_to_the_first_failure(spark):
    rows = [("a", 1, 0), ("a", 2, 3), ("a", 3, 0), ("b", 1, 0), ("b", 2, None), (None, 1, 1), (None, 2, 0)]
    for stop in (windows.stop_at_first_failure, windows.stop_at_first_failure_by_minimum):
        got = stop(spark.createDataFrame(rows, "transition_id string, cmd_ord int, exit_code int"), ["cmd_ord"])
        assert {(r["transition_id"], r["cmd_ord"]): r["executed"] for r in got.collect()} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("b", 2): True, (None, 1): True, (None, 2): False}


def test_combined_parts_are_pieces_of_the_whole(spark):
    rows = [("x" if k % 3 else None, k, f"p{k}" + " " * (k % 2)) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, ord long, path string")
    join = lambda parts: "".join(p if k == 0 or parts[k - 1].endswith(" ") else " " + p for k, p in enumerate(parts))
    for g in ("x", None):
        parts = [r for r in aggregates.combined_parts(df, ["g"], 4).orderBy("part").collect() if r["g"] == g]
        assert [r["part"] for r in parts] == list(range(len(parts))) and all(r["n"] == 4 for r in parts[:-1])
        assert join([r["inputs"] for r in parts]) == join([p for h, _, p in rows if h == g])
    quoted = aggregates.combined_parts(df, [], 100, quoted=True).collect()
    assert [(r["part"], r["n"]) for r in quoted] == [(0, 40)] and quoted[0]["inputs"].startswith('"p0" "p1 " "p2"')


def test_work_on_groups_in_parts(spark):
    df = spark.createDataFrame([(("a", "b", None)[k % 3], k) for k in range(300)], "g string, n long").repartition(5)

    def part(rows):
        if rows["g"].iloc[0] == "b" and (rows["n"] == 100).any():
            raise ValueError("broken")
        return int(rows["n"].sum())

    got = {r["g"]: r for r in work.run_all_merged(df, ["g"], part, lambda sums: sum(map(int, sums))).collect()}
    assert {g: r["result"] for g, r in got.items() if g != "b"} == {"a": str(sum(range(0, 300, 3))), None: str(sum(range(2, 300, 3)))}
    assert got["b"]["state"] == "FAILED" and got["b"]["exit_code"] == -1 and "broken" in got["b"]["error"]


def test_work_in_parts_keeps_its_order_over_levels(spark):
    n = 1000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("h"), F.col("id").alias("n")).repartition(7)
    sizes = spark.sparkContext.accumulator(0)

    def merge(results):
        assert len(results) <= 3
        sizes.add(1)
        return "".join(results)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = work.run_all_merged(df, ["g"], lambda rows: "".join(f"{k} " for k in rows["n"]), merge, order=["n"], width=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["g"]: r["result"].split() for r in got} == {g: [str(k) for k in range(g, n, 2)] for g in (0, 1)} and sizes.value > 10


def test_all_compares_every_input(spark):
    row = spark.createDataFrame([("o", 0, at(5), 17, at(9), None, False)], "output string, flags long, out_mtime timestamp, in_flags long, in_mtime timestamp, dep_mtime timestamp, any_build boolean")
    assert incremental.mark_outputs(row, kind="all").first()["flags"] == 20


def test_work_records_outcomes(spark):
    def do(row):
        if row.x == 0:
            raise RuntimeError("no")
        return -3 if row.x == 1 else 0, row.x

    df = spark.createDataFrame([(0,), (1,), (2,)], "x long")
    got = {r["x"]: (r["state"], r["exit_code"]) for r in work.run_foreach(df, do).collect()}
    assert got == {0: ("FAILED", -1), 1: ("FAILED", 1), 2: ("FINISHED", 0)}
    got = {r["x"]: (r["state"], r["exit_code"]) for r in work.run_foreach(df, do, checking=False).collect()}
    assert got[1] == ("FINISHED", 1)


def test_manifest_pointer_survives_a_broken_write(spark, tmp_path):
    files = spark.createDataFrame([(1, "f", 3, at(0), 0)], "dir_id long, file string, size long, last_modified timestamp, flags long")
    dirs = spark.createDataFrame([(1, "d/")], "dir_id long, dir string")
    root = str(tmp_path / "m")
    store.write_manifest(files, dirs, root)
    files.limit(0).write.parquet(f"{root}/snapshot-broken/file")
    assert store.read_manifest(spark, root)[0].count() == 1


def test_upsert_of_absent_file(spark):
    old = spark.createDataFrame([], "dir_id long, file string, size long, last_modified timestamp, flags long")
    new = spark.createDataFrame([(1, "f", None, None, 1, 1), (1, "f", 5, at(0), 2, 2)], "dir_id long, file string, size long, last_modified timestamp, flags long, seq long")
    assert manifest.upsert(old, new).select("size", "flags").collect() == [(5, 2)]
    absent = manifest.upsert(old, new.where("seq = 1")).select("size", F.unix_seconds("last_modified")).first()
    assert tuple(absent) == (0, -2208988800)


def test_new_directories_get_ids_of_their_own(spark):
    d = spark.createDataFrame([(7, "a/")], "dir_id long, dir string")
    p = spark.createDataFrame([(f"x{i}/f",) for i in range(50)] + [("a/f",), ("f",)], "path string")
    out = manifest.extend_directories(d, p).collect()
    assert len({r["dir_id"] for r in out}) == len({r["dir"] for r in out}) == 52
    assert min(r["dir_id"] for r in out) == 7 and max(r["dir_id"] for r in out) == 58


def test_single_sample_is_measured_from_the_start(spark):
    df = spark.createDataFrame([("s", 1, at(0), 2.0, 10.0), ("s", 2, at(2), 4.0, 10.0), ("s", 3, at(4), 4.0, 10.0)], "series string, event_id long, ts timestamp, value double, total double")
    got = [(r["recent_speed"], r["eta_ms"], r["percent"]) for r in windows.with_progress(df).orderBy("ts").collect()]
    assert got == [(float("inf"), float("inf"), 20.0), (2.0, 2000.0, 60.0), (0.0, 0.0, 100.0)]


@pytest.mark.parametrize("progress", [windows.with_progress, windows.with_progress_by_ranges])
def test_samples_that_tie_count_together(spark, progress):
    rows = [("s", 1, at(0), 2.0, 20.0)] * 2 + [("s", 2, at(2), 3.0, 20.0)] * 3 + [("s", 3, at(2), 7.0, 20.0)]
    df = spark.createDataFrame(rows, "series string, event_id long, ts timestamp, value double, total double")
    got = progress(df).select("event_id", "current", "percent", "global_speed").collect()
    assert sorted(map(tuple, got)) == [(1, 4.0, 20.0, float("inf"))] * 2 + [(2, 13.0, 65.0, 6.5)] * 3 + [(3, 20.0, 100.0, 0.0)]


@pytest.mark.parametrize("history", [1, 3, 8])
def test_progress_by_ranges_is_that_of_whole_series(spark, history):
    rng = random.Random(history)
    rows = [(("hot", "b", None)[0 if k % 3 else rng.randrange(3)], k, at(k // 4), float(rng.randrange(5)), 400.0) for k in range(200)]
    df = spark.createDataFrame(rows, "series string, event_id long, ts timestamp, value double, total double")
    want = windows.with_progress(df, history).orderBy("event_id").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = windows.with_progress_by_ranges(df, history).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and len(got) == 200


def test_throttled_stream_equals_batch(spark, tmp_path):
    rows = [("a", at(i / 4), 1.0) for i in range(20)] + [("a", at(100), 1.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = throttled_progress(stream, delay="1 second").writeStream.outputMode("append").format("memory").queryName("throttled").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT * FROM throttled").collect()}
    want = {tuple(r) for r in throttled_progress(df).where(F.col("second") < F.lit(at(100))).collect()}
    assert got == want


def test_timed_stream_gives_the_last_second_too(spark, tmp_path):
    rows = [("a", at(i / 4), 1.0) for i in range(20)] + [("a", at(100), 1.0), ("b", at(3.5), 2.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = timed_progress(stream).writeStream.outputMode("append").format("memory").queryName("timed").trigger(processingTime="500 milliseconds").start()
    want = {tuple(r) for r in throttled_progress(df).collect()}
    for _ in range(60):
        got = [tuple(r) for r in spark.sql("SELECT * FROM timed").collect()]
        if len(got) >= len(want):
            break
        time.sleep(1)
    q.stop()
    assert set(got) == want and len(got) == len(want)


def test_files_arrive_again_when_they_change(spark, tmp_path):
    root, came = str(tmp_path), []
    sink = manifest_sink(spark, f"{root}/manifest")

    def apply(batch, number):
        came.append(sorted(r["path"] for r in batch.select("path").collect()))
        sink(batch, number)
        before = store.newest_snapshot(spark, f"{root}/manifest")
        sink(batch, number)  # a batch that comes again changes nothing
        assert store.newest_snapshot(spark, f"{root}/manifest") == before

    def listed(number, *rows):
        write_listing(spark.createDataFrame(rows, "path string, size long, mtime timestamp"), f"{root}/in", number)

    def run():
        came.clear()
        incremental_arrivals(spark, f"{root}/in", f"{root}/checkpoint", apply).awaitTermination()
        return [x for x in came if x]

    listed(0, ("d/a", 1, at(0)), ("d/b", 2, at(0)), ("e/c", None, None))
    assert run() == [["d/a", "d/b", "e/c"]]
    listed(1, ("d/a", 1, at(0)), ("d/b", 2, at(5)), ("e/c", None, None))
    assert run() == [["d/b"]] and run() == []
    # Less than a second later counts as the same time, another size doesn't.
    listed(2, ("d/a", 1, at(0.5)), ("d/b", 9, at(5)), ("e/c", 4, at(7)))
    listed(3, ("d/a", 1, at(0.9)), ("d/b", 9, at(5)), ("e/c", 4, at(7)), ("new", 1, at(1)))
    assert run() == [["d/b", "e/c", "new"]]
    files, directories = store.read_manifest(spark, f"{root}/manifest")
    got = {r["path"]: (r["size"], r["last_modified"]) for r in joins.manifest_join(files, directories).collect()}
    assert got == {"d/a": (1, at(0)), "d/b": (9, at(5)), "e/c": (4, at(7)), "/new": (1, at(1))}


def test_two_writers_of_one_snapshot_are_found_out(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([(1, "f", 3, at(0), 0)], "dir_id long, file string, size long, last_modified timestamp, flags long")
    dirs = spark.createDataFrame([(1, "d/")], "dir_id long, dir string")
    root = str(tmp_path / "m")
    store.write_manifest(files, dirs, root)
    real, seen = store._pointers, []
    old = spark.createDataFrame(real(spark, root).collect(), "number long, name string, batch long")
    # The second writer looks before the first one has written.
    monkeypatch.setattr(store, "_pointers", lambda s, r: old if not seen and not seen.append(1) else real(s, r))
    store.write_manifest(files, dirs, root)
    seen.clear()
    with pytest.raises(RuntimeError, match="two writers"):
        store.write_manifest(files, dirs, root)
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="two writers"):
        store.read_manifest(spark, root)


def test_patterns_with_and_without_literal_directories(spark):
    a = spark.createDataFrame([("a/b/c1.txt",), ("d.txt",)], "path string")
    p = spark.createDataFrame([(r"a/b/c[0-9]\.txt",), (r"a/x/.*",), (r".*\.txt",), (r"[d]\.txt",), ("d.txt",), ("b/.*",)], "pattern string")
    got = {r["pattern"]: r["rexists"] for r in joins.with_pattern_exists(p, a).collect()}
    assert [got[r[0]] for r in p.collect()] == ["true", "false", "true", "true", "true", "false"]


def test_patterns_by_their_literals(spark):
    assert [joins.required_literal(p) for p in (r"/data/in/[0-9]+\.txt", r"x/a?bc{2}def+gh", r"(?:ab|c)/d[\]x]efg\.h", r"[]a]xyz[^]b]", r"a|bcd", r"(?i)abc", r"\x41bcd", r"\Qabc\E", r"ab(c|d)", "")] == [
        "/data/in/", "x/", "efg.h", "xyz", "", "", "", "", "ab", ""
    ]
    rng = random.Random(4)
    names = ["".join(rng.choice("ab/.1é") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    piece = lambda: rng.choice(["a", "b", "/", r"\.", ".", "1?", "a*", "b+", "[ab1]", "(a|b/)", "(?:1|)", "é{1,2}", "ab/", r"\d", "[^/]+"])
    patterns = sorted({"".join(piece() for _ in range(rng.randint(1, 6))) for _ in range(200)})
    a = spark.createDataFrame([(n,) for n in names], "path string")
    p = spark.createDataFrame([(x,) for x in [*patterns, None]], "pattern string")
    got = {r["pattern"]: r["rexists"] for r in joins.with_pattern_exists(p, a).collect()}
    assert got == {x: str(any(re.fullmatch(x, n, re.ASCII | re.DOTALL) for n in names)).lower() for x in patterns} | {None: "false"}


def test_absolute_patterns_make_no_nested_loop(spark):
    a = spark.range(5000).select(F.concat(F.lit("/data/in/"), "id", F.lit(".txt")).alias("path"))
    p = spark.range(1, 300).select(F.concat(F.lit("/data/in/"), "id", F.lit(r"[0-9]\.txt")).alias("pattern"))
    out = joins.with_pattern_exists(p, a)
    assert {r["rexists"] for r in out.collect()} == {"true"}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_cycles_are_an_error(spark):
    edges = spark.createDataFrame([("a", "r"), ("b", "a"), ("a", "b")], "output string, dependency string")
    with pytest.raises(ValueError, match="cycle"):
        incremental.dag_level(edges, most_rounds=6)


def test_changes_of_a_batch_of_listings_without_python(spark, capsys):
    rng = random.Random(7)
    rows = [(f"p{k % 9}", rng.choice([None, 1, 2]), rng.choice([None, at(0), at(0.5), at(1), at(3)]), k // 9) for k in range(108)]
    seen, want = {"p0": (at(0), 1), "old": (None, -1)}, []
    known = spark.createDataFrame([("p0", None, 1, []), ("old", None, -1, [])], STATE).withColumn("time", F.when(F.col("path") == "p0", F.unix_micros(F.lit(at(0)))))
    for path, size, time_, number in rows:
        last, bytes_ = seen.get(path), -1 if size is None else size
        later = last is not None and None not in (time_, last[0]) and (time_ - last[0]).total_seconds() >= 1
        if last is None or later or bytes_ != last[1] or (last[0] is None) != (time_ is None):
            seen[path] = (time_, bytes_)
            want.append((path, size, time_, number))
    out = changed_assets(known, spark.createDataFrame(rows, LISTING))
    out.explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas"))
    got = out.collect()
    assert sorted(((r["path"], *x) for r in got for x in r["came"]), key=lambda x: (x[0], x[3])) == sorted(want, key=lambda x: (x[0], x[3]))
    assert {r["path"]: r["size"] for r in got} == {k: v[1] for k, v in seen.items()}
