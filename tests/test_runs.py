"""Whole pipelines over several runs: chains, all and none, temporaries, touched inputs, failures, remains."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from assetflow.operators import blocks, incremental, joins, windows
from assetflow.plans import pipeline
from assetflow.plans.pipeline import all_step, foreach_of_all_step, foreach_step, incremental_run, none_step, pipeline_run
from assetflow.sources import scan, store

ASSET = "path string, ord long, mtime timestamp, flags long, captures map<string,string>"
FAR = datetime.datetime(2100, 1, 1)


def inputs(spark, *names, touched=()):
    old = datetime.datetime(2024, 1, 1)
    rows = [(f"{n}.txt", i, FAR if n in touched else old, 17, {"num": n[-1]}) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, ASSET)


def nothing(spark):
    return spark.createDataFrame([], "path string, mtime timestamp, flags long")


def again(steps, given, before, work=lambda row: len(row.outputs), **more):
    """A run whose assets are the inputs and what the run before has left."""
    there = before.where("mtime IS NOT NULL").select("path", "mtime", "flags")
    return pipeline_run(steps, given.select("path", "mtime", "flags").unionByName(there), before.select("path", "flags"), work, **more)


def paths(df, column="path"):
    return sorted(r[0] for r in df.select(column).collect())


def built(run):
    return sorted(p for r in run.log.where("state = 'FINISHED'").collect() for p in r["outputs"])


def there(run):
    return paths(run.manifest.where("mtime IS NOT NULL"))


def test_union_then_reduce(spark):
    given = inputs(spark, "in1", "in2", "in3")
    none = blocks.none(spark, {"destination": "l1_10.txt"})
    each = blocks.foreach(given, {"destination": "l1_{num}.txt"}, names=("num",))
    some = given.where(r"path RLIKE '^in[13]\\.txt$'")
    reduced = blocks.all_of(some, {"destination": "l1_all.txt"})
    second = blocks.as_inputs(none).unionByName(blocks.as_inputs(each)).unionByName(blocks.as_inputs(reduced))
    two = blocks.foreach(blocks.select_inputs(second, r".*l1_(?<num>[23])\.txt"), {"destination": "l2_{num}.txt"}, names=("num",))
    passed = blocks.forward(blocks.select_inputs(second, r".*l1_[0-9]+\.txt", invert=True))
    last = blocks.select_inputs(blocks.as_inputs(two).unionByName(passed), r".*(l1_all|l2_2)\.txt")
    out = blocks.all_of(last, {"destination": "out.txt"})
    steps = none_step("A0", none)
    for more in (foreach_step("A1", each), all_step("B", reduced, some), foreach_step("C", two), all_step("D", out, last)):
        steps = steps.unionByName(more)
    run = again(steps, given, nothing(spark))
    assert there(run) == sorted(["l1_10.txt", "l1_1.txt", "l1_2.txt", "l1_3.txt", "l1_all.txt", "l2_2.txt", "l2_3.txt", "out.txt"])
    order = {r["transition_id"]: r["level"] for r in run.plan.collect()}
    assert order["A0/0"] == 0 and max(order.values()) == 2
    got = {tuple(r["outputs"]): r["dependencies"] for r in run.log.collect()}
    assert got[("l1_all.txt",)] == ["in1.txt", "in3.txt"] and sorted(got[("out.txt",)]) == ["l1_all.txt", "l2_2.txt"] and got[("l1_10.txt",)] is None
    assert built(again(steps, given, run.manifest)) == []
    assert built(again(steps, inputs(spark, "in1", "in2", "in3", touched=["in2"]), run.manifest)) == ["l1_2.txt", "l2_2.txt", "out.txt"]


def temporaries(spark, given):
    tmp = blocks.foreach(given, {"destination": "l1_{num}.txt"}, names=("num",), temporary=frozenset({"destination"}))
    chosen = blocks.select_inputs(blocks.as_inputs(tmp), r".*l1_(?<num>[23])\.txt")
    two = blocks.foreach(chosen, {"destination": "l2_{num}.txt"}, names=("num",))
    last = blocks.as_inputs(two)
    return foreach_step("A", tmp).unionByName(foreach_step("B", two)).unionByName(all_step("C", blocks.all_of(last, {"destination": "out.txt"}), last))


def test_touched_input_behind_temporaries(spark, tmp_path):
    given = inputs(spark, "in1", "in2", "in3")
    run = again(temporaries(spark, given), given, nothing(spark), root=str(tmp_path / "manifest"))
    assert built(run) == ["l1_2.txt", "l1_3.txt", "l2_2.txt", "l2_3.txt", "out.txt"]
    assert paths(run.deletable) == ["l1_2.txt", "l1_3.txt"] and there(run) == ["l2_2.txt", "l2_3.txt", "out.txt"]
    assert run.incomplete.count() == 0 and run.missing.count() == 0
    files, directories = store.read_manifest(spark, str(tmp_path / "manifest"))
    assert {r["file"]: r["flags"] for r in files.join(directories, "dir_id").collect()} == {"l1_1.txt": 2, "l1_2.txt": 2, "l1_3.txt": 2, "l2_2.txt": 16, "l2_3.txt": 16, "out.txt": 16}
    assert built(again(temporaries(spark, given), given, run.manifest)) == []
    touched = inputs(spark, "in1", "in2", "in3", touched=["in2"])
    second = again(temporaries(spark, touched), touched, run.manifest)
    assert built(second) == ["l1_2.txt", "l2_2.txt", "out.txt"] and paths(second.deletable) == ["l1_2.txt"]


def test_touched_dependency_behind_a_temporary(spark):
    def steps(given):
        one = blocks.foreach(given, {"destination": "l1_{num}.txt"}, names=("num",))
        two = blocks.foreach(blocks.select_inputs(blocks.as_inputs(one), r"l1_(?<num>[0-9])\.txt"), {"destination": "l2_{num}.txt"}, names=("num",), temporary=frozenset({"destination"}))
        three = blocks.foreach(blocks.select_inputs(blocks.as_inputs(two), r"l2_(?<num>[0-9])\.txt"), {"destination": "l3_{num}.txt"}, names=("num",))
        return foreach_step("A", one).unionByName(foreach_step("B", two)).unionByName(foreach_step("C", three, ("dep.txt",)))

    names = ("in1", "in2", "in3", "dep")
    given = inputs(spark, *names)
    run = again(steps(given.where("path <> 'dep.txt'")), given, nothing(spark))
    assert len(built(run)) == 9 and paths(run.deletable) == ["l2_1.txt", "l2_2.txt", "l2_3.txt"]
    assert {tuple(r["dependencies"]) for r in run.log.where("transition_id LIKE 'C/%'").collect()} == {(f"l2_{k}.txt", "dep.txt") for k in (1, 2, 3)}
    touched = inputs(spark, *names, touched=["dep"])
    second = again(steps(touched.where("path <> 'dep.txt'")), touched, run.manifest)
    assert built(second) == [f"l{k}_{i}.txt" for k in (2, 3) for i in (1, 2, 3)]
    assert again(steps(given.where("path <> 'dep.txt'")), given, run.manifest, force=True, dry=True).plan.count() == 9


def two_steps(spark, given):
    one = blocks.foreach(given, {"destination": "out{num}.txt"}, names=("num",))
    last = blocks.as_inputs(one)
    return foreach_step("A", one).unionByName(all_step("B", blocks.all_of(last, {"destination": "sum.txt"}), last))


def test_failures_stop_later_steps(spark):
    given = inputs(spark, "in0", "in1")
    steps = two_steps(spark, given)
    fails = lambda row: (int(row.outputs[0] == "out1.txt"), None)
    run = again(steps, given, nothing(spark), fails)
    assert there(run) == ["out0.txt"] and "out1.txt" in paths(run.missing)
    # The step after the failure wasn't begun.
    whole = again(steps, given, nothing(spark))
    assert there(whole) == ["out0.txt", "out1.txt", "sum.txt"]
    touched = inputs(spark, "in0", "in1", touched=["in1"])
    broken = again(steps, touched, whole.manifest, fails)
    assert paths(broken.incomplete) == ["sum.txt"] and there(broken) == ["out0.txt", "out1.txt"]
    assert built(again(steps, touched, broken.manifest)) == ["out1.txt", "sum.txt"]
    kept = again(steps, touched, whole.manifest, fails, clean_incompletes=False)
    assert paths(kept.incomplete) == [] and there(kept) == ["out0.txt", "out1.txt", "sum.txt"]


@pytest.mark.parametrize(("failing", "ran", "incomplete"), [(1, 2, ["out1.txt", "sum.txt"]), (2, 3, ["sum.txt"])])
def test_a_failed_command_is_over_and_leaves_later_ones_idle(spark, failing, ran, incomplete):
    given = inputs(spark, "in0", "in1")
    whole = again(two_steps(spark, given), given, nothing(spark))
    touched = inputs(spark, "in0", "in1", touched=["in1"])
    commands = [lambda row, k=k: (int(k == failing and row.outputs[0] == "out1.txt"), k) for k in range(3)]
    run = again(two_steps(spark, given), touched, whole.manifest, commands)
    assert paths(run.incomplete) == incomplete
    one = run.log.where("transition_id = 'A/1'").first()
    assert (one["ran"], one["state"], one["result"]) == (ran, "FINISHED" if failing is None else "FAILED", str(ran - 1))


def on_all_steps(spark, given, as_group):
    """Each output depends on all temporaries, by a group or by the edges themselves."""
    tmp = blocks.foreach(given, {"destination": "l1_{num}.txt"}, names=("num",), temporary=frozenset({"destination"}))
    one = blocks.foreach(given, {"destination": "p1_{num}.txt"}, names=("num",))
    both = blocks.as_inputs(tmp.unionByName(one))
    out = blocks.foreach(given, {"destination": "out_{num}.txt"}, names=("num",))
    steps = foreach_step("A", tmp).unionByName(foreach_step("P", one))
    if as_group:
        rows, groups = foreach_of_all_step("B", out, both)
    else:
        rows = foreach_step("B", out).drop("dependency", "dep_ord").crossJoin(both.select(F.col("path").alias("dependency"), F.col("ord").alias("dep_ord")))
        groups = None
    last = blocks.as_inputs(out)
    return steps.unionByName(rows).unionByName(all_step("C", blocks.all_of(last, {"destination": "sum.txt"}), last)), groups


def test_groups_equal_their_edges(spark):
    """One changed input, a temporary and a permanent step whose outputs all of the next step's outputs depend on; one step fails."""
    names = ("in1", "in2", "in3")
    made = [f"{kind}_{k}.txt" for kind in ("p1", "out") for k in (1, 2, 3)] + ["sum.txt"]
    before = spark.createDataFrame([(p, datetime.datetime(2025, 1, 1), 16) for p in made] + [(f"l1_{k}.txt", None, 2) for k in (1, 2, 3)], "path string, mtime timestamp, flags long")
    given = inputs(spark, *names, touched=("in2",))
    found = []
    for as_group in (True, False):
        steps, groups = on_all_steps(spark, given, as_group)
        run = again(steps, given, before, lambda row: (int(row.outputs[0] == "out_3.txt"), 0), groups=groups)
        tables = {t: sorted(str(r) for r in getattr(run, t).drop("mtime").collect()) for t in ("plan", "remains", "deletable", "incomplete", "missing")}
        found.append(tables | {"built": built(run), "there": there(run)})
    assert found[0] == found[1]
    assert found[0]["built"] == ["l1_1.txt", "l1_2.txt", "l1_3.txt", "out_1.txt", "out_2.txt", "p1_2.txt"] and found[0]["incomplete"] == ["Row(path='sum.txt')"]


def test_groups_of_many_assets_make_no_product(spark):
    n = 100_000
    given = spark.range(n).select(F.concat(F.lit("in/"), "id").alias("path"), F.col("id").alias("ord"), F.lit(datetime.datetime(2024, 1, 1)).alias("mtime"), F.lit(17).cast("long").alias("flags"), F.create_map().cast("map<string,string>").alias("captures"))
    steps, groups = foreach_of_all_step("B", blocks.foreach(given, {"destination": "out/{?}"}), given)
    assert steps.count() == groups.count() == n
    old = given.select(F.concat(F.lit("out/"), "path").alias("path"), F.lit(datetime.datetime(2025, 1, 1)).alias("mtime"), F.lit(16).cast("long").alias("flags"))
    late = given.withColumn("mtime", F.when(F.col("ord") == 77, F.lit(FAR)).otherwise(F.col("mtime")))
    for assets, want in ((given, 0), (late, n)):
        run = pipeline_run(steps, assets.select("path", "mtime", "flags").unionByName(old), old.select("path", "flags"), lambda row: 0, dry=True, groups=groups)
        assert run.plan.count() == want


def test_failed_rebuild_loses_exists(spark):
    given = inputs(spark, "in1")
    steps = blocks.foreach(given, {"destination": "out.txt"}).select("transition_id", "dependency", "output", "flags")
    old = spark.createDataFrame([("out.txt", datetime.datetime(2020, 1, 1), 16)], "path string, mtime timestamp, flags long")
    run = incremental_run(steps, given, old, lambda row: (1, None))
    assert [(r["path"], r["flags"]) for r in run.manifest.collect()] == [("out.txt", 0)]


def test_remains_of_an_earlier_pipeline(spark):
    given = inputs(spark, "in1")
    step = lambda n: foreach_step(n, blocks.foreach(given, {"destination": f"{n}.txt"}))
    run = again(step("out1"), given, nothing(spark))
    second = again(step("out2"), given, run.manifest)
    assert paths(second.remains) == ["out1.txt"] and there(second) == ["out2.txt"]


def test_missing_dependency_isnt_run(spark):
    given = inputs(spark, "in1")
    steps = foreach_step("A", blocks.foreach(given, {"destination": "a.txt"}), ("gone.txt",))
    run = again(steps, given, nothing(spark))
    assert run.plan.count() == 1 and run.log.count() == 0 and there(run) == [] and run.missing.count() == 0
    with pytest.raises(ValueError, match="occurs"):
        again(steps.unionByName(foreach_step("B", blocks.foreach(given, {"destination": "a.txt"}))), given, nothing(spark))


def test_long_chains_have_all_levels(spark):
    edges = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(12)] + [("n5", "n0"), ("m", "n12")], "output string, dependency string")
    want = {f"n{k}": k for k in range(13)} | {"m": 13}
    assert {r["node"]: r["level"] for r in incremental.dag_level(edges).collect()} == want
    with pytest.raises(ValueError, match="over 5 steps"):
        incremental.dag_level(edges, most_rounds=5)
    assert incremental.dag_level(edges.unionByName(edges)).count() == len(want)
    for rows in ([("a", "b"), ("b", "a")], [("a", "r"), ("b", "a"), ("a", "b")], [("a", "r"), ("c", "d"), ("d", "c")]):
        with pytest.raises(ValueError, match="cycle"):
            incremental.dag_level(spark.createDataFrame(rows, "output string, dependency string"))
    assert incremental.dag_level(edges.limit(0)).collect() == []


def test_a_cycle_behind_a_root_ends_the_walk(spark, monkeypatch):
    rows = [(f"c{(k + 1) % 43}", f"c{k}") for k in range(43)] + [("c0", "r"), ("b", "c5"), ("x", "r"), ("y", "x")]
    rounds = []
    monkeypatch.setattr(incremental, "checkpointed", lambda df: rounds.append(1) or df.checkpoint())
    store.shared_folder(spark)
    with pytest.raises(ValueError, match="cycle among or above: b, c0, c1"):
        incremental.dag_level(spark.createDataFrame(rows, "output string, dependency string"))
    assert len(rounds) <= 6


def test_forced_assets_reach_down_chains_by_doubling(spark, monkeypatch):
    n = 10_000
    edges = spark.range(1, n).selectExpr("concat('n', id) AS output", "concat('n', id - 1) AS dependency")
    more = spark.createDataFrame([("n7", "m"), ("tail", "n9999"), ("tail", "m"), ("end", "tail"), ("q", "n3"), ("c0", "c1"), ("c1", "c0"), ("c2", "c1")], edges.schema)
    nodes = spark.range(n).selectExpr("concat('n', id) AS path", "id = 5 AS forced").unionByName(spark.createDataFrame([(x, False) for x in ("m", "tail", "end", "q", "c0", "c1", "c2")], "path string, forced boolean"))
    rounds = []
    monkeypatch.setattr(incremental, "checkpointed", lambda df: rounds.append(1) or df.checkpoint())
    store.shared_folder(spark)
    got = {r["path"] for r in incremental.propagate_forced(nodes, edges.unionByName(more)).where("forced").collect()}
    assert got == {f"n{k}" for k in range(5, n)} | {"tail", "end"} and len(rounds) < 40


def test_forced_assets_in_any_graph(spark):
    rng = random.Random(1)
    for n in (12, 40):
        pairs = {(k, k - 1) for k in range(1, n) if rng.random() < 0.8} | {(k, rng.randrange(k)) for k in range(1, n) if rng.random() < 0.2} | {(n, n + 1), (n + 1, n), (n + 2, n)}
        forced = {rng.randrange(n), n // 2}
        want = set(forced)
        while more := {o for o, d in pairs if d in want} - want:
            want |= more
        nodes = spark.createDataFrame([(k, k in forced) for k in range(n + 3)], "path long, forced boolean")
        edges = spark.createDataFrame(sorted(pairs), "output long, dependency long")
        for plain in (0, 2, 99):
            assert {r["path"] for r in incremental.propagate_forced(nodes, edges, plain_rounds=plain).where("forced").collect()} == want


def test_places_of_many_outputs_and_long_chains(spark):
    given = inputs(spark, "in0", "in1").withColumn("ord", F.xxhash64("path"))
    first, second = [r["path"] for r in given.orderBy("ord").collect()]
    made = given.select(F.col("ord").alias("transition_id"), "path", "flags", "captures").crossJoin(spark.range(1500).select(F.col("id").cast("int").alias("out_ord")))
    made = made.withColumn("output", F.format_string("%s.%04d", "path", "out_ord")).repartition(5)
    assert [r["path"] for r in blocks.as_inputs(made).orderBy("ord").collect()] == [f"{p}.{k:04d}" for p in (first, second) for k in range(1500)]
    step = lambda df: blocks.as_inputs(blocks.foreach(df, {"destination": "{?}a", "destination[0]": "{?}b"}))
    out = blocks.then(*[step] * 8)(given).orderBy("ord").collect()
    names = [first, second]
    for _ in range(8):
        names = [n + x for n in names for x in "ab"]
    assert [r["path"] for r in out] == names and [r["ord"] for r in out] == list(range(512))
    beside = blocks.also(step, lambda df: df.select("path", "ord", "mtime", "flags", "captures"))(given).orderBy("ord").collect()
    assert [r["path"] for r in beside] == [first + "a", first + "b", second + "a", second + "b", first, second]


def test_patterns_that_undo_their_directories(spark):
    assets = spark.createDataFrame([("lib/y.txt",), ("srcfoo",), ("a/b/c.txt",)], "path string")
    cases = {r"src/x\.txt|lib/y\.txt": "true", "src/?foo": "true", "src/*foo": "true", "src/{0,1}foo": "true", "src/+foo": "false", r"a/(x|b/c)\.txt": "true", r"a/[|]|lib/y.txt": "true", r"a/b/[(]|srcfoo": "true", r"a/b/\(|srcfoo": "true", r"lib/(((((((((x|y)))))))))\.txt": "true", r"lib/x\.txt": "false"}
    df = spark.createDataFrame([(p,) for p in cases], "pattern string")
    assert {r["pattern"]: r["rexists"] for r in joins.with_pattern_exists(df, assets).collect()} == cases


def test_edges_on_demand(spark):
    given = inputs(spark, "in1", "in2")
    ids = given.select(F.col("ord").alias("transition_id"))
    assert {(r["transition_id"], r["dependency"], r["dep_ord"]) for r in joins.depends_on_all(ids, given, edges=True).collect()} == {(i, f"in{k + 1}.txt", k) for i in (0, 1) for k in (0, 1)}
    one = joins.depends_on_all(ids, given).collect()
    other = joins.depends_on_all(ids, given.withColumn("ord", 1 - F.col("ord"))).collect()
    assert one[0]["n_dependencies"] == 2 and one[0]["digest"] != other[0]["digest"]


def test_directories_that_the_pattern_rules_out_are_not_listed(spark, tmp_path):
    for a in ("en", "fr", "de", "e+n %"):
        for k in range(6):
            (tmp_path / a / f"d{k}" / "deep").mkdir(parents=True)
            (tmp_path / a / f"d{k}" / f"x {k}.txt").write_text("abc")
    root = str(tmp_path)
    pattern = re.sub(r"([^A-Za-z0-9/])", r"\\\1", root) + r"/(?<lang>e.*)/d[12]/.*\.txt"
    files, listed = scan.frontiers(spark, pattern)
    assert [df.count() for df in listed] == [1, 2, 4]
    got = scan.scan_by_levels(spark, pattern).orderBy("path").collect()
    want = scan.scan_regex(spark, pattern).orderBy("path").collect()
    assert [(r["path"], r["size"], r["captures"]["lang"], r["ord"]) for r in got] == [(r["path"], r["size"], r["captures"]["lang"], r["ord"]) for r in want] and len(got) == 4
    assert all(abs(a["mtime"] - b["mtime"]) < datetime.timedelta(seconds=1) for a, b in zip(got, want, strict=True))


def test_scans_are_in_order_of_paths(spark, tmp_path):
    names = [f"f{k}.txt" for k in (10, 2, 1, 33, 4)]
    for n in names:
        (tmp_path / n).write_text("x")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = scan.scan_recursive(spark, root, "f.*").orderBy("ord").collect()
        assert [r["path"] for r in found] == [f"{tmp_path}/{n}" for n in sorted(names)]
        assert [r["ord"] for r in found] == list(range(5))
    uris = spark.createDataFrame([("hdfs://host:9000/a/b",), ("s3a://bucket/a b/c",), ("file:/x/y",), ("file:///x/y",), ("/plain/p",)], "u string")
    assert [r[0] for r in uris.select(scan.plain_path(F.col("u"))).collect()] == ["/a/b", "/a b/c", "/x/y", "/x/y", "/plain/p"]


def test_two_steps_take_few_recovery_points(spark, tiny, monkeypatch):
    # What is found is written once: neither all that is known again at each level, nor walks over temporaries that don't meet.
    from assetflow.plans.catalog_builds import i15_chain

    made, write = [], incremental.checkpointed
    for module in (incremental, pipeline, windows):
        monkeypatch.setattr(module, "checkpointed", lambda df: made.append(1) or write(df))
    assert i15_chain(spark, tiny).count() > 0 and len(made) <= 36
