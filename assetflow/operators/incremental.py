"""What is missing, changed or forced, and what follows from it through the graph of transitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import add_flags, has_flags, reason_string
from ..functions.times import was_modified
from ..schema import EXISTS, FORCED, MODIFIED, REASON_CHANGED, REASON_FORCED, REASON_MISSING, TEMPORARY
from ..sources.store import checkpointed
from .aggregates import needs_build, needs_build_any
from .windows import first_reason


def mark_outputs(outputs: DataFrame, force: bool = False, kind: str = "foreach") -> DataFrame:
    """flags and mtime of outputs. ``outputs``: output, flags, out_mtime (null if it doesn't exist), in_flags, in_mtime and
    dep_mtime (newest extra dependency). For ``all`` the inputs' newest time and the any-input verdict (``any_build``) come
    as columns too; for ``none`` there are no inputs."""
    exists = F.col("out_mtime").isNotNull()
    flags = F.when(exists, add_flags(F.col("flags"), EXISTS)).otherwise(F.col("flags"))
    if kind == "none":
        changed = ~exists | was_modified(F.col("dep_mtime"), F.col("out_mtime"))
        forced = F.lit(force)
    else:
        changed = was_modified(F.col("in_mtime"), F.col("out_mtime")) | was_modified(F.col("dep_mtime"), F.col("out_mtime")) | needs_build(F.col("in_flags"))
        if kind == "all":
            changed = changed | F.col("in_mtime").isNull() | F.col("any_build")
        forced = F.lit(force) | has_flags(F.col("in_flags"), FORCED)
    flags = F.when(changed, add_flags(flags, MODIFIED)).otherwise(flags)
    flags = F.when(forced, add_flags(flags, FORCED | MODIFIED)).otherwise(flags)
    newest = F.when(F.col("dep_mtime") > F.col("in_mtime"), F.col("dep_mtime")).otherwise(F.col("in_mtime"))
    mtime = F.when(exists, F.col("out_mtime")).when(has_flags(F.col("flags"), TEMPORARY), newest)
    return outputs.withColumns({"flags": flags, "mtime": mtime})


def reason_bits(flags: Column) -> Column:
    missing = ~(has_flags(flags, EXISTS) | has_flags(flags, TEMPORARY))
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return bit(has_flags(flags, MODIFIED), REASON_CHANGED) + bit(missing, REASON_MISSING) + bit(has_flags(flags, FORCED), REASON_FORCED)


def needs_build_reasons(transitions: DataFrame, members: DataFrame, force: bool = False) -> DataFrame:
    """(transition_id, reason, all_reasons) per transition. ``members``: transition_id, role, ord, flags, and where a row stands
    for several, bits and all_bits, which then say why rather than its flags."""
    if force:
        return transitions.select("transition_id", F.lit(REASON_FORCED).alias("reason"), F.lit(REASON_FORCED).alias("all_reasons"))
    bits = members.select("transition_id", "role", "ord", reason_bits(F.col("flags")).alias("bits"))
    if "bits" in members.columns:
        bits = members.select("transition_id", "role", "ord", F.coalesce("bits", reason_bits(F.col("flags"))).alias("bits"), "all_bits")
    found = first_reason(bits)
    outputs = members.where("role = 'output'").groupBy("transition_id").agg(F.lit(1).alias("__out"))
    joined = transitions.select("transition_id").join(outputs, "transition_id", "left").join(found, "transition_id", "left")
    return joined.select(
        "transition_id",
        F.when(F.col("__out").isNull(), REASON_MISSING).otherwise(F.coalesce("reason", F.lit(0))).alias("reason"),
        F.when(F.col("__out").isNull(), REASON_MISSING).otherwise(F.coalesce("all_reasons", F.lit(0))).alias("all_reasons"),
    )


def build_plan(reasons: DataFrame) -> DataFrame:
    """What would run, with its reasons; nothing is run."""
    return reasons.where("reason <> 0").withColumn("text", F.concat(F.lit("["), reason_string(F.col("reason")), F.lit("]")))


class Rounds:
    """What the rounds of a walk have found. Each round adds its own rows; eight tables of about one size become one, so rows
    are written again as often as the logarithm of the number of rounds says, and plans stay short."""

    def __init__(self, first: DataFrame):
        self.parts: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, found: DataFrame) -> None:
        self.parts.append((0, found))
        while len(self.parts) >= 8 and len({size for size, _ in self.parts[-8:]}) == 1:
            size, last = self.parts[-1][0] + 1, self.parts[-8:]
            self.parts[-8:] = [(size, checkpointed(reduce(DataFrame.unionByName, [df for _, df in last])))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for _, df in self.parts])


#: Rounds that a walk takes step by step before it goes along chains by doubled steps.
PLAIN_ROUNDS = 8


def propagate_forced(nodes: DataFrame, edges: DataFrame, most_rounds: int | None = None, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """(path, forced): everything that depends on a forced asset is forced. ``nodes``: path, forced; ``edges``: output,
    dependency. See ``forced_paths`` for the rounds."""
    reached = forced_paths(nodes, edges, most_rounds, plain_rounds)
    return nodes.select("path").join(reached.withColumn("__f", F.lit(True)), "path", "left").select("path", F.coalesce("__f", F.lit(False)).alias("forced"))


def forced_paths(nodes: DataFrame, edges: DataFrame, most_rounds: int | None = None, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """The paths, each once, of ``propagate_forced`` that are forced. Each round joins only the assets that the round before has reached, until there are none. A walk that isn't over
    after ``plain_rounds`` goes on with the chains in one piece (``_along_chains``): a chain of n assets takes log n rounds. With
    ``most_rounds`` there are only plain rounds, and a walk that isn't over after them is an error."""
    front = checkpointed(nodes.where("forced").select("path").distinct())
    reached = Rounds(front)
    for done in count():
        if most_rounds is None and done == plain_rounds:
            reached.add(_along_chains(edges, reached.all()))
            break
        front = edges.join(front, edges["dependency"] == front["path"], "left_semi").select(F.col("output").alias("path")).distinct()
        front = checkpointed(front.join(reached.all(), "path", "left_anti"))
        if not front.limit(1).count():
            break
        if done == most_rounds:
            raise ValueError(f"forced assets reach further than {most_rounds} steps")
        reached.add(front)
    return reached.all()


def chain_heads(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(path, head, hit) for each unreached asset with a single dependency: the first asset up its chain that has several
    dependencies or none, and whether the chain up to there, head included, is reached. Each round takes over the pointers of the
    asset pointed to, which doubles all steps. What is still under way when a step is as long as all chains together runs in a
    cycle that nothing has reached."""
    known = reached.select(F.col("path").alias("__reached")).distinct()
    single = edges.groupBy(F.col("output").alias("path")).agg(F.min("dependency").alias("head"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    single = single.join(known, F.col("path") == F.col("__reached"), "left_anti").join(known, F.col("head") == F.col("__reached"), "left")
    hit = F.col("__reached").isNotNull()
    state = single.select("path", "head", hit.alias("hit")).alias("s").join(single.select(F.col("path").alias("__next")), F.col("head") == F.col("__next"), "left")
    state = checkpointed(state.select("path", "head", "hit", (~F.col("hit") & F.col("__next").isNotNull()).alias("open")))
    n = state.count()
    step = 1
    while step <= n and state.where("open").limit(1).count():
        ahead = state.select(F.col("path").alias("__at"), F.col("head").alias("__head"), F.col("hit").alias("__hit"), F.col("open").alias("__open"))
        joined = state.join(ahead, F.col("open") & (F.col("head") == F.col("__at")), "left")
        over = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)
        state = checkpointed(joined.select("path", over("head"), over("hit"), over("open")))
        step *= 2
    return state.select("path", "head", "hit")


def _along_chains(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Assets, beyond the reached ones, that depend on them: chains are one step to their head, and what is left are rounds over
    the assets with several dependencies."""
    edges = checkpointed(edges.select("output", "dependency").distinct())
    chains = checkpointed(chain_heads(edges, reached))
    known = reached.select(F.col("path").alias("__reached")).distinct()
    several = edges.groupBy("output").agg(F.count("*").alias("__n")).where("__n > 1").select("output").join(known, F.col("output") == F.col("__reached"), "left_anti")
    heads = chains.select(F.col("path").alias("__chain"), F.col("head").alias("__head"), F.col("hit").alias("__hit"))
    steps = edges.join(several, "output", "left_semi").join(heads, F.col("dependency") == F.col("__chain"), "left").join(known, F.col("dependency") == F.col("__reached"), "left")
    steps = checkpointed(steps.select("output", F.coalesce("__head", "dependency").alias("dependency"), (F.coalesce("__hit", F.lit(False)) | F.col("__reached").isNotNull()).alias("hit")))
    front = checkpointed(steps.where("hit").select(F.col("output").alias("path")).distinct())
    found = Rounds(front)
    while front.limit(1).count():
        front = steps.join(front, steps["dependency"] == front["path"], "left_semi").select(F.col("output").alias("path")).distinct()
        front = checkpointed(front.join(found.all(), "path", "left_anti"))
        found.add(front)
    several = checkpointed(found.all())
    behind = chains.join(several.select(F.col("path").alias("__several")), F.col("head") == F.col("__several"), "left").where(F.col("hit") | F.col("__several").isNotNull())
    return checkpointed(several.unionByName(behind.select("path")))


def dag_level(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, level): the longest way from a node without dependencies. Nodes are peeled off: each knows how many dependencies
    it has, each round takes off those that the round before has settled, and what has none left is the next level. Rounds are
    as many as levels, and a node has one row. If nothing is next and nodes are left, there is a cycle among or above these,
    which is an error, as is a graph that goes on after ``most_rounds``, if given."""
    edges = edges.select("output", "dependency").distinct()
    needs = edges.groupBy(F.col("output").alias("__output")).agg(F.count("*").alias("needs"))
    edges = checkpointed(edges.join(needs, F.col("output") == F.col("__output")).drop("__output"))
    front = checkpointed(edges.select(F.col("dependency").alias("node")).distinct().join(edges, F.col("node") == F.col("output"), "left_anti"))
    levels = Rounds(front.withColumn("level", F.lit(0)))
    waiting = checkpointed(edges.select(F.col("output").alias("node"), "needs", F.lit(0).cast("long").alias("settled")).limit(0))
    for level in count(1):
        now = edges.join(front, F.col("dependency") == F.col("node"), "left_semi").groupBy(F.col("output").alias("node"), "needs").agg(F.count("*").alias("settled"))
        state = checkpointed(waiting.unionByName(now).groupBy("node", "needs").agg(F.sum("settled").alias("settled")))
        front, waiting = state.where("settled = needs").select("node"), state.where("settled < needs")
        if not front.limit(1).count():
            break
        if most_rounds is not None and level >= most_rounds:
            raise ValueError(f"the graph has a cycle or a way of over {most_rounds} steps")
        levels.add(front.withColumn("level", F.lit(level)))
    found = levels.all()
    left = edges.join(found, F.col("output") == F.col("node"), "left_anti").select("output").distinct().orderBy("output").limit(3).collect()
    if left:
        raise ValueError(f"the graph has a cycle among or above: {', '.join(str(r[0]) for r in left)}")
    return found


def _closure(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(temporary, end): what each temporary ``start`` reaches through temporaries. ``edges``: output, dependency, out_temp,
    dep_temp."""
    pairs = edges.where(F.col(f"{start[:3]}_temp")).select(F.col(start).alias("temporary"), F.col(end).alias("end"), F.col(f"{end[:3]}_temp").alias("end_temp")).distinct()
    steps = front = checkpointed(pairs)
    seen = Rounds(steps)
    hop = steps.select(F.col("temporary").alias("end"), F.col("end").alias("next"), F.col("end_temp").alias("next_temp"))
    while True:
        front = front.where("end_temp").join(hop, "end").select("temporary", F.col("next").alias("end"), F.col("next_temp").alias("end_temp")).distinct()
        front = checkpointed(front.join(seen.all(), ["temporary", "end"], "left_anti"))
        if not front.limit(1).count():
            return seen.all()
        seen.add(front)


def temporary_inputs(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Per temporary: its permanent inputs through temporaries, the newest change among all it reaches, whether all exist and
    whether any is modified. ``edges``: output, dependency, out_temp, dep_temp; ``assets``: path, flags, mtime."""
    reach = _closure(edges, "output", "dependency").join(assets, F.col("end") == F.col("path"), "left")
    permanent = ~F.col("end_temp")
    return reach.groupBy("temporary").agg(
        F.sort_array(F.collect_set(F.when(permanent, F.col("end")))).alias("inputs"),
        F.max("mtime").alias("newest_input"),
        F.coalesce(F.bool_and(F.when(permanent, F.coalesce(has_flags(F.col("flags"), EXISTS), F.lit(False)))), F.lit(True)).alias("all_input_exists"),
        F.coalesce(F.bool_or(permanent & F.coalesce(has_flags(F.col("flags"), MODIFIED), F.lit(False))), F.lit(False)).alias("input_was_modified"),
    )


def temporary_outputs(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """The mirror: permanent outputs, the oldest change, whether all exist and whether any will be modified."""
    reach = _closure(edges, "dependency", "output").join(assets, F.col("end") == F.col("path"), "left")
    permanent = ~F.col("end_temp")
    due = F.coalesce(has_flags(F.col("flags"), MODIFIED) | has_flags(F.col("flags"), FORCED), F.lit(False))
    return reach.groupBy("temporary").agg(
        F.sort_array(F.collect_set(F.when(permanent, F.col("end")))).alias("outputs"),
        F.min("mtime").alias("oldest_output"),
        F.coalesce(F.bool_and(F.when(permanent, F.coalesce(has_flags(F.col("flags"), EXISTS), F.lit(False)))), F.lit(True)).alias("all_output_exists"),
        F.coalesce(F.bool_or(permanent & due), F.lit(False)).alias("output_will_be_modified"),
    )


def _folded(edges: DataFrame, assets: DataFrame, start: str, end: str, time: Callable, due: Column) -> DataFrame:
    """(temporary, time, exist, due) over all that each temporary ``start`` reaches through temporaries. Each takes over from
    those next to it when their own values are whole, level by level, so rows are as many as edges and not as pairs."""
    mine = edges.where(F.col(f"{start[:3]}_temp")).select(F.col(start).alias("temporary"), F.col(end).alias("end"), F.col(f"{end[:3]}_temp").alias("end_temp"))
    fold = lambda df: df.groupBy("temporary").agg(time("time").alias("time"), F.bool_and("exist").alias("exist"), F.bool_or("due").alias("due"))
    seen = mine.join(assets, F.col("end") == F.col("path"), "left")
    exists = F.coalesce(has_flags(F.col("flags"), EXISTS), F.lit(False))
    own = checkpointed(fold(seen.select("temporary", F.col("mtime").alias("time"), (F.col("end_temp") | exists).alias("exist"), (~F.col("end_temp") & due).alias("due"))))
    links = checkpointed(mine.where("end_temp").select(F.col("temporary").alias("output"), F.col("end").alias("dependency")).distinct())
    if not links.limit(1).count():  # no temporary depends on another
        return own
    levels = checkpointed(dag_level(links).withColumnRenamed("node", "temporary"))
    depth = levels.agg(F.max("level")).first()[0] or 0
    found = Rounds(checkpointed(own.join(levels.where("level > 0"), "temporary", "left_anti")))
    for level in range(1, depth + 1):
        now = levels.where(F.col("level") == level).select("temporary")
        below = links.join(now, F.col("output") == F.col("temporary"), "left_semi").join(found.all(), F.col("dependency") == F.col("temporary"))
        taken = below.select(F.col("output").alias("temporary"), "time", "exist", "due")
        found.add(checkpointed(fold(taken.unionByName(own.join(now, "temporary", "left_semi")))))
    return found.all()


def temporary_states(edges: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, outputs) for ``decide_temporaries``: those of ``temporary_inputs`` and ``temporary_outputs`` without their sets.
    A cycle of temporaries is an error."""
    has = lambda bit: F.coalesce(has_flags(F.col("flags"), bit), F.lit(False))
    inputs = _folded(edges, assets, "output", "dependency", F.max, has(MODIFIED))
    outputs = _folded(edges, assets, "dependency", "output", F.min, has(MODIFIED) | has(FORCED))
    return (
        inputs.withColumnsRenamed({"time": "newest_input", "exist": "all_input_exists", "due": "input_was_modified"}),
        outputs.withColumnsRenamed({"time": "oldest_output", "exist": "all_output_exists", "due": "output_will_be_modified"}),
    )


def decide_temporaries(temporaries: DataFrame, inputs: DataFrame, outputs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, flags, and the columns ``keep``): temporaries that have to be made again are FORCED, and MODIFIED if a change is the reason."""
    all_of = temporaries.join(inputs, F.col("path") == inputs["temporary"], "left").drop("temporary").join(outputs, F.col("path") == outputs["temporary"], "left")
    absent = ~(F.coalesce("all_input_exists", F.lit(True)) & F.coalesce("all_output_exists", F.lit(True)))
    changed = was_modified(F.col("newest_input"), F.col("oldest_output")) | F.coalesce("input_was_modified", F.lit(False)) | F.coalesce("output_will_be_modified", F.lit(False))
    flags = F.col("flags")
    return all_of.select("path", F.when(has_flags(flags, FORCED), flags).when(absent, add_flags(flags, FORCED)).when(changed, add_flags(flags, FORCED | MODIFIED)).otherwise(flags).alias("flags"), *keep)


def settle_dependents(pending: DataFrame, finished: DataFrame) -> DataFrame:
    """``pending`` (output, dependency) without the dependencies whose transitions finished and whose output is there."""
    return pending.join(finished.select("output", "dependency"), ["output", "dependency"], "left_anti")


def deletable_temporaries(temporaries: DataFrame, pending: DataFrame) -> DataFrame:
    """Temporaries that no pending output depends on."""
    return temporaries.where(has_flags(F.col("flags"), TEMPORARY)).join(pending.select(F.col("dependency").alias("path")), "path", "left_anti").select("path")


def incomplete_outputs(outputs: DataFrame, log: DataFrame, missing: DataFrame) -> DataFrame:
    """Outputs of needed transitions, no input missing, with a command that is idle or still running. One that failed is over."""
    open_ = log.groupBy("transition_id").agg(F.bool_or(F.col("state").isin("IDLE", "RUNNING")).alias("open")).where("open")
    return outputs.join(open_, "transition_id", "left_semi").join(missing, "transition_id", "left_anti").select("transition_id", "output")


def sweep_remains(before: DataFrame, now: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(remains to remove, new manifest): rows of the old manifest that are no output now, and the current rows."""
    joined = before.select(F.col(key), F.col("flags").alias("__old")).join(now.select(F.col(key), F.col("flags").alias("__new")), key, "full_outer")
    return joined.where("__new IS NULL").select(key), joined.where("__new IS NOT NULL").select(key, F.col("__new").alias("flags"))


def missing_outputs(outputs: DataFrame, assets: DataFrame, missing: DataFrame) -> DataFrame:
    """After the run: outputs of needed transitions, no input missing, that don't exist."""
    return outputs.join(missing, "transition_id", "left_anti").join(assets.select(F.col("path").alias("output")), "output", "left_anti").select("transition_id", "output")


def any_input_verdict(inputs: DataFrame, by: list[str]) -> DataFrame:
    """What ``all`` transitions compare: the newest time over all inputs and whether any needs a build."""
    return inputs.groupBy(*by).agg(F.max("mtime").alias("in_mtime"), needs_build_any(F.col("flags"), F.col("mtime")).alias("any_build"))
