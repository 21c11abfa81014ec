"""User functions per transition or group, with captured outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed

LOG = "state string, exit_code int, started timestamp, ended timestamp, result string, error string, ran int"


def commands_of(work: Callable | Sequence[Callable]) -> list[Callable]:
    return [work] if callable(work) else list(work)


def _attempt(work: Callable | Sequence[Callable], argument, checking: bool) -> dict:
    """The outcome of one or more commands, which run in order up to the first failure: that of the last one that ran, and how
    many ran."""
    out, started, ran = {"state": "FINISHED", "exit_code": 0, "result": None, "error": None}, datetime.now(UTC), 0
    for command in commands_of(work):
        out, ran = _command(command, argument, checking), ran + 1
        if out["state"] == "FAILED":
            break
    return out | {"started": started, "ended": datetime.now(UTC), "ran": ran}


def _command(work: Callable, argument, checking: bool) -> dict:
    """State and exit code as a command's: negative codes count as 1, a code other than 0 fails only under checking, and work
    that can't be started at all fails with -1."""
    result, error, code = None, None, 0
    try:
        out = work(argument)
        code, result = out if isinstance(out, tuple) else (0, out)
        code = 1 if code < 0 else code
        state = "FAILED" if code and checking else "FINISHED"
    except Exception as e:  # the row's own failure is its outcome
        state, code, error = "FAILED", -1, f"{type(e).__name__}: {e}"
    return {"state": state, "exit_code": code, "result": None if result is None else str(result), "error": error}


def run_foreach(transitions: DataFrame, work: Callable | Sequence[Callable], checking: bool = True) -> DataFrame:
    """``work``, one command or several, gets each row as a named tuple and returns a result, or (exit code, result). Columns:
    those of ``transitions`` and the outcome, with the number of commands that ran."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in transitions.schema] + [LOG])
    names = [x.split()[0] for x in LOG.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            outcome = pd.DataFrame([_attempt(work, r, checking) for r in rows.itertuples(index=False)], columns=names, index=rows.index)
            yield pd.concat([rows, outcome], axis=1)

    return transitions.mapInPandas(run, schema)


def run_all(inputs: DataFrame, by: list[str], work: Callable, checking: bool = True) -> DataFrame:
    """``work`` gets all rows of a group as a pandas frame; one outcome a group. A group is one transition over all its
    inputs, and has to fit one task."""
    schema = ", ".join([f"`{k}` {inputs.schema[k].dataType.simpleString()}" for k in by] + [LOG])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(by, key, strict=True)) | _attempt(work, rows, checking)])

    return inputs.groupBy(*by).applyInPandas(run, schema)


#: Results that one call of a merge takes.
MERGED_AT_ONCE = 1000


def run_all_merged(inputs: DataFrame, by: list[str], part: Callable, merge: Callable, checking: bool = True, order: list[str] | None = None, width: int = MERGED_AT_ONCE) -> DataFrame:
    """``run_all`` for groups that don't fit one task, where the work can be parted: ``part`` gets the rows of a group in each
    Arrow batch where they lie, and ``merge`` lists of up to ``width`` results as strings, of parts and then of merges, until a
    group has one; so no task holds all of a group's parts. With ``order`` the rows are dealt by ranges of these columns first,
    and results stay in that order; without, rows aren't shuffled and results come in the order of partitions. A part that
    fails is its group's outcome."""
    schema = ", ".join([f"`{k}` {inputs.schema[k].dataType.simpleString()}" for k in by] + [LOG, "__place long"])
    names = [*by, *(x.split()[0] for x in LOG.split(", ")), "__place"]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in enumerate(batches):
            place = (TaskContext.get().partitionId() << 32) + number
            out = [{k: None if pd.isna(v) else v for k, v in zip(by, key, strict=True)} | _attempt(part, own, checking) | {"__place": place} for key, own in rows.groupby(by, dropna=False, sort=False)]
            yield pd.DataFrame(out, columns=names)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__place")
        failed = rows[rows["state"] == "FAILED"].sort_values("started")
        outcome = failed.iloc[0].to_dict() if len(failed) else _attempt(merge, rows["result"].tolist(), checking)
        return pd.DataFrame([outcome | dict(zip([*by, "__place"], key, strict=True)) | {"started": rows["started"].min()}], columns=names)

    if order:
        inputs = inputs.repartitionByRange(*order).sortWithinPartitions(*order)
    results = checkpointed(inputs.mapInPandas(parts, schema))
    while True:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__place")) - 1
        results = results.withColumn("__run", F.floor(rank / width).cast("long"))
        results = checkpointed(results.groupBy(*by, "__run").applyInPandas(lambda key, rows: whole(key, rows.drop(columns="__run")), schema))
        if not results.where("__place > 0").limit(1).count():
            return results.drop("__place")
