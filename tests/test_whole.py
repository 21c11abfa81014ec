"""Queries over whole texts and all rows, on small tables of their own."""

import pytest

from assetflow.operators import incremental as inc
from assetflow.plans import catalog, catalog_builds  # noqa: F401  registers


def of_documents(spark, folder, rows, name):
    made = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    made.write.parquet(f"{folder}/documents.parquet")
    return catalog.QUERIES[name](spark, str(folder))


def test_case_of_whole_texts(spark, tmp_path):
    rows = [(1, "Straße " * 60 + "ÄÖé Ende ß"), (2, ""), (3, None)]
    got = {r["doc_id"]: (r["up"], r["low"]) for r in of_documents(spark, tmp_path, rows, "f4_upper_lower_whole").collect()}
    assert got == {i: (t and t.upper(), t and t.lower()) if t else (t, t) for i, t in rows}


def test_substr_of_whole_texts(spark, tmp_path):
    rows = [(1, "".join(chr(0x100 + k) for k in range(300))), (2, "ab"), (3, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in of_documents(spark, tmp_path, rows, "f6_substr_whole").collect()}
    assert got == {i: (t[1:], t[-3:], t[3:5], t[1:3], t[max(len(t) - 5, 0) : max(len(t) - 3, 0)]) for i, t in rows}


def test_human_size_of_every_document(spark, tmp_path):
    def brute(b):
        step, x = 0, float(b)
        while x > 1024:
            step, x = step + 1, x / 1024
        return f"{x:.{min(step, 1)}f} " + ("byte" if b == 1 else ("bytes", "KiB", "MiB", "GiB", "TiB")[step])

    # 48 * 48 / 1024 = 2.25 and 80 * 80 / 1024 = 6.25 lie between two tenths.
    rows = [(n, "x" * n) for n in (0, 1, 31, 32, 33, 48, 80, 112, 1000, 1024, 1025, 20000, 40000)]
    got = {r["doc_id"]: r["size"] for r in of_documents(spark, tmp_path, rows, "f17_human_size_whole").collect()}
    assert got == {n: brute(n * n) for n, _ in rows}


def test_forced_flags_reach_the_end_of_a_chain(spark):
    nodes = spark.createDataFrame([(f"n{k}", k == 0) for k in range(6)] + [("other", False)], "path string, forced boolean")
    chain = [(f"n{k + 1}", f"n{k}") for k in range(5)]
    edges = spark.createDataFrame([*chain, ("n0", "n5")], "output string, dependency string")
    want = {f"n{k}": True for k in range(6)} | {"other": False}
    assert {r["path"]: r["forced"] for r in inc.propagate_forced(nodes, edges).collect()} == want
    assert {r["path"]: r["forced"] for r in inc.propagate_forced(nodes, edges, most_rounds=5).collect()} == want
    with pytest.raises(ValueError, match="further than 4"):
        inc.propagate_forced(nodes, edges, most_rounds=4)
