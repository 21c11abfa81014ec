"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assetflow.llm import collocations as c

SCHEMA = "lang string, text string, key binary, order_key int, range string, n int"


def brute(rows, least, longest, top, percent):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if a >= least}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        longer = [b for (l, q), b in frequent.items() if l == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def texts(seed, rows=150):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "é", "b\x01", "ab", "b!", "c,", "ß", "日本", "d\n", "e\x00"]
    passage = "one Two three four five six seven."
    out = []
    for i in range(rows):
        words = [rng.choice(vocabulary[: rng.choice([2, 4, 11])]) for _ in range(rng.choice([0, 1, 5, 40]))]
        words.insert(rng.randint(0, len(words)), passage if i % 3 else "one two")
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([" ", "  ", " \t"]).join(words)))
    return [*out, ("en", None), (None, None), ("en", ""), ("en", " \n ."), *out[:5]]


@pytest.mark.parametrize(("least", "longest", "top", "percent", "counters", "places", "range_rows"), [(3, 5, 2000, 100, 1 << 16, 300, 7), (20, 4, 6, 60, 64, 10**6, 100_000), (5, 2, 3, 100, 1 << 17, 90, 40), (300, 5, 9, 100, 64, 1000, 3)])
def test_plain_count(spark, least, longest, top, percent, counters, places, range_rows):
    rows = texts(least)
    df = spark.createDataFrame([(l, t, b"x", i, "y", i) for i, (l, t) in enumerate(rows)], SCHEMA).repartition(5)
    got = c.collocations(df, least=least, longest=longest, top=top, absorbed_percent=percent, counters=counters, range_places=places, range_rows=range_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top, percent)


def test_runs_leave_a_task_in_parts(spark, monkeypatch):
    """Stretches of a few runs and ranges of a few places give the counts of one stretch and range."""
    rows = [(l or "und", t) for l, t in texts(1, 60)]
    batch = pa.RecordBatch.from_pydict({"lang": [l for l, _ in rows], "text": [t for _, t in rows]})
    splits = sorted([("de", b"ab "), ("en", b""), ("en", b"a ab "), ("en", b"b "), ("en", b"b b b b b "), ("und", b"one two ")])

    def counts(held, splits):
        monkeypatch.setattr(c, "HELD_RUNS", held)
        out = c.run_maker(5, np.full(8, 255, np.uint8), 5, splits)(iter([batch, batch]))
        packed = sorted((r for b in out for r in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)), key=lambda r: r[:2])
        found = Counter()
        for k in range(len(splits) + 1):
            own = [r for r in packed if r[0] == k]
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], f.type) for i, f in enumerate(c._RUNS)], schema=c._RUNS)
            for b in c.prefix_counter(1, 5)(iter([rows])):
                for lang, key, n, f in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    found[lang, key, n] += f
        return found

    assert counts(1 << 20, []) == counts(3, splits) == counts(40, splits[2:4])


def test_long_text_and_exact_scores(spark):
    long = "x y " * 600_000
    df = spark.createDataFrame([("en", long), ("en", "p q. " * 120)], "lang string, text string")
    got = {r["phrase"]: r for r in c.collocations(df).collect()}
    n = 1_200_240
    assert tuple(got["p q"])[3:] == (120, 120, 120, n, 1000 * 120 * n // (120 * 120))
    assert got["x y"] is not None and got["x y x y x"]["a"] == 599_998
    assert "y x" not in got or 100 * got["y x y x y"]["a"] < 100 * got["y x"]["a"]


def test_products_pass_64_bits(spark, monkeypatch):
    big = 1 << 40
    rows = [("en", b"", 0, 5 * big), ("en", b"a ", 1, 3 * big), ("en", b"b ", 1, 2 * big + 1), ("en", b"a b ", 2, 2 * big)]
    monkeypatch.setattr(c, "phrase_counts", lambda *a: spark.createDataFrame(rows, "lang string, key binary, k int, f long"))
    (row,) = c.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert row["score"] == 1000 * (2 * big) * (5 * big) // ((3 * big) * (2 * big + 1))


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(df).collect() == []
    assert c.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []
