"""Near copies and repeated strings against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from assetflow.llm import jaccard_join, oracles, queries, suffix_dedup
from assetflow.llm.common import BASE, Rolling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def brute_components(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORDS.findall((t or "").translate(upper))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(x), find(i)) for i, x in sets)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    base = [f"b{rng.randrange(400)}" for _ in range(120)]
    rows = [(100 + i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(150)]
    rows += [(i, "Same text  here") for i in (7, 3, 5)] + [(8, "same TEXT here"), (9, None), (10, ""), (11, " \n"), (12, "a b c d e"), (13, "a b c d e f"), (14, "é ü ß ñ ö é ü ß ñ ö")]
    rows += [(500 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " the common line that all of these documents share") for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4096, 40])
def test_components(spark, near_rows, limit):
    got = jaccard_join.jaccard_components(docs_of(spark, near_rows), region_sets=limit, bucket_shingles=1500)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(near_rows)


def test_components_of_odd_tables(spark):
    assert jaccard_join.jaccard_components(docs_of(spark, [])).collect() == []
    rows = docs_of(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")])
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1)]


def test_one_of_each(spark, near_rows):
    df = docs_of(spark, [*near_rows, (3, "Same text  here")])
    got = [r["doc_id"] for r in jaccard_join.one_of_each(df).collect()]
    assert sorted(got) == sorted({c for _, _, c in brute_components(near_rows)})


def test_forest_finds_all_components():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(80)]
    n = np.array([len(s) for s in sets])
    parent = list(range(80))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in jaccard_join.forest(n, sets):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        parent[find(a)] = find(b)
    for a in range(80):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def test_components_query(same):
    same(queries.QUERIES["op10_jaccard_join"], oracles.ORACLES["op10_jaccard_join"])


def brute_dedup(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 2])
def test_repeated_strings(spark, most):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    passage = [text(rng.randrange(90, 400)) for _ in range(6)]
    rows = [(i, text(rng.randrange(300)) + "".join(rng.choice(passage)[rng.randrange(60) :] + text(rng.randrange(80)) for _ in range(rng.randrange(4)))) for i in range(120)]
    rows += [(200, "a" * 1500), (201, "ab" * 400), (202, "a" * 99), (203, "a" * 100), (204, None), (205, ""), (206, "x" * 50 + "a" * 101), (207, rows[3][1])]
    rng.shuffle(rows)
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows), most_contexts=most).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8) % 4 + 97
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    row, lo, hi, anchor, h, _ = suffix_dedup.anchors_in_pieces(data, np.array([0, len(data)]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert starts.tolist() == list(range(len(data) - 99))
    assert ((anchor >= hi) & (anchor <= lo + 68)).all()


def test_suffix_sort_orders_groups():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    place = rng.integers(0, 3900, 300)
    group = np.sort(rng.integers(0, 9, 300))
    order = suffix_dedup.Suffixes(data, place, 5).sort(group)
    raw = data.tobytes()
    got = [(group[i], raw[place[i] : place[i] + 100]) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(300))


def test_suffix_sort_does_not_trust_its_hashes(monkeypatch):
    """With hashes that tell nothing, or only the first letters, bytes still decide."""
    rng = np.random.default_rng(5)
    for words in (2, 5, 40):
        own = [bytes(rng.integers(97, 99, 100).astype(np.uint8)) for _ in range(words)]
        texts = [own[i] + bytes(rng.integers(97, 99, 20).astype(np.uint8)) for i in rng.integers(0, words, 120)]
        n = len(texts)
        ids, zero = rng.permutation(n), np.zeros(n, np.int64)
        want = set()
        seen = {}
        for k in np.argsort(ids):
            for step in range(21):
                if (step, texts[k][step : step + 100]) in seen:
                    want.add((int(k), step))
                seen[step, texts[k][step : step + 100]] = k
        for of in (lambda self, a, b: np.zeros(len(a), np.uint64), lambda self, a, b: self.prefix[np.minimum(a + 1, b)] - self.prefix[a], None):
            with monkeypatch.context() as m:
                if of is not None:
                    m.setattr(Rolling, "of", of)
                c, p = suffix_dedup.repeats_among(zero.astype(np.uint64), ids, zero, zero, np.full(n, 20), texts, 3)
            assert set(zip(c.tolist(), p.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [4096, 2])
def test_texts_that_collide_under_a_public_base(spark, most):
    """Two different strings with equal polynomial hashes under the base that ``Rolling`` has by default, alternating in random
    surroundings: every string after its first is removed, in every run."""
    one, two = colliding_strings()
    roll = Rolling(np.frombuffer(one + two, np.uint8))
    a, b = roll.of(np.array([0, 100]), np.array([100, 200]))
    assert one != two and a == b
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("uvwxyz") for _ in range(n))
    rows = [(i, word(60) + (one, two)[i % 2].decode() + word(60)) for i in range(20)]
    want = brute_dedup(rows)
    for _ in range(3):
        got = suffix_dedup.suffix_dedup(docs_of(spark, rows), most_contexts=most).drop("kept")
        assert sorted(tuple(r) for r in got.collect()) == want


def colliding_strings():
    """Two strings of 100 letters with one hash: small multiples of the first powers of BASE that cancel modulo 2**64, found by
    lattice reduction."""
    step = [2, -4, -3, 2, 0, 0, -1, 0, -3, -3, 1, -4, -2, -2, 3, -3, 2, 0, 0, 2, 4, 1, 1, -1]
    assert sum(d * pow(BASE, i, 1 << 64) for i, d in enumerate(step)) % (1 << 64) == 0
    tail = b"the rest of both strings is the same, and they are cut where they have a hundred letters"[: 100 - len(step)]
    return bytes(105 + max(0, -d) for d in step) + tail, bytes(105 + max(0, d) for d in step) + tail


def test_rolling_hash_is_of_content():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    r = Rolling(data)
    at = np.array([0, 3, 6])
    a, b, c = r.of(at, at + 3)
    assert a == b != c


def test_dedup_of_tables(spark, tiny):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    got = queries.QUERIES["op5_suffix_dedup"](spark, tiny)
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(rows)


def test_dedup_of_odd_tables(spark):
    assert suffix_dedup.suffix_dedup(docs_of(spark, [])).collect() == []
    t = "z" * 60 + "y" * 60
    got = suffix_dedup.suffix_dedup(docs_of(spark, [(1, t), (1, t), (None, t)]))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 120, 120]


@pytest.mark.parametrize("most", [4096, 2])
def test_dedup_keeps_rows_that_come_twice(spark, most):
    t = "z" * 60 + "y" * 60
    for rows in ([(1, t), (1, t)], [(None, t), (None, t)]):
        got = suffix_dedup.suffix_dedup(docs_of(spark, rows), most_contexts=most).collect()
        assert [(r["n_removed"], bytes(r["kept"]).decode()) for r in got] == [(0, t)] * 2
    # Against the same rows taken once: chunks and edges of their own, and passages that others repeat.
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    passage = [text(150) for _ in range(3)]
    once = [(i, text(130) + rng.choice(passage) + text(40) + rng.choice(passage)[20:]) for i in range(30)]
    got = suffix_dedup.suffix_dedup(docs_of(spark, once * 2).repartition(3), most_contexts=most).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_dedup(once) * 2)
