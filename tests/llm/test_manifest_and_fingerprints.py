"""Merkle manifests and I-Match fingerprints against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetflow.llm import imatch, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, h string"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, s, "en", len(t or ""), t, "leaf", 7, "h") for i, s, t in rows], SCHEMA).repartition(parts)


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(i, s, t):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", len(t or ""), t)))


def tree(nodes, fanout):
    """Root, and of each leaf its siblings on both sides, level by level."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for k in range(len(run)):
                for leaf in own[a + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            up.append(sha("".join(run)))
            held.append(sum(own[a : a + fanout], []))
        nodes, own = up, held
    return nodes[0], paths


def plain_manifest(rows, fanout):
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subroots, out = [], []
    for s in sources:
        leaves = sorted(((i is not None, i or 0, leaf_of(i, s, t), i, t) for i, q, t in rows if q == s))
        root, paths = tree([x[2] for x in leaves], fanout)
        subroots.append(root)
        out.append([(x[3], x[4], s, x[2], p) for x, p in zip(leaves, paths, strict=True)])
    root, tops = tree(subroots, fanout)
    for leaves, subroot, top in zip(out, subroots, tops, strict=True):
        for i, t, s, leaf, path in leaves:
            path = path + top
            changed = None if t is None else t.replace("\n", "")
            h = leaf if changed == t else sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", len(t or ""), changed)))
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            yield i, leaf, subroot, root, sha("".join("".join(left + right) for left, right in path)), h, h == root


@pytest.mark.parametrize(("fanout", "upper"), [(2, 8), (3, 0), (3, 5), (4, 50_000)])
def test_manifest(spark, fanout, upper):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "", "ü"]), rng.choice(["x\ny", "", None, "é" * rng.randint(0, 9), "z" * 70_000 + "\n"])) for i in rng.sample(range(-99, 999), 60)]
    rows += [(5000, "one", "alone\n"), (None, "a", "no id"), (None, None, None), *rows[:4]]
    altered = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    got = merkle.verified(merkle.merkle_manifest(rows_of(spark, rows), altered=altered, fanout=fanout, upper_nodes=upper)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(rows, fanout)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_and_of_none(spark):
    ((only,),) = [merkle.verified(merkle.merkle_manifest(rows_of(spark, [(1, None, "x")]))).collect()]
    assert (only["leaf"], only["proof_sha256"], only["verified"]) == (only["root"], sha(""), True)
    none = merkle.verified(merkle.merkle_manifest(rows_of(spark, []), altered={"text": F.lit("other")}))
    assert none.collect() == [] and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, "s" if i % 3 else "t", f"text {i}") for i in range(50)]
    roots = {merkle.merkle_manifest(rows_of(spark, rng, parts)).first()["root"] for rng, parts in ((rows, 1), (rows[::-1], 5))}
    assert len(roots) == 1
    other = merkle.merkle_manifest(rows_of(spark, [*rows[:-1], (49, "s", "text 49 ")])).first()["root"]
    assert other not in roots


# ---- fingerprints


def plain_terms(text):
    return {t for t in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if t}


def plain_print(text, lexicon):
    known = sorted(plain_terms(text) & lexicon, key=str.encode)
    number = {t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in known}
    out = []
    for mask in imatch.MASKS:
        for byte in range(imatch.BYTES):
            own = [t for t in known if number[t] >> 8 * byte & mask == 0]
            out.append(hashlib.md5(" ".join(own).encode()).hexdigest()[:8] if own else imatch.NO_TERMS)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    told = [(x, y) for x, y in zip(a, b, strict=True) if {x, y} != {imatch.NO_TERMS}]
    return sum(x == y for x, y in told) / len(told)


def plain_fingerprints(texts, rarest, commonest):
    """Of distinct texts in order."""
    texts = [t or "" for t in texts]
    df = Counter(t for text in texts for t in plain_terms(text))
    lexicon = {t for t, n in df.items() if n * rarest >= len(texts) and n * commonest <= len(texts)}
    prints = [plain_print(t, lexicon) for t in texts]
    for k, text in enumerate(texts):
        other = texts[(k + 1) % len(texts)]
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        e = plain_print(edited, lexicon)
        yield n, hashlib.sha256(edited.encode()).hexdigest(), "".join(prints[k]), "".join(e), plain_likeness(prints[k], e), plain_likeness(prints[k], prints[(k + 1) % len(texts)])


@pytest.mark.parametrize(("rarest", "commonest"), [(20, 2), (500, 20), (3, 1)])
def test_fingerprints(spark, rarest, commonest):
    rng = random.Random(rarest)
    vocabulary = [f"w{i}" for i in range(40)] + ["Äb", "äb", "x-y", "ß", "日本語", "O'k", "\x01", "ÉÉ"]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 9, 60]))) for _ in range(40)]
    texts += [None, "", "😀" * 7, "w1 " * 60_000, texts[3], texts[3]]
    rows = [(3 * i - 20, None, t) for i, t in enumerate(texts)]
    got = imatch.edited_fingerprints(rows_of(spark, rows), rarest=rarest, commonest=commonest).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _, _ in rows]
    for r, want in zip(got, plain_fingerprints(texts, rarest, commonest), strict=True):
        assert tuple(r)[1:5] == want[:4]
        assert tuple(r)[5:] == pytest.approx(want[4:])
    alone = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(rows_of(spark, rows), rarest=rarest, commonest=commonest).collect()}
    assert alone == {r["doc_id"]: r["fingerprint"] for r in got}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (-11, 112, 115)}) == 1


def test_fingerprints_of_repeats_and_of_rows_without_id(spark):
    rows = [(None, "s", "a b c"), (None, "s", "a b c"), (None, "s", "d e"), (1, "s", "b c d"), (1, "s", "b c d"), (2, "s", None)]
    got = imatch.edited_fingerprints(rows_of(spark, rows), rarest=100, commonest=1)
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_chars").collect()))) == sorted(str((i, len(t or ""))) for i, _, t in rows)
    # Rows of one id and text are one document with one result.
    assert got.distinct().count() == 4


def test_fingerprints_of_one_and_of_none(spark):
    (only,) = imatch.edited_fingerprints(rows_of(spark, [(1, "s", "a b c d")])).collect()
    assert only["edited_sha256"] == sha("a b a b") and only["near_next"] == 1.0
    assert imatch.edited_fingerprints(rows_of(spark, [])).collect() == []
    assert imatch.fingerprints(rows_of(spark, [])).collect() == []


def test_edits_leave_small_subsets_alone(spark):
    """An edit of a few words keeps most of a long text's subsets, another text none."""
    rng = random.Random(9)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(150)) for _ in range(200)]
    words = texts[0].split()
    rows = [(i, "s", t) for i, t in enumerate([*texts, " ".join(["other", *words[3:]])])]
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(rows_of(spark, rows)).collect()}
    parts = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    assert plain_likeness(parts(prints[0]), parts(prints[200])) > 0.5 > plain_likeness(parts(prints[0]), parts(prints[1]))
