"""Odd input for every operator and stage: long texts, clashing columns, empty tables, nulls, ties, texts made to collide."""

import bisect
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assetflow.llm import decontaminate, jaccard_join, mixing, quality, queries, secret_scan, sharding, suffix_dedup, token_counts, url_filter, warc

from .test_pairs import brute_components, brute_dedup, docs_of
from .test_rows import brute_hits, brute_secrets, repeats

LONG = 2_300_000
CLASHES = ["n_words", "n_bytes", "n_removed", "kept", "spans", "size", "slot", "shard", "target", "taken", "component_id", "__id", "__text", "__of", "__who", "key", "check", "id", "tie", "set", "region", "kind", "items", "words", "hash"]


def long_text(seed=1, n=LONG):
    rng = random.Random(seed)
    words = [f"{rng.randrange(36**4):x}" for _ in range(n // 5)]
    return " ".join(words)[:n]


def clashing(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


# ---- long texts


def test_tokens_of_any_text(spark):
    encoding = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    plain = ["x" * 3_000_000, "\0" * 2_000_000, "ab " * 200_000, " \t\n" * 1200 + "x", "a" + " " * 5000 + "b", "!" + " " * 5000, "　" * 4500 + "\x1c" * 10 + " 'll"]
    texts = [*plain, " " * 2_000_000 + "x", "y" + "\n" * 2_000_000]
    got = {r["n_tokens"]: r["docs"] for r in token_counts.length_histogram(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = [len(encoding.encode_ordinary(t)) for t in plain]
    blank = lambda c, n: len(encoding._encode_single_piece(c * n))
    want += [blank(" ", 1_999_999) + len(encoding.encode_ordinary(" x")) + 0, len(encoding.encode_ordinary("y")) + blank("\n", 2_000_000)]
    assert got == Counter(want)


def test_pieces_of_blanks_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(token_counts, "_BLANKS", re.compile(token_counts._BLANKS.pattern.replace("{4096,}", "{3,}")))
    encoding = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "b1", "'s", "!", "é", "\r\n", " " * 5]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert token_counts.encoded_length(encoding, text) == len(encoding.encode_ordinary(text)), text


def test_repeats_in_a_long_text(spark):
    a = long_text()
    rows = [(1, a), (2, a[1_000_000:1_200_000] + "!" + a[-150:]), (3, a[1_048_500:1_048_700])]
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows)).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(rows)


def test_components_of_long_texts(spark):
    a = long_text()
    w = a.split()
    near = " ".join(w[: len(w) * 9 // 10])
    rows = [(5, a), (3, near), (9, long_text(2)), (4, "short text of just a few words"), (8, " ".join(w[:1000]))]
    got = jaccard_join.jaccard_components(docs_of(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_decontamination_of_a_long_text(spark):
    a = long_text()
    w = a.split()
    items = [(1, " ".join(w[100_000:100_040])), (2, " ".join(w[-13:])), (3, "none of this is in there"), (4, w[7])]
    docs = [(1, a), (2, "x " * 1_200_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.hits(docs_of(spark, docs), bench).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(dict(docs)[r["doc_id"]], items)


def test_rows_of_long_texts(spark):
    a = long_text() + " token=abcdefgh1 é AKIAABCDEFGH123456 " + "f" * 40
    line = "one line of eight words, each time again\n"
    rows = [(1, a), (2, line * 60_000), (3, "x" * LONG)]
    df = docs_of(spark, rows)
    for r in secret_scan.scan_secrets(df).collect():
        assert [tuple(s) for s in r["spans"]] == brute_secrets(dict(rows)[r["doc_id"]])
    for r in quality.judge(df, ("doc_id",)).collect():
        t = dict(rows)[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeats(w))
    got = {r["doc_id"]: r for r in sharding.assign_shards(df, 24).collect()}
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows}
    mixed = mixing.mix_sources(df, mixing.ranked_weights(df, (5, 2, 1)), 1.5).collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len(t.split()) for i, t in rows}


def test_long_payloads_and_urls(spark):
    big = long_text(n=5_000_000)
    rows = [(1, "http://a.net/" + "p" * 1_100_000, big), (2, "http://b.org/fr/x", big), (3, "http://b.org/fr/y", "small"), (4, None, big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"{warc.shared_dir(spark)}/long-packages"
    back = warc.read_packages(warc.write_packages(df, folder, package_bytes=3_000_000)).collect()
    assert {(r["page"], r["type"], r["refers"]) for r in back} == {("1", "revisit", "2"), ("2", "response", None), ("3", "response", None), ("4", "response", None)}
    assert {r["page"]: bytes(r["payload"]).decode() for r in back if r["type"] == "response"} == {"2": big, "3": "small", "4": big + "!"}
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df.select("page_id", "url"), rules).collect()}
    assert got == {1: ("net/", "block"), 2: ("org/fr/", "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow")}


def test_archives_are_read_by_many_tasks(spark):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 3000) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    made = warc.write_packages(df, f"{warc.shared_dir(spark)}/many", package_bytes=20 << 20)
    back = warc.read_packages(made)
    used = back.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) >= 3 and sum(r["count"] for r in used) == 400


# ---- texts made to collide


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_texts_that_collide_under_a_polynomial(spark):
    t = thue_morse(4096)
    other = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, t), (2, other), (3, f"{t} x y z u v w"), (4, f"{other} x y z u v w")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(1, t)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.hits(docs_of(spark, rows), bench).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    pair = [(1, t), (2, other)]
    got = suffix_dedup.suffix_dedup(docs_of(spark, pair)).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(pair)


# ---- the metric join at its own limits


def test_cells_at_the_limits_of_production(spark, monkeypatch):
    rng = random.Random(21)
    calls = []
    whole = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links: calls.append(1) or whole(links))
    base = [f"b{k}" for k in range(160)]
    rows = []
    for i in range(1400):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(160)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert len(calls) >= 2  # stars of sub-pivots, and the links of all cells
    assert sorted(tuple(r) for r in got) == brute_components(rows)


# ---- clashing columns, rows told apart


def test_operators_leave_other_columns_alone(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven"), (3, "password: abcdefgh12"), (4, None), (4, "")]
    df, plain = clashing(docs_of(spark, rows)), docs_of(spark, rows)
    page = lambda d: d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), "doc_id").alias("url"), F.col("text").alias("html"), *[c for c in d.columns if c in CLASHES])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    weights = lambda d: mixing.ranked_weights(d, (5, 2, 1))
    for run in (
        token_counts.length_histogram,
        suffix_dedup.suffix_dedup,
        secret_scan.scan_secrets,
        jaccard_join.jaccard_components,
        lambda d: decontaminate.hits(d, bench),
        lambda d: sharding.assign_shards(d, 5),
        lambda d: mixing.mix_sources(d, weights(d), 1.5),
        lambda d: warc.round_trip(page(d)),
        lambda d: quality.judge(d, ("doc_id",)),
    ):
        assert sorted(map(str, run(df).collect())) == sorted(map(str, run(plain).collect()))
    for run in (jaccard_join.one_of_each, quality.kept_documents, lambda d: decontaminate.clean_documents(d, bench), lambda d: mixing.mixed_documents(d, (5, 2, 1), 1.5)):
        out = run(df)
        assert out.columns == df.columns
        assert sorted(map(str, out.drop(*CLASHES).collect())) == sorted(map(str, run(plain).collect()))
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHES)
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    out = url_filter.filter_urls(page(df), rules)
    assert {r["verdict"] for r in out.collect()} == {"block"} and set(CLASHES) <= set(out.columns)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = [(1, a), (1, b), (2, a), (None, b), (None, a), (1, a), (3, None), (3, None)]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs_of(spark, rows)).collect())
    assert got == {(1, a): 1, (1, b): 1, (3, None): 2}
    left = [(None, a), (None, a), (None, b)]
    assert Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs_of(spark, left)).collect()) == {(None, a): 1, (None, b): 1}
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in decontaminate.clean_documents(docs_of(spark, rows), bench).collect())
    assert got == {(1, b): 1, (None, b): 1, (3, None): 2}


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_with_odd_rows(spark, tiny, stage):
    name, run = corpus_pipeline.STAGES[stage]
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good, None, None, None), (2, None, None, "s", None), (3, "", "en", None, 0), (4, long_text(3), "en", "t", 5), (5, good + " more", "de", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0), clashing(docs)):
        out = run(spark, df, tiny)
        got = out.collect()
        assert (out.columns == df.columns) == (name != "ring_sharding")
        if name == "ring_sharding":
            assert len(got) == df.count()
        else:
            assert {str(r["text"]) for r in got} <= {str(r[1]) for r in rows}


# ---- shards, sources and secrets against plain versions


@pytest.mark.parametrize("part_rows", [200_000, 40])
def test_ring_against_a_walk_of_each_key(spark, part_rows):
    rng = random.Random(8)
    rows = [(i, f"text {rng.randrange(500)}" if i % 3 else "hot") for i in range(2500)] + [(None, "null id"), (7, None), (8, "é")]
    shards = 11
    points = sorted((zlib.crc32(f"{s}/{v}".encode()) % 65536, s) for s in range(shards) for v in range(sharding.VIRTUAL_NODES))
    capacity = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    at = [p for p, _ in points]
    fine = max(64, -(-len(rows) // part_rows))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    arcs = {}
    for i, t in rows:
        place = xxhash.xxh64((t or "").encode(), seed=42).intdigest() % 65536
        order = xxhash.xxh64(b"order", seed=42).intdigest()
        if i is not None:
            order = xxhash.xxh64(struct.pack("<q", i), seed=order).intdigest()
        order = signed(order)
        arcs.setdefault(bisect.bisect_left(at, place) % len(points), []).append((order, -1 if i is None else i, zlib.crc32((t or "").encode()), (i, t)))
    room, want, late = list(capacity), Counter(), []
    for a in range(len(points)):
        keys = arcs.get(a, [])
        parts = max(1, -(-len(keys) // part_rows))
        for key in sorted(keys, key=lambda k: (k[0] % fine * parts // fine, k)):
            s = points[a][1]
            if room[s]:
                room[s] -= 1
                want[(*key[-1], s)] += 1
            else:
                late.append((a, key[-1]))
    for a, key in late:
        step = a + 1
        while not room[points[step % len(points)][1]]:
            step += 1
        s = points[step % len(points)][1]
        room[s] -= 1
        want[(*key, s)] += 1
    got = sharding.assign_shards(docs_of(spark, rows), shards, keep=("doc_id", "text"), part_rows=part_rows).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in got) == want
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(capacity[s])) for s in range(shards))


def test_sources_are_ranked_in_code_point_order(spark):
    rng = random.Random(9)
    names = [None, "", "é", "z", "Z", "\U0001f600", "￮"] + ["".join(rng.choice("abcXYZ-é") for _ in range(6)) for _ in range(400)]
    docs = spark.createDataFrame([(n,) for n in names for _ in range(2)], "source string").repartition(7)
    got = {r["__source"]: r["weight"] for r in mixing.ranked_weights(docs, (5, 2, 1)).collect()}
    ordered = sorted(set(names) - {None}) + [None]
    assert got == {n: float((5, 2, 1)[k % 3]) for k, n in enumerate(ordered)}


ADDED = [("github", r"gh[pousr]_([A-Za-z0-9]+)", 36), ("slack", r"xox[abprs]-([A-Za-z0-9-]+)", 10), ("google", r"AIza([0-9A-Za-z_-]+)", 35), ("pem", r"-----BEGIN (?:|RSA |EC |DSA |OPENSSH |ENCRYPTED )PRIVATE KEY(-+)", 5)]


def test_added_secrets_change_no_base_ones(spark):
    rng = random.Random(12)
    parts = ["AKIAABCDEFGH123456", "ghp_", "gho_", "gh", "xoxb-", "xox", "AIza", "-----BEGIN ", "RSA ", "EC ", "PRIVATE KEY", "-----", "-", "A1b2C3d4E5F6" * 3, "a1-", "token=", "0123456789abcdef" * 2, " ", "_", "é", "BEGIN ", "abcdefghij"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + [None, ""]
    order = [r.name for r in secret_scan.RULES + secret_scan.ADDED]
    found = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        text = texts[r["doc_id"]] or ""
        want = brute_secrets(text) + [(k, m.start(), m.end()) for k, p, n in ADDED for m in re.finditer(p, text) if len(m[1]) >= n]
        assert [tuple(s) for s in r["spans"]] == sorted(want, key=lambda s: (s[1], order.index(s[0]))), text
    assert {s["kind"] for r in found for s in r["spans"]} == set(order)
    assert secret_scan.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
