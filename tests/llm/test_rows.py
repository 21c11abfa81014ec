"""Filters, counts, shards, quality, mixes, secrets, archives and decontamination against SQL or brute force."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetflow.llm import decontaminate, mixing, oracles, quality, queries, secret_scan, sharding, token_counts, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, s, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(set(oracles.ORACLES) - {"op10_jaccard_join"}))
def test_query(name, same):
    same(queries.QUERIES[name], oracles.ORACLES[name])


# ---- op1


def test_url_rules_nest(spark):
    rules = spark.createDataFrame(
        [("com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("a.com", "/x/y/z", "allow"), ("b.a.com", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")],
        "host string, path string, verdict string",
    )
    urls = ["http://a.com/x/y/zz", "http://A.Com/x/y", "http://a.com/xq", "http://q.a.com/x/1?u=/y", "http://b.a.com/", "http://b.a.com/x/y/z", "http://xcom/", "http://com", "http://com/", "ftp://dup.org/#f", "no url", None, "", "://", "http://a.com/x/y/zz"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("mine"))
    plain = [(h, p, v) for h, p, v in [("com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("a.com", "/x/y/z", "allow"), ("b.a.com", "/", "block"), ("dup.org", "/", "block")]]
    for r in url_filter.filter_urls(df, rules, salts=3).collect():
        u = r["url"] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit) if fit else (0, None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[1], want[2]), u


def test_url_filter_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert tuple(url_filter.filter_urls(df, none).first()) == (1, "http://a.com/x", "a.com", "/x", None, "allow")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []


def test_hot_hosts_are_parted_by_their_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.example.net/"), F.when(F.col("id") % 3 == 0, "en/").otherwise("x"), "id").alias("url"))
    for rows in (20_000, 70):
        got = url_filter.filter_urls(df, rules, salts=1, salt_rows=rows).collect()
        assert len(got) == 3000
        assert all((r["rule"], r["verdict"]) == (("example.net/en/", "allow") if r["page_id"] % 3 == 0 else ("net/", "block")) for r in got)


# ---- op2


def test_token_histogram(spark, tiny):
    encode = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN).encode_ordinary
    rows = [r[0] for r in duckdb.sql(f"SELECT text FROM '{tiny}/documents.parquet'").fetchall()]
    rows += [None, "", "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    lengths = [len(encode(t or "")) for t in rows]
    table = token_counts.context_table(token_counts.length_histogram(df))
    got = {r["n_tokens"]: r for r in table.collect()}
    assert {k: r["docs"] for k, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = spark.createDataFrame([(0,), (7,), (512,), (2048,), (10**6,)], "context_limit long")
    for r in token_counts.at_limits(table, limits).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in lengths)
        assert r["docs_over"] == sum(x > r["context_limit"] for x in lengths)
    half = token_counts.quantiles(table, [0.5]).first()["n_tokens"]
    assert half == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_token_histogram_of_nothing(spark):
    assert token_counts.context_table(token_counts.length_histogram(spark.createDataFrame([], "text string"))).collect() == []


# ---- op3


def check_shards(rows, shards):
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count.get(s, 0)))


def test_shards_are_even_and_move_little(spark):
    rows = [(i, "s", f"text {i}" if i % 3 else "hot") for i in range(3000)] + [(None, "s", None), (1, "s", "text 1"), (1, "s", "text 1"), (9, "s", "é")]
    df = docs_of(spark, rows).withColumn("shard", F.lit(-1))
    a = sharding.assign_shards(df, 24).collect()
    check_shards(a, 24)
    assert len(a) == len(rows)
    for r in a:
        if r["doc_id"] == 9 and r["size"] == 10:
            assert r["text_crc32"] == zlib.crc32("é".encode())
    light = docs_of(spark, [(i, "s", f"text {i}") for i in range(3000)])
    at = {k: {r["doc_id"]: r["shard"] for r in sharding.assign_shards(light, k).collect()} for k in (24, 25)}
    moved = sum(at[24][i] != at[25][i] for i in at[24])
    assert moved < 0.35 * len(at[24])
    assert at[24] == {r["doc_id"]: r["shard"] for r in sharding.assign_shards(light.repartition(7), 24).collect()}


def test_shards_of_few_rows(spark):
    assert sharding.assign_shards(docs_of(spark, []), 24).collect() == []
    check_shards(sharding.assign_shards(docs_of(spark, [(1, "s", "a"), (2, "s", "b")]), 24).collect(), 24)


def test_settle_fills_exactly():
    points = sharding.ring(5, 8)
    rng = random.Random(1)
    counts = [rng.choice([0, 0, 3, 500]) for _ in points]
    settled = sharding.settle(points, counts, sharding.capacities(sum(counts), 5))
    assert [sum(n for _, n in p) for p in settled] == counts
    by = Counter()
    for p in settled:
        for s, n in p:
            by[s] += n
    assert [by[s] for s in range(5)] == sharding.capacities(sum(counts), 5)


# ---- op4


def repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    c = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)})


def test_quality_metrics(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 30, 200)] + ["a b c d e " * 3, "x\ny\nx\n\n \nx # $ é", None, "", "\x0b\x0cé\t", " ".join(f"w{i}" for i in range(5000))]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    for r in quality.judge(docs_of(spark, rows), ("doc_id",)).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert tuple(r[c] for c in quality.METRICS[:5]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * want[4] > 20 * len(w))


def test_bad_hosts_are_rejected_and_small_ones_are_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(20)), "too short"
    rows = [(i, "bad", bad if i % 10 else good) for i in range(200)] + [(1000 + i, "fine", good) for i in range(400)] + [(2000, "small", bad), (2001, "small", good), (3000, None, good)]
    kept = {r["doc_id"] for r in quality.kept_documents(docs_of(spark, rows)).select("doc_id").collect()}
    assert not any(i < 200 for i in kept)
    assert {1000 + i for i in range(400)} <= kept and 2001 in kept and 3000 in kept and 2000 not in kept


def test_quality_keeps_columns_with_its_own_names(spark):
    df = docs_of(spark, [(1, "s", " ".join(f"w{i}" for i in range(20)))]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit("mine"))
    assert quality.kept_documents(df).select("n_words", "kept").collect() == [("mine", "mine")]
    assert quality.kept_documents(docs_of(spark, [])).collect() == []


# ---- op6


def test_archives(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/\r\n", big), (5, "u", big), (3, None, big), (2, "u", other), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "a\r\n\r\nb" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        kind, to = ("revisit", 5) if html == big and i != 5 else ("response", None)
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), kind, to)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("archive/data.warc", "indexes/é.cdxj"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as m:
                m.write(name.encode() * 3)
        z.comment = b"comment"
    raw = out.getvalue()
    read = lambda at, n: raw[at : at + n]
    for m in warc.directory(read, len(raw)):
        at = warc.data_start(read, m)
        assert raw[at : at + m["size"]] == m["name"].encode() * 3


def test_zip64_end_and_sizes():
    """A directory whose count, sizes and places are all in ZIP64 fields."""
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"n" + struct.pack("<HHQQ", 1, 16, 3, 3) + b"abc"
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    at = len(local) + len(entry)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local)) + struct.pack("<4sIQI", b"PK\6\7", 0, at, 1)
    raw = local + entry + end64 + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    read = lambda a, n: raw[a : a + n]
    (m,) = warc.directory(read, len(raw))
    assert (m["size"], read(warc.data_start(read, m), 3)) == (3, b"abc")


# ---- op7


def test_mix_hits_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaabbc"), " ".join("w" * rng.randrange(60))) for i in range(600)] + [(700, None, "one two"), (701, None, None), (702, "empty", ""), (1, "a", "same id"), (1, "a", "same id")]
    docs = docs_of(spark, rows)
    got = mixing.mix_sources(docs, mixing.ranked_weights(docs, (5, 2, 1)), 1.5, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    again = mixing.mix_sources(docs.repartition(5), mixing.ranked_weights(docs, (5, 2, 1)), 1.5, keep=("doc_id", "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs.limit(0), mixing.ranked_weights(docs.limit(0), (5, 2, 1)), 1.5).collect() == []


# ---- op8

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")


def brute_secrets(text):
    b = (text or "").encode()
    at = lambda k: len(b[:k].decode())
    out = [(at(m.start()), 0, "assign", at(m.end())) for m in ASSIGN.finditer(b) if len(m[2]) >= 8]
    out += [(at(m.start()), 1, "access", at(m.end())) for m in ACCESS.finditer(b) if len(m[0]) >= 16]
    out += [(at(m.start()), 2, "hex", at(m.end())) for m in HEX.finditer(b) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets(spark):
    rng = random.Random(11)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "==", "abc12345", "x", "é", "AKIA", "AKIAABCDEFGH123456", "ABCDEFGH", "0123456789abcdef" * 2, "deadbeef", "\n", "tok", "en", "-", "/."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(3000)] + [None, "", "é" * 1000 + "token=abcdefgh"]
    got = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert [tuple(s) for s in r["spans"]] == brute_secrets(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_secrets_query(spark, tiny):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())
    for r in queries.QUERIES["op8_secrets"](spark, tiny).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()


# ---- op9


def brute_hits(text, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w = split(text)
    hit, found = set(), set()
    for i, t in items:
        v = split(t)
        k = min(13, len(v))
        wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in wins:
                hit |= set(range(a, a + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(40)] + ["É", "ñu"]
    long_ = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(13, 40))) for _ in range(12)]
    items = list(enumerate([*long_, "one two", "Solo", "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 v12", None, "...", long_[0], "a a a a a"]))
    texts = []
    for _ in range(200):
        w = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1] or ""
            x = x.split()
            a = rng.randrange(max(1, len(x)))
            w[rng.randrange(len(w) + 1) : 0] = x[a : a + rng.randrange(1, 30)]
        texts.append(rng.choice([" ", ", ", "-"]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += [None, "", "solo", "a a a a a a a", *long_]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.hits(docs, bench).collect():
        n, hit, found = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found), texts[r["doc_id"]]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert not any(r["contaminated"] for r in decontaminate.hits(docs, bench.limit(0)).collect())
    assert decontaminate.hits(docs.limit(0), bench).collect() == []


# ---- pipeline


def test_pipeline_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    plain = {r["doc_id"]: r for r in docs.collect()}
    from .test_pairs import brute_components

    judged = duckdb.connect()
    for t in ("documents", "benchmark"):
        judged.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    kept = {r[0] for r in judged.execute(oracles.OP4).fetchall() if r[-1]}
    got = corpus_pipeline.quality_rules(spark, docs, tiny)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == kept
    left = {c for _, _, c in brute_components([(i, plain[i]["text"]) for i in sorted(kept)])}
    got = corpus_pipeline.ngram_jaccard_join(spark, got, tiny)
    assert {r["doc_id"] for r in got.collect()} == left
    items = judged.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = {i for i in left if (x := brute_hits(plain[i]["text"], items))[1] == 0 or 20 * x[1] < x[0]}
    got = corpus_pipeline.benchmark_decontamination(spark, got, tiny)
    assert {r["doc_id"] for r in got.collect()} == clean
    mixed = corpus_pipeline.source_mixing(spark, got, tiny)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= clean and max(copies.values()) <= 2
    whole = corpus_pipeline.run(spark, tiny).collect()
    assert Counter(r["doc_id"] for r in whole) == copies
    check_shards(whole, queries.SHARDS)
