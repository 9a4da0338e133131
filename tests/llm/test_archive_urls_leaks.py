"""Operators 8, 9 and 10 against brute force."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palaver.llm import decontamination, url_filters, warc_archive
from palaver.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark):
    rows = [(k, f"http://a/{k}", f"page {k % 4} é" if k % 3 else "common") for k in range(40)] + [(50, None, None), (51, "u\r\nX: y", ""), (None, "n", "common"), (7, "http://a/7", "page 3 é"), (7, "http://a/7", "page 3 é")]
    df = spark.createDataFrame(rows, PAGES).withColumn("record", F.lit("clash"))
    path = shared_dir(spark, "test")
    warc_archive.write_archive(df, path)
    records = warc_archive.read_archive(spark, path).collect()
    assert len(records) == len(rows) and all(r["verified"] for r in records)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    lead = {}
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = max(i, lead.get(h or "", i))
    seen = []
    for r in records:
        html = bytes(r["payload"]).decode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and r["payload_bytes"] == len(html.encode())
        assert (r["record_type"] == "response") <= (r["id"] == lead[html]) and r["refers_to"] == (lead[html] if r["record_type"] == "revisit" else None)
        seen.append((r["id"], r["record_type"], html))
        assert bytes(r["header"]).startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in bytes(r["header"])
    for html in lead:
        assert sum(t == "response" for _, t, h in seen if h == html) == 1
    sizes = warc_archive.read_archive(spark, path).select(F.length(warc_archive.record_bytes(F.col("record_type"), F.col("header"), F.col("payload"))).alias("n")).collect()
    assert all(r["n"] > 100 for r in sizes)


def test_small_payloads_are_all_responses(spark):
    path = shared_dir(spark, "test")
    warc_archive.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")], PAGES), path, least=5)
    assert {r["id"]: r["record_type"] for r in warc_archive.read_archive(spark, path).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = shared_dir(spark, "test")
    warc_archive.write_archive(spark.createDataFrame([], PAGES), empty)
    assert warc_archive.read_archive(spark, empty).count() == 0


def test_damage_is_seen(spark):
    path, other = shared_dir(spark, "test"), shared_dir(spark, "test")
    warc_archive.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "cd")], PAGES), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    damaged = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.decode("payload", "UTF-8") == "ab", F.encode(F.lit("aX"), "UTF-8")).otherwise(F.col("payload")))
    damaged.write.parquet(f"{other}/payloads")
    assert {r["id"]: r["verified"] for r in warc_archive.read_archive(spark, other).collect()} == {1: False, 2: True}


def parsed(record):
    """(headers, block) of a record, by its own Content-Length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    assert version == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n"
    return fields, block


def test_records_are_valid(spark):
    """Each record stands by itself: required headers, lengths, revisits that name a response, exact urls."""
    rows = [(1, "http://a/é", "same é"), (2, "http://b\r\nX: y%0A", "same é"), (3, "", "x" * 300_000), (4, None, None), (None, "http://c", "same é")]
    path = shared_dir(spark, "test")
    warc_archive.write_archive(spark.createDataFrame(rows, PAGES), path, date=F.lit("2024-02-03 04:05:06").cast("timestamp"))
    found = [parsed(bytes(r["bytes"])) for r in warc_archive.records(spark, path).collect()]
    by_uri = {f["WARC-Record-ID"]: (f, b) for f, b in found}
    assert len(by_uri) == len(rows) and {f["WARC-Date"] for f, _ in found} == {"2024-02-03T04:05:06Z"}
    for f, b in found:
        http, _, body = b.partition(b"\r\n\r\n")
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", f["WARC-Record-ID"]) and http.startswith(b"HTTP/1.1 200 OK")
        if f["WARC-Type"] == "revisit":
            lead, its = by_uri[f["WARC-Refers-To"]]
            assert body == b"" and lead["WARC-Type"] == "response" and lead["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
            assert f.get("WARC-Refers-To-Target-URI") == lead.get("WARC-Target-URI") and f["WARC-Refers-To-Date"] == lead["WARC-Date"]
            body = its.partition(b"\r\n\r\n")[2]
        assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    read = warc_archive.read_archive(spark, path).collect()
    assert sorted(((r["id"], r["url"], bytes(r["payload"]).decode()) for r in read), key=str) == sorted(((i, u, h or "") for i, u, h in rows), key=str)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("block", "org/a/b"), ("allow", "org/a/b/c"), ("block", "x.com"), ("allow", "x.com"), ("allow", "com/")]


def brute_verdict(url, rules):
    _, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if found else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


#: Two entries of equal length can fit one url.
EVEN = [("allow", "org/a/b"), ("block", "x.org/a"), ("block", "com/a"), ("allow", "com/b"), ("allow", "x.com"), ("block", "y.x.com")]


@pytest.mark.parametrize("rules", [url_filters.RULES, RULES, EVEN])
def test_urls(spark, rules):
    rnd = random.Random(1)
    parts = ["x.org", "org", "example.org", "a.example.org", "xexample.org", "X.com", "y.x.com", "com", "net", "É.org", "org.", ""]
    urls = [f"{rnd.choice(['http', 'HTTPS', 'a://b'])}://{rnd.choice(parts)}{rnd.choice(['', ':80'])}{rnd.choice(['', '/', '/es/', '/es', '/en/1', '/en/12/x', '/en', '/a/b', '/a/bc', '/a/b/c', '/a/b/cd/e', '//a', '/fr/x', '/de/'])}{rnd.choice(['', '?q=/es/', '#/en/1'])}" for _ in range(600)]
    df = spark.createDataFrame([(k, u, "r") for k, u in enumerate([*urls, "http://x.org/a/b", "http://x.org/a/" + "b/" * 50_000, None, "", "no scheme", "://", "://org/es/\nx", "http://example.org/es/"])], "page_id long, url string, judged string")
    for r in url_filters.filter_urls(df, rules).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(r["url"], rules), r["url"]
        assert r["judged"] == "r"
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_leak(text, items, size=10):
    words, hit, found = brute_words(text), set(), set()
    for item, t in items:
        ws = brute_words(t)
        windows = [ws[k : k + size] for k in range(max(1, len(ws) - size + 1))] if ws and item is not None else []
        for w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 15])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rnd = random.Random(9)
    some = lambda n: " ".join(rnd.choice(["the", "of", "a", "Été", "x1", "zz"]) for _ in range(n))
    items = [(k, some(rnd.choice([3, 9, 10, 11, 30]))) for k in range(12)] + [(20, ""), (21, None), (None, "the of a"), (3, "the of the of the"), (22, "the"), (22, "the")]
    texts = [some(60) + ", " + rnd.choice(items[:12])[1].upper() + "--" + some(5) for _ in range(30)] + [None, "", "!!", "the", "THE\tof\na", some(3000)]
    docs = spark.createDataFrame([(k, t, "i") for k, t in enumerate(texts)] + [(0, texts[0], "i")], "doc_id long, text string, items_ string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.contamination(docs, bench).collect():
        want = brute_leak(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == want
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == want[1]
    nothing = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(nothing) == docs.count() and all(r["n_hit"] == 0 and not r["items"] for r in nothing)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def brute_near(text, item, counts, terms=6, span=20):
    words = brute_words(text)
    rare = sorted(set(brute_words(item)), key=lambda w: counts.get(w, 0))[:terms]
    return any(set(rare) <= set(words[k : k + span]) for k in range(max(1, len(words) - span + 1)))


@pytest.mark.parametrize("block", [500_000, 40])
def test_proximity_is_brute_force(spark, monkeypatch, block):
    """Items and texts over words with distinct counts, so that the rarest are the same for both."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rnd = random.Random(4)
    names = [f"w{k}" for k in range(30)]
    texts = [" ".join(rnd.choices(names, range(1, 31), k=rnd.choice([3, 25, 90]))) for _ in range(60)]
    texts.append(" ".join(" ".join([w] * (200 * k + 200)) for k, w in enumerate(names)))  # counts differ from word to word
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    assert len(set(counts.values())) == len(names)
    items = [(k, " ".join(rnd.sample(names, rnd.choice([1, 3, 8, 12])))) for k in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc"]] if r["doc"] < 99 else None
        assert r["near_items"] == [i for i, t in items if brute_near(text, t, counts)]


def test_all_terms_indexed(spark, monkeypatch):
    """Without the filter by the benchmark's terms, and with words cut piece by piece: the same matches."""
    monkeypatch.setattr(decontamination, "MOST_TERMS", 0)
    monkeypatch.setattr(decontamination, "PIECE", 50)
    monkeypatch.setattr(decontamination, "MEMO", 3)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "b", "c"]) for _ in range(rnd.choice([5, 300]))) for _ in range(20)] + ["word " * 400_000 + "a b c d"]
    items = [(k, " ".join(rnd.choice(["a", "b", "c"]) for _ in range(12))) for k in range(5)] + [(8, "word a b c d")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        want = brute_leak(texts[r["doc"]], items) if r["doc"] < 20 else (400_004, 5, [8])
        assert (r["n_words"], r["n_hit"], r["items"]) == want


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = "x zeta epsilon x delta gamma beta alpha"
    far = "zeta " + "x " * 30 + "epsilon delta gamma beta alpha"
    docs = spark.createDataFrame([(1, near), (2, far), (3, "alpha beta"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["near_items"] for r in decontamination.contamination(docs, bench, near_terms=12).collect()}
    assert got == {1: [], 2: [], 3: [], 4: []}
    six = " ".join(item.split()[:6])
    bench = spark.createDataFrame([(7, six)], "item_id long, text string")
    assert {r["doc_id"]: r["near_items"] for r in decontamination.contamination(docs, bench).collect()} == {1: [7], 2: [], 3: [], 4: []}


def test_proximity_query(spark):
    """The whole small table against brute force; of equally rare words those with the smallest hashes count."""
    at = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: brute_words(r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    items = {r["item_id"]: brute_words(r["text"]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()}
    counts = {}
    for words in docs.values():
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    rare = {i: sorted(set(ws), key=lambda w: (counts.get(w, 0), decontamination.term(w.encode() if isinstance(w, str) else w)))[:6] for i, ws in items.items()}
    rare = {i: set(ws) for i, ws in rare.items() if ws and all(w in counts for w in items[i])}
    got = {r["doc_id"]: r for r in decontamination.decontamination_proximity(spark, at).collect()}
    assert set(got) == set(docs)
    for d, words in docs.items():
        near = sorted(str(i) for i, ws in rare.items() if any(ws <= set(words[k : k + 20]) for k in range(max(1, len(words) - 19))))
        assert (got[d]["n_near"], got[d]["near_sha256"]) == (len(near), hashlib.sha256(",".join(near).encode()).hexdigest())
    assert sum(r["n_near"] for r in got.values()) > 0
