"""Copies, contamination, media, archives and language against plain Python."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

from feedline.llm import decontam, langid, media, simhash, warc
from feedline.llm.common import uri
from feedline.session import new_scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    parts = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs):
    rows = [(r["doc_id"], fingerprint(r["text"] or "")) for r in docs.collect()]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if (x ^ y).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for g, (doc_id, _) in zip(group, rows, strict=True):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    want = Counter((d, f"{x:016x}", least.get(g)) for g, (d, x) in zip(group, rows, strict=True))
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want


def test_ball_links_connect_all_pairs_within_the_radius(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds:
        x = s
        for _ in range(12):  # chains of near prints
            for b in random.sample(range(64), random.choice((1, 2, 3))):
                x ^= 1 << b
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    root = {p: p for p in signed}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    links = simhash.links(nodes)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {p: found.get(p, p) for p in signed} == {p: top(p) for p in signed}
    assert links.count() <= 65 * len(signed)
    with pytest.raises(ValueError):
        simhash.links(nodes, radius=3)


def brute(texts, items, width=13):
    windows = {}
    for name, text in items:
        words = WORDS.findall((text or "").translate(LOWER))
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if name is None else str(name))
    out = Counter()
    for doc_id, text in texts:
        words = WORDS.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(words[i : i + n])]
        bad = bool(hit) and 20 * len(hit) >= len(words)
        out[(doc_id, len(words), len(hit), ",".join(sorted(names)), bad)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_contamination(spark, docs, texts, block):
    near = texts[18].split()
    items = [
        (1, " ".join(near[10:40])),
        (2, " ".join(near[100:113])),
        (10, "ONE two"),
        (None, "hereby granted"),
        (5, None),
        (6, ""),
        (7, " ".join(near[30:60])),
        (1, " ".join(near[300:320])),
        (8, "mit license"),
        (9, texts[8][:4000]),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs, benchmark, block_bytes=block)
    got = Counter(
        (r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()
    )
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    longest = {r["doc_id"]: r["longest"] for r in found.collect() if r["doc_id"] in (18, 8)}
    assert (longest[18]["words"], longest[18]["at"]) == (30, 10)
    assert longest[8]["item"] == "9" and longest[8]["at"] == 0
    kept = decontam.remove_contaminated(docs, benchmark, block_bytes=block)
    assert kept.count() == found.filter("NOT contaminated").count() and kept.columns == docs.columns
    assert decontam.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_suffix_array_is_sorted():
    random.seed(2)
    words = np.array([random.randint(0, 3) for _ in range(500)], np.int32)
    order = decontam.suffix_array(words, 500).tolist()
    assert order == sorted(range(500), key=lambda p: words[p:].tolist())


def test_media_round_trip(spark, docs):
    folder = uri(new_scratch(spark, "media-test"))
    index = media.write_shards(docs, folder, shard_bytes=5000)
    texts = {r["text"] or "" for r in docs.collect()}
    assert index.count() == len(texts) and index.select("shard").distinct().count() > 1
    heads = {r["digest"]: r for r in media.metadata(index, folder).collect()}
    read = {r["digest"]: r for r in media.payloads(index, folder).collect()}
    for text in texts:
        body = text.encode()
        payload = media.payload_of(body)
        key = hashlib.sha256(body).hexdigest()
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == body.rstrip(b" ") and len(payload) > 0
        assert read[key]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert read[key]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (heads[key]["width"], heads[key]["height"], heads[key]["bits"]) == (192, len(payload) // 192, 8)
        assert media.from_png(media.to_png(payload)) == payload
    found = media.media_columns(docs)
    assert found.count() == docs.count()
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b" " * 192).replace(b"IDAT", b"IDAX"))


PAGES = [
    (3, "http://a/é x", "same"),
    (1, None, "same"),
    (2, "http://b/", None),
    (9, "u", ""),
    (5, "u\r\nInjected: 1", "<p>" + "zü" * 200_000 + "</p>"),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "u", "big " * 9),
    (7, "u", "big " * 9),
    (None, "u", "unnamed"),
    (None, "u", "same"),
]


def test_many_items_take_little_more_time_than_few():
    random.seed(9)
    words = [f"w{i}".encode() for i in range(3000)]
    items = [(str(n), b" ".join(random.choices(words, k=40))) for n in range(4000)]
    texts = [b" ".join(random.choices(words, k=400)) for _ in range(500)]
    for n in range(0, 4000, 40):
        texts.append(b" ".join(random.choices(words, k=50)) + b" " + items[n][1] + b" " + items[n + 1][1][:150])

    def timed(n):
        start = time.perf_counter()
        queries = decontam.Queries(items[:n], 13)
        found = decontam.search([queries.numbered(decontam.words_of(t)) for t in texts], queries)
        return time.perf_counter() - start, {f[2] for f in found if f[0] >= 500}

    timed(10)
    few, _ = timed(200)
    many, names = timed(4000)
    assert many < 12 * few
    assert names >= {str(n) for n in range(0, 4000, 40)}


def test_bounds_equal_plain_bisection():
    random.seed(4)
    items = [(str(n), " ".join(random.choices("abc", k=random.choice((1, 2, 20, 40)))).encode()) for n in range(30)]
    queries = decontam.Queries(items, 5)
    text = np.array([random.choice((0, 1, 2, 3)) for _ in range(600)] + [0], np.int32)
    array = decontam.suffix_array(text, queries.longest)
    limits = np.full(len(queries.starts), queries.longest)
    stop = lambda start: start + list(queries.words[start:]).index(0)
    for after, windows in ((False, limits), (False, queries.windows), (True, queries.windows)):
        found = decontam.bound(text, array, queries, queries.starts, windows, after)
        for start, width, place in zip(queries.starts.tolist(), windows.tolist(), found.tolist(), strict=True):
            want = queries.words[start : min(start + width, stop(start))].tolist()
            keys = [text[p : p + len(want)].tolist() for p in array.tolist()]
            assert place == sum(k <= want if after else k < want for k in keys)


@pytest.mark.parametrize("size", [64, 1000, 4 << 20])
def test_archives_by_range(spark, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    folder = uri(new_scratch(spark, "warc-test"))
    archives = warc.write_archives(pages, folder)
    rows = warc.read_archives(archives, folder, range_bytes=size).collect()
    got = Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    name = lambda p: None if p is None else f"<urn:page:{p}>"
    want = Counter()
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        other = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[(name(page), len(body), digest, "revisit" if other else "response", name(first) if other else None)] += 1
    assert got == want
    assert {bytes(r["payload"]) for r in rows if r["payload"] is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def member(kind, block, **named):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}"] + [f"{k.replace('_', '-')}: {v}" for k, v in named.items()]
    if "Content_Length" not in named:
        head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1)


def test_archives_of_other_writers(spark):
    """Every kind of record, missing fields, chunked bodies, and a member of 40 MB."""
    large = random.Random(2).randbytes(40 << 20)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    chunks = b"5;x=y\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    http, chunked = b"HTTP/1.1 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    long = b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n"
    parts = [
        (member("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:a>"), ("warcinfo", "<urn:a>", 13, b"software: x\r\n")),
        (member("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", Content_Type="application/http"), ("request", None, 0, b"")),
        (member("response", http + b"no length"), ("response", None, 9, b"no length")),
        (member("response", chunked + chunks, WARC_Payload_Digest=sha1(b"hello world")), ("response", None, 11, b"hello world")),
        (member("response", chunked + chunks, WARC_Payload_Digest=sha1(chunks)), ("response", None, 11, b"hello world")),
        (member("response", chunked + b"no chunks"), ("response", None, 9, b"no chunks")),
        (member("response", http + b"x", WARC_Payload_Digest=sha1(b"y")), ("damaged", None, 1, b"x")),
        (member("response", http + b"x", WARC_Payload_Digest="md5:00"), ("response", None, 1, b"x")),
        (member("response", long + b"cut"), ("damaged", None, 99, b"cut")),
        (member("response", long + b"cut", WARC_Truncated="length"), ("response", None, 99, b"cut")),
        (member("resource", b"plain", WARC_Target_URI="f:x"), ("resource", None, 5, b"plain")),
        (member("revisit", http), ("revisit", None, 0, None)),
        (member("metadata", b"a: b", Content_Length="many"), ("metadata", None, 8, b"a: b\r\n\r\n")),
        (gzip.compress(b"WARC/1.0\r\nno type\r\n\r\n"), ("damaged", None, None, None)),
        (member("response", http + large), ("response", None, len(large), large)),
        (member("response", http + b"last"), ("response", None, 4, b"last")),
    ]
    folder = uri(new_scratch(spark, "warc-test"))
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base)
    body = b"".join(p for p, _ in parts)
    with store.open_output_stream(f"{base}/other.warc.gz", compression=None) as out:
        out.write(body)
    archives = spark.createDataFrame([("other.warc.gz", len(body))], "file string, bytes long")
    start = time.perf_counter()
    rows = warc.read_archives(archives, folder, range_bytes=16 << 20).orderBy("offset").collect()
    assert time.perf_counter() - start < 60
    got = [(r["record_type"], r["record_id"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert got == [want for _, want in parts]
    assert rows[10]["target"] == "f:x"


def test_ids_of_any_text_come_back(spark):
    ids = ["a\r\nWARC-Type: x", "> <", "ü/%20+", "plain"]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    folder = uri(new_scratch(spark, "warc-test"))
    rows = warc.read_archives(warc.write_archives(pages, folder), folder)
    found = rows.select(warc.page_of("record_id", "string").alias("i"), "record_type", warc.page_of("refers_to", "string").alias("r"))
    assert {(r.i, r.record_type, r.r) for r in found.collect()} == {
        (i, "response" if i == min(ids) else "revisit", None if i == min(ids) else min(ids)) for i in ids
    }


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = uri(new_scratch(spark, "warc-test"))
    rows = warc.read_archives(warc.write_archives(pages, folder, min_bytes=10), folder).collect()
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 10)
    assert sum(r["record_type"] == "revisit" for r in rows) == 0  # the one pair of equals of that size shares its id


def test_a_damaged_member_does_not_hide_the_next(spark, tmp_path):
    pages = spark.createDataFrame([(n, "u", f"page {n} " * 50) for n in range(5)], "page_id long, url string, html string")
    folder = uri(new_scratch(spark, "warc-test"))
    archives = warc.write_archives(pages.coalesce(1), folder)
    first = archives.first()
    store, base = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{first['file']}") as source:
        body = bytearray(source.read())
    second = body.index(warc.MAGIC, 10)
    body[second + 60 : second + 70] = b"\xff" * 10
    with store.open_output_stream(f"{base}/{first['file']}", compression=None) as out:
        out.write(bytes(body))
    kinds = Counter(r["record_type"] for r in warc.read_archives(archives, folder, range_bytes=100).collect())
    assert kinds["response"] == 4


def test_language(spark):
    random.seed(4)
    words = {"en": "the of and tion with that".split(), "de": "der und nicht keit ein ich".split()}
    rows = []
    for n in range(120):
        lang = ("en", "de")[n % 2]
        rows.append((n, " ".join(random.choice(words[lang]) for _ in range(random.choice((5, 40, 900)))), lang, None))
    rows += [(900, None, "en", "s"), (901, "", None, "s"), (902, "123 ?!", "de", "s"), (903, "der und nicht", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = langid.fit(docs.filter("doc_id % 3 != 0"), steps=60)
    found = {r["doc_id"]: r for r in langid.predict(docs, net, keep=("doc_id", "lang")).collect()}
    assert len(found) == len(rows)
    for doc_id, text, lang, _ in rows[:120]:
        assert found[doc_id]["lang_pred"] == lang, text
        assert 0 < found[doc_id]["score"] <= 1
    assert [(found[n]["lang_pred"], found[n]["score"]) for n in (900, 901, 902)] == [("und", 0.0)] * 3
    assert found[903]["lang_pred"] == "de"
    again = langid.predict(docs, langid.fit(docs.filter("doc_id % 3 != 0"), steps=60)).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(d, r["score"]) for d, r in found.items()}


def test_language_without_labels(none, docs):
    assert langid.fit(none) is None
    found = langid.predict(docs.withColumn("lang", F.lit(None).cast("string")), None)
    assert found.filter("lang_pred != 'und'").count() == 0 and found.count() == docs.count()


def test_gradients_are_those_of_the_loss():
    random_state = np.random.default_rng(1)
    net = langid.train([b"abcd", b"dcba", b"aabb"], [0, 1, 1], ["x", "y"], hidden=3, steps=1)
    for name in ("table", "state", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    symbols, truth = random_state.integers(97, 101, (5, 4)), np.array([0, 1, 1, 0])
    symbols[3:, 2] = 256
    symbols[:, 2] = 97

    def loss():
        p = langid.probabilities(net, (langid.states(net, 0, symbols), langid.states(net, 1, symbols)))
        return -np.log(p[np.tile(truth, 5), np.arange(20)]).mean()

    grads = langid.gradients(net, symbols, truth)
    for name in ("table", "state", "out", "bias"):
        values = getattr(net, name)
        flat = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for at in flat:
            where = np.unravel_index(at, values.shape)
            kept = values[where]
            values[where] = kept + 1e-2
            high = loss()
            values[where] = kept - 1e-2
            low = loss()
            values[where] = kept
            assert abs((high - low) / 2e-2 - grads[name][where]) < 2e-3 + 0.05 * abs(grads[name][where])
