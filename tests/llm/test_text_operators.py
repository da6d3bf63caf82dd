"""Tokens, licenses and personal data against plain Python."""

import hashlib
import re
from collections import Counter
from random import Random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedline.llm import bpe, licenses, pii, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1024), (700, 64), (100, 20)])
def test_chunked_ids_are_those_of_whole_texts(docs, chunk, overlap):
    whole = bpe.encoding(public_tokenizers.path(bpe.VOCABULARY))
    want = Counter((i, tuple(whole.encode_ordinary(t)), t.encode()) for i, t in plain(docs))
    found = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    got = Counter(
        (r["doc_id"], tuple(int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)), bytes(r["bytes"]))
        for r in found
    )
    assert got == want


def test_no_documents(none):
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(none)).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert pii.pii_report(none).count() == 0
    assert pii.redact(none).columns == none.columns


def test_lengths_and_limits(docs):
    whole = bpe.encoding(public_tokenizers.path(bpe.VOCABULARY))
    sizes = [len(whole.encode_ordinary(t)) for _, t in plain(docs)]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs), block=16)
    got = {tuple(r) for r in sums.drop("docs_share").collect()}
    assert got == {
        (n, sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
        for n in set(sizes)
    }
    limits = [0, 1, 7, 100, max(sizes), max(sizes) + 5]
    answers = {tuple(r) for r in token_counts.at_limits(sums, limits).collect()}
    assert answers == {
        (n, sum(s > n for s in sizes), sum(min(s, n) for s in sizes), sum(max(0, s - n) for s in sizes)) for n in limits
    }
    shares = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    for share, n in shares.items():
        assert n == min(x for x in sizes if sum(s <= x for s in sizes) / len(sizes) >= share)


def test_license_places(docs):
    found = licenses.license_scan(docs)
    got = Counter(tuple(r) for r in found.drop("labels", "score").collect())
    want = Counter()
    for doc_id, text in plain(docs):
        words = WORDS.findall(text.translate(LOWER))
        places = [
            (at, label)
            for phrase, label in licenses.BASE.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        at = sorted(p for p, _ in places)
        labels = ",".join(sorted({label for _, label in places}))
        want[(doc_id, len(words), len(places), at[0] if at else None, at[-1] if at else None, labels)] += 1
    assert got == want
    near = found.filter(F.col("labels") != F.col("base_labels")).select("doc_id", "labels").collect()
    assert (16, "mit") in {tuple(r) for r in near}
    assert found.filter("score < 0 OR score > 1 OR (labels = '') != (score = 0)").count() == 0


def luhn(text):
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    count = lambda m: sum(c.isdigit() for c in m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= count(m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= count(m) <= 15),
    ]
    return sorted(
        (m.start(), rank, m.end(), name)
        for rank, (name, pattern, good) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if good(m.group())
    )


def test_personal_data(docs):
    got = Counter(
        (r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_spans"]) for r in pii.pii_report(docs).collect()
    )
    want = Counter()
    for doc_id, text in plain(docs):
        spans = base_spans(text)
        names = Counter(s[3] for s in spans)
        listed = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
        want[(doc_id, *(names[k] for k in ("email", "ip", "card", "phone")), listed)] += 1
    assert got == want


def test_checksums_and_context_decide(docs):
    spans = pii.pii_spans(docs).filter("doc_id = 17").select("kind", "match", "base").collect()
    assert [tuple(r) for r in spans if r["kind"] == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00", False)]
    assert sorted(r["match"] for r in spans if r["kind"] == "ssn") == ["123-45-6789"]


def test_redacted_texts_hold_no_base_match(docs):
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r["text"] is None or base_spans(r["text"]) == []
    kept = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] in (0, 5, 9)}
    assert kept[0] is None and kept[5] == "one two"


def test_long_runs_are_linear(spark):
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "a." * 100_000 + "@ " + "x@a" + ".b" * 100_000
    found = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_email"], found["n_card"]) == (1, 0)
    assert hashlib.sha256(b"").hexdigest() != hashlib.sha256(found["base_spans"].encode()).hexdigest()


def spans_by_definition(words):
    """(label, base, exact, begin, end, held share) of each span, without Spark, hashes or windows."""
    held = [(t, label, True, 2) for t, label in licenses.BASE.items()]
    held += [(t, label, False, 2) for t, label in licenses.OWN.items()]
    held += [(t, label, False, 4) for label, t in licenses.BODIES.items()]
    found = set()
    for text, label, base, k in held:
        template = licenses.template_words(text)
        seeds, slack = len(template) - k + 1, 2 if k == 2 else len(template) // 8
        votes = {}
        for i in range(len(words) - k + 1):
            for j in range(seeds):
                if words[i : i + k] == template[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        chains = [[d] for d, v in votes.items() if len(v) == seeds]
        last = None
        for d in sorted(d for d, v in votes.items() if len(v) < seeds and not base and (k == 2 or len(v) > 1)):
            if last is None or d - last > slack:
                chains.append([])
            chains[-1].append(d)
            last = d
        for n, chain in enumerate(chains):
            exact = len(votes[chain[0]]) == seeds
            positions = set().union(*(votes[d] for d in chain))
            begin, end = min(d + min(votes[d]) for d in chain), max(d + max(votes[d]) + k for d in chain)
            share = len(positions) / seeds
            if exact or (share >= licenses.COVERAGE[k] and end - begin <= len(template) + slack):
                found.add((label, base, exact, begin, end, round(share, 9)))
    return found


def edited(words, random, changes):
    out = list(words)
    for _ in range(changes):
        at = random.randrange(len(out))
        kind = random.choice(("put in", "left out", "changed"))
        out[at : at + (kind != "put in")] = [] if kind == "left out" else [f"new{random.randrange(99)}"]
    return out


@pytest.fixture(scope="module")
def licensed(spark):
    random, rows = Random(7), []
    filler = "the of software and this license notice to use copy is provided in any form mit".split()
    for n, (label, body) in enumerate(licenses.BODIES.items()):
        words = licenses.template_words(body)
        for changes in (0, 1, len(words) // 25):
            around = [[random.choice(filler) for _ in range(random.randrange(120))] for _ in range(2)]
            text = " ".join([*around[0], *edited(words, random, changes), *around[1]])
            rows.append((len(rows), label if changes < 3 or len(words) > 40 else None, text))
        rows.append((len(rows), label, f"{body} -- {body.upper()}"))
        rows.append((len(rows), None, " ".join(words[: len(words) // 4])))
    return spark.createDataFrame([*rows, *rows[:3]], "doc_id long, label string, text string").repartition(3), rows


def test_license_wordings_are_found_with_edits(licensed):
    docs, rows = licensed
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_scan(docs).collect()}
    assert all(label in found[n] for n, label, _ in rows if label)


def test_license_spans_equal_their_definition(docs, licensed):
    for table in (docs, licensed[0]):
        want = Counter()
        for r in set((r["doc_id"], r["text"]) for r in table.collect()):
            for span in spans_by_definition(licenses.template_words(r[1] or "")):
                want[(r[0], *span)] += 1
        spans = licenses.license_spans(table).collect()
        got = Counter(
            (r["doc_id"], r["label"], r["base"], r["exact"], r["begin"], r["end"], round(r["score"], 9)) for r in spans
        )
        assert got == want and len(want) > 5


def test_templates_are_told_apart(spark):
    table = licenses.templates(spark)
    named = table.groupBy("template").agg(F.countDistinct("label", "k", "n_template").alias("n"), F.count("*").alias("rows"))
    assert named.filter("n > 1").count() == 0
    assert table.count() == table.select("template", "j").distinct().count()
    assert named.count() == len(licenses.BASE) + len(licenses.OWN) + len(licenses.BODIES)
