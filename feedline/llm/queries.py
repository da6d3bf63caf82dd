"""The registered queries of this package and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.llm import balltree, bpe, decontam, feast, katz, langid, licenses, media, pieces, pii, simhash, token_counts, warc
from feedline.llm.common import load, stored, uri
from feedline.session import new_scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op1_length_histogram")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length with its documents and suffix sums."""
    # The sums read the histogram twice; the texts are encoded once.
    return token_counts.suffix_sums(stored(token_counts.length_histogram(load(spark, sf_dir, "documents")), "lengths"))


@query("op2_katz_backoff")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score under the model learned from four fifths of the documents."""
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    model = katz.fit(docs.filter("NOT held_out"))
    found = katz.score(docs, model, keep=("doc_id", "held_out"))
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query("op3_chunked_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the bytes they decode to."""
    coded = bpe.decode(bpe.encode(load(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages of every text."""
    return licenses.license_scan(load(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from four fifths of the documents."""
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    net = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs, net, keep=("doc_id", "held_out"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.pii_report(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in ("email", "ip", "card", "phone", "iban", "ssn")],
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
        "max_score",
    )


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos0
  FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (
  SELECT doc_id, item_id, pos0, p.n FROM places p JOIN windows v ON p.n = v.n AND array_to_string(w[pos0:pos0 + p.n - 1], ' ') = win),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(pos0, pos0 + n)) AS pos FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op7_decontamination", DECONTAMINATION)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every text."""
    found = decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_media_columns")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, and what is read back from it."""
    stored = media.media_columns(load(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "width",
        "height",
    )


ARCHIVES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN firsts USING (h)"""


@query("op10_warc", ARCHIVES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back by byte ranges."""
    pages = load(spark, sf_dir, "pages")
    folder = uri(new_scratch(spark, "warc"))
    records = warc.read_archives(warc.write_archives(pages, folder), folder, payload=False)
    kind = pages.schema["page_id"].dataType.simpleString()
    return records.select(
        warc.page_of("record_id", kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to", kind).alias("refers_to"),
    )


@query("op11_chunk_table")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and what they decode to."""
    coded = pieces.decode(pieces.encode(load(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKING = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL),
filled AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM filled),
counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM filled)
  GROUP BY r, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
items AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
weights AS (
  SELECT item_id, term, repeats * CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM items JOIN df USING (term), total),
scores AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_docs) // all_terms))))) AS BIGINT) AS score
  FROM weights JOIN counts USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query("op12_ball_tree", RANKING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    counted = stored(balltree.term_counts(load(spark, sf_dir, "documents")), "terms")
    return balltree.search(counted, load(spark, sf_dir, "benchmark"), k=20)


@query("op13_feast_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's components, whitened, and how far it lies from the mean."""
    found = feast.whiten(load(spark, sf_dir, "embeddings"), components=32)
    return found.select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"),
        "whitened", "explained", "identity_error",
    )
