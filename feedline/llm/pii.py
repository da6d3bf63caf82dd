"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Each kind's pattern cuts a text into gaps and matches, leftmost and without
overlap.  The pairs become rows, and running sums of their lengths give the
places, so a text with many matches costs no more than its matches.  Validators
then drop matches that fail (Luhn for cards, mod 97 for IBANs, digit and part
limits for phones and addresses).  A context word close by, in the text up to
the neighbouring matches of the kind, raises the score; kinds that are weak
without it need it to pass.

Patterns start at the first character of a run and give nothing back, so long
runs cost linear time.  Places are code points, ends exclusive.

Null texts are empty.  Rows equal in id and text get the same result; rows that
share only an id do not mix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedline.llm.common import keyed, same_document

BEFORE, AFTER = 60, 30
ACCEPT = 0.5
CONTEXT_BONUS = 0.3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's check: every second from the right is doubled, less 9 if above 9."""
    number = F.reverse(digits(match))
    at = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def weighed(total: Column, n: Column) -> Column:
        digit = F.ascii(F.substring(number, n, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(n % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), weighed) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def remainder(total: Column, n: Column) -> Column:
        code = F.ascii(F.substring(turned, n, F.lit(1)))
        return F.when(code >= 65, total * 100 + code - 55).otherwise(total * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), remainder) == 1


def between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits(match)).between(low, high)


def parts_to_255(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    ))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        0.9,
        "e-?mail|mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        parts_to_255,
        0.6,
        "ip|address|host|server|from",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        lambda m: between(14, 19)(m) & luhn(m),
        0.7,
        "card|visa|mastercard|credit|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        between(10, 15),
        0.6,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        mod97,
        0.8,
        "iban|account|bank|transfer",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: F.lit(True),
        0.3,
        "ssn|social|security",
        False,
    ),
)


def scored(kind: Kind, before: Column, after: Column) -> Column:
    """The kind's score, raised where a context word stands just before or after."""
    near = F.lower(F.concat_ws(" ", before, after)).rlike(rf"\b(?:{kind.context})\b")
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0))


def cut(rows: DataFrame, kind: Kind, text: str, gaps: str, matches: str) -> DataFrame:
    """Columns for the gaps and the matches of a kind; null where its guard finds nothing to look at."""
    body = F.col(text)
    return rows.withColumns(
        {
            gaps: F.when(kind.guard(body), F.split(body, kind.pattern, -1)),
            matches: F.when(kind.guard(body), F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))),
        }
    )


def paired(gaps: str, matches: str, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(match, gap before, gap after)`` for every match, in order."""
    size = F.size(matches)
    around = F.zip_with(
        F.slice(gaps, F.lit(1), size), F.slice(gaps, F.lit(2), size), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    return F.zip_with(matches, around, lambda m, g: use(m, g["a"], g["b"]))


def pii_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``kind``, ``base``, ``begin``, ``end``, ``match`` and ``score`` of every accepted span."""
    rows = keyed(docs, doc_id=doc_id, text=text)
    arrays = []
    for n, kind in enumerate(KINDS):
        rows = cut(rows, kind, "text", f"gaps{n}", f"matches{n}")

        def entry(match: Column, gap: Column, after: Column, kind: Kind = kind) -> Column:
            return F.struct(
                F.lit(kind.name).alias("kind"),
                F.length(gap).alias("gap"),
                match.alias("match"),
                F.right(gap, F.lit(BEFORE)).alias("before"),
                F.left(after, F.lit(AFTER)).alias("after"),
            )

        arrays.append(paired(f"gaps{n}", f"matches{n}", entry))
    each = rows.select("doc_id", "text_key", F.explode(F.array(*arrays)).alias("found"))
    each = each.select("doc_id", "text_key", F.posexplode("found").alias("n", "f")).select("doc_id", "text_key", "n", "f.*")
    before = Window.partitionBy("doc_id", "text_key", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    # Rows repeated in the input are one document; its matches count once.
    placed = each.distinct().withColumn("end", end).withColumn("begin", F.col("end") - F.length("match"))
    score = valid = base = None
    for kind in KINDS:
        here = F.col("kind") == kind.name
        own = scored(kind, F.col("before"), F.col("after"))
        good = kind.valid(F.col("match")) if kind.base else kind.valid(F.col("match")) & (own >= ACCEPT)
        score = F.when(here, own) if score is None else score.when(here, own)
        valid = F.when(here, good) if valid is None else valid.when(here, good)
        base = F.when(here, F.lit(kind.base)) if base is None else base.when(here, F.lit(kind.base))
    return placed.filter(valid).select(
        "doc_id", "text_key", "kind", base.alias("base"), "begin", "end", "match", score.alias("score")
    )


def pii_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, a count for each base kind, ``base_spans`` and ``spans`` as ``kind:begin:end`` texts, and ``max_score``."""
    order = F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k.name, n)])
    spans = pii_spans(docs, doc_id=doc_id, text=text).withColumn("rank", order[F.col("kind")])
    entry = F.struct("begin", "rank", "end", "kind", "base")
    listed = spans.groupBy("doc_id", "text_key").agg(
        *[F.count_if(F.col("kind") == k.name).alias(f"n_{k.name}") for k in KINDS],
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.max("score").alias("max_score"),
    )

    def shown(entries: Column) -> Column:
        each = F.transform(entries, lambda e: F.concat_ws(":", e["kind"], e["begin"].cast("string"), e["end"].cast("string")))
        return F.coalesce(F.array_join(each, ","), F.lit(""))

    rows = keyed(docs, doc_id=doc_id, text=text, keep=False)
    return rows.join(listed, same_document(rows, listed), "left").select(
        rows["doc_id"],
        *[F.coalesce(f"n_{k.name}", F.lit(0)).alias(f"n_{k.name}") for k in KINDS],
        shown(F.filter("entries", lambda e: e["base"])).alias("base_spans"),
        shown(F.col("entries")).alias("spans"),
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with every accepted match replaced by its kind in brackets; nothing is shuffled.

    One kind is replaced after the other, phones last: once addresses and cards
    are gone, a phone beside one is no longer too long to be a phone.  Null
    stays null.
    """
    names = docs.columns
    gaps, matches = "__pii_gaps", "__pii_matches"
    for kind in sorted(KINDS, key=lambda k: k.name == "phone"):

        def replaced(match: Column, gap: Column, after: Column, kind: Kind = kind) -> Column:
            good = kind.valid(match)
            if not kind.base:
                near = scored(kind, F.right(gap, F.lit(BEFORE)), F.left(after, F.lit(AFTER)))
                good = good & (near >= ACCEPT)
            return F.concat(gap, F.when(good, F.lit(f"[{kind.name.upper()}]")).otherwise(match))

        joined = F.concat(F.array_join(paired(gaps, matches, replaced), ""), F.element_at(gaps, -1))
        docs = cut(docs, kind, text, gaps, matches).withColumn(text, F.coalesce(joined, F.col(text)))
    return docs.select(*[F.col(f"`{c}`") for c in names])
