"""SQL over the warehouse tables that several expected results share."""

OFFERS = """
offers AS (
  SELECT l.*, p_name, p_brand, p_type, p_size, s_nationkey
  FROM (
    SELECT *, row_number() OVER (
      PARTITION BY l_suppkey, l_partkey
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC,
               l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) AS rn
    FROM lineitem) l
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  WHERE rn = 1)"""

LINES = """
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
    FROM lineitem)
  WHERE rn = 1)"""

LISTING = """
listing AS (
  SELECT source, category, page, pos, fname, year, file_date,
         'https://files.example.net/' || source || '/' || fname AS href
  FROM (
    SELECT 's' || (l_suppkey % 25) AS source,
           CAST(l_partkey % 5 + 1 AS INTEGER) AS category,
           l_linenumber AS page,
           l_orderkey AS pos,
           CASE l_partkey % 3 WHEN 0 THEN 'PriceFull' WHEN 1 THEN 'PromoFull' ELSE 'Stores' END
             || l_suppkey || '-' || l_partkey || '-'
             || CASE WHEN l_partkey % 50 = 0 THEN 'undated' ELSE strftime(
                  l_shipdate + to_seconds(l_orderkey % 86400), '%Y%m%d-%H%M%S') END
             || '.gz' AS fname,
           CASE WHEN l_partkey % 50 <> 0 THEN strftime(
             l_shipdate + to_seconds(l_orderkey % 86400), '%Y%m%d%H%M%S') END AS file_date,
           year(l_shipdate) AS year
    FROM lineitem))"""

MARKS = """
marks AS (
  SELECT 's' || n_nationkey AS source,
         CASE WHEN n_nationkey % 5 IN (0, 1) THEN NULL
              ELSE (1995 + n_nationkey % 5) || '0615120000' END AS mark
  FROM nation)"""

_VISIBLE = (
    r"regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>|<![A-Za-z][^>]*>', '', 'g')"
)


def trimmed(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def unescaped(expr: str) -> str:
    for ref, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        expr = f"replace({expr}, '{ref}', '{char}')"
    return expr


def markup_text(expr: str) -> str:
    """Text of an HTML fragment, nodes joined by one space."""
    node = trimmed(unescaped("n"))
    nodes = f"string_split(regexp_replace({expr}, '<[^>]*>', chr(1), 'g'), chr(1))"
    return f"array_to_string(list_filter(list_transform({nodes}, lambda n: {node}), lambda n: n <> ''), ' ')"


PAGE_TEXT = markup_text(_VISIBLE)


def words(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


def tokens(expr: str) -> str:
    bare = r"lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
    return f"list_filter(list_transform({words(expr)}, lambda w: {bare}), lambda t: t <> '')"
