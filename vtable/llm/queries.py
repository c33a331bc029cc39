"""The operators applied to whole tables, as the driver calls them, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, read
from .decontaminate import MASKS, PERCENT, WINDOW, leaks
from .exact import exact_dedup
from .jaccard import jaccard_components
from .langid import language_id
from .licenses import BLOCK, CONTAINED, TEMPLATES, license_scan
from .mixing import mix_sources
from .quality import quality_scores
from .tokens import load_pieces, token_counts
from .urlfilter import LOWER, UPPER, DomainRule, parse_filters, url_verdicts
from .warc import archive


#: Target weights of the sources: the hot one is cut down, one is raised, the others share the rest evenly.
#: Documents of any other source, or of none, keep their share: their rate is OTHERS.
WEIGHTS = {"src0": 0.1, "src1": 0.18} | {f"src{i}": 0.04 for i in range(2, 20)}
OTHERS = 1.0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, each as often as its Poisson count says: all columns, rate (rounded to nine places), copy, shuffle_key. See mix_sources."""
    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs, WEIGHTS, seed=7, default=OTHERS).withColumn("rate", F.round("rate", 9))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to of each row. See write_warc."""
    records = archive(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of documents, for four-word shingles and 0.85. See jaccard_components."""
    return jaccard_components(read(spark, sf_dir, "documents"), words=4, num=85, den=100)[0]


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of documents. See exact_dedup."""
    return exact_dedup(read(spark, sf_dir, "documents"), digest="text_sha256")


DOMAINS = [DomainRule("net", "/", "block"), DomainRule("example.net", "/en/", "allow"), DomainRule("example.com", "/de/", "block"), DomainRule("org", "/fr/", "allow")]
#: Words that hosts and paths of spam are made of; each pair of one of the first and one of the second makes two rules.
LURES = "ads all-new best big bonus buy casino cheap cool crazy daily deal easy extra fast first free fresh gold great hot instant lucky mega new online real smart spam super top win".split()
WARES = "bank bets bids bonus cards cash coins credit dating deals diet drugs farm gems gifts hacks jobs loans lotto money offers pills poker prizes promo shop slots stream tokens track videos win".split()
FILTERS = [*(f"||{a}-{b}." for a in LURES for b in WARES), *(f"/{a}/{b}/*" for a in LURES for b in WARES), r"/://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(?:[:/?#]|$)/"]
PATTERNS = parse_filters(FILTERS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of each row of pages, under DOMAINS and the two thousand rules of FILTERS. See url_verdicts."""
    return url_verdicts(read(spark, sf_dir, "pages"), DOMAINS, PATTERNS).drop("regexes")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, most_words of each row of documents: whether it holds items of benchmark, how many, and the most equal
    words. Rows with one doc_id share their finding; a row without a doc_id has none. See leaks."""
    docs = read(spark, sf_dir, "documents")
    found = leaks(docs, read(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("words").alias("most_words"))
    found = Scratch(spark).write(found, "found")
    every = docs.select("doc_id").join(checked(found, found.count()), "doc_id", "left")
    return every.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, template, license, containment, word: a row for each template that a row of documents holds. See license_scan."""
    return license_scan(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, kept of each row of documents. See quality_scores."""
    return quality_scores(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of documents. See language_id."""
    return language_id(read(spark, sf_dir, "documents"))


#: Where the vocabulary files of public tokenizers are, and the one whose pieces and scores are counted with.
TOKENIZERS, MODEL = "/opt/tokenizers", "piece_bpe_32k.model"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of documents. See token_counts."""
    return token_counts(read(spark, sf_dir, "documents"), load_pieces(f"{TOKENIZERS}/{MODEL}"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

_MIX = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
_MASKED = " UNION ALL ".join(
    f"""SELECT id, i, {k} k, [{", ".join(f"ws[i + {j}]" for j, bit in enumerate(m) if bit == "1")}] h
    FROM (SELECT id, ws, unnest(range(1, len(ws) - {len(m) - 2})) i FROM {{t}} WHERE len(ws) >= {len(m)})"""
    for k, m in enumerate(MASKS)
)
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_NOTICES = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
_TERMS = rf"list_filter(regexp_split_to_array(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\x{{{{80}}}}-\x{{{{10FFFF}}}}]+'), lambda x: x <> '')"
_THREES = "list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))"
_DOMAINS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in DOMAINS)
_PATTERNS = ", ".join(f"({i}, '{r.name}', '{r.pattern}')" for i, r in enumerate(PATTERNS))
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1(p), {1 + i // 4 * 5}, 5))::BIGINT >> {15 - i % 4 * 5}) % 32, 1)" for i in range(32))

SQL = {
    "op1_mixing": f"""
WITH w(s, weight) AS (VALUES {_MIX}),
c AS (SELECT coalesce(source, '') s, count(*) n FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) FROM c JOIN w USING (s)) * weight / (SELECT sum(weight) FROM c JOIN w USING (s)) / n rate FROM c JOIN w USING (s)),
step AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) p
         FROM r, range(0, 120) t(k) WHERE k < rate + 40 * sqrt(rate) + 60),
i AS (SELECT *, '7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, '')) i FROM documents),
u AS (SELECT doc_id, source, i, ('0x' || substr(md5(i), 1, 13))::BIGINT / 4503599627370496.0 u FROM i),
n AS (SELECT u.doc_id, u.i, r.rate, (SELECT count(*) FROM step WHERE step.s = r.s AND step.p <= u.u) n FROM u JOIN r ON r.s = coalesce(u.source, '')),
e AS (SELECT doc_id, i, rate, unnest(range(0, n)) copy FROM n)
SELECT d.*, round(rate, 9) rate, copy::INTEGER AS copy,
  ('0x' || substr(md5(i || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0 shuffle_key
FROM documents d JOIN e USING (doc_id)
""",
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') p FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY p) f FROM p)
SELECT page_id, octet_length(encode(p))::BIGINT payload_bytes, {_BASE32} payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> f THEN f END refers_to
FROM f
""",
    "op5_url_filter": rf"""
WITH d(h, p, v) AS (VALUES {_DOMAINS}), r(i, name, pattern) AS (VALUES {_PATTERNS}),
u AS (
  SELECT page_id, coalesce(url, '') url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
s AS (
  SELECT page_id, translate(url, '{UPPER}', '{LOWER}') url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  FROM u),
b AS (
  SELECT page_id, max_by(h || p, length(h || p)) rule, max_by(v, length(h || p)) v FROM s JOIN d
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
m AS (SELECT page_id, min_by(name, i) pattern FROM s JOIN r ON regexp_matches(url, r.pattern) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN m.pattern IS NULL THEN 'allow' ELSE 'block' END) verdict, CASE WHEN rule IS NULL THEN m.pattern END pattern
FROM s LEFT JOIN b USING (page_id) LEFT JOIN m USING (page_id)
""",
    "op7_license_scan": f"""
WITH t(k, license, x) AS (VALUES {_NOTICES}),
ts AS (SELECT k, license, {_THREES} sh FROM (SELECT k, license, {_TERMS.format("x")} ws FROM t)),
tu AS (SELECT k, license, len(list_distinct(sh)) n, ({BLOCK} * 2 ** greatest(0, ceil(log2(len(sh) / {BLOCK}.0))))::BIGINT size, unnest(list_distinct(sh)) sh FROM ts),
ds AS (SELECT doc_id, {_THREES} sh FROM (SELECT doc_id, {_TERMS.format("text")} ws FROM documents) WHERE len(ws) >= 3),
du AS (SELECT doc_id, unnest(sh) sh, unnest(range(0, len(sh))) i FROM ds),
hit AS (SELECT doc_id, k, license, n, size, i, sh, unnest(CASE WHEN i >= size THEN [i // size, i // size - 1] ELSE [0] END) b FROM du JOIN tu USING (sh)),
win AS (SELECT doc_id, k, license, b, count(DISTINCT sh) / n share, min(i) word FROM hit GROUP BY doc_id, k, license, n, b)
SELECT doc_id, k::INTEGER AS template, license, share AS containment, word::BIGINT AS word FROM win WHERE share >= {CONTAINED}
QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY share DESC, b) = 1
""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') t FROM documents) WINDOW same AS (PARTITION BY t)
""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id id, {_WORDS} ws FROM documents), t AS (SELECT item_id id, {_WORDS} ws FROM benchmark),
ds AS ({_MASKED.replace("{t}", "d")}), ts AS ({_MASKED.replace("{t}", "t")}),
hit AS (SELECT DISTINCT ds.id doc_id, ts.id item_id, ds.i - ts.i off FROM ds JOIN ts ON ds.k = ts.k AND ds.h = ts.h),
eq AS (
  SELECT doc_id, item_id, off, least(len(t.ws), {WINDOW}) w,
    list_transform(range(1, len(t.ws) + 1), lambda q: CASE WHEN q + off >= 1 AND q + off <= len(d.ws) AND d.ws[q + off] = t.ws[q] THEN 1 ELSE 0 END) e
  FROM hit JOIN d ON d.id = doc_id JOIN t ON t.id = item_id),
leak AS (
  SELECT doc_id, item_id, max(list_sum(e)) words FROM eq
  WHERE len(list_filter(range(1, len(e) - w + 2), lambda s: list_sum(e[s:s + w - 1]) >= ceil(w * {PERCENT} / 100.0))) > 0
  GROUP BY ALL),
n AS (SELECT doc_id, count(*) n, max(words) m FROM leak GROUP BY 1)
SELECT doc_id, n IS NOT NULL contaminated, coalesce(n, 0)::BIGINT n_items, coalesce(m, 0)::BIGINT most_words FROM documents LEFT JOIN n USING (doc_id)
""",
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END gs
  FROM w),
s AS (SELECT DISTINCT doc_id, unnest(gs) sh FROM g),
n AS (SELECT doc_id, len(list_distinct(gs)) n FROM g),
both_ AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id r FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT n.doc_id, n.n::BIGINT n_shingles, min(r)::BIGINT component_id, (SELECT count(*) FROM link WHERE a = n.doc_id)::BIGINT n_links
FROM n JOIN reach USING (doc_id) GROUP BY ALL
""",
}
