"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .decontam import contaminated
from .exact_dedup import exact_dedup
from .langid import identify
from .licenses import scan
from .minhash import near_duplicates
from .mixing import mix
from .quality import quality
from .sharding import shard
from .substrings import digests, substring_dedup
from .urlfilter import url_filter
from .warc import archive_and_read
from .whitening import component_rows, whitened

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), docs_per_lang=150)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=20, recall=0.995)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The SQL walks so far that no verdict can change; the query stops as soon as it has proven all.
ROUNDS, DAMPING = 120, 0.85


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES, threshold=0.5, damping=DAMPING)


def _op6_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    host = lower(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    link = r"""regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''>\s]+)', 1)"""
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in by_length]
    case = lambda out: "CASE " + " ".join(f"WHEN {f} THEN '{o}'" for f, o in zip(fits, out, strict=True)) + " END"
    steps = "".join(
        f""", r{k} AS MATERIALIZED (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT w.dst AS host, t * trust * {DAMPING} AS trust, d * distrust * {DAMPING} AS distrust FROM ways w JOIN r{k - 1} r ON r.host = w.src
    UNION ALL SELECT host, trust * (1 - {DAMPING}), distrust * (1 - {DAMPING}) FROM r0) GROUP BY host)"""
        for k in range(1, ROUNDS + 1)
    )
    return rf"""
WITH p0 AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS MATERIALIZED (SELECT *, {case([h + q for _, h, q in by_length])} AS rule, {case([v for v, _, _ in by_length])} AS said FROM p0),
h AS (SELECT host, sum((said IS NOT NULL AND said = 'allow')::INT)::DOUBLE AS trust, sum((said IS NOT NULL AND said = 'block')::INT)::DOUBLE AS distrust
  FROM p WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (
  SELECT host, CASE WHEN sum(trust) OVER () > 0 THEN trust / sum(trust) OVER () ELSE 0 END AS trust,
         CASE WHEN sum(distrust) OVER () > 0 THEN distrust / sum(distrust) OVER () ELSE 0 END AS distrust FROM h),
found AS (SELECT DISTINCT page_id, host AS src, {lower("unnest(list_distinct(" + link + "))")} AS dst FROM p),
links AS (SELECT src, dst, count(*)::DOUBLE AS links FROM found WHERE src <> '' AND src <> dst GROUP BY ALL),
names AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM h UNION ALL SELECT dst FROM links)),
kin AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM names WHERE len(l) > 2)),
e AS (SELECT src, dst, sum(links) AS links FROM (
  SELECT * FROM links UNION ALL SELECT src, dst, 1.0 FROM kin UNION ALL SELECT dst, src, 1.0 FROM kin) GROUP BY ALL),
n AS (SELECT *, links / sum(links) OVER (PARTITION BY src) AS o, links / sum(links) OVER (PARTITION BY dst) AS i FROM e),
ways AS MATERIALIZED (
  SELECT src, dst, sum(t) AS t, sum(d) AS d FROM (SELECT src, dst, o AS t, 0 AS d FROM n UNION ALL SELECT dst, src, 0, i FROM n) GROUP BY ALL)
{steps},
b AS (SELECT host FROM r{ROUNDS} WHERE trust + distrust > 0 AND trust / (trust + distrust) < 0.5 - 5e-7)
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN b ON b.host = p.host
"""


OP6_SQL = _op6_sql()


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train_rows=20_000)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), sample_docs=200)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5('mix:' || doc_id) AS place
  FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap FROM s1),
s3 AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den, row_number() OVER w AS place
  FROM s2 WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, src)),
f AS (SELECT * FROM s3 WHERE "left"::DOUBLE * weight::DOUBLE <= cap::DOUBLE * den::DOUBLE ORDER BY place LIMIT 1),
goal AS (
  SELECT s3.src, s3.source_size, CASE WHEN s3.place < f.place THEN s3.cap::DOUBLE
         ELSE (s3.weight::DOUBLE * f."left"::DOUBLE) / f.den::DOUBLE END AS target
  FROM s3 CROSS JOIN f),
q AS (
  SELECT d.*, goal.source_size, goal.target, sum(size) OVER (PARTITION BY d.src ORDER BY d.place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM d JOIN goal ON d.src = goal.src),
c AS (
  SELECT doc_id, src, place, size, turn, CASE WHEN target > 0 THEN (done + turn * source_size)::DOUBLE / target ELSE 0 END AS finish
  FROM q, (SELECT unnest(range(3))::BIGINT AS turn)),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, src, place, doc_id, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c),
t AS (SELECT doc_id, sum(greatest(0, least(size, size - running + (SELECT sum(size) FROM d))))::BIGINT AS taken FROM r GROUP BY doc_id)
SELECT doc_id, size, source_size, target, taken, CASE WHEN target > 0 THEN done::DOUBLE / target END AS virtual_finish FROM q JOIN t USING (doc_id)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=24)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_rows(whitened(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, size=3, held=50, top=2000)


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({NORM}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m)) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND a >= 10),
k AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * k.a * k.a) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY ALL),
o AS (
  SELECT b.lang, b.phrase, b.a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(substring_dedup(table(spark, sf_dir, "documents"), width=20))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
r AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS late FROM p),
c AS (SELECT doc_id, i, word, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def queries() -> dict:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_warc": op3_warc, "op4_language_id": op4_language_id, "op5_decontamination": op5_decontamination, "op6_url_filter": op6_url_filter, "op7_quality": op7_quality, "op8_license_scan": op8_license_scan, "op9_mixing": op9_mixing, "op10_sharding": op10_sharding, "op11_whitening": op11_whitening, "op12_collocations": op12_collocations, "op13_substring_dedup": op13_substring_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op6_url_filter": OP6_SQL, "op9_mixing": OP9_SQL, "op12_collocations": OP12_SQL, "op13_substring_dedup": OP13_SQL}
