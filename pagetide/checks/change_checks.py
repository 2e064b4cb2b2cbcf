"""Fingerprints, change decision, near duplicates (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import query
from pagetide.functions import hashing as X
from pagetide.operators import fingerprints as P
from pagetide.operators import neardup as N
from pagetide.plans import derived as V
from pagetide.plans import scan as S

DOC_SIMS = Q.simhash("documents", "doc_id", "text")


def documents(spark, d):
    return V.table(spark, d, "documents")


def doc_signatures(spark, d):
    return P.simhash(documents(spark, d), ["doc_id"], "text")


@query("c1_binary_hash", "SELECT page_id, sha256(html) AS binary_hash FROM pages")
def binary(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.sha256_hex(F.col("html")).alias("binary_hash"))


@query("c2_page_fingerprints", f"""WITH t AS (SELECT page_id, html, {Q.clean('html')} AS text FROM pages),
{Q.simhash('t', 'page_id', 'text')}
SELECT page_id, sha256(html) AS binary_hash, sha256(text) AS filtered_hash, simhash FROM t JOIN sims USING (page_id)""")
def prints(spark, d):
    return P.page_fingerprints(V.table(spark, d, "pages"))


@query("c3_simhash", f"WITH {DOC_SIMS} SELECT doc_id, simhash FROM sims")
def signatures(spark, d):
    return doc_signatures(spark, d)


NEIGHBOURS = f"""WITH {DOC_SIMS},
n AS (SELECT a.doc_id, bit_count(xor(a.simhash, b.simhash)) AS distance FROM sims a JOIN sims b ON b.doc_id = a.doc_id + 1)"""


def neighbours(spark, d):
    """Each document next to its successor."""
    sims = doc_signatures(spark, d)
    follower = sims.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("next_simhash"))
    return sims.join(follower, "doc_id")


@query("c4_hamming_distance", NEIGHBOURS + " SELECT doc_id, CAST(distance AS BIGINT) AS distance FROM n")
def distance(spark, d):
    return neighbours(spark, d).select("doc_id", X.hamming(F.col("simhash"), F.col("next_simhash")).cast("bigint").alias("distance"))


@query("c5_similar_neighbours", NEIGHBOURS + " SELECT doc_id, distance <= 20 AS similar FROM n")
def similar(spark, d):
    return neighbours(spark, d).select("doc_id", X.similar(F.col("simhash"), F.col("next_simhash"), 20).alias("similar"))


@query("c6_batch_simhash", f"""WITH {Q.simhash('conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, simhash FROM sims""")
def batch(spark, d):
    return P.simhash(V.table(spark, d, "conversations"), ["conv_id", "turn"], "text")


NODES = f"""WITH RECURSIVE {DOC_SIMS},
nodes AS (SELECT simhash, min(doc_id) AS lead_id, count(*) AS copies FROM sims GROUP BY 1)"""


@query("c7_near_pairs", NODES + """
SELECT a.lead_id AS lead_a, b.lead_id AS lead_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance
FROM nodes a JOIN nodes b ON a.lead_id < b.lead_id AND bit_count(xor(a.simhash, b.simhash)) <= 5""")
def pairs(spark, d):
    return N.near_pairs(N.signature_nodes(doc_signatures(spark, d)), 5)


@query("c8_near_duplicate_groups", NODES + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY lead_id) AS k FROM nodes),
pass(k, leaders) AS (
  SELECT 0::BIGINT, []::STRUCT(id BIGINT, sig BIGINT)[]
  UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(p.leaders, lambda l: bit_count(xor(l.sig, o.simhash)) <= 5)) > 0 THEN p.leaders
    ELSE list_append(p.leaders, {'id': o.lead_id, 'sig': o.simhash}) END
  FROM pass p JOIN ordered o ON o.k = p.k + 1),
heads AS (SELECT unnest(leaders) AS l FROM (SELECT arg_max(leaders, k) AS leaders FROM pass)),
member AS (
  SELECT s.doc_id, min(l.id) AS group_id, arg_min(bit_count(xor(l.sig, s.simhash)), l.id) AS distance
  FROM sims s JOIN heads ON bit_count(xor(l.sig, s.simhash)) <= 5 AND l.id <= s.doc_id GROUP BY 1)
SELECT doc_id, group_id, CAST(distance AS INTEGER) AS distance FROM member
QUALIFY count(*) OVER (PARTITION BY group_id) > 1""")
def groups(spark, d):
    return N.greedy_groups(doc_signatures(spark, d), threshold=5)


@query("c9_changed_pages", f"""WITH {Q.SNAPSHOT_PAIRS},
h AS (SELECT page_id, old_html, new_html, {Q.clean('old_html')} AS o, {Q.clean('new_html')} AS n FROM snapshot_pairs)
SELECT page_id, old_html IS NULL OR (old_html <> new_html AND o <> n) AS change_detected,
  CASE WHEN old_html IS NULL THEN 'BINARY' WHEN old_html <> new_html AND o <> n THEN 'FILTERED' ELSE 'NONE' END AS change_type,
  CASE WHEN old_html IS NULL OR old_html = new_html OR o <> n THEN 'none' ELSE '0' END AS hamming_distance FROM h""")
def changed(spark, d):
    out = S.changed_pages(V.snapshot_pairs(spark, d))
    return out.withColumn("hamming_distance", F.coalesce(F.col("hamming_distance").cast("string"), F.lit("none")))


@query("c9_semantic_tier", f"""WITH {Q.SNAPSHOT_PAIRS},
o AS (SELECT page_id, old_html AS html, {Q.clean('old_html')} AS text FROM snapshot_pairs WHERE old_html IS NOT NULL),
n AS (SELECT page_id, new_html AS html, {Q.clean('new_html')} AS text FROM snapshot_pairs),
{Q.simhash('o', 'page_id', 'text', 'old_sims')}, {Q.simhash('n', 'page_id', 'text', 'new_sims')},
j AS (SELECT n.page_id, o.html AS old, n.html AS new, bit_count(xor(s.simhash, t.simhash)) AS dist
  FROM n JOIN new_sims t USING (page_id) LEFT JOIN o USING (page_id) LEFT JOIN old_sims s USING (page_id))
SELECT page_id, CASE WHEN old IS NULL THEN 'BINARY' WHEN old = new OR dist <= 5 THEN 'NONE' ELSE 'SEMANTIC' END AS change_type,
  CASE WHEN old IS NULL OR old = new THEN 'none' ELSE CAST(dist AS VARCHAR) END AS hamming_distance FROM j""")
def semantic(spark, d):
    """The opt-in third tier: small text changes do not count."""
    pairs = V.snapshot_pairs(spark, d)

    def prints(column):
        version = pairs.select("page_id", F.col(column).alias("html")).filter("html IS NOT NULL")
        return P.page_fingerprints(version)

    out = P.detect_changes(prints("new_html"), prints("old_html"), semantic=True)
    return out.select("page_id", "change_type", F.coalesce(F.col("hamming_distance").cast("string"), F.lit("none")).alias("hamming_distance"))


@query("c10_baseline_rule", Q.with_watch("""
SELECT event_id, CASE WHEN is_baseline THEN deadlines_count > 0 ELSE change_detected END AS change_detected,
  CASE WHEN is_baseline AND deadlines_count > 0 THEN 'BINARY' WHEN is_baseline THEN 'NONE' ELSE change_type END AS change_type
FROM watch WHERE ok"""))
def baseline(spark, d):
    log = V.watch_log(spark, d).filter("status = 'succeeded'")
    changed, kind = P.apply_baseline(F.col("is_baseline"), F.col("deadlines_count"), F.col("change_detected"), F.col("change_type"))
    return log.select("event_id", changed.alias("change_detected"), kind.alias("change_type"))


@query("c11_tuned_threshold", f"""WITH {DOC_SIMS},
p AS (
  SELECT b.quality = 1 AS y, a.text = c.text AS same, bit_count(xor(s.simhash, u.simhash)) AS dist
  FROM documents a JOIN labels b USING (doc_id) JOIN documents c ON c.doc_id = a.doc_id + 1
  JOIN sims s ON s.doc_id = a.doc_id JOIN sims u ON u.doc_id = c.doc_id),
acc AS (SELECT t, count(*) FILTER ((NOT same AND dist > t) = y) AS hits, count(*) AS n FROM p, range(1, 21) r(t) GROUP BY 1)
SELECT CAST(t AS INTEGER) AS threshold, round(hits / n, 9) AS accuracy FROM acc ORDER BY hits DESC, t LIMIT 1""")
def tuned(spark, d):
    """Neighbouring documents as versions of a page, their quality as the label."""
    sims = doc_signatures(spark, d)
    hashed = documents(spark, d).select("doc_id", X.sha256_hex(F.col("text")).alias("binary_hash")).join(sims, "doc_id")
    hashed = hashed.withColumn("filtered_hash", F.col("binary_hash"))
    names = ("binary_hash", "filtered_hash", "simhash")
    new = hashed.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in names])
    old = hashed.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(c).alias(f"old_{c}") for c in names])
    labels = V.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("expected_change"))
    out = P.tune_threshold(new.join(old, "doc_id").join(labels, "doc_id"), semantic=True)
    return out.select("threshold", F.round("accuracy", 9).alias("accuracy"))


@query("c12_unsigned_signature", f"""WITH {DOC_SIMS}
SELECT doc_id, CAST(CASE WHEN simhash < 0 THEN simhash::HUGEINT + 18446744073709551616::HUGEINT ELSE simhash END AS VARCHAR) AS unsigned, simhash AS back
FROM sims""")
def unsigned(spark, d):
    out = doc_signatures(spark, d).withColumn("u", X.to_unsigned(F.col("simhash")))
    return out.select("doc_id", F.col("u").cast("string").alias("unsigned"), X.from_unsigned(F.col("u")).alias("back"))
