"""Registered queries of the operators in this package, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from orderlens.operators.staging import shared_folder

from . import align, audit, bpe, caps, jaccard, language, mixing, packing, pii, sharding, tokens, topk, urls

QUERIES: dict = {}
ORACLE: dict = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_text(name: str) -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_shards(spark, sf_dir):
    """Documents in 40 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.identify(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_similar_documents(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents"))


ORACLE["op3_similar_documents"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT reached.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.doc_id GROUP BY reached.doc_id
"""


# The rules of the contract, and words of the default block list.
PATH_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
              ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BLOCKED_WORDS = ("adserver", "casino", "doubleclick", "malware", "phishing", "porn", "viagra", "xxx")


def op4_url_verdicts(spark, sf_dir):
    rules = [urls.path_rule(*rule) for rule in PATH_RULES] + [urls.word_rule(word, "block") for word in BLOCKED_WORDS]
    judged = urls.judge(table(spark, sf_dir, "pages"), rules)
    by_path = F.col("rule").isin([host + path for host, path, _ in PATH_RULES])
    return judged.select("page_id", "host", "path", F.when(by_path, F.col("rule")).alias("rule"), "verdict")


ORACLE["op4_url_verdicts"] = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in PATH_RULES)}),
fitting AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])({"|".join(BLOCKED_WORDS)})([^0-9A-Za-z]|$)')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (n)
"""


def op5_near_vectors(spark, sf_dir):
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op5_near_vectors"] = """
WITH RECURSIVE units AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reached.vec_id, links.b FROM reached JOIN links ON links.a = reached.other),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""


def op6_mixture(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_personal_data(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.Model(spark))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id", *[of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op8_token_counts(spark, sf_dir):
    """The cache of this query starts empty, so that it shows the cost of a first run."""
    cache = f"{shared_folder(spark).rstrip('/')}/orderlens-token-cache-{uuid.uuid4().hex}"
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_text("word_bpe_49k.json"), cache)


def op9_top_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


ORACLE["op9_top_vectors"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_packing(spark, sf_dir):
    pieces = packing.cut(table(spark, sf_dir, "documents"), tokenizer_text("byte_bpe_50k.json"), ids=False)
    packed = packing.pack(pieces, order=("doc_id", "start", "ids_crc32"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_bpe(spark, sf_dir):
    return bpe.code(table(spark, sf_dir, "documents"), tokenizer_text("word_bpe_49k.json"), whole=False)


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    pieces = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return align.align(table(spark, sf_dir, "documents"), tokenizer_text("byte_bpe_50k.json"), pieces, whole=False)[0]


def op13_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flagged AS MATERIALIZED (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
         EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = texts.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = texts.doc_id AND toxic = 1) AS toxic
  FROM texts),
sets AS MATERIALIZED (
  SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS own, filter_order[1:step - 1] AS before
  FROM orders, range(1, 6) AS u(step)),
judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
         translate(failed, before, '') <> failed AS earlier
  FROM sets, steps),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""


QUERIES |= {"op1_shards": op1_shards, "op2_language": op2_language, "op3_similar_documents": op3_similar_documents, "op4_url_verdicts": op4_url_verdicts, "op5_near_vectors": op5_near_vectors,
            "op6_mixture": op6_mixture, "op7_personal_data": op7_personal_data, "op8_token_counts": op8_token_counts, "op9_top_vectors": op9_top_vectors,
            "op10_packing": op10_packing, "op11_bpe": op11_bpe, "op12_alignment": op12_alignment, "op13_filter_audit": op13_filter_audit}
