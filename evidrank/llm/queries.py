"""One query per operator of this subpackage, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.llm import divergence, licenses, lm, minhash, mixing, packing, pivots, runs, secret_scan, simhash, substrings, toxicity, warc
from evidrank.llm.common import WORD, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def packing_parameters() -> packing.Packing:
    """Production parameters: the public vocabulary where the installed package keeps it."""
    import public_tokenizers

    return packing.Packing(tokenizer=public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), packing_parameters())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded"
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.with_revisits(table(spark, folder, "pages"))
    read = warc.read(warc.write(records, warc.archive_folder(spark)))
    full = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, folder, "documents"))


@query
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op7_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, folder, "documents"), kept=["doc_id"])  # texts go to the scan and not back
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix_sizes(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = lm.score(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", F.round("log_score", 4).alias("log_score"),
        F.round("mean_log_score", 6).alias("mean_log_score"),
    )


ORACLE["op10_lm_scores"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT g.doc_id, g.u, g.v, a.n AS n1, b.n AS n2, c.n AS n3, x.n AS m1, y.n AS m2
      FROM g JOIN c1 a ON a.w = g.w LEFT JOIN c2 b ON b.v = g.v AND b.w = g.w
      LEFT JOIN c3 c ON c.u = g.u AND c.v = g.v AND c.w = g.w
      LEFT JOIN c1 x ON x.w = g.v LEFT JOIN c2 y ON y.v = g.u AND y.w = g.v),
r AS (SELECT doc_id, n3 >= 2 AS three, n2 >= 2 AND coalesce(n3, 0) < 2 AS two,
             CASE WHEN n3 >= 2 THEN ln(n3 / m2)
                  WHEN n2 >= 2 THEN ln(n2 / m1) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
                  ELSE ln(n1 / (SELECT count(*) FROM t)) + ln(0.4) * (CASE WHEN u IS NULL THEN 0 ELSE 1 END + CASE WHEN v IS NULL THEN 0 ELSE 1 END)
             END AS l FROM s),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE three) AS n3, count(*) FILTER (WHERE two) AS n2, sum(l) AS l FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram,
       coalesce(n - n2 - n3, 0) AS n_unigram, round(coalesce(l, 0.0), 4) AS log_score, round(l / n, 6) AS mean_log_score
FROM d LEFT JOIN z USING (doc_id)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the decimal doc_id ends in 0, the words from some place on repeat with some period."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    chosen = docs.where(h % 10 == 0).withColumn("w", F.regexp_extract_all(whole_text(), F.lit(f"({WORD})"), 1)).where(F.size("w") > 0)
    n = F.size("w")
    chosen = chosen.select("doc_id", "w", n.alias("n"), (g % n).cast("int").alias("a"), (3 + g % 8).alias("times"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("times"))).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.least("p", F.col("n") - F.col("a")))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = chosen.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ").alias("text"))
    plain = F.coalesce(h % 10 != 0, F.lit(True)) | ~whole_text().rlike(WORD)
    return docs.where(plain).unionByName(planted)


@query
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("best"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLE["op12_divergence"] = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
             CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * v.v) AS BIGINT) AS p
      FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
l AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v.v)) AS BIGINT) AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_substrings(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.dedup(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op13_substrings"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM d),
w AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS run FROM i),
m AS (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY run) AS first FROM w),
x AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM m WHERE first < doc_id),
l AS (SELECT r, list(i) AS gone FROM x GROUP BY r),
t AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON x.r = t.r AND x.i = t.i GROUP BY t.r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (r) LEFT JOIN k USING (r)
"""
