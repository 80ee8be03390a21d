"""Composite, report, quality, control and sweep operators on a scored document table.

Six layers with natural gaps over ``documents``: length (not for Spanish), label quality and safety (labelled documents
only), topic (English only), talk (documents with a conversation of the same number) and markup (with a page of the same
number). The symbol is the hash of the text, so exact copies compete for one place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.functions.joins import widen
from evidrank.functions.ranks import with_percent_rank, with_row_number
from evidrank.functions.rows import known_count, mentions_any
from evidrank.operators import composite as J
from evidrank.operators import controls as K
from evidrank.operators import entities as E
from evidrank.operators import quality as Q
from evidrank.operators import report as P
from evidrank.operators import sweep as S
from evidrank.plans.evidence_run import SCORED, UNIVERSE, EvidenceRun
from evidrank.plans.registry import query, r6, table
from evidrank.plans.table_text import CONTEXTS, _word_sql
from evidrank.sources import delimited, records, schema
from evidrank.sources.lines import write_block_gzip
from evidrank.sources.stages import StageStore, cut, scratch_folder, write_id_list

WEIGHTS = {"length": 0.20, "quality": 0.20, "safety": 0.15, "topic": 0.15, "talk": 0.15, "markup": 0.15}
LAYERS = list(WEIGHTS)

LAYERS_SQL = f"""
texts AS (SELECT doc_id, ({" + ".join(f"CAST({_word_sql(t)} AS INT)" for t in CONTEXTS.values())}) / 4e0 AS v
          FROM documents),
talks AS (SELECT conv_id, count(*) / (count(*) + 5e0) AS v FROM conversations GROUP BY conv_id),
joined AS (
  SELECT d.doc_id AS gene_id, md5(d.text) AS gene_symbol, d.source,
    CASE WHEN d.lang <> 'es' THEN d.n_chars / (d.n_chars + 5000e0) END AS length_score,
    l.quality * 0.8e0 + 0.1e0 AS quality_score,
    CASE WHEN l.quality = 1 THEN 0.9e0 - 0.8e0 * l.toxic END AS safety_score,
    t.v AS topic_score, k.v AS talk_score, length(p.html) / (length(p.html) + 5000e0) AS markup_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN texts t ON d.doc_id = t.doc_id
    LEFT JOIN talks k ON d.doc_id = k.conv_id LEFT JOIN pages p ON d.doc_id = p.page_id),
counted AS (SELECT *, CAST({" + ".join(f"CASE WHEN {n}_score IS NULL THEN 0 ELSE 1 END" for n in LAYERS)} AS BIGINT) AS evidence_count FROM joined)"""


def _weighted_sql(weights: dict[str, float]) -> tuple[str, str]:
    top = " + ".join(f"coalesce({n}_score * {w!r}e0, 0)" for n, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {n}_score IS NULL THEN 0e0 ELSE {w!r}e0 END" for n, w in weights.items())
    return top, bottom


_TOP, _BOTTOM = _weighted_sql(WEIGHTS)

COMPOSITE_SQL = f"""{LAYERS_SQL},
weighed AS (SELECT *, {_TOP} AS weighted_sum, {_BOTTOM} AS available_weight FROM counted),
combined AS (
  SELECT *, CASE WHEN available_weight > 0 THEN weighted_sum / available_weight END AS composite_score,
    CASE WHEN evidence_count >= 4 THEN 'sufficient_evidence' WHEN evidence_count >= 2 THEN 'moderate_evidence'
         WHEN evidence_count >= 1 THEN 'sparse_evidence' ELSE 'no_evidence' END AS quality_flag FROM weighed),
scored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY evidence_count DESC,
    composite_score DESC NULLS LAST, gene_id) AS i FROM combined) WHERE i = 1)"""

TIERS_SQL = f"""{COMPOSITE_SQL},
tiered AS (
  SELECT * FROM (SELECT *, CASE WHEN composite_score >= 0.7 AND evidence_count >= 3 THEN 'HIGH'
    WHEN composite_score >= 0.4 AND evidence_count >= 2 THEN 'MEDIUM' WHEN composite_score >= 0.2 THEN 'LOW' END AS confidence_tier
    FROM scored) WHERE confidence_tier IS NOT NULL)"""


def document_layers(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, tuple[DataFrame, str]]]:
    """Six stand-in layers. Counts and lengths x score x / (x + half), which no long text or talk exceeds or evens out."""
    docs = table(spark, sf, "documents")
    texts = widen(docs.select("doc_id", "text"))
    share = lambda x, half: x / (x + F.lit(half))
    doc_id = F.col("doc_id").alias("gene_id")
    universe = docs.select(doc_id, F.md5("text").alias("gene_symbol"))
    labels = table(spark, sf, "labels")
    flags = [mentions_any("text", terms).cast("int") for terms in CONTEXTS.values()]
    parts = {
        "length": docs.where(F.col("lang") != "es").select(
            doc_id, share(F.col("n_chars"), 5000.0).alias("score")
        ),
        "quality": labels.select(doc_id, (F.col("quality") * F.lit(0.8) + F.lit(0.1)).alias("score")),
        "safety": labels.where(F.col("quality") == 1).select(
            doc_id, (F.lit(0.9) - F.lit(0.8) * F.col("toxic")).alias("score")
        ),
        "topic": texts.select(doc_id, (sum(flags, F.lit(0)) / F.lit(4.0)).alias("score")),
        "talk": table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("gene_id"))
        .agg(share(F.count(F.lit(1)), 5.0).alias("score")),
        "markup": table(spark, sf, "pages").select(
            F.col("page_id").alias("gene_id"), share(F.length("html"), 5000.0).alias("score")
        ),
    }
    return universe, {n: (df, "score") for n, df in parts.items()}


def joined_documents(spark: SparkSession, sf: str) -> DataFrame:
    universe, layers = document_layers(spark, sf)
    return J.evidence_join(universe, layers, dedupe=False)


def composite_documents(spark: SparkSession, sf: str) -> DataFrame:
    return J.weighted_composite(joined_documents(spark, sf), WEIGHTS)


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The scored stage, written once so that every check below reads columns instead of re-joining the layers."""
    return cut(composite_documents(spark, sf))


def tiered_documents(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign_tiers(composite_documents(spark, sf))


# ---------------------------------------------------------------------------------------------------------------------
# composite and report


@query(
    "evidence_join",
    f"""WITH {LAYERS_SQL} SELECT gene_id, gene_symbol, evidence_count, {", ".join(f"round({n}_score, 6) AS {n}_score" for n in LAYERS)}
        FROM (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY evidence_count DESC, gene_id) AS i FROM counted)
        WHERE i = 1""",
)
def evidence_join(spark, sf):
    universe, layers = document_layers(spark, sf)
    return J.evidence_join(universe, layers).withColumns({f"{n}_score": r6(f"{n}_score") for n in LAYERS})


@query(
    "weighted_composite",
    f"""WITH {COMPOSITE_SQL} SELECT gene_id, gene_symbol, evidence_count, quality_flag, round(available_weight, 6) AS available_weight,
        round(weighted_sum, 6) AS weighted_sum, round(composite_score, 6) AS composite_score,
        {", ".join(f"round({n}_score * {w!r}, 6) AS {n}_contribution" for n, w in WEIGHTS.items())} FROM scored""",
)
def weighted_composite(spark, sf):
    names = ["available_weight", "weighted_sum", "composite_score", *[f"{n}_contribution" for n in LAYERS]]
    return composite_documents(spark, sf).select(
        "gene_id", "gene_symbol", "evidence_count", "quality_flag", *[r6(c) for c in names]
    )


@query(
    "group_dedup",
    f"""WITH {COMPOSITE_SQL} SELECT gene_id, source, evidence_count, round(composite_score, 6) AS composite_score FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY evidence_count DESC, composite_score DESC NULLS LAST, gene_id) AS j
          FROM combined) WHERE j = 1""",
)
def group_dedup(spark, sf):
    """Twenty sources share all documents: the hot-group case of the dedup."""
    universe, layers = document_layers(spark, sf)
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("gene_id"), F.col("source").alias("gene_symbol"))
    scored = J.weighted_composite(J.evidence_join(sources, layers, dedupe=False), WEIGHTS)
    return scored.select("gene_id", F.col("gene_symbol").alias("source"), "evidence_count", r6("composite_score"))


@query(
    "tiers",
    f"""WITH {TIERS_SQL} SELECT gene_id, gene_symbol, evidence_count, round(composite_score, 6) AS composite_score, confidence_tier
        FROM tiered""",
)
def tiers(spark, sf):
    rows = J.by_score(tiered_documents(spark, sf))
    return rows.select("gene_id", "gene_symbol", "evidence_count", r6("composite_score"), "confidence_tier")


def _names_sql(known: bool) -> str:
    test = "IS NOT NULL" if known else "IS NULL"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {n}_score {test} THEN '{n}' END" for n in LAYERS) + ")"


@query(
    "evidence_summary",
    f"WITH {COMPOSITE_SQL} SELECT gene_id, {_names_sql(True)} AS supporting_layers, {_names_sql(False)} AS evidence_gaps FROM scored",
)
def evidence_summary(spark, sf):
    rows = P.evidence_summary(composite_documents(spark, sf), LAYERS)
    return rows.select("gene_id", "supporting_layers", "evidence_gaps")


@query(
    "tier_counts",
    f"""WITH {TIERS_SQL} SELECT confidence_tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM tiered GROUP BY confidence_tier""",
)
def tier_counts(spark, sf):
    return P.category_counts(tiered_documents(spark, sf), "confidence_tier").withColumn("share", r6("share"))


@query(
    "quality_counts",
    f"""WITH {COMPOSITE_SQL} SELECT quality_flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM scored GROUP BY quality_flag""",
)
def quality_counts(spark, sf):
    return P.category_counts(composite_documents(spark, sf), "quality_flag").withColumn("share", r6("share"))


@query(
    "layer_coverage",
    f"WITH {COMPOSITE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS layer, count({n}_score) AS n FROM scored" for n in LAYERS),
)
def layer_coverage(spark, sf):
    return P.layer_coverage(composite_documents(spark, sf), LAYERS)


@query(
    "score_histogram",
    f"""WITH {TIERS_SQL}, r AS (SELECT round(composite_score, 9) AS x, confidence_tier FROM tiered),
        s AS (SELECT min(x) AS lo, max(x) AS hi FROM r)
        SELECT CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, confidence_tier, count(*) AS n
        FROM r, s GROUP BY ALL""",
)
def score_histogram(spark, sf):
    rows = tiered_documents(spark, sf).select(F.round("composite_score", 9).alias("composite_score"), "confidence_tier")
    return P.score_histogram(cut(rows))


@query(
    "top_rows",
    f"""WITH {COMPOSITE_SQL} SELECT gene_id, round(composite_score, 9) AS composite_score FROM scored
        ORDER BY round(composite_score, 9) DESC NULLS LAST, gene_id LIMIT 100""",
)
def top_rows(spark, sf):
    rows = composite_documents(spark, sf).select("gene_id", F.round("composite_score", 9).alias("composite_score"))
    return P.top_rows(rows, 100, [F.desc_nulls_last("composite_score"), F.asc("gene_id")])


@query(
    "dual_sink",
    f"""WITH {TIERS_SQL} SELECT CAST(gene_id AS VARCHAR) AS gene_id, confidence_tier, round(composite_score, 6) AS composite_score,
        (SELECT count(*) FROM tiered) AS total_candidates, (SELECT count(*) FROM tiered WHERE confidence_tier = 'HIGH') AS high_count
        FROM tiered""",
)
def dual_sink(spark, sf):
    """Write TSV and Parquet, then read the TSV back next to the statistics of the write."""
    folder = f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}"
    stats = P.write_dual(tiered_documents(spark, sf), folder)
    back = delimited.read_delimited(spark, f"{folder}/candidates.tsv", null_tokens=("",))
    return back.select(
        "gene_id",
        "confidence_tier",
        r6(schema.lenient("composite_score", "double")).alias("composite_score"),
        stats.select("total_candidates").scalar().alias("total_candidates"),
        stats.select("high_count").scalar().alias("high_count"),
    )


# ---------------------------------------------------------------------------------------------------------------------
# quality


@query(
    "missing_rates",
    f"WITH {COMPOSITE_SQL}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS layer, avg(CASE WHEN {n}_score IS NULL THEN 1e0 ELSE 0e0 END) AS v FROM scored" for n in LAYERS
    )
    + """) SELECT layer, round(v, 6) AS missing_rate, CASE WHEN v > 0.8 THEN 'error' WHEN v > 0.5 THEN 'warning' ELSE 'ok' END
         AS severity FROM m""",
)
def missing_rates(spark, sf):
    return Q.missing_rates(composite_documents(spark, sf), LAYERS).withColumn("missing_rate", r6("missing_rate"))


LONG_SQL = f"{COMPOSITE_SQL}, long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS layer, gene_id, {n}_score AS score FROM scored" for n in LAYERS
) + ")"


@query(
    "distribution_stats",
    f"""WITH {LONG_SQL}, d AS (SELECT layer, avg(score) AS mean, quantile_cont(score, 0.5) AS median, stddev_pop(score) AS std,
          min(score) AS min, max(score) AS max, count(score) AS count FROM long GROUP BY layer)
        SELECT layer, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min,
          round(max, 6) AS max, count, CASE WHEN count = 0 THEN 'warning' WHEN min < 0 OR max > 1 THEN 'error'
            WHEN std < 0.01 THEN 'warning' ELSE 'ok' END AS severity FROM d""",
)
def distribution_stats(spark, sf):
    stats = Q.distribution_stats(scored_documents(spark, sf), LAYERS)
    return stats.withColumns({c: r6(c) for c in ("mean", "median", "std", "min", "max")})


@query(
    "mad_outliers",
    f"""WITH {LONG_SQL}, known AS (SELECT layer, gene_id, round(score, 9) AS score FROM long WHERE score IS NOT NULL),
        m AS (SELECT layer, quantile_cont(score, 0.5) AS med FROM known GROUP BY layer),
        d AS (SELECT layer, med, quantile_cont(abs(score - med), 0.5) * 1.482602218505602 AS mad FROM known JOIN m USING (layer) GROUP BY layer, med),
        o AS (SELECT layer, gene_id FROM known JOIN d USING (layer) WHERE mad > 1e-8 AND abs(score - med) > 3 * mad),
        e AS (SELECT layer, string_agg(gene_id, ',' ORDER BY gene_id) AS examples
              FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY gene_id) AS i FROM o) WHERE i <= 5 GROUP BY layer),
        n AS (SELECT layer, count(*) AS c FROM o GROUP BY layer)
        SELECT DISTINCT long.layer, coalesce(c, 0) AS outlier_count, examples FROM long LEFT JOIN n USING (layer) LEFT JOIN e USING (layer)""",
)
def mad_outliers(spark, sf):
    rows = scored_documents(spark, sf).select("gene_id", *[F.round(f"{n}_score", 9).alias(f"{n}_score") for n in LAYERS])
    found = Q.mad_outliers(rows, LAYERS, "gene_id")
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    "composite_percentiles",
    f"""WITH {COMPOSITE_SQL} SELECT round(avg(composite_score), 6) AS mean, round(quantile_cont(composite_score, 0.5), 6) AS median,
        round(stddev_samp(composite_score), 6) AS std, round(min(composite_score), 6) AS min, round(max(composite_score), 6) AS max,
        {", ".join(f"round(quantile_cont(composite_score, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))},
        count(*) AS total, count(composite_score) AS non_null FROM scored""",
)
def composite_percentiles(spark, sf):
    row = Q.composite_stats(scored_documents(spark, sf))
    return row.withColumns({c: r6(c) for c in row.columns if c not in ("total", "non_null")})


@query(
    "qc_findings",
    f"""WITH {LONG_SQL}, m AS (SELECT layer, avg(CASE WHEN score IS NULL THEN 1e0 ELSE 0e0 END) AS v, stddev_pop(score) AS std,
          count(score) AS n, min(score) AS lo, max(score) AS hi FROM long GROUP BY layer)
        SELECT 'missing_data' AS check_name, layer, CASE WHEN v > 0.8 THEN 'error' ELSE 'warning' END AS severity,
          printf('%s: %.1f%% missing', layer, v * 100) AS message FROM m WHERE v > 0.5
        UNION ALL SELECT 'distribution', layer, 'warning', layer || ': no data available' FROM m WHERE n = 0
        UNION ALL SELECT 'distribution', layer, 'warning', printf('%s: no variation (std=%.4f)', layer, std) FROM m WHERE std < 0.01
        UNION ALL SELECT 'distribution', layer, 'error', printf('%s: out of range (min=%.4f, max=%.4f)', layer, lo, hi) FROM m WHERE lo < 0 OR hi > 1""",
)
def qc_findings(spark, sf):
    return Q.qc_findings(scored_documents(spark, sf), LAYERS)


_SIDES = {"west": ["FRANCE", "GERMANY", "BRAZIL"], "east": ["CHINA", "JAPAN", "FRANCE"], "nowhere": ["ATLANTIS"]}


@query(
    "control_rows",
    f"""WITH listed AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{side}')" for side, names in _SIDES.items() for n in names)}) AS t(gene_symbol, source))
        SELECT gene_symbol, source, 'MEDIUM' AS confidence, count(c_custkey) AS customers
        FROM listed LEFT JOIN nation ON n_name = gene_symbol LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY gene_symbol, source""",
)
def control_rows(spark, sf):
    """A control set built from named lists, with a member of two lists and one that no table knows, met with its customers."""
    listed = K.control_set(spark, _SIDES, "MEDIUM")
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("gene_symbol"), "n_nationkey")
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return listed.join(nations.join(per, "n_nationkey"), "gene_symbol", "left").select(*listed.columns, F.coalesce("customers", F.lit(0)).alias("customers"))


@query(
    "qc_verdict",
    f"""WITH {LONG_SQL}, m AS (SELECT layer, avg(CASE WHEN score IS NULL THEN 1e0 ELSE 0e0 END) AS v, stddev_pop(score) AS std,
          count(score) AS n, min(score) AS lo, max(score) AS hi FROM long GROUP BY layer),
        c AS (SELECT count(*) FILTER (v > 0.5 AND v <= 0.8) + count(*) FILTER (n = 0 OR std < 0.01) AS warnings,
                count(*) FILTER (v > 0.8) + count(*) FILTER (lo < 0 OR hi > 1) AS errors FROM m)
        SELECT warnings, errors, errors = 0 AS passed FROM c""",
)
def qc_verdict(spark, sf):
    return Q.qc_verdict(Q.qc_findings(scored_documents(spark, sf), LAYERS))


# ---------------------------------------------------------------------------------------------------------------------
# controls: labelled documents as positive (clean; clean and English) and negative (toxic) sets

RANKED_SQL = f"""{COMPOSITE_SQL.replace("scored AS", "unrounded AS")},
scored AS (SELECT * EXCLUDE (composite_score), round(composite_score, 9) AS composite_score FROM unrounded),
ranked AS (SELECT gene_id, composite_score, percent_rank() OVER (ORDER BY composite_score) AS percentile_rank,
             row_number() OVER (ORDER BY composite_score DESC, gene_id) AS position FROM scored WHERE composite_score IS NOT NULL),
positives AS (SELECT doc_id AS gene_id, 'clean' AS source FROM labels WHERE quality = 1 AND toxic = 0
  UNION ALL SELECT doc_id, 'english' FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND lang = 'en'),
negatives AS (SELECT doc_id AS gene_id, 'toxic' AS source FROM labels WHERE toxic = 1)"""


def control_tables(spark: SparkSession, sf: str, joined: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored documents (rounded, so that both engines see the same ties), positive and negative controls."""
    scored = cut(J.weighted_composite(joined, WEIGHTS)) if joined else scored_documents(spark, sf)
    scored = scored.select("gene_id", F.round("composite_score", 9).alias("composite_score"))
    labels = table(spark, sf, "labels")
    english = table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id")
    good = labels.where(F.col("quality") == 1)
    pick = lambda df, source: df.select(F.col("doc_id").alias("gene_id"), F.lit(source).alias("source"))
    positives = pick(good.where(F.col("toxic") == 0), "clean").unionByName(
        pick(good.join(english, "doc_id", "left_semi"), "english")
    )
    return scored, positives, pick(labels.where(F.col("toxic") == 1), "toxic")


@query(
    "percent_rank_all",
    f"WITH {RANKED_SQL} SELECT gene_id, round(percentile_rank, 6) AS percentile_rank FROM ranked",
)
def percent_rank_all(spark, sf):
    scored, _, _ = control_tables(spark, sf)
    known = scored.where(F.col("composite_score").isNotNull())
    return with_percent_rank(known, "composite_score").select("gene_id", r6("percentile_rank"))


@query("global_position", f"WITH {RANKED_SQL} SELECT gene_id, position FROM ranked")
def global_position(spark, sf):
    scored, _, _ = control_tables(spark, sf)
    known = scored.where(F.col("composite_score").isNotNull())
    return with_row_number(known, [F.desc("composite_score"), F.asc("gene_id")]).select("gene_id", "position")


def _summary_sql(controls: str, test: str, why: str) -> str:
    return f"""WITH {RANKED_SQL}, hit AS (SELECT DISTINCT gene_id, composite_score, percentile_rank FROM ranked JOIN {controls} USING (gene_id)),
      s AS (SELECT (SELECT count(DISTINCT gene_id) FROM {controls}) AS total_expected, count(*) AS total_in_dataset,
        quantile_cont(percentile_rank, 0.5) AS median, count(*) FILTER (percentile_rank >= 0.75) AS top_quartile_count,
        count(*) FILTER (composite_score >= 0.7) AS high_score_count FROM hit)
      SELECT total_expected, total_in_dataset, round(median, 6) AS median_percentile, top_quartile_count,
        round(top_quartile_count / total_in_dataset, 6) AS top_quartile_fraction, high_score_count,
        median {test} AS validation_passed, CASE WHEN NOT (median {test}) THEN '{why}' END AS reason FROM s"""


def _rounded_summary(row: DataFrame) -> DataFrame:
    return row.withColumns({c: r6(c) for c in ("median_percentile", "top_quartile_fraction")})


@query("positive_controls", _summary_sql("positives", ">= 0.75", "median_under_limit"))
def positive_controls(spark, sf):
    scored, positives, _ = control_tables(spark, sf)
    ranked = K.rank_controls(scored, positives, "gene_id")
    return _rounded_summary(K.control_summary(ranked, positives, on="gene_id"))


@query("negative_controls", _summary_sql("negatives", "< 0.5", "median_over_limit"))
def negative_controls(spark, sf):
    scored, _, negatives = control_tables(spark, sf)
    ranked = K.rank_controls(scored, negatives, "gene_id")
    return _rounded_summary(K.control_summary(ranked, negatives, positive=False, on="gene_id"))


@query(
    "per_source_controls",
    f"""WITH {RANKED_SQL} SELECT source, round(quantile_cont(percentile_rank, 0.5), 6) AS median_percentile, count(*) AS n,
        count(*) FILTER (percentile_rank >= 0.75) AS top_quartile_count FROM ranked JOIN positives USING (gene_id) GROUP BY source""",
)
def per_source_controls(spark, sf):
    scored, positives, _ = control_tables(spark, sf)
    found = K.control_by_source(K.rank_controls(scored, positives, "gene_id"), positives)
    return found.withColumn("median_percentile", r6("median_percentile"))


@query(
    "control_details",
    f"""WITH {RANKED_SQL} SELECT gene_id, source, round(composite_score, 6) AS composite_score, round(percentile_rank, 6) AS percentile_rank
        FROM ranked JOIN negatives USING (gene_id) ORDER BY ranked.percentile_rank, gene_id, source LIMIT 20""",
)
def control_details(spark, sf):
    scored, _, negatives = control_tables(spark, sf)
    rows = K.control_details(K.rank_controls(scored, negatives, "gene_id"), best_first=False, on="gene_id")
    return rows.select("gene_id", "source", r6("composite_score"), r6("percentile_rank"))


_CUTS = [(str(k), str(k)) for k in K.RECALL_KS] + [
    (f"{int(f * 100)}%", f"CAST(floor((SELECT count(*) FROM ranked) * {f}e0) AS BIGINT)") for f in K.RECALL_FRACTIONS
]


@query(
    "recall_at_k",
    f"WITH {RANKED_SQL}, u AS (SELECT DISTINCT gene_id FROM positives), cuts AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS threshold, CAST({k} AS BIGINT) AS k" for name, k in _CUTS)
    + """) SELECT threshold, k, count(position) AS hits, (SELECT count(*) FROM u) AS total_known,
         round(count(position) / (SELECT count(*) FROM u), 6) AS recall
         FROM cuts LEFT JOIN (SELECT position FROM ranked JOIN u USING (gene_id)) ON position <= k GROUP BY threshold, k""",
)
def recall_at_k(spark, sf):
    scored, positives, _ = control_tables(spark, sf)
    return K.recall_at_k(scored, positives, on="gene_id").withColumn("recall", r6("recall"))


# ---------------------------------------------------------------------------------------------------------------------
# sweep


@query(
    "weight_scenarios",
    f"""WITH {LAYERS_SQL}, c AS (SELECT {", ".join(f"CAST(count({n}_score) AS DOUBLE) AS {n}" for n in LAYERS)} FROM joined),
        b AS (SELECT {", ".join(f"{n} / ({' + '.join(LAYERS)}) AS {n}" for n in LAYERS)} FROM c),
        g AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n in LAYERS)}) AS t(target_layer),
                            (VALUES {", ".join(f"({d}e0)" for d in S.DEFAULT_DELTAS)}) AS d(delta)),
        p AS (SELECT target_layer, delta, {", ".join(f"CASE WHEN target_layer = '{n}' THEN greatest(0e0, least(1e0, {n} + delta)) ELSE {n} END AS {n}" for n in LAYERS)} FROM g, b)
        SELECT target_layer, delta, layer, round(w, 6) AS weight FROM ("""
    + " UNION ALL ".join(f"SELECT target_layer, delta, '{n}' AS layer, {n} / ({' + '.join(LAYERS)}) AS w FROM p" for n in LAYERS)
    + ")",
)
def weight_scenarios(spark, sf):
    """Scenarios around weights proportional to the coverage of each layer."""
    joined = joined_documents(spark, sf)
    counts = joined.agg(*[F.count(f"{n}_score").cast("double").alias(n) for n in LAYERS])
    total = sum((F.col(n) for n in LAYERS), F.lit(0.0))
    baseline = counts.select(*[(F.col(n) / total).alias(n) for n in LAYERS])
    return S.weight_scenarios(baseline).withColumn("weight", r6("weight"))


def _scenario_sql() -> str:
    rows = [(0, "baseline", 0.0, WEIGHTS)] + [(i, n, d, w) for i, (n, d, w) in enumerate(S.scenarios(WEIGHTS), start=1)]
    values = ", ".join(f"({i}, '{n}', {d!r}e0, {', '.join(f'{v!r}e0' for v in w.values())})" for i, n, d, w in rows)
    return f"scen AS (SELECT * FROM (VALUES {values}) AS t(scenario, layer, delta, {', '.join(f'w_{n}' for n in LAYERS)}))"


SWEEP_SQL = f"""{LAYERS_SQL}, {_scenario_sql()},
every AS (
  SELECT scenario, layer, delta, gene_id, gene_symbol, evidence_count,
    round(({" + ".join(f"coalesce({n}_score * w_{n}, 0)" for n in LAYERS)})
      / nullif({" + ".join(f"CASE WHEN {n}_score IS NULL THEN 0e0 ELSE w_{n} END" for n in LAYERS)}, 0), 9) AS composite
  FROM counted, scen),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, gene_symbol
    ORDER BY evidence_count DESC, composite DESC NULLS LAST, gene_id) AS i FROM every) WHERE i = 1 AND composite IS NOT NULL),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY composite DESC, gene_id) AS j FROM kept) WHERE j <= 100),
pairs AS (SELECT t.scenario, t.layer, t.delta, t.composite AS x, b.composite AS y FROM tops t JOIN tops b
          ON t.gene_symbol = b.gene_symbol AND b.scenario = 0 WHERE t.scenario > 0),
ranks AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY x) + (count(*) OVER (PARTITION BY scenario, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY scenario ORDER BY y) + (count(*) OVER (PARTITION BY scenario, y) - 1) / 2.0 AS ry FROM pairs),
sweep AS (SELECT layer, delta, count(*) AS overlap_count, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS rho FROM ranks GROUP BY layer, delta)"""


def document_sweep(spark: SparkSession, sf: str, joined: DataFrame | None = None) -> DataFrame:
    return S.sensitivity_sweep(joined or joined_documents(spark, sf), WEIGHTS, digits=9)


@query(
    "sensitivity",
    f"""WITH {SWEEP_SQL},
        r AS (SELECT *, overlap_count - 2 AS f, CASE WHEN abs(rho) < 0.999999 THEN rho * sqrt((overlap_count - 2) / (1 - rho * rho)) END AS t FROM sweep),
        -- Student's t by Simpson's rule on its density in the angle atan(t / sqrt(f)), 400 pieces
        a AS (SELECT *, atan(abs(t) / sqrt(f)) / 400 AS h, exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(pi()) AS c FROM r),
        p AS (SELECT *, list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                                * pow(cos(h * i), f - 1))) * h / 3 * c AS inside FROM a)
        SELECT layer, delta, round(rho, 6) AS spearman_rho, overlap_count, CAST(100 AS BIGINT) AS top_n, round(t, 4) AS t_statistic,
          round(CASE WHEN t IS NOT NULL THEN greatest(0e0, 1 - 2 * inside) END, 6) AS p_value FROM p""",
)
def sensitivity(spark, sf):
    """Agreement per scenario with its t statistic and p-value, but for agreements of 0.999999 and more, where t has no stable digits."""
    rows = document_sweep(spark, sf)
    told = lambda c, digits: F.when(F.abs("spearman_rho") < 0.999999, F.round(c, digits)).alias(c)
    return rows.select("layer", "delta", told("t_statistic", 4), told("p_value", 6), r6("spearman_rho"), "overlap_count", "top_n")


@query(
    "sensitivity_summary",
    f"""WITH {SWEEP_SQL}, m AS (SELECT layer, round(avg(rho), 9) AS v FROM sweep WHERE rho IS NOT NULL GROUP BY layer)
        SELECT round(min(rho), 6) AS min_rho, round(max(rho), 6) AS max_rho, round(avg(rho), 6) AS mean_rho,
          count(*) FILTER (rho >= 0.85) AS stable_count, count(*) FILTER (rho < 0.85) AS unstable_count,
          count(*) AS total_perturbations, count(rho) > 0 AND count(rho) = count(*) FILTER (rho >= 0.85) AS overall_stable,
          (SELECT layer FROM m ORDER BY v, layer LIMIT 1) AS most_sensitive_layer,
          (SELECT layer FROM m ORDER BY v DESC, layer LIMIT 1) AS most_robust_layer FROM sweep""",
)
def sensitivity_summary(spark, sf):
    row = S.sweep_summary(cut(document_sweep(spark, sf).withColumn("spearman_rho", F.round("spearman_rho", 9))))
    return row.withColumns({c: r6(c) for c in ("min_rho", "max_rho", "mean_rho")})


@query(
    "extended_controls",
    f"""WITH {RANKED_SQL}, u AS (SELECT DISTINCT gene_id FROM positives),
        hit AS (SELECT DISTINCT gene_id, composite_score, percentile_rank FROM ranked JOIN positives USING (gene_id)),
        s AS (SELECT (SELECT count(*) FROM u) AS total_expected, count(*) AS total_in_dataset, quantile_cont(percentile_rank, 0.5) AS median_percentile,
            count(*) FILTER (percentile_rank >= 0.75) AS top_quartile_count, count(*) FILTER (composite_score >= 0.7) AS high_score_count FROM hit),
        cuts AS ({" UNION ALL ".join(f"SELECT '{name}' AS threshold, CAST({k} AS BIGINT) AS k" for name, k in _CUTS)})
        SELECT 'summary' AS section, name, round(value, 6) AS value FROM (
          SELECT 'total_expected' AS name, CAST(total_expected AS DOUBLE) AS value FROM s
          UNION ALL SELECT 'total_in_dataset', total_in_dataset FROM s UNION ALL SELECT 'median_percentile', median_percentile FROM s
          UNION ALL SELECT 'top_quartile_count', top_quartile_count FROM s
          UNION ALL SELECT 'top_quartile_fraction', top_quartile_count / total_in_dataset FROM s
          UNION ALL SELECT 'high_score_count', high_score_count FROM s)
        UNION ALL SELECT 'recall', threshold, round(count(position) / (SELECT count(*) FROM u), 6)
          FROM cuts LEFT JOIN (SELECT position FROM ranked JOIN u USING (gene_id)) ON position <= k GROUP BY threshold, k
        UNION ALL SELECT 'source', source, round(quantile_cont(percentile_rank, 0.5), 6) FROM ranked JOIN positives USING (gene_id) GROUP BY source""",
)
def extended_controls(spark, sf):
    scored, positives, _ = control_tables(spark, sf)
    return K.extended_controls(scored, positives, on="gene_id").withColumn("value", r6("value"))


def document_run(spark: SparkSession, sf: str) -> EvidenceRun:
    """A run over the document layers, all of it in a store of its own: universe, layers, scores."""
    universe, layers = document_layers(spark, sf)
    run = EvidenceRun(fresh_store(spark), {n: (f"layer_{n}", column) for n, (_, column) in layers.items()})
    run.store.save(universe, UNIVERSE, "documents")
    for name, (layer, _) in layers.items():
        run.layer(f"layer_{name}", lambda layer=layer: layer)
    run.score(WEIGHTS)
    return run


@query(
    "persisted_scores",
    f"""WITH {COMPOSITE_SQL} SELECT quality_flag, count(*) AS n, count(composite_score) AS with_score,
        round(sum(composite_score), 4) AS total FROM scored GROUP BY quality_flag""",
)
def persisted_scores(spark, sf):
    """Scores written to the store by a run, read back."""
    kept = document_run(spark, sf).store.load(SCORED).groupBy("quality_flag")
    total = F.round(F.sum("composite_score"), 4).alias("total")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count("composite_score").alias("with_score"), total)


@query(
    "run_summary",
    f"""WITH {TIERS_SQL} SELECT 'tier' AS section, confidence_tier AS name, CAST(NULL AS BIGINT) AS input_count, count(*) AS output_count
          FROM tiered GROUP BY confidence_tier
        UNION ALL SELECT 'step', 'score', (SELECT count(*) FROM documents), (SELECT count(*) FROM scored)
        UNION ALL SELECT 'step', 'quality', (SELECT count(*) FROM scored), (SELECT count(*) FROM scored)
        UNION ALL SELECT 'step', 'report', (SELECT count(*) FROM scored), (SELECT count(*) FROM tiered)""",
)
def run_summary(spark, sf):
    """Steps and tiers of a run's summary, the loading of the layers left out."""
    run = document_run(spark, sf)
    run.report(f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}")
    rows = run.summary(WEIGHTS).where(F.col("section").isin("tier", "step") & ~F.col("name").startswith("load_"))
    return rows.select("section", "name", "input_count", "output_count")


@query(
    "relaxed_concat",
    """SELECT o_custkey AS id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS name FROM orders
       UNION SELECT c_custkey, c_acctbal, c_name FROM customer UNION SELECT s_suppkey, NULL, s_name FROM supplier""",
)
def relaxed_concat(spark, sf):
    """Sources with other types and missing columns, cast to one schema, united, repeated rows dropped."""
    parts = [
        table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_totalprice").cast("double").cast("string").alias("amount")),
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name")),
        table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("n/a").alias("amount")),
    ]
    return records.union_conformed(parts, _struct("id bigint, amount double, name string"))


@query(
    "validation_verdict",
    f"""WITH {RANKED_SQL}, o AS (
          SELECT (SELECT quantile_cont(percentile_rank, 0.5) >= 0.75 FROM ranked WHERE gene_id IN (SELECT gene_id FROM positives)) AS p,
                 (SELECT quantile_cont(percentile_rank, 0.5) < 0.5 FROM ranked WHERE gene_id IN (SELECT gene_id FROM negatives)) AS n)
        SELECT p AS positive_passed, n AS negative_passed, s AS sensitivity_stable,
          CASE WHEN NOT p THEN 'failed' WHEN NOT n THEN 'specificity_issue' WHEN NOT s THEN 'sensitivity_unstable' ELSE 'all_passed' END AS status
        FROM o, (WITH {SWEEP_SQL} SELECT count(rho) > 0 AND count(rho) = count(*) FILTER (rho >= 0.85) AS s FROM sweep)""",
)
def validation_verdict(spark, sf):
    joined = cut(joined_documents(spark, sf))  # read by the scores and by the sweep
    scored, positives, negatives = control_tables(spark, sf, joined)
    both = positives.withColumn("side", F.lit("plus")).unionByName(negatives.withColumn("side", F.lit("minus")))
    ranked = K.rank_controls(scored, both, "gene_id", keep=("source", "side"), stored=True)
    of = lambda side: ranked.where(F.col("side") == side).drop("side")
    plus = K.control_summary(of("plus"), positives, on="gene_id")
    minus = K.control_summary(of("minus"), negatives, positive=False, on="gene_id")
    sweep = document_sweep(spark, sf, joined).withColumn("spearman_rho", F.round("spearman_rho", 9))
    return K.validation_verdict(plus, minus, S.sweep_summary(cut(sweep)))


# ---------------------------------------------------------------------------------------------------------------------
# gates, stages and sources


@query(
    "coverage_gate",
    """SELECT count(*) AS total, count(l.doc_id) AS mapped_symbol, count(p.page_id) AS mapped_accession,
         round(count(l.doc_id) / count(*), 6) AS symbol_rate, round(count(p.page_id) / count(*), 6) AS accession_rate,
         CASE WHEN count(l.doc_id) / count(*) < 0.3 THEN 'failed' WHEN count(l.doc_id) / count(*) < 0.6 THEN 'warning' ELSE 'passed' END AS status,
         count(l.doc_id) / count(*) >= 0.3 AS passed
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id AND l.doc_id IS NOT NULL""",
)
def coverage_gate(spark, sf):
    """Documents are requested, labels map them to a symbol, pages to an accession."""
    row = E.mapping_gate(E.mapping_report(mapped_documents(spark, sf)), 0.3, 0.6)
    return row.withColumns({c: r6(c) for c in ("symbol_rate", "accession_rate")})


def mapped_documents(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("gene_id"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    mapping = (
        table(spark, sf, "labels")
        .join(pages, "doc_id", "left")
        .select(
            F.col("doc_id").alias("gene_id"),
            F.concat(F.lit("L"), F.col("quality").cast("string")).alias("gene_symbol"),
            F.col("url").alias("uniprot_accession"),
        )
    )
    return E.map_requested(ids, mapping)


@query("unmapped_ids", "SELECT CAST(doc_id AS VARCHAR) AS gene_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_ids(spark, sf):
    """Write the list, one id per line, and read it back."""
    path = f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}"
    write_id_list(E.unmapped_ids(mapped_documents(spark, sf)), "gene_id", path)
    return spark.read.text(path).withColumnRenamed("value", "gene_id")


@query(
    "universe_gate",
    """WITH u AS (SELECT c_mktsegment || c_nationkey AS id FROM customer), c AS (
         SELECT CAST(count(*) AS BIGINT) AS total, count(*) FILTER (NOT starts_with(id, 'M')) AS bad_prefix, count(*) - count(DISTINCT id) AS duplicates FROM u)
       SELECT *, total BETWEEN 100 AND 20000 AS size_ok, bad_prefix = 0 AS prefix_ok, duplicates = 0 AS unique_ok,
         total BETWEEN 100 AND 20000 AND bad_prefix = 0 AND duplicates = 0 AS passed FROM c""",
)
def universe_gate(spark, sf):
    ids = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("gene_id"))
    return E.universe_gate(ids, "M", 100, 20000)


def fresh_store(spark: SparkSession) -> StageStore:
    return StageStore(spark, f"{scratch_folder(spark)}/evidrank-stages/{uuid.uuid4().hex}")


@query(
    "stage_roundtrip",
    """SELECT quality, toxic, 2 * count(*) AS n, (SELECT 2 * count(*) FROM labels) AS row_count FROM labels GROUP BY ALL""",
)
def stage_roundtrip(spark, sf):
    """Save, append, delete another stage, load, and join the ledger's row count on."""
    store, labels = fresh_store(spark), table(spark, sf, "labels")
    store.save(labels, "labels", "first half")
    store.save(labels, "labels", "second half", replace=False)
    store.save(labels, "scrap")
    store.delete("scrap")
    counts = store.load("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_count", store.list().select("row_count").scalar())


@query("stage_sql", "SELECT source, count(*) AS n FROM documents WHERE n_chars >= 2000 GROUP BY source")
def stage_sql(spark, sf):
    store = fresh_store(spark)
    store.save(table(spark, sf, "documents").select("source", "n_chars"), "staged_docs")
    return store.query("SELECT source, count(*) AS n FROM staged_docs WHERE n_chars >= :low GROUP BY source", {"low": 2000})


@query("stage_skip", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def stage_skip(spark, sf):
    """The second build must not replace the stage; the export must equal it."""
    store = fresh_store(spark)
    customer = table(spark, sf, "customer")
    store.stage("segments", lambda: customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    store.stage("segments", lambda: customer.select("c_mktsegment", F.lit(0).cast("long").alias("n")))
    store.export("segments", f"{store.root}/exported")
    return spark.read.parquet(f"{store.root}/exported")


@query(
    "run_ledger",
    """SELECT 'scan' AS step_name, count(*) AS input_count, count(*) FILTER (quality = 1) AS output_count,
         CAST(sum(toxic) AS VARCHAR) AS toxic FROM labels""",
)
def run_ledger(spark, sf):
    store, labels = fresh_store(spark), table(spark, sf, "labels")
    kept = store.save(labels.where(F.col("quality") == 1), "kept")
    toxic = labels.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    store.record_step("run", "scan", toxic["n"], kept, "quality = 1", {"toxic": toxic["toxic"]})
    return store.steps("run").select("step_name", "input_count", "output_count", F.col("details")["toxic"].alias("toxic"))


@query(
    "delimited_scan",
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, CAST(NULL AS BIGINT) AS absent FROM customer""",
)
def delimited_scan(spark, sf):
    """Gzip TSV with several null tokens and unreadable numbers, conformed to a declared schema."""
    path = f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).when(F.col("c_nationkey") > 9, "NA").otherwise("n/a").alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "BUILDING", ".").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    declared = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string, absent bigint"
    return schema.conform(delimited.read_delimited(spark, path), _struct(declared))


def _write_with_head(spark: SparkSession, lines: DataFrame, head: list[str], files: int = 4) -> str:
    """Text files of the lines (column ``value``), each below the same head lines."""
    path = f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}"
    tops = spark.createDataFrame([(f, n, line) for f in range(files) for n, line in enumerate(head)], "file int, n int, value string")
    rows = lines.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("file"), F.lit(len(head)).alias("n"), "value")
    rows = tops.unionByName(rows).repartitionById(files, F.col("file")).sortWithinPartitions("n")
    rows.select("value").write.text(path)
    return path


def _named_lines(spark: SparkSession, sf: str, head: list[str]) -> DataFrame:
    """Tab-separated customers: a third has a number for a name, a third a name that starts with #; fields are empty.

    Every fortieth row repeats the header, and the one after it the first head line, word for word.
    """
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("#"), "c_name")).when(key % 3 == 1, key.cast("string")).otherwise(F.col("c_name"))
    value = F.when(F.col("c_nationkey") <= 9, F.col("c_acctbal").cast("string")).otherwise("")
    line = F.concat_ws("\t", name, F.col("c_nationkey").cast("string"), value)
    return table(spark, sf, "customer").select(F.when(key % 40 == 0, head[-1]).when(key % 40 == 1, head[0]).otherwise(line).alias("value"))


def _named_sql(first: str) -> str:
    return f"""SELECT CASE WHEN c_custkey % 40 = 0 THEN 'Name' WHEN c_custkey % 40 = 1 THEN '{first}'
    WHEN c_custkey % 3 = 0 THEN '#' || c_name WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 40 = 0 THEN 'Description' WHEN c_custkey % 40 > 1 THEN CAST(c_nationkey AS VARCHAR) END AS description,
  CASE WHEN c_nationkey <= 9 AND c_custkey % 40 > 1 THEN c_acctbal END AS value FROM customer"""


PREAMBLE = ["#1.2", "600\t1", "Name\tDescription\tValue"]
COMMENTED = ["# release 7", "Name\tDescription\tValue"]


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("Name").alias("name"), F.col("Description").alias("description"), schema.lenient("Value", "double").alias("value"))


@query("preamble_scan", _named_sql(PREAMBLE[0]))
def preamble_scan(spark, sf):
    """Files below a version line, a dimension line and the header, read back without losing a row."""
    return _named(delimited.read_preamble(spark, _write_with_head(spark, _named_lines(spark, sf, PREAMBLE), PREAMBLE)))


@query("comment_scan", _named_sql(COMMENTED[0]))
def comment_scan(spark, sf):
    """Files whose first line is a comment; later lines that start like one, or repeat it, are rows."""
    return _named(delimited.read_delimited(spark, _write_with_head(spark, _named_lines(spark, sf, COMMENTED), COMMENTED), comment="#"))


@query(
    "block_gzip_scan",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_returnflag, l_quantity FROM lineitem
       UNION ALL SELECT NULL, NULL, 'l_returnflag', NULL FROM region""",
)
def block_gzip_scan(spark, sf):
    """All line items from block-gzip files, cut anywhere into ranges; rows that repeat the header stay."""
    head = "\t".join(["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])
    flag = F.when(F.col("l_returnflag") == "N", "NA").otherwise(F.col("l_returnflag"))
    item = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), flag, F.col("l_quantity").cast("string"))
    rows = table(spark, sf, "lineitem").select(item.alias("value")).unionByName(table(spark, sf, "region").select(F.lit(head).alias("value")))
    path = f"{scratch_folder(spark)}/evidrank-sinks/{uuid.uuid4().hex}"
    write_block_gzip(rows, path, head=[head])
    declared = "l_orderkey bigint, l_linenumber bigint, l_returnflag string, l_quantity double"
    return schema.conform(delimited.read_delimited(spark, path, range_bytes=256 << 10), _struct(declared))


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@query(
    "known_counts",
    f"WITH {LAYERS_SQL} SELECT evidence_count, count(*) AS n FROM counted GROUP BY evidence_count",
)
def known_counts(spark, sf):
    joined = joined_documents(spark, sf).withColumn("evidence_count", known_count([f"{n}_score" for n in LAYERS]))
    return joined.groupBy("evidence_count").agg(F.count(F.lit(1)).alias("n"))
