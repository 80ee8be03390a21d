"""Layer operators on the star-schema tables: parts, customers, orders, events and line items stand in for sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.functions.joins import join_growth
from evidrank.functions.rows import all_known
from evidrank.operators import annotation as A
from evidrank.operators import constraint as C
from evidrank.operators import expression as X
from evidrank.operators import localization as L
from evidrank.operators import orthology as O
from evidrank.plans.registry import percentile_sql, query, r6, table
from evidrank.sources.stages import cut

# ---------------------------------------------------------------------------------------------------------------------
# constraint: parts, with line-item coverage

PARTS_SQL = """
cov AS (
  SELECT l_partkey, CAST(count(*) AS DOUBLE) AS mean_depth,
         avg(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END) AS cds_covered_pct
  FROM lineitem GROUP BY l_partkey),
parts AS (
  SELECT p_partkey AS gene_id, p_brand AS gene_symbol,
         CASE WHEN p_size >= 5 THEN p_retailprice / 1000 END AS loeuf,
         CASE WHEN p_size >= 3 THEN p_size / 50e0 END AS pli, mean_depth, cds_covered_pct
  FROM part LEFT JOIN cov ON p_partkey = l_partkey),
flagged AS (
  SELECT *, CASE WHEN mean_depth >= 30 AND cds_covered_pct >= 0.5 AND loeuf IS NOT NULL THEN 'measured'
                 WHEN loeuf IS NULL AND pli IS NULL THEN 'no_data' ELSE 'incomplete_coverage' END AS quality_flag
  FROM parts),
span AS (SELECT min(loeuf) AS lo, max(loeuf) AS hi FROM flagged WHERE quality_flag = 'measured'),
scored AS (
  SELECT flagged.*, CASE WHEN quality_flag = 'measured' AND hi > lo THEN (hi - loeuf) / (hi - lo) END AS loeuf_normalized
  FROM flagged, span)"""


def constraint_source(spark: SparkSession, sf: str) -> DataFrame:
    """Raw constraint rows under version-specific header names, all text, as a delimited file would give them."""
    cov = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("mean_coverage"),
            F.avg((F.col("l_linestatus") == "F").cast("double")).alias("mean_proportion_covered"),
        )
    )
    parts = table(spark, sf, "part").join(cov, "p_partkey", "left")
    return parts.select(
        F.col("p_partkey").alias("gene_id"),
        F.col("p_brand").alias("gene"),
        F.when(F.col("p_size") >= 5, (F.col("p_retailprice") / 1000).cast("string")).alias("lof.oe_ci.upper"),
        F.when(F.col("p_size") >= 3, (F.col("p_size") / 50).cast("string")).alias("lof.pLI"),
        F.col("mean_coverage").cast("string").alias("mean_coverage"),
        F.col("mean_proportion_covered").cast("string").alias("mean_proportion_covered"),
    )


def flagged_parts(spark: SparkSession, sf: str) -> DataFrame:
    return C.flag_coverage(C.constraint_columns(constraint_source(spark, sf)), 30.0, 0.5)


@query("quality_flag", f"WITH {PARTS_SQL} SELECT gene_id, quality_flag FROM flagged")
def quality_flag(spark, sf):
    return flagged_parts(spark, sf).select("gene_id", "quality_flag")


@query(
    "alias_columns",
    f"""WITH {PARTS_SQL} SELECT gene_id, gene_symbol, round(pli, 6) AS pli, round(loeuf, 6) AS loeuf,
        round(loeuf, 6) AS loeuf_upper, round(mean_depth, 6) AS mean_depth FROM parts""",
)
def alias_columns(spark, sf):
    named = C.constraint_columns(constraint_source(spark, sf))
    numbers = [r6(F.col(c).try_cast("double")).alias(c) for c in ("pli", "loeuf", "loeuf_upper", "mean_depth")]
    return named.select("gene_id", "gene_symbol", *numbers)


@query(
    "inverted_minmax",
    f"WITH {PARTS_SQL} SELECT gene_id, quality_flag, round(loeuf_normalized, 6) AS loeuf_normalized FROM scored",
)
def inverted_minmax(spark, sf):
    return C.invert_minmax(flagged_parts(spark, sf)).select("gene_id", "quality_flag", r6("loeuf_normalized"))


@query(
    "constraint_summary",
    f"""WITH {PARTS_SQL} SELECT count(*) AS row_count, count(*) FILTER (quality_flag = 'measured') AS measured_count,
        count(*) FILTER (quality_flag = 'incomplete_coverage') AS incomplete_count,
        count(*) FILTER (quality_flag = 'no_data') AS no_data_count,
        count(*) FILTER (loeuf IS NULL) AS null_loeuf_count FROM flagged""",
)
def constraint_summary(spark, sf):
    return C.constraint_summary(flagged_parts(spark, sf))


@query(
    "threshold_constrained",
    f"""WITH {PARTS_SQL} SELECT gene_id, gene_symbol, round(loeuf, 6) AS loeuf, round(pli, 6) AS pli, quality_flag,
        round(loeuf_normalized, 6) AS loeuf_normalized FROM scored WHERE quality_flag = 'measured' AND loeuf < 1.2""",
)
def threshold_constrained(spark, sf):
    rows = C.constrained_entities(C.constraint_layer(constraint_source(spark, sf), None, 30.0, 0.5), 1.2)
    return rows.select("gene_id", "gene_symbol", r6("loeuf"), r6("pli"), "quality_flag", r6("loeuf_normalized"))


@query(
    "id_rescue",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'C' || o_custkey
         WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
         ELSE 'C' || c_custkey END AS gene_id
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def id_rescue(spark, sf):
    universe = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("gene_id"), F.col("c_name").alias("gene_symbol")
    )
    own = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    unnamed = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", own).otherwise(F.concat(F.lit("old-"), own)).alias("gene_id"),
        F.when(~unnamed, name).alias("gene_symbol"),
    )
    return C.rescue_ids(rows, universe, "C").select("o_orderkey", "gene_id")


@query(
    "bridge_growth",
    """WITH l AS (SELECT CASE WHEN c_nationkey > 2 THEN c_nationkey END AS k, count(*) AS n FROM customer GROUP BY ALL),
        r AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier WHERE s_nationkey < 20 GROUP BY ALL),
        j AS (SELECT l.k, n, m, n * greatest(coalesce(m, 0), 1) AS made FROM l LEFT JOIN r ON l.k = r.k)
        SELECT CAST(sum(n) AS BIGINT) AS left_rows, CAST(sum(made) AS BIGINT) AS joined_rows, count(m) AS matched_keys,
          (SELECT k FROM j WHERE m IS NOT NULL ORDER BY made DESC, k DESC LIMIT 1) AS hottest_key,
          (SELECT max(made) FROM j WHERE m IS NOT NULL) AS hottest_rows FROM j""",
)
def bridge_growth(spark, sf):
    """Rows that the many-to-many bridge from customers to the suppliers of their nation would make, before it is joined."""
    left = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("nation"))
    right = table(spark, sf, "supplier").where(F.col("s_nationkey") < 20).select(F.col("s_nationkey").alias("nation"))
    return join_growth(left, right, "nation")


@query(
    "constraint_layer",
    f"""WITH {PARTS_SQL}, named AS (SELECT *, CASE WHEN gene_id % 3 = 0 THEN 'P' || gene_id ELSE 'old-' || gene_id END AS own,
          CASE WHEN gene_id % 5 > 0 THEN 'sym' || gene_id // 2 END AS symbol FROM scored),
        known AS (SELECT 'P' || p_partkey AS id, 'sym' || p_partkey // 2 AS symbol FROM part WHERE p_partkey % 7 > 0)
        SELECT CASE WHEN own LIKE 'P%' THEN own ELSE id END AS gene_id, symbol AS gene_symbol, quality_flag,
          round(loeuf_normalized, 6) AS loeuf_normalized FROM named LEFT JOIN known USING (symbol)""",
)
def constraint_layer(spark, sf):
    """The whole layer with id rescue: ids of an old form are replaced through symbols that two, one or no ids share."""
    key = F.col("gene_id")
    raw = constraint_source(spark, sf).withColumn("gene", F.when(key % 5 > 0, F.concat(F.lit("sym"), F.floor(key / 2).cast("string"))))
    raw = raw.withColumn("gene_id", F.concat(F.when(key % 3 == 0, "P").otherwise("old-"), key.cast("string")))
    part = F.col("p_partkey")
    universe = table(spark, sf, "part").where(part % 7 > 0)
    universe = universe.select(F.concat(F.lit("P"), part.cast("string")).alias("gene_id"), F.concat(F.lit("sym"), F.floor(part / 2).cast("string")).alias("gene_symbol"))
    return C.constraint_layer(raw, universe, 30.0, 0.5, "P").select("gene_id", "gene_symbol", "quality_flag", r6("loeuf_normalized"))


# ---------------------------------------------------------------------------------------------------------------------
# annotation: customers, with order counts

CUSTOMERS_SQL = """
per AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS urgent
        FROM orders GROUP BY o_custkey),
customers AS (
  SELECT c_custkey AS gene_id, c_name AS gene_symbol, n AS go_term_count,
         CASE WHEN c_acctbal >= 0 THEN n_regionkey + 1 END AS uniprot_annotation_score,
         urgent = 1 AS has_pathway_membership
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per ON c_custkey = o_custkey),
tiered AS (
  SELECT *, CASE WHEN coalesce(go_term_count, 0) >= 20 AND coalesce(uniprot_annotation_score, 0) >= 4 THEN 'well_annotated'
                 WHEN coalesce(go_term_count, 0) >= 5 OR coalesce(uniprot_annotation_score, 0) >= 3 THEN 'partially_annotated'
                 ELSE 'poorly_annotated' END AS annotation_tier FROM customers),
top AS (SELECT max(log2(go_term_count + 1)) AS m FROM customers),
annotated AS (
  SELECT tiered.*, CASE WHEN coalesce(go_term_count, uniprot_annotation_score, CAST(has_pathway_membership AS INT)) IS NOT NULL
    THEN greatest(0e0, least(1e0, coalesce(log2(go_term_count + 1) / m * 0.5, 0) + coalesce(uniprot_annotation_score / 5e0 * 0.3, 0)
      + CASE WHEN has_pathway_membership THEN 0.2 ELSE 0 END)) END AS annotation_score_normalized
  FROM tiered, top)"""


def annotated_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts per entity, entity-to-accession mapping, and accession scores."""
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    per = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("go_term_count"), F.max(urgent).alias("has_pathway_membership"))
    )
    customer = table(spark, sf, "customer")
    counts = customer.join(per, "c_custkey", "left").select(
        F.col("c_custkey").alias("gene_id"), F.col("c_name").alias("gene_symbol"), "go_term_count", "has_pathway_membership"
    )
    mapping = customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("gene_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("uniprot_accession")
    )
    scores = table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("uniprot_accession"),
        (F.col("n_regionkey") + 1).alias("uniprot_annotation_score"),
    )
    return counts, mapping, scores


def annotated_customers(spark: SparkSession, sf: str) -> DataFrame:
    return A.annotation_layer(*annotated_sources(spark, sf))


@query("annotation_tier", f"WITH {CUSTOMERS_SQL} SELECT gene_id, annotation_tier FROM tiered")
def annotation_tier(spark, sf):
    counts, mapping, scores = annotated_sources(spark, sf)
    joined = counts.join(A.source_scores(mapping, scores), "gene_id", "left")
    return A.annotation_tier(joined).select("gene_id", "annotation_tier")


@query(
    "annotation_score",
    f"""WITH {CUSTOMERS_SQL} SELECT gene_id, annotation_tier, CAST(uniprot_annotation_score AS BIGINT) AS uniprot_annotation_score,
        round(annotation_score_normalized, 6) AS annotation_score_normalized FROM annotated""",
)
def annotation_score(spark, sf):
    return annotated_customers(spark, sf).select(
        "gene_id", "annotation_tier", F.col("uniprot_annotation_score").cast("long"), r6("annotation_score_normalized")
    )


@query(
    "accession_scores",
    """SELECT c_custkey AS gene_id, CAST(CASE WHEN c_acctbal >= 0 THEN n_regionkey + 1 END AS BIGINT) AS uniprot_annotation_score
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def accession_scores(spark, sf):
    counts, mapping, scores = annotated_sources(spark, sf)
    found = A.source_scores(mapping, scores, counts.select("gene_id"))
    return found.select("gene_id", F.col("uniprot_annotation_score").cast("long"))


@query(
    "annotation_summary",
    f"""WITH {CUSTOMERS_SQL} SELECT count(*) AS row_count,
        count(*) FILTER (annotation_tier = 'well_annotated') AS well_annotated_count,
        count(*) FILTER (annotation_tier = 'partially_annotated') AS partially_annotated_count,
        count(*) FILTER (annotation_tier = 'poorly_annotated') AS poorly_annotated_count,
        count(*) FILTER (go_term_count IS NULL) AS null_go_count,
        count(*) FILTER (uniprot_annotation_score IS NULL) AS null_uniprot_count,
        count(*) FILTER (annotation_score_normalized IS NULL) AS null_score_count,
        round(avg(annotation_score_normalized), 6) AS mean_annotation_score,
        round(quantile_cont(annotation_score_normalized, 0.5), 6) AS median_annotation_score FROM annotated""",
)
def annotation_summary(spark, sf):
    row = A.annotation_summary(cut(annotated_customers(spark, sf)))
    return row.withColumns({c: r6(c) for c in ("mean_annotation_score", "median_annotation_score")})


@query(
    "threshold_poorly_annotated",
    f"""WITH {CUSTOMERS_SQL} SELECT gene_id, gene_symbol, annotation_tier,
        round(annotation_score_normalized, 6) AS annotation_score_normalized
        FROM annotated WHERE annotation_score_normalized <= 0.5""",
)
def threshold_poorly_annotated(spark, sf):
    rows = A.poorly_annotated(annotated_customers(spark, sf), 0.5)
    return rows.select("gene_id", "gene_symbol", "annotation_tier", r6("annotation_score_normalized"))


# ---------------------------------------------------------------------------------------------------------------------
# expression: events, users by type

TYPES = ["click", "view", "purchase", "signup", "error"]
TARGET = ["purchase", "signup"]

LEVELS_SQL = """
levels AS (
  SELECT user_id, event_type, CASE WHEN value > 300 THEN NULL WHEN value > 180 THEN 3e0 WHEN value > 120 THEN 2e0
    WHEN value > 80 THEN 1e0 WHEN value > 60 THEN 0e0 END AS level FROM events)"""

WIDE_SQL = """
wide AS (SELECT user_id AS gene_id, """ + ", ".join(
    f"max(CASE WHEN event_type = '{t}' AND value > 60 THEN value END) AS {t}" for t in TYPES
) + """ FROM events GROUP BY user_id)"""


def _known_mean_sql(columns: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)
    return f"(({total}) / nullif({n}, 0))"


TAU_SQL = f"""
tops AS (SELECT *, greatest({", ".join(TYPES)}) AS top,
           {" AND ".join(f"{t} IS NOT NULL" for t in TYPES)} AS complete FROM wide),
taus AS (SELECT *, CASE WHEN complete AND top > 0 THEN ({" + ".join(f"(1 - {t} / top)" for t in TYPES)}) / 4 END AS tau_specificity
         FROM tops)"""

EXPRESSION_SQL = f"""
enriched AS (SELECT *, CASE WHEN {_known_mean_sql(TYPES)} > 0 THEN {_known_mean_sql(TARGET)} / {_known_mean_sql(TYPES)} END
               AS target_enrichment, CASE WHEN purchase IS NULL THEN signup WHEN signup IS NULL THEN purchase
               ELSE greatest(purchase, signup) END AS target_max FROM taus),
ranked AS (SELECT *, {percentile_sql("target_enrichment")} AS p1, {percentile_sql("target_max")} AS p2 FROM enriched),
expressed AS (SELECT *, CASE WHEN target_enrichment IS NOT NULL OR tau_specificity IS NOT NULL THEN
    0.4 * coalesce(p1, 0) + 0.3 * coalesce(tau_specificity, 0) + 0.3 * coalesce(p2, 0) END AS expression_score_normalized
  FROM ranked)"""


def wide_values(spark: SparkSession, sf: str) -> DataFrame:
    """Highest value per user and event type; values up to 60 count as unknown, so some users lack some types."""
    rows = table(spark, sf, "events")
    cells = [F.max(F.when((F.col("event_type") == t) & (F.col("value") > 60), F.col("value"))).alias(t) for t in TYPES]
    return rows.groupBy(F.col("user_id").alias("gene_id")).agg(*cells)


@query(
    "level_pivot",
    f"""WITH {LEVELS_SQL} SELECT user_id AS gene_id,
        {", ".join(f"max(CASE WHEN event_type = '{t}' THEN level END) AS {t}_level" for t in TYPES if t != "error")}
        FROM levels WHERE event_type <> 'error' GROUP BY user_id""",
)
def level_pivot(spark, sf):
    value = F.col("value")
    name = (
        F.when(value > 300, "Off scale").when(value > 180, "High").when(value > 120, "Medium").when(value > 80, "Low")
    ).when(value > 60, "Not detected")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("gene_id"), F.col("event_type").alias("tissue"), name.alias("level")
    )
    return X.level_pivot(rows, {t: f"{t}_level" for t in TYPES if t != "error"}, entity="gene_id")


@query(
    "versioned_wide",
    f"""WITH {WIDE_SQL} SELECT 'U' || gene_id AS gene_id, round(purchase, 6) AS bought, CAST(NULL AS DOUBLE) AS returned
        FROM wide WHERE gene_id IN (SELECT o_custkey FROM orders)""",
)
def versioned_wide(spark, sf):
    raw = wide_values(spark, sf).select(
        F.concat(F.lit("U"), F.col("gene_id").cast("string"), F.lit("."), F.pmod("gene_id", F.lit(12)).cast("string")).alias("Name"),
        F.col("purchase").cast("string").alias("Store - Purchase"),
    )
    ids = table(spark, sf, "orders").select(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("gene_id"))
    wide = X.versioned_wide(raw, {"Store - Purchase": "bought", "Store - Return": "returned"}, ids=ids)
    return wide.select("gene_id", r6("bought"), "returned")


@query("tau_specificity", f"WITH {WIDE_SQL}, {TAU_SQL} SELECT gene_id, round(tau_specificity, 6) AS tau_specificity FROM taus")
def tau_specificity(spark, sf):
    return X.tau_specificity(wide_values(spark, sf), TYPES).select("gene_id", r6("tau_specificity"))


@query(
    "expression_score",
    f"""WITH {WIDE_SQL}, {TAU_SQL}, {EXPRESSION_SQL} SELECT gene_id, round(target_enrichment, 6) AS target_enrichment,
        round(expression_score_normalized, 6) AS expression_score_normalized FROM expressed""",
)
def expression_score(spark, sf):
    scored = X.expression_score(X.tau_specificity(wide_values(spark, sf), TYPES), TARGET, TYPES)
    return scored.select("gene_id", r6("target_enrichment"), r6("expression_score_normalized"))


def expression_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The whole layer: three types come keyed by id, two keyed by symbol, and every customer is requested."""
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("gene_id"))
    symbols = ids.withColumn("gene_symbol", F.concat(F.lit("S"), F.col("gene_id").cast("string")))
    wide = wide_values(spark, sf)
    by_symbol = wide.select(F.concat(F.lit("S"), F.col("gene_id").cast("string")).alias("gene_symbol"), "signup", "error")
    return X.expression_layer(ids, wide.select("gene_id", "click", "view", "purchase"), by_symbol, symbols, TARGET, TYPES)


EXPRESSION_LAYER_SQL = f"""{WIDE_SQL.replace("wide AS", "seen AS")},
wide AS (SELECT c_custkey AS gene_id, {", ".join(TYPES)} FROM customer LEFT JOIN seen ON c_custkey = seen.gene_id),
{TAU_SQL}, {EXPRESSION_SQL}"""


@query(
    "expression_layer",
    f"""WITH {EXPRESSION_LAYER_SQL} SELECT gene_id, 'S' || gene_id AS gene_symbol, round(tau_specificity, 6) AS tau_specificity,
        round(expression_score_normalized, 6) AS expression_score_normalized FROM expressed""",
)
def expression_layer(spark, sf):
    return expression_entities(spark, sf).select(
        "gene_id", "gene_symbol", r6("tau_specificity"), r6("expression_score_normalized")
    )


@query(
    "threshold_enriched",
    f"""WITH {EXPRESSION_LAYER_SQL} SELECT gene_id, 'S' || gene_id AS gene_symbol, round(target_enrichment, 6) AS target_enrichment
        FROM expressed WHERE target_enrichment >= 1.1""",
)
def threshold_enriched(spark, sf):
    rows = X.enriched_entities(expression_entities(spark, sf), 1.1)
    return rows.select("gene_id", "gene_symbol", r6("target_enrichment"))


@query(
    "expression_summary",
    f"""WITH {EXPRESSION_LAYER_SQL} SELECT count(*) AS row_count,
        count(*) FILTER (purchase IS NOT NULL OR signup IS NOT NULL) AS near_count,
        count(*) FILTER (error IS NOT NULL) AS far_count, round(avg(tau_specificity), 6) AS mean_tau,
        round(min(expression_score_normalized), 6) AS min_score, round(max(expression_score_normalized), 6) AS max_score,
        round(avg(expression_score_normalized), 6) AS mean_score,
        round(quantile_cont(expression_score_normalized, 0.5), 6) AS median_score FROM expressed""",
)
def expression_summary(spark, sf):
    row = X.expression_summary(cut(expression_entities(spark, sf)), TARGET, ["error"])
    return row.withColumns({c: r6(c) for c in ("mean_tau", "min_score", "max_score", "mean_score", "median_score")})


@query(
    "complete_rows",
    f"""WITH {WIDE_SQL}, {TAU_SQL} SELECT complete, count(*) AS n, round(max(top), 6) AS top FROM tops GROUP BY complete""",
)
def complete_rows(spark, sf):
    rows = wide_values(spark, sf).withColumns({"complete": all_known(TYPES), "top": F.greatest(*TYPES)})
    return rows.groupBy("complete").agg(F.count(F.lit(1)).alias("n"), r6(F.max("top")).alias("top"))


# ---------------------------------------------------------------------------------------------------------------------
# localization: parts, type as reliability, name words as places

PLACES = {
    "compartment_cilia": ["ring"],
    "compartment_centrosome": ["gear", "bolt"],
    "compartment_basal_body": ["anvil"],
    "compartment_transition_zone": ["gizmo"],
    "compartment_stereocilia": ["old w"],
}
NEARBY = ["plate", "widget"]
RELIABILITY = {"ECONOMY": "Enhanced", "LARGE": "Supported", "MEDIUM": "Approved", "PROMO": "Uncertain", "STANDARD": "Other"}
FLAGS = ["in_cilia_proteomics", "in_centrosome_proteomics"]

PLACES_SQL = f"""
s1 AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 3 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')),
s2 AS (SELECT DISTINCT p_name FROM part WHERE p_size = 50 AND p_type = 'PROMO'),
base AS (
  SELECT p_partkey AS gene_id, p_name AS gene_symbol,
    CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELIABILITY.items())} END AS hpa_reliability,
    CASE WHEN p_size <= 45 THEN CASE WHEN p_size <= 20 THEN p_name || ';' || p_brand ELSE p_name END
         WHEN p_size <= 48 THEN p_brand END AS hpa_main_location,
    s1.p_name IS NOT NULL AS in_cilia_proteomics, s2.p_name IS NOT NULL AS in_centrosome_proteomics
  FROM part LEFT JOIN s1 USING (p_name) LEFT JOIN s2 USING (p_name)),
typed AS (
  SELECT *, CASE WHEN hpa_reliability IN ('Enhanced', 'Supported') THEN 'experimental'
                 WHEN hpa_reliability IN ('Approved', 'Uncertain') THEN 'computational' END AS hpa_evidence_type FROM base),
kinds AS (
  SELECT *, CASE WHEN in_cilia_proteomics OR in_centrosome_proteomics THEN
      CASE WHEN hpa_evidence_type = 'computational' THEN 'both' ELSE 'experimental' END
    ELSE coalesce(hpa_evidence_type, 'none') END AS evidence_type FROM typed),
placed AS (
  SELECT *, {", ".join(f"regexp_matches(lower(hpa_main_location), '{'|'.join(w)}') AS {c}" for c, w in PLACES.items())},
    regexp_matches(lower(hpa_main_location), '{"|".join(NEARBY)}') AS near FROM kinds),
near_scores AS (
  SELECT *, CASE WHEN {" OR ".join(PLACES)} THEN 1e0 WHEN near THEN 0.5
    WHEN (in_cilia_proteomics OR in_centrosome_proteomics) AND hpa_main_location IS NULL THEN 0.3
    WHEN in_cilia_proteomics OR in_centrosome_proteomics OR hpa_main_location IS NOT NULL THEN 0
    END AS cilia_proximity_score FROM placed),
localized AS (
  SELECT *, CASE WHEN evidence_type = 'none' THEN NULL WHEN evidence_type = 'computational' THEN cilia_proximity_score * 0.6
    ELSE cilia_proximity_score END AS localization_score_normalized FROM near_scores)"""


def localization_sources(spark: SparkSession, sf: str):
    part = table(spark, sf, "part")
    size, name = F.col("p_size"), F.col("p_name")
    level = F.when(F.lit(False), "")
    for kind, value in RELIABILITY.items():
        level = level.when(F.col("p_type") == kind, value)
    raw = part.select(
        F.col("p_partkey").alias("gene_id"),
        F.concat_ws("/", name, F.col("p_partkey").cast("string")).alias("Gene name"),
        level.alias("Reliability"),
        F.when(size <= 45, name).otherwise(F.lit("")).alias("Main location"),
        F.when((size <= 20) | size.between(46, 48), F.col("p_brand")).alias("Additional location"),
        F.lit(" ").alias("Extracellular location"),
    )
    names = part.select(F.col("p_partkey").alias("gene_id"), name.alias("gene_symbol"), "p_size", "p_brand", "p_type")
    sets = {
        FLAGS[0]: names.where((F.col("p_size") <= 3) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")),
        FLAGS[1]: names.where((F.col("p_size") == 50) & (F.col("p_type") == "PROMO")),
    }
    return raw, names.select("gene_id", "gene_symbol"), {k: v.select("gene_symbol").distinct() for k, v in sets.items()}


def localized_parts(spark: SparkSession, sf: str) -> DataFrame:
    raw, names, sets = localization_sources(spark, sf)
    located = L.location_strings(raw).withColumn("gene_id", F.split("gene_symbol", "/")[1].cast("long")).drop("gene_symbol")
    flagged = L.membership_flags(names.join(located, "gene_id"), sets)
    return L.proximity_score(L.evidence_type(flagged, FLAGS), PLACES, NEARBY, FLAGS)


@query("membership_flag", f"WITH {PLACES_SQL} SELECT gene_id, {', '.join(FLAGS)} FROM base")
def membership_flag(spark, sf):
    _, names, sets = localization_sources(spark, sf)
    return L.membership_flags(names, sets).select("gene_id", *FLAGS)


@query("location_strings", f"WITH {PLACES_SQL} SELECT gene_id, hpa_main_location FROM base")
def location_strings(spark, sf):
    raw, _, _ = localization_sources(spark, sf)
    located = L.location_strings(raw)
    return located.select(F.split("gene_symbol", "/")[1].cast("long").alias("gene_id"), "hpa_main_location")


@query("evidence_type", f"WITH {PLACES_SQL} SELECT gene_id, hpa_evidence_type, evidence_type FROM kinds")
def evidence_type(spark, sf):
    return localized_parts(spark, sf).select("gene_id", "hpa_evidence_type", "evidence_type")


@query(
    "proximity_score",
    f"""WITH {PLACES_SQL} SELECT gene_id, {", ".join(PLACES)}, CAST(cilia_proximity_score AS DOUBLE) AS cilia_proximity_score,
        round(CAST(localization_score_normalized AS DOUBLE), 6) AS localization_score_normalized FROM localized""",
)
def proximity_score(spark, sf):
    return localized_parts(spark, sf).select("gene_id", *PLACES, "cilia_proximity_score", r6("localization_score_normalized"))


SEGMENT_LEVELS = {
    "AUTOMOBILE": "Enhanced", "BUILDING": "Supported", "FURNITURE": "Approved", "HOUSEHOLD": "Uncertain", "MACHINERY": "Other",
}


@query(
    "localization_layer",
    f"""WITH base AS (
          SELECT c_custkey AS gene_id, c_nationkey % 4 AS place, c_acctbal > 5000 OR c_acctbal < 0 AS member,
            CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'experimental'
                 WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'computational' END AS kind
          FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
        typed AS (SELECT *, CASE WHEN member THEN CASE WHEN kind = 'computational' THEN 'both' ELSE 'experimental' END
            ELSE coalesce(kind, 'none') END AS evidence_type,
          CASE place WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0e0 ELSE CASE WHEN member THEN 0.3e0 END END AS near FROM base)
        SELECT gene_id, evidence_type, CAST(near AS DOUBLE) AS cilia_proximity_score,
          round(CAST(CASE evidence_type WHEN 'none' THEN NULL WHEN 'computational' THEN near * 0.6e0 ELSE near END AS DOUBLE), 6)
            AS localization_score_normalized FROM typed""",
)
def localization_layer(spark, sf):
    """The whole layer over the symbol map: customers, the market segment as reliability, the nation's number as place.

    Customers with much money and with debts are the two member sets; a quarter of all has no place.
    """
    customer = table(spark, sf, "customer")
    names = customer.select(F.col("c_custkey").alias("gene_id"), F.col("c_name").alias("gene_symbol"))
    level = F.when(F.lit(False), "")
    for segment, value in SEGMENT_LEVELS.items():
        level = level.when(F.col("c_mktsegment") == segment, value)
    number = F.col("c_nationkey") % 4
    place = F.when(number == 0, "Centriole;Cytosol").when(number == 1, "Nucleus;Microtubules").when(number == 2, "Cytosol")
    located = customer.select(
        F.col("c_name").alias("gene_symbol"), level.alias("hpa_reliability"), place.alias("hpa_main_location")
    )
    named = lambda c: customer.where(c).select(F.col("c_name").alias("gene_symbol"))
    sets = {FLAGS[0]: named(F.col("c_acctbal") > 5000), FLAGS[1]: named(F.col("c_acctbal") < 0)}
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene_id"))
    layer = L.localization_layer(names, located, sets, ids)
    return layer.select("gene_id", "evidence_type", "cilia_proximity_score", r6("localization_score_normalized"))


@query(
    "localization_summary",
    f"""WITH {PLACES_SQL} SELECT count(*) AS row_count, count(*) FILTER (evidence_type = 'experimental') AS experimental_count,
        count(*) FILTER (evidence_type = 'computational') AS computational_count,
        count(*) FILTER (evidence_type = 'both') AS both_count, count(*) FILTER (evidence_type = 'none') AS none_count,
        count(*) FILTER (compartment_cilia OR compartment_centrosome) AS cilia_compartment_count,
        count(*) FILTER (cilia_proximity_score > 0.5) AS high_proximity_count,
        round(avg(CAST(localization_score_normalized AS DOUBLE)), 6) AS mean_localization_score FROM localized""",
)
def localization_summary(spark, sf):
    row = L.localization_summary(localized_parts(spark, sf))
    return row.withColumn("mean_localization_score", r6("mean_localization_score"))


@query(
    "threshold_localized",
    f"""WITH {PLACES_SQL} SELECT gene_id, gene_symbol, evidence_type, CAST(cilia_proximity_score AS DOUBLE) AS cilia_proximity_score,
        round(CAST(localization_score_normalized AS DOUBLE), 6) AS localization_score_normalized
        FROM localized WHERE cilia_proximity_score > 0.5""",
)
def threshold_localized(spark, sf):
    rows = L.localized_entities(localized_parts(spark, sf), 0.5)
    return rows.select(
        "gene_id", "gene_symbol", "evidence_type", "cilia_proximity_score", r6("localization_score_normalized")
    )


# ---------------------------------------------------------------------------------------------------------------------
# animal models: parts and suppliers from line items

KEYWORDS = ["ring", "OLD", "gizmo"]

SUPPORT_SQL = """
support AS (SELECT l_partkey, l_suppkey, l_returnflag = 'A' AS fish, count(*) AS n FROM lineitem GROUP BY ALL),
mouse AS (SELECT l_partkey AS gene_id, l_suppkey AS mouse_ortholog,
    CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS mouse_ortholog_confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS i FROM support WHERE NOT fish) WHERE i = 1),
fish AS (SELECT l_partkey AS gene_id, l_suppkey AS zebrafish_ortholog,
    CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS zebrafish_ortholog_confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS i FROM support WHERE fish) WHERE i = 1)"""

PHENO_SQL = """
lp AS (SELECT DISTINCT l_suppkey, p_name, l_orderkey % 3 AS kind FROM lineitem JOIN part ON l_partkey = p_partkey
       WHERE regexp_matches(lower(p_name), 'ring|old|gizmo')),
mgi AS (SELECT l_suppkey, count(*) AS n, string_agg(p_name, '; ' ORDER BY p_name) AS t
        FROM (SELECT DISTINCT l_suppkey, p_name FROM lp WHERE kind = 0) GROUP BY l_suppkey),
zfin AS (SELECT l_suppkey, count(*) AS n, string_agg(p_name, '; ' ORDER BY p_name) AS t
         FROM (SELECT DISTINCT l_suppkey, p_name FROM lp WHERE kind = 1) GROUP BY l_suppkey),
impc AS (SELECT l_suppkey, count(*) AS n, string_agg(p_name, '; ' ORDER BY p_name) AS t
         FROM (SELECT DISTINCT l_suppkey, p_name FROM lp WHERE kind = 2) GROUP BY l_suppkey)"""

ANIMAL_SQL = f"""{SUPPORT_SQL}, {PHENO_SQL},
joined AS (
  SELECT p_partkey AS gene_id, mouse_ortholog, mouse_ortholog_confidence, zebrafish_ortholog, zebrafish_ortholog_confidence,
    mgi.n > 0 AS has_mouse_phenotype, zfin.n > 0 AS has_zebrafish_phenotype, impc.n > 0 AS has_impc_phenotype,
    nullif(coalesce(mgi.n, 0) + coalesce(zfin.n, 0) + coalesce(impc.n, 0), 0) AS sensory_phenotype_count,
    concat_ws('; ', mgi.t, zfin.t, impc.t) AS phenotype_categories
  FROM part LEFT JOIN mouse ON p_partkey = mouse.gene_id LEFT JOIN fish ON p_partkey = fish.gene_id
    LEFT JOIN mgi ON mouse_ortholog = mgi.l_suppkey LEFT JOIN zfin ON zebrafish_ortholog = zfin.l_suppkey
    LEFT JOIN impc ON mouse_ortholog = impc.l_suppkey),
peak AS (SELECT max(sensory_phenotype_count) AS m FROM joined),
animals AS (
  SELECT joined.*, CASE WHEN mouse_ortholog IS NOT NULL OR zebrafish_ortholog IS NOT NULL THEN least(1e0, (
      CASE WHEN has_mouse_phenotype THEN 0.4 * CASE mouse_ortholog_confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 0 END ELSE 0 END
    + CASE WHEN has_zebrafish_phenotype THEN 0.3 * CASE zebrafish_ortholog_confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 0 END ELSE 0 END
    + CASE WHEN has_impc_phenotype THEN 0.3 ELSE 0 END) * coalesce(log2(sensory_phenotype_count + 1) / log2(m + 1), 0)) END
    AS animal_model_score_normalized
  FROM joined, peak)"""


def supplied_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items per part, supplier, species and kind of phenotype, from one scan; every row has one of each."""
    rows = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_suppkey", (F.col("l_returnflag") == "A").alias("fish"), F.pmod("l_orderkey", F.lit(3)).alias("kind")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def supplier_support(rows: DataFrame, prefix: str, count: Column) -> DataFrame:
    """Best supplier per part, of rows (l_partkey, l_suppkey) whose support is the given aggregate."""
    counts = rows.groupBy(F.col("l_partkey").alias("gene_id"), "l_suppkey").agg(count.alias("support_count"))
    return O.best_support(counts, "gene_id", "l_suppkey", "support_count", prefix, high=3, medium=2)


def scanned_support(spark: SparkSession, sf: str, fish: bool, prefix: str) -> DataFrame:
    """The same from the line items themselves: counted once, the species is a filter of the scan."""
    flag = F.col("l_returnflag") == "A"
    rows = table(spark, sf, "lineitem").where(flag if fish else ~flag).select("l_partkey", "l_suppkey")
    return supplier_support(rows, prefix, F.count(F.lit(1)))


def animal_parts(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"))
    parts = cut(supplied_parts(spark, sf))
    of = lambda fish, prefix: supplier_support(parts.where(F.col("fish") == fish), prefix, F.sum("n"))
    orthologs = O.ortholog_mapping(ids, of(False, "mouse"), of(True, "zebrafish"))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = cut(parts.join(names, "l_partkey").select("l_suppkey", "p_name", "kind").distinct())

    def phenotypes(kind, entity, term):
        return named.where(F.col("kind") == kind).select(F.col("l_suppkey").alias(entity), F.col("p_name").alias(term))

    return O.animal_layer(
        orthologs,
        phenotypes(0, "mouse_gene", "mp_term_name"),
        phenotypes(1, "zebrafish_gene", "zp_term_name"),
        phenotypes(2, "mouse_gene", "mp_term_name"),
        KEYWORDS,
        KEYWORDS,
    )


@query("best_support", f"WITH {SUPPORT_SQL} SELECT * FROM mouse")
def best_support(spark, sf):
    return scanned_support(spark, sf, False, "mouse")


@query(
    "ortholog_mapping",
    f"""WITH {SUPPORT_SQL} SELECT p_partkey AS gene_id, mouse_ortholog, mouse_ortholog_confidence, zebrafish_ortholog,
        zebrafish_ortholog_confidence FROM part LEFT JOIN mouse ON p_partkey = mouse.gene_id LEFT JOIN fish ON p_partkey = fish.gene_id""",
)
def ortholog_mapping(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"))
    return O.ortholog_mapping(ids, scanned_support(spark, sf, False, "mouse"), scanned_support(spark, sf, True, "zebrafish"))


@query(
    "ortholog_support",
    """WITH s AS (SELECT l_partkey, 'S' || l_suppkey AS c, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)
       SELECT CAST(l_partkey AS VARCHAR) AS gene_id, c AS mouse_ortholog,
         CASE WHEN n >= 8 THEN 'HIGH' WHEN n >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS mouse_ortholog_confidence
       FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, c) AS i FROM s) WHERE i = 1""",
)
def ortholog_support(spark, sf):
    """Support as a comma-separated list: the line numbers under which a supplier delivered a part (seven at most)."""
    raw = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.collect_set("l_linenumber").alias("lines"))
    raw = raw.select(
        F.col("l_partkey").cast("string").alias("human_ensembl_gene"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("mouse_symbol"),
        F.array_join(F.sort_array("lines").cast("array<string>"), ",").alias("support"),
    )
    return O.ortholog_table(raw, "mouse_symbol", "mouse")


@query("fuzzy_headers", "SELECT DISTINCT p_brand AS mouse_gene, p_type AS mp_term_id, p_name AS mp_term_name FROM part")
def fuzzy_headers(spark, sf):
    """A report whose columns are found by words of their names."""
    raw = table(spark, sf, "part").select(
        F.col("p_size").alias("Rank"),
        F.col("p_brand").alias("MGI Marker Symbol (latest)"),
        F.col("p_type").alias("High-level Mammalian Phenotype ID"),
        F.col("p_name").alias("term"),
    )
    return O.marker_phenotypes(raw, "term")


@query("structure_phenotypes", "SELECT DISTINCT p_brand AS zebrafish_gene, CAST(NULL AS VARCHAR) AS zp_term_id, p_type AS zp_term_name FROM part")
def structure_phenotypes(spark, sf):
    """The affected-structure report: the last gene column and the first phenotype-like one, found by words of their names."""
    raw = table(spark, sf, "part").select(
        F.col("p_size").alias("Rank"),
        F.col("p_name").alias("Gene Name"),
        F.col("p_brand").alias("ZFIN Gene Symbol"),
        F.col("p_type").alias("Affected Structure or Process 1 superterm"),
        F.col("p_retailprice").alias("Phenotype Tag"),
    )
    return O.structure_phenotypes(raw)


@query("keyword_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'ring|old|gizmo')")
def keyword_filter(spark, sf):
    return O.keyword_filter(table(spark, sf, "part").select("p_partkey", "p_name"), KEYWORDS, "p_name")


@query(
    "term_rollup",
    """SELECT p_brand, count(*) AS part_phenotype_count, string_agg(p_name, '; ' ORDER BY p_name) AS part_terms
       FROM (SELECT DISTINCT p_brand, p_name, p_type FROM part WHERE regexp_matches(lower(p_name), 'ring|old|gizmo')) GROUP BY p_brand""",
)
def term_rollup(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_name", "p_type").distinct()
    return O.term_rollup(O.keyword_filter(rows, KEYWORDS, "p_name"), "p_brand", "p_name", "part")


@query(
    "term_pieces",
    """WITH c AS (SELECT l_suppkey, p_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
        p AS (SELECT l_suppkey, p_name, n, unnest(range(0, (n - 1) // 2 + 1)) AS part,
                dense_rank() OVER (PARTITION BY l_suppkey ORDER BY p_name) - 1 AS term FROM c)
        SELECT l_suppkey, CAST(term AS INTEGER) AS term, part, least(2, n - 2 * part) AS n,
          p_name || CASE WHEN n - 2 * part > 1 THEN '; ' || p_name ELSE '' END AS terms FROM p""",
)
def term_pieces(spark, sf):
    """Part names of every line item per supplier as coded lists, written out in pieces of two."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(names, "l_partkey")
    pieces = O.term_pieces(O.term_counts(rows, "l_suppkey", "p_name", "part"), "l_suppkey", "part", repeats=2)
    return pieces.select("l_suppkey", "piece.term", "piece.part", F.col("n").cast("long").alias("n"), "terms")


@query(
    "model_score",
    f"""WITH {ANIMAL_SQL} SELECT gene_id, mouse_ortholog, zebrafish_ortholog, sensory_phenotype_count, phenotype_categories,
        round(CAST(animal_model_score_normalized AS DOUBLE), 6) AS animal_model_score_normalized FROM animals""",
)
def model_score(spark, sf):
    return animal_parts(spark, sf).select(
        "gene_id",
        "mouse_ortholog",
        "zebrafish_ortholog",
        "sensory_phenotype_count",
        "phenotype_categories",
        r6("animal_model_score_normalized"),
    )


@query(
    "animal_summary",
    f"""WITH {ANIMAL_SQL} SELECT count(*) AS row_count, count(mouse_ortholog) AS with_mouse_count,
        count(zebrafish_ortholog) AS with_zebrafish_count, count(sensory_phenotype_count) AS with_sensory_count,
        {", ".join(f"count(*) FILTER ({s}_ortholog_confidence = '{c}') AS {s}_{c.lower()}_count"
                   for s in ("mouse", "zebrafish") for c in ("HIGH", "MEDIUM", "LOW"))},
        round(avg(sensory_phenotype_count), 6) AS mean_sensory_count FROM animals""",
)
def animal_summary(spark, sf):
    return O.animal_summary(animal_parts(spark, sf)).withColumn("mean_sensory_count", r6("mean_sensory_count"))


@query(
    "threshold_animal",
    f"""WITH {ANIMAL_SQL} SELECT gene_id, mouse_ortholog, round(CAST(animal_model_score_normalized AS DOUBLE), 6) AS animal_model_score_normalized
        FROM animals WHERE animal_model_score_normalized >= 0.3""",
)
def threshold_animal(spark, sf):
    rows = O.animal_supported(animal_parts(spark, sf), 0.3)
    return rows.select("gene_id", "mouse_ortholog", r6("animal_model_score_normalized"))
