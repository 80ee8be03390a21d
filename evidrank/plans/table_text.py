"""Text and record operators on documents, conversations, events and customers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.functions.joins import widen
from evidrank.operators import literature as T
from evidrank.operators import protein as P
from evidrank.plans.registry import average_rank_sql, percentile_sql, query, r6, table
from evidrank.sources import records as R
from evidrank.sources.stages import StageStore, cut, resume_remaining, scratch_folder

# ---------------------------------------------------------------------------------------------------------------------
# literature: documents, grouped by source and language, or found by the words they hold

CONTEXTS = {
    "cilia": ["thble", "thing"],
    "sensory": ["ering", "nicht", "eriner"],
    "cytoskeleton": ["that the", "attion"],
    "cell_polarity": ["mente", "oning"],
}
DIRECT = ["onble", "worthless"]
SCREEN = ["hation", "aning"]
FLAG_NAMES = [*[f"{c}_context" for c in CONTEXTS], "direct_experimental", "hts_screen"]


def _word_sql(terms: list[str]) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9_])({'|'.join(terms)})([^a-z0-9_]|$)')"


DOCS_SQL = f"""
docs AS (
  SELECT *, source || '/' || lang AS entity, {", ".join(f"{_word_sql(t)} AS {c}_context" for c, t in CONTEXTS.items())},
    {_word_sql(DIRECT)} AND {_word_sql(CONTEXTS["cilia"])} AS direct_experimental, {_word_sql(SCREEN)} AS hts_screen
  FROM documents)"""

_FLAG_COUNTS = ", ".join(f"count(*) FILTER ({f}) AS {f}_count" for f in FLAG_NAMES)

COUNTS_SQL = f"{DOCS_SQL}, counts AS (SELECT entity, count(*) AS total_pubmed_count, {_FLAG_COUNTS} FROM docs GROUP BY entity)"

MENTIONS_SQL = f"""{DOCS_SQL},
symbols AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z0-9_-]+')) AS entity FROM benchmark),
words AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_-]+')) AS word FROM documents),
per AS (SELECT word, count(*) AS total_pubmed_count, {_FLAG_COUNTS} FROM words JOIN docs USING (doc_id) GROUP BY word),
counts AS (SELECT entity, coalesce(total_pubmed_count, 0) AS total_pubmed_count,
    {", ".join(f"coalesce({f}_count, 0) AS {f}_count" for f in FLAG_NAMES)}
  FROM symbols LEFT JOIN per ON entity = word WHERE entity <> '')"""

SCORED_TEXT_SQL = f"""
tiered AS (
  SELECT *, CASE WHEN direct_experimental_count >= 1 AND (cilia_context_count >= 1 OR sensory_context_count >= 1) THEN 'direct_experimental'
    WHEN hts_screen_count >= 1 AND (cilia_context_count >= 1 OR sensory_context_count >= 1) THEN 'hts_hit'
    WHEN (cilia_context_count >= 1 OR sensory_context_count >= 1) AND total_pubmed_count >= 3 THEN 'functional_mention'
    WHEN total_pubmed_count >= 1 THEN 'incidental' ELSE 'none' END AS evidence_tier FROM counts),
raws AS (
  SELECT *, CASE WHEN total_pubmed_count = 0 THEN 0e0 ELSE round((2 * cilia_context_count + 2 * sensory_context_count
      + cytoskeleton_context_count + cell_polarity_context_count)
      * CASE evidence_tier WHEN 'direct_experimental' THEN 1.0 WHEN 'functional_mention' THEN 0.6 WHEN 'hts_hit' THEN 0.3
          WHEN 'incidental' THEN 0.1 ELSE 0 END / log2(total_pubmed_count + 1), 9) END AS raw FROM tiered),
texts AS (SELECT *, {percentile_sql("raw")} AS literature_score_normalized FROM raws)"""


def text_documents(spark: SparkSession, sf: str) -> DataFrame:
    return widen(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_documents(spark, sf).withColumn("entity", F.concat_ws("/", "source", "lang"))
    return T.context_counts(docs, "entity", CONTEXTS, DIRECT, SCREEN)


def symbol_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the benchmark items is an entity symbol; documents mention it or not."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_-]+")))
    symbols = table(spark, sf, "benchmark").select(words.alias("gene_symbol")).where(F.col("gene_symbol") != "").distinct()
    return T.mention_counts(text_documents(spark, sf), symbols, CONTEXTS, DIRECT, SCREEN)


@query("context_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def context_counts(spark, sf):
    return entity_counts(spark, sf)


@query("mention_counts", f"WITH {MENTIONS_SQL} SELECT entity AS gene_symbol, * EXCLUDE (entity) FROM counts")
def mention_counts(spark, sf):
    return symbol_counts(spark, sf)


@query("literature_tier", f"WITH {MENTIONS_SQL}, {SCORED_TEXT_SQL} SELECT entity AS gene_symbol, evidence_tier FROM tiered")
def literature_tier(spark, sf):
    return T.literature_tier(symbol_counts(spark, sf)).select("gene_symbol", "evidence_tier")


@query(
    "literature_score",
    f"""WITH {COUNTS_SQL}, {SCORED_TEXT_SQL} SELECT entity, evidence_tier,
        round(literature_score_normalized, 6) AS literature_score_normalized FROM texts""",
)
def literature_score(spark, sf):
    scored = T.literature_score(T.literature_tier(cut(entity_counts(spark, sf))), digits=9)
    return scored.select("entity", "evidence_tier", r6("literature_score_normalized"))


def scored_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return T.literature_score(T.literature_tier(cut(symbol_counts(spark, sf))), digits=9)


@query(
    "literature_summary",
    f"""WITH {MENTIONS_SQL}, {SCORED_TEXT_SQL} SELECT count(*) AS row_count,
        {", ".join(f"count(*) FILTER (evidence_tier = '{t}') AS {t}_count" for t in T.TIER_ORDER)},
        count(*) FILTER (evidence_tier IN ('direct_experimental', 'functional_mention', 'hts_hit')) AS with_evidence_count,
        round(avg(literature_score_normalized), 6) AS mean_literature_score FROM texts""",
)
def literature_summary(spark, sf):
    return T.literature_summary(scored_symbols(spark, sf)).withColumn("mean_literature_score", r6("mean_literature_score"))


@query(
    "threshold_literature",
    f"""WITH {MENTIONS_SQL}, {SCORED_TEXT_SQL} SELECT entity AS gene_symbol, evidence_tier,
        round(literature_score_normalized, 6) AS literature_score_normalized FROM texts
        WHERE evidence_tier IN ('direct_experimental', 'functional_mention')""",
)
def threshold_literature(spark, sf):
    rows = scored_symbols(spark, sf).withColumn("gene_id", F.col("gene_symbol"))
    return T.supported_at_least(rows, "functional_mention").select(
        "gene_symbol", "evidence_tier", r6("literature_score_normalized")
    )


@query(
    "literature_layer",
    f"""WITH {COUNTS_SQL.replace("counts AS", "wide_counts AS")}, counts AS (SELECT * REPLACE (CASE WHEN entity LIKE '%/en' THEN 2 * total_pubmed_count + 3 ELSE total_pubmed_count END
            AS total_pubmed_count) FROM wide_counts WHERE entity IN (SELECT entity FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))), {SCORED_TEXT_SQL}
        SELECT doc_id AS gene_id, entity AS gene_symbol, evidence_tier,
        round(literature_score_normalized, 6) AS literature_score_normalized FROM docs LEFT JOIN texts USING (entity)
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def literature_layer(spark, sf):
    """The whole layer: each (source, language) is scored once and fans out to its labelled documents.

    Some counts stand for an earlier partial run, which saw more documents: they are kept, and only the other symbols
    are taken from the new one.
    """
    docs = table(spark, sf, "documents")
    names = docs.select(F.col("doc_id").alias("gene_id"), F.concat_ws("/", "source", "lang").alias("gene_symbol"))
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("gene_id"))
    counts = cut(entity_counts(spark, sf).withColumnRenamed("entity", "gene_symbol"))
    done = counts.where(F.col("gene_symbol").endswith("/en"))
    done = done.withColumn("total_pubmed_count", 2 * F.col("total_pubmed_count") + 3)
    layer = T.literature_layer(names, counts, ids, done, digits=9)
    return layer.select("gene_id", "gene_symbol", "evidence_tier", r6("literature_score_normalized"))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return resume_remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


# ---------------------------------------------------------------------------------------------------------------------
# protein features: words of a document and of the conversation with the same number

GROUPS = {
    "has_cilia_domain": ["thble", "nicht"],
    "scaffold_adaptor_domain": ["TION", "queque"],
    "has_sensory_domain": ["license", "worthless"],
}

PROTEINS_SQL = f"""
feat AS (
  SELECT doc_id AS uniprot_id, CASE WHEN lang <> 'de' THEN n_chars END AS protein_length,
    list_distinct(string_split(text, ' ')) AS names,
    CASE WHEN lang <> 'es' THEN len(list_filter(string_split(text, ' '), lambda w: w LIKE 'co%')) END AS coiled_coil_count,
    len(list_filter(string_split(text, ' '), lambda w: w LIKE 'er%')) AS transmembrane_count FROM documents),
dom AS (SELECT conv_id AS uniprot_id, list_distinct(flatten(list(string_split(text, ' ')))) AS other FROM conversations
        GROUP BY conv_id),
merged AS (
  SELECT feat.*, CASE WHEN len(other) > 0 THEN list_distinct(list_concat(names, other)) ELSE names END AS domain_names,
    coiled_coil_count > 0 AS coiled_coil FROM feat LEFT JOIN dom USING (uniprot_id)),
motifs AS (
  SELECT *, len(domain_names) AS domain_count, {", ".join(
      f"len(list_filter(domain_names, lambda w: regexp_matches(lower(w), '{'|'.join(w.lower() for w in words)}'))) > 0 AS {g}"
      for g, words in GROUPS.items())} FROM merged),
known AS (SELECT uniprot_id, {average_rank_sql("protein_length")} AS r1, {average_rank_sql("domain_count")} AS r2
          FROM motifs WHERE protein_length IS NOT NULL),
proteins AS (
  SELECT motifs.*, 0.15 * r1 / (SELECT max(r1) FROM known) + 0.20 * r2 / (SELECT max(r2) FROM known)
    + CASE WHEN coiled_coil THEN 0.20 ELSE 0 END + 0.20 * least(transmembrane_count, 20) / 20.0
    + CASE WHEN has_cilia_domain THEN 0.15 ELSE 0 END + CASE WHEN scaffold_adaptor_domain THEN 0.10 ELSE 0 END
    AS protein_score_normalized FROM motifs LEFT JOIN known USING (uniprot_id))"""


def protein_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    words = F.split("text", " ")
    starting = lambda p: F.size(F.filter(words, lambda w: w.startswith(p))).cast("long")
    features = text_documents(spark, sf).select(
        F.col("doc_id").alias("uniprot_id"),
        F.when(F.col("lang") != "de", F.col("n_chars")).alias("protein_length"),
        F.array_distinct(words).alias("domain_names"),
        F.when(F.col("lang") != "es", starting("co")).alias("coiled_coil_count"),
        starting("er").alias("transmembrane_count"),
    )
    domains = (
        table(spark, sf, "conversations")
        .select(F.col("conv_id").alias("uniprot_id"), F.explode(F.array_distinct(words)).alias("word"))
        .groupBy("uniprot_id")
        .agg(F.collect_set("word").alias("domain_names"))  # words of one conversation, each once
    )
    return features, domains


def scored_proteins(spark: SparkSession, sf: str) -> DataFrame:
    flagged = P.motif_flags(P.merge_features(*protein_sources(spark, sf)), GROUPS)
    return P.protein_score(cut(flagged.drop("domain_names")))


@query(
    "array_merge_motifs",
    f"WITH {PROTEINS_SQL} SELECT uniprot_id, domain_count, coiled_coil, {', '.join(GROUPS)} FROM motifs",
)
def array_merge_motifs(spark, sf):
    merged = P.motif_flags(P.merge_features(*protein_sources(spark, sf)), GROUPS)
    return merged.select("uniprot_id", "domain_count", "coiled_coil", *GROUPS)


@query(
    "feature_score",
    f"""WITH {PROTEINS_SQL} SELECT uniprot_id, round(CAST(protein_score_normalized AS DOUBLE), 6) AS protein_score_normalized
        FROM proteins""",
)
def feature_score(spark, sf):
    return scored_proteins(spark, sf).select("uniprot_id", r6("protein_score_normalized"))


@query(
    "protein_layer",
    f"""WITH {PROTEINS_SQL.replace("FROM documents),", "FROM documents WHERE doc_id IN (SELECT c_custkey FROM customer)),", 1)}
        SELECT c_custkey AS gene_id, c_name AS gene_symbol, c_custkey AS uniprot_id, protein_length, domain_count,
          round(CAST(protein_score_normalized AS DOUBLE), 6) AS protein_score_normalized
        FROM customer LEFT JOIN proteins ON c_custkey = proteins.uniprot_id""",
)
def protein_layer(spark, sf):
    """The whole layer: customers are the requested entities, and some have no record."""
    customer = table(spark, sf, "customer")
    names = customer.select(
        F.col("c_custkey").alias("gene_id"), F.col("c_name").alias("gene_symbol"), F.col("c_custkey").alias("uniprot_id")
    )
    features, domains = protein_sources(spark, sf)
    layer = P.protein_layer(names, features, domains, GROUPS, names)
    return layer.select(
        "gene_id", "gene_symbol", "uniprot_id", "protein_length", "domain_count", r6("protein_score_normalized")
    )


@query(
    "protein_summary",
    f"""WITH {PROTEINS_SQL} SELECT count(*) AS row_count, count(uniprot_id) AS with_uniprot_count,
        count(*) FILTER (uniprot_id IS NULL) AS null_uniprot_count,
        count(*) FILTER (has_cilia_domain) AS cilia_domain_count, count(*) FILTER (scaffold_adaptor_domain) AS scaffold_domain_count,
        count(*) FILTER (coiled_coil) AS coiled_coil_count, count(*) FILTER (transmembrane_count > 0) AS tm_domain_count,
        round(avg(domain_count), 2) AS mean_domain_count FROM proteins""",
)
def protein_summary(spark, sf):
    return P.protein_summary(scored_proteins(spark, sf))


@query(
    "threshold_motif",
    f"""WITH {PROTEINS_SQL} SELECT uniprot_id, coiled_coil, has_cilia_domain, scaffold_adaptor_domain,
        round(CAST(protein_score_normalized AS DOUBLE), 6) AS protein_score_normalized FROM proteins
        WHERE has_cilia_domain OR (coiled_coil AND scaffold_adaptor_domain)""",
)
def threshold_motif(spark, sf):
    rows = scored_proteins(spark, sf).withColumn("gene_id", F.col("uniprot_id"))
    return P.motif_candidates(rows).select(
        "uniprot_id", "coiled_coil", "has_cilia_domain", "scaffold_adaptor_domain", r6("protein_score_normalized")
    )


# ---------------------------------------------------------------------------------------------------------------------
# JSON records, written from the tables in the shapes the sources use


def _either(items, one):
    """JSON text of an array, or of its only element when it has just one."""
    return F.when(F.size(items) == 1, F.to_json(one)).otherwise(F.to_json(items))


def _object(**fields) -> F.Column:
    """JSON object text from ready-made JSON values; NULL values leave their field out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _terms(prefix: str):
    words = F.filter(F.split("text", " "), lambda w: w.startswith(prefix))
    items = F.transform(words, lambda w: F.struct(w.alias("id")))
    return F.when(F.size(items) > 0, _either(items, items[0]))


@query(
    "json_counts",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total
       FROM events GROUP BY event_type""",
)
def json_counts(spark, sf):
    parsed = R.parse_records(table(spark, sf, "events"), "props", "k bigint", keep=("event_type",))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_total"))


@query(
    "annotation_records",
    """WITH w AS (SELECT *, string_split(text, ' ') AS ws FROM documents),
       c AS (SELECT doc_id, source, lang, nullif(len(list_filter(ws, lambda x: x LIKE 'wi%')), 0) AS bp,
               nullif(len(list_filter(ws, lambda x: x LIKE 'co%')), 0) AS mf, nullif(len(list_filter(ws, lambda x: x LIKE 'qu%')), 0) AS cc FROM w)
       SELECT CAST(doc_id AS VARCHAR) AS gene_id, source AS gene_symbol, bp AS go_biological_process_count,
         mf AS go_molecular_function_count, cc AS go_cellular_component_count,
         CASE WHEN coalesce(bp, mf, cc) IS NOT NULL THEN coalesce(bp, 0) + coalesce(mf, 0) + coalesce(cc, 0) END AS go_term_count,
         CASE lang WHEN 'en' THEN TRUE WHEN 'de' THEN FALSE END AS has_pathway_membership FROM c""",
)
def annotation_records(spark, sf):
    """One hit per document: term lists may be absent, an object or a list; the pathway may be absent or empty."""
    pathway = F.when(F.col("lang") == "en", '{"kegg":[{"id":"a"}]}').when(F.col("lang") == "de", '{"kegg":[],"reactome":[]}')
    hits = text_documents(spark, sf).select(
        _object(
            query=_quoted(F.col("doc_id").cast("string")),
            symbol=_quoted(F.col("source")),
            go=_object(BP=_terms("wi"), MF=_terms("co"), CC=_terms("qu")),
            pathway=pathway,
        ).alias("hit")
    )
    return R.annotation_counts(hits, "hit")


@query(
    "feature_records",
    """WITH w AS (SELECT *, string_split(text, ' ') AS ws FROM documents WHERE lang <> 'fr')
       SELECT CAST(d.doc_id AS VARCHAR) AS uniprot_id, w.n_chars AS protein_length,
         array_to_string(coalesce(list_filter(ws, lambda x: x LIKE 'wi%'), []), '|') AS domain_names,
         len(list_filter(ws, lambda x: x LIKE 'co%')) AS coiled_coil_count,
         len(list_filter(ws, lambda x: x LIKE 'er%')) AS transmembrane_count
       FROM documents d LEFT JOIN w USING (doc_id)""",
)
def feature_records(spark, sf):
    """One record per document that is not French; the French ids are requested too and come back empty."""
    docs = table(spark, sf, "documents")
    spread = text_documents(spark, sf).where(F.col("lang") != "fr")
    kind = lambda w: (
        F.when(w.startswith("wi"), "Domain").when(w.startswith("co"), "Coiled coil").when(w.startswith("er"), "Transmembrane")
    )
    features = F.transform(F.split("text", " "), lambda w: F.struct(kind(w).alias("type"), w.alias("description")))
    record = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("primaryAccession"),
            F.struct(F.col("n_chars").alias("length")).alias("sequence"),
            features.alias("features"),
        )
    )
    requested = docs.select(F.col("doc_id").cast("string").alias("uniprot_id"))
    counts = R.feature_counts(spread.select(record.alias("record")), "record", requested)
    return counts.withColumn("domain_names", F.array_join("domain_names", "|"))


@query(
    "domain_records",
    """WITH w AS (SELECT *, string_split(text, ' ') AS ws FROM conversations)
       SELECT conv_id || '-' || turn AS uniprot_id, array_to_string(list_filter(ws, lambda x: x <> ''), '|') AS domain_names,
         len(ws) AS entries FROM w""",
)
def domain_records(spark, sf):
    entry = lambda w: F.struct(
        F.struct(F.concat(F.lit("I"), w).alias("accession"), F.struct(w.alias("name")).alias("name")).alias("metadata")
    )
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uniprot_id"),
        F.to_json(F.struct(F.transform(F.split("text", " "), entry).alias("results"))).alias("body"),
    )
    out = R.domain_entries(rows, "body")
    return out.select(
        "uniprot_id", F.array_join("domain_names", "|").alias("domain_names"), F.size("interpro_ids").cast("long").alias("entries")
    )


@query(
    "phenotype_records",
    """WITH w AS (SELECT DISTINCT source, unnest(string_split(text, ' ')) AS x, n_chars / 1e6 AS p FROM documents)
       SELECT source AS mouse_gene, count(*) AS n, round(sum(p), 6) AS p_sum FROM w WHERE x LIKE 'wi%' GROUP BY source""",
)
def phenotype_records(spark, sf):
    """One response per document with a result per word; only words with the prefix get a term id."""
    doc = lambda w: F.struct(
        F.col("source").alias("marker_symbol"),
        F.when(w.startswith("wi"), w).alias("mp_term_id"),
        w.alias("mp_term_name"),
        (F.col("n_chars") / F.lit(1e6)).alias("p_value"),
    )
    body = F.to_json(F.struct(F.struct(F.transform(F.split("text", " "), doc).alias("docs")).alias("response")))
    rows = R.phenotype_documents(text_documents(spark, sf).select(body.alias("body")), "body")
    return rows.groupBy("mouse_gene").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("p_value")).alias("p_sum"))


def _customer_hits(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    gene = lambda p: F.concat(F.lit(f'{{"gene":"{p}'), key, F.lit('"}'))
    ensembl = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("["), gene("ENSG"), F.lit(","), gene("LRG"), F.lit("]")))
        .when(F.col("c_mktsegment") != "BUILDING", gene("ENSG"))
    )
    swiss = F.when(F.col("c_nationkey") < 10, _quoted(F.concat(F.lit("P"), key))).when(
        F.col("c_nationkey") < 20, F.concat(F.lit('["Q'), key, F.lit('","Q0"]'))
    )
    return table(spark, sf, "customer").select(
        _object(
            query=_quoted(key),
            ensembl=ensembl,
            symbol=F.when(F.col("c_acctbal") >= 0, _quoted(F.col("c_name"))),
            notfound=F.when(F.col("c_mktsegment") == "BUILDING", F.lit("true")),
            uniprot=F.when(swiss.isNotNull(), F.concat(F.lit('{"Swiss-Prot":'), swiss, F.lit("}"))),
        ).alias("hit")
    )


@query("entity_ids", "SELECT 'ENSG' || c_custkey AS gene_id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def entity_ids(spark, sf):
    return R.entity_ids(_customer_hits(spark, sf), "hit", "ENSG")


MAPPING_SQL = """
mapped AS (SELECT CAST(c_custkey AS VARCHAR) AS gene_id,
    CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 THEN c_name END AS gene_symbol,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE WHEN c_nationkey < 10 THEN 'P' || c_custkey
      WHEN c_nationkey < 20 THEN 'Q' || c_custkey END END AS uniprot_accession FROM customer)"""


@query("id_mapping", f"WITH {MAPPING_SQL} SELECT * FROM mapped")
def id_mapping(spark, sf):
    return R.id_mapping(_customer_hits(spark, sf), "hit")


@query("resumed_build", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def resumed_build(spark, sf):
    """Counts per entity built in committed batches by a worker that is lost in the third; a second run builds only the rest."""
    docs = cut(text_documents(spark, sf).withColumn("entity", F.concat_ws("/", "source", "lang")))
    root, lost = f"{scratch_folder(spark)}/evidrank-stages/{uuid.uuid4().hex}", []

    def work(keys: DataFrame) -> DataFrame:
        lost.append(len(lost))
        if len(lost) == 3:
            raise ConnectionError("worker lost")
        return T.context_counts(docs.join(keys, "entity", "left_semi"), "entity", CONTEXTS, DIRECT, SCREEN)

    keys = docs.select("entity").distinct()
    try:
        StageStore(spark, root).build_in_batches(keys, "entity", work, "entity_counts", batches=6)
    except ConnectionError:
        pass
    return StageStore(spark, root).build_in_batches(keys, "entity", work, "entity_counts", batches=6)
