"""JSON record sources: one pass of ``from_json`` per record, fields of uncertain shape kept as raw text first.

A field that may be an object or a list is declared as a string, which keeps its JSON text, and then parsed as an
array: Spark reads a lone object as a one-element array.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach
from evidrank.functions.rows import known_sum


def parse_records(
    df: DataFrame, json_column: str, schema: str, keep: tuple[str, ...] = (), required: str | None = None
) -> DataFrame:
    """Expand a JSON text column into the declared top-level columns.

    ``required`` drops the records without that text field. The test sits inside the generator: as a plain filter it
    would be pushed below and parse every record a second time.
    """
    record = F.from_json(F.col(json_column), schema)
    if required is not None:
        record = F.explode(F.filter(F.array(record), lambda r: r[required] != ""))
    return df.select(*keep, record.alias("_r")).select(*keep, "_r.*")


def as_list(text: Column, element: str) -> Column:
    """Array from JSON text that holds either one object or a list of them."""
    return F.from_json(text, f"array<{element}>")


def text_or_first(text: Column) -> Column:
    """A string, or the first entry when the JSON text is a list of strings."""
    first = F.get(F.from_json(text, "array<string>"), F.lit(0))
    return F.when(text.startswith("["), first).otherwise(text)


def entity_ids(records: DataFrame, json_column: str, prefix: str, field: str = "ensembl", key: str = "gene") -> DataFrame:
    """Distinct ids with the given prefix from hits whose id field is an object or a list (``gene_id``)."""
    parsed = parse_records(records, json_column, f"`{field}` string")
    entries = parsed.select(F.explode(as_list(F.col(f"`{field}`"), f"struct<`{key}`: string>")).alias("e"))
    return entries.select(F.col(f"e.`{key}`").alias("gene_id")).where(F.col("gene_id").startswith(prefix)).distinct()


def id_mapping(records: DataFrame, json_column: str) -> DataFrame:
    """``gene_id, gene_symbol, uniprot_accession`` from mapping hits; not-found hits keep their id with NULLs.

    Several hits for one id collapse to one of them, never to a mix: a hit with a symbol first, then by symbol and accession.
    """
    parsed = parse_records(
        records, json_column, "query string, symbol string, notfound boolean, uniprot struct<`Swiss-Prot`: string>"
    )
    found = ~F.coalesce(F.col("notfound"), F.lit(False))
    mapped = parsed.select(
        F.col("query").alias("gene_id"),
        F.when(found, F.col("symbol")).alias("gene_symbol"),
        F.when(found, text_or_first(F.col("uniprot.`Swiss-Prot`"))).alias("uniprot_accession"),
    )
    hit = F.struct(
        F.col("gene_symbol").isNull().alias("no_symbol"),
        "gene_symbol",
        F.col("uniprot_accession").isNull().alias("no_accession"),
        "uniprot_accession",
    )
    best = mapped.groupBy("gene_id").agg(F.min(hit).alias("hit"))
    return best.select("gene_id", "hit.gene_symbol", "hit.uniprot_accession")


def _count_or_null(text: Column) -> Column:
    return F.nullif(F.size(as_list(text, "struct<id: string>")).cast("long"), F.lit(0))


def annotation_counts(records: DataFrame, json_column: str) -> DataFrame:
    """Term counts per ontology, their NULL-aware total and the three-valued pathway flag from annotation hits."""
    parsed = parse_records(
        records, json_column, "query string, symbol string, go struct<BP: string, MF: string, CC: string>, pathway string"
    )
    filled = lambda name: ~F.coalesce(F.get_json_object("pathway", f"$.{name}"), F.lit("")).isin("", "[]", "{}")
    has_pathway = filled("kegg") | filled("reactome")
    some_pathway = F.col("pathway").isNotNull() & ~F.col("pathway").isin("", "{}", "[]")
    counts = ["go_biological_process_count", "go_molecular_function_count", "go_cellular_component_count"]
    return parsed.select(
        F.col("query").alias("gene_id"),
        F.col("symbol").alias("gene_symbol"),
        _count_or_null(F.col("go.BP")).alias(counts[0]),
        _count_or_null(F.col("go.MF")).alias(counts[1]),
        _count_or_null(F.col("go.CC")).alias(counts[2]),
        F.when(some_pathway, has_pathway).alias("has_pathway_membership"),
    ).select("gene_id", "gene_symbol", known_sum(counts).alias("go_term_count"), *counts, "has_pathway_membership")


def feature_counts(records: DataFrame, json_column: str, requested: DataFrame | None = None) -> DataFrame:
    """Length, domain names and region counts from feature records.

    ``requested`` (``uniprot_id``) brings back the ids without a record: NULL counts and an empty domain list.
    """
    parsed = parse_records(
        records,
        json_column,
        "primaryAccession string, sequence struct<length: bigint>, "
        "features array<struct<type: string, description: string>>",
        required="primaryAccession",
    )
    features = F.coalesce(F.col("features"), F.array().cast("array<struct<type: string, description: string>>"))
    of_type = lambda t: F.filter(features, lambda f: f["type"] == t)
    named = F.filter(of_type("Domain"), lambda f: f["description"] != "")
    out = parsed.select(
        F.col("primaryAccession").alias("uniprot_id"),
        F.col("sequence.length").alias("protein_length"),
        F.transform(named, lambda f: f["description"]).alias("domain_names"),
        F.size(of_type("Coiled coil")).cast("long").alias("coiled_coil_count"),
        F.size(of_type("Transmembrane")).cast("long").alias("transmembrane_count"),
    )
    if requested is None:
        return out
    full = attach(requested.select("uniprot_id").distinct(), out, "uniprot_id")
    return full.withColumn("domain_names", F.coalesce("domain_names", F.array().cast("array<string>")))


def domain_entries(records: DataFrame, json_column: str, id_column: str = "uniprot_id") -> DataFrame:
    """Non-empty domain names and ids from result arrays; records without results give empty lists."""
    parsed = parse_records(
        records,
        json_column,
        "results array<struct<metadata: struct<accession: string, name: struct<name: string>>>>",
        keep=(id_column,),
    )

    def collected(pick) -> Column:
        values = F.filter(F.transform(F.col("results"), pick), lambda x: x != "")
        return F.coalesce(values, F.array().cast("array<string>"))

    return parsed.select(
        id_column,
        collected(lambda r: r["metadata"]["name"]["name"]).alias("domain_names"),
        collected(lambda r: r["metadata"]["accession"]).alias("interpro_ids"),
    )


def phenotype_documents(records: DataFrame, json_column: str) -> DataFrame:
    """Flatten result documents to distinct ``mouse_gene, mp_term_id, mp_term_name, p_value`` rows.

    Documents without a gene or term id are dropped.
    """
    doc = "struct<marker_symbol: string, mp_term_id: string, mp_term_name: string, p_value: double>"
    parsed = parse_records(records, json_column, f"response struct<docs: array<{doc}>>")
    rows = parsed.select(F.explode("response.docs").alias("d")).select(
        F.col("d.marker_symbol").alias("mouse_gene"),
        F.col("d.mp_term_id").alias("mp_term_id"),
        F.col("d.mp_term_name").alias("mp_term_name"),
        F.col("d.p_value").alias("p_value"),
    )
    return rows.where((F.col("mouse_gene") != "") & (F.col("mp_term_id") != "")).distinct()


def union_conformed(parts: Mapping[str, DataFrame] | list[DataFrame], schema) -> DataFrame:
    """Concatenate frames after casting each to the declared schema, then drop repeated rows."""
    from evidrank.sources.schema import conform

    frames = list(parts.values()) if isinstance(parts, Mapping) else list(parts)
    out = conform(frames[0], schema)
    for part in frames[1:]:
        out = out.unionByName(conform(part, schema))
    return out.distinct()
