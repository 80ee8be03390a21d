"""Layer scorers against hand-computed values."""

import math

import pytest
from helpers import by_key, one, rows
from pyspark.sql import functions as F

from evidrank.operators import annotation as A
from evidrank.operators import constraint as C
from evidrank.operators import expression as X
from evidrank.operators import literature as T
from evidrank.operators import localization as L
from evidrank.operators import orthology as O
from evidrank.operators import protein as P
from evidrank.plans import presets

CONSTRAINT = "gene_id string, loeuf string, pli string, mean_depth string, cds_covered_pct string"


def constraint(spark):
    return spark.createDataFrame(
        [
            ("g1", "0.0", "1.0", "45", "0.98"),
            ("g2", "1.0", "0.5", "30", "0.90"),
            ("g3", "2.0", "0.1", "60", "0.95"),
            ("g4", "0.2", "0.9", "29.9", "0.99"),
            ("g5", "0.3", "0.9", "50", "0.89"),
            ("g6", None, None, "50", "0.99"),
            ("g7", None, "0.7", "50", "0.99"),
            ("g8", "0.4", None, None, None),
            ("g9", "bad", None, "50", "0.99"),
        ],
        CONSTRAINT,
    )


def test_coverage_flag(spark):
    flags = by_key(C.flag_coverage(constraint(spark)), "gene_id", "quality_flag")
    assert [flags[f"g{i}"] for i in range(1, 10)] == ["measured"] * 3 + ["incomplete_coverage"] * 2 + [
        "no_data",
        "incomplete_coverage",
        "incomplete_coverage",
        "no_data",
    ]


def test_flag_without_coverage_columns(spark):
    flags = by_key(C.flag_coverage(constraint(spark).drop("mean_depth", "cds_covered_pct")), "gene_id", "quality_flag")
    assert flags["g4"] == flags["g8"] == "measured" and flags["g7"] == "incomplete_coverage" and flags["g6"] == "no_data"


def test_inverted_score(spark):
    scores = by_key(C.invert_minmax(C.flag_coverage(constraint(spark))), "gene_id", "loeuf_normalized")
    assert (scores["g1"], scores["g2"], scores["g3"]) == (1.0, 0.5, 0.0)
    assert all(scores[f"g{i}"] is None for i in range(4, 10))


def test_no_spread_gives_no_score(spark):
    df = constraint(spark).where("gene_id = 'g1'")
    assert C.invert_minmax(C.flag_coverage(df)).first()["loeuf_normalized"] is None


def test_constrained_query_and_summary(spark):
    layer = C.constraint_layer(constraint(spark).withColumn("gene_symbol", F.col("gene_id")))
    assert [r["gene_id"] for r in C.constrained_entities(layer, 1.5).collect()] == ["g1", "g2"]
    assert one(C.constraint_summary(layer)) == {
        "row_count": 9,
        "measured_count": 3,
        "incomplete_count": 4,
        "no_data_count": 2,
        "null_loeuf_count": 3,
    }


def test_id_rescue(spark):
    universe = spark.createDataFrame([("ENSG1", "A"), ("ENSG2", "B"), ("ENSG3", "B")], "gene_id string, gene_symbol string")
    df = spark.createDataFrame([("ENSG9", "A"), ("7", "B"), ("8", "C"), (None, None)], "gene_id string, gene_symbol string")
    assert rows(C.rescue_ids(df, universe), "gene_id", "gene_symbol") == [
        (None, None),
        (None, "C"),
        ("ENSG2", "B"),
        ("ENSG3", "B"),
        ("ENSG9", "A"),
    ]
    assert rows(C.rescue_ids(df.drop("gene_id"), universe), "gene_id", "gene_symbol")[2] == ("ENSG1", "A")


ANNOTATION = "gene_id string, go_term_count long, uniprot_annotation_score long, has_pathway_membership boolean"


def test_annotation_tier_and_score(spark):
    df = spark.createDataFrame(
        [
            ("a", 31, 5, True),
            ("b", 20, 3, False),
            ("c", 4, 3, None),
            ("d", None, None, None),
            ("e", None, 4, None),
            ("f", 0, None, False),
            ("g", 5, None, None),
        ],
        ANNOTATION,
    )
    out = A.annotation_score(A.annotation_tier(df))
    tiers, scores = by_key(out, "gene_id", "annotation_tier"), by_key(out, "gene_id", "annotation_score_normalized")
    assert tiers == {
        "a": "well_annotated",
        "b": "partially_annotated",
        "c": "partially_annotated",
        "d": "poorly_annotated",
        "e": "partially_annotated",
        "f": "poorly_annotated",
        "g": "partially_annotated",
    }
    assert scores["a"] == pytest.approx(1.0)
    assert scores["b"] == pytest.approx(0.5 * math.log2(21) / 5 + 0.18)
    assert scores["d"] is None and scores["f"] == 0.0
    assert scores["e"] == pytest.approx(0.24)
    assert one(A.annotation_summary(out))["null_score_count"] == 1


def test_annotation_without_counts(spark):
    df = spark.createDataFrame([("a", None, 5, None), ("b", 0, None, None)], ANNOTATION)
    scores = by_key(A.annotation_score(df), "gene_id", "annotation_score_normalized")
    assert scores == {"a": pytest.approx(0.3), "b": None}


def test_highest_source_score_wins(spark):
    mapping = spark.createDataFrame([("a", "P1"), ("a", "P2"), ("b", "P9"), ("z", "P1")], "gene_id string, uniprot_accession string")
    scores = spark.createDataFrame([("P1", 2), ("P2", 4)], "uniprot_accession string, uniprot_annotation_score long")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "gene_id string")
    assert rows(A.source_scores(mapping, scores, ids)) == [("a", 4), ("b", None), ("c", None)]


def test_tau(spark):
    df = spark.createDataFrame(
        [("flat", 5.0, 5.0, 5.0), ("single", 10.0, 0.0, 0.0), ("gap", 10.0, None, 0.0), ("zero", 0.0, 0.0, 0.0), ("mid", 4.0, 2.0, 0.0)],
        "gene_id string, a double, b double, c double",
    )
    tau = by_key(X.tau_specificity(df, ["a", "b", "c", "absent"]), "gene_id", "tau_specificity")
    assert tau == {"flat": 0.0, "single": 1.0, "gap": None, "zero": None, "mid": pytest.approx(0.75)}
    assert X.tau_specificity(df, ["a"]).first()["tau_specificity"] is None


def test_expression_score(spark):
    df = spark.createDataFrame(
        [("p", 8.0, 0.0, 1.0), ("q", 2.0, 2.0, 0.0), ("r", None, 4.0, None), ("s", None, None, None)],
        "gene_id string, a double, b double, tau_specificity double",
    )
    out = X.expression_score(df, ["a"], ["a", "b"])
    assert by_key(out, "gene_id", "target_enrichment") == {"p": 2.0, "q": 1.0, "r": None, "s": None}
    scores = by_key(out, "gene_id", "expression_score_normalized")
    assert scores["p"] == pytest.approx(1.0) and scores["q"] == pytest.approx(0.4 * 0.5 + 0.3 * 0.5)
    assert scores["r"] is None and scores["s"] is None
    assert X.expression_score(df, ["none"], ["a"]).first()["expression_score_normalized"] is None
    named = out.withColumn("gene_symbol", F.col("gene_id"))
    assert [r["gene_id"] for r in X.enriched_entities(named, 1.0).collect()] == ["p", "q"]


def test_level_pivot_and_versioned_source(spark):
    long = spark.createDataFrame(
        [("A", "eye", "Low"), ("A", "eye", "High"), ("A", "ear", "odd"), ("B", "eye", "Not detected"), ("B", "leg", "High")],
        "gene_symbol string, tissue string, level string",
    )
    assert rows(X.level_pivot(long, {"eye": "eye_l", "ear": "ear_l"})) == [("A", 3.0, None), ("B", 0.0, None)]
    wide = spark.createDataFrame([("E1.12", "1.5"), ("E2", "x")], "Name string, `Eye - Retina` string")
    ids = spark.createDataFrame([("E1",)], "gene_id string")
    out = X.versioned_wide(wide, {"Eye - Retina": "eye", "Testis": "testis"}, ids=ids)
    assert rows(out) == [("E1", 1.5, None)]


def test_expression_layer_bridges_symbols(spark):
    ids = spark.createDataFrame([("E1",), ("E2",), ("E3",)], "gene_id string")
    by_id = spark.createDataFrame([("E1", 4.0)], "gene_id string, a double")
    by_symbol = spark.createDataFrame([("S1", 2.0), ("S9", 1.0)], "gene_symbol string, b double")
    names = spark.createDataFrame([("E1", "S1"), ("E2", "S2")], "gene_id string, gene_symbol string")
    out = X.expression_layer(ids, by_id, by_symbol, names, ["a"], ["a", "b", "c"])
    assert rows(out, "gene_id", "gene_symbol", "a", "b", "c") == [
        ("E1", "S1", 4.0, 2.0, None),
        ("E2", "S2", None, None, None),
        ("E3", None, None, None, None),
    ]
    assert by_key(out, "gene_id", "tau_specificity")["E1"] == pytest.approx(0.5)


PLACE = "gene_id string, hpa_main_location string, hpa_reliability string, in_cilia_proteomics boolean, in_centrosome_proteomics boolean"


def test_localization(spark):
    df = spark.createDataFrame(
        [
            ("a", "Cilium", "Enhanced", False, False),
            ("b", "Centrosome;Cytosol", "Uncertain", False, False),
            ("c", "Cytoskeleton", "Approved", True, False),
            ("d", None, None, False, True),
            ("e", "Cytosol", "Supported", False, False),
            ("f", "Cytosol", None, True, False),
            ("g", None, None, False, False),
            ("h", "Nucleus", "Other", False, False),
            ("i", None, "Supported", False, False),
        ],
        PLACE,
    )
    out = L.proximity_score(L.evidence_type(df))
    kinds, near, score = (by_key(out, "gene_id", c) for c in ("evidence_type", "cilia_proximity_score", "localization_score_normalized"))
    assert [kinds[k] for k in "abcdefghi"] == [
        "experimental",
        "computational",
        "both",
        "experimental",
        "experimental",
        "experimental",
        "none",
        "none",
        "experimental",
    ]
    assert [near[k] for k in "abcdefghi"] == [1.0, 1.0, 0.5, 0.3, 0.0, 0.0, None, 0.0, None]
    assert [score[k] for k in "abcdefghi"] == [1.0, 0.6, 0.5, 0.3, 0.0, 0.0, None, None, None]
    assert out.where("gene_id = 'd'").first()["compartment_cilia"] is None


def test_location_string_and_membership(spark):
    raw = spark.createDataFrame(
        [("A", "Enhanced", "Cilia", "", "Secreted"), ("B", None, "", None, "")],
        "`Gene name` string, Reliability string, `Main location` string, `Additional location` string, `Extracellular location` string",
    )
    assert rows(L.location_strings(raw)) == [("A", "Enhanced", "Cilia;Secreted"), ("B", None, None)]
    names = spark.createDataFrame([("BBS1",), ("PCNT",), ("CEP152",), ("X",), (None,)], "gene_symbol string")
    sets = {k: spark.createDataFrame([(s,) for s in v], "gene_symbol string") for k, v in presets.PROTEOMICS_SETS.items()}
    out = L.membership_flags(names, sets)
    assert rows(out, "gene_symbol", *presets.PROTEOMICS_SETS) == [
        (None, False, False),
        ("BBS1", True, False),
        ("CEP152", True, True),
        ("PCNT", False, True),
        ("X", False, False),
    ]


def test_orthologs(spark):
    raw = spark.createDataFrame(
        [
            ("E1", "m1", "a,b,c,d,e,f,g,h"),
            ("E1", "m2", "a,b"),
            ("E2", "m4", "a,b,c,d"),
            ("E2", "m3", "a,b,c,e"),
            ("E3", "m5", "a"),
            ("E9", "m9", "a"),
        ],
        "human_ensembl_gene string, mouse_symbol string, support string",
    )
    ids = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E4",)], "gene_id string")
    mouse = O.ortholog_table(raw, "mouse_symbol", "mouse", ids)
    fish = O.ortholog_table(raw, "zebrafish_symbol", "zebrafish", ids)
    assert rows(O.ortholog_mapping(ids, mouse, fish)) == [
        ("E1", "m1", "HIGH", None, None),
        ("E2", "m3", "MEDIUM", None, None),
        ("E3", "m5", "LOW", None, None),
        ("E4", None, None, None, None),
    ]


def test_keyword_filter_and_rollup(spark):
    df = spark.createDataFrame(
        [("m", "1", "Hearing loss"), ("m", "2", "deaf"), ("m", "3", "deaf"), ("m", "4", None), ("k", "5", "fat")],
        "gene string, id string, term string",
    )
    hits = O.keyword_filter(df, presets.MOUSE_KEYWORDS, "term")
    assert hits.count() == 3
    assert rows(O.term_rollup(hits, "gene", "term", "x")) == [("m", 3, "Hearing loss; deaf; deaf")]
    assert O.keyword_filter(df, ["a"], "absent").count() == 0


def test_animal_layer(spark):
    orthologs = spark.createDataFrame(
        [("E1", "m1", "HIGH", "z1", "LOW"), ("E2", "m2", "MEDIUM", None, None), ("E3", None, None, None, None), ("E4", "m4", "HIGH", None, None)],
        "gene_id string, mouse_ortholog string, mouse_ortholog_confidence string, zebrafish_ortholog string, zebrafish_ortholog_confidence string",
    )
    term = lambda c, e: spark.createDataFrame(c, f"{e} string, term string")
    mouse = term([("m1", "deaf"), ("m1", "blind"), ("m2", "cilia loss")], "mouse_gene").withColumnRenamed("term", "mp_term_name")
    fish = term([("z1", "small eye")], "zebrafish_gene").withColumnRenamed("term", "zp_term_name")
    impc = spark.createDataFrame([("m1", "deaf", 0.2)], "mouse_gene string, mp_term_name string, p_value double")
    args = (orthologs, mouse, fish, impc, presets.MOUSE_KEYWORDS, presets.FISH_KEYWORDS)
    out = O.animal_layer(*args)
    score = by_key(out, "gene_id", "animal_model_score_normalized")
    assert score["E1"] == pytest.approx(0.4 + 0.3 * 0.4 + 0.3)
    assert score["E2"] == pytest.approx(0.4 * 0.7 * math.log2(2) / math.log2(5))
    assert score["E3"] is None and score["E4"] == 0.0
    assert by_key(out, "gene_id", "phenotype_categories")["E1"] == "blind; deaf; small eye; deaf"
    assert by_key(out, "gene_id", "sensory_phenotype_count") == {"E1": 4, "E2": 1, "E3": None, "E4": None}
    strict = by_key(O.animal_layer(*args, max_p_value=0.05), "gene_id", "has_impc_phenotype")
    assert strict["E1"] is None


COUNTS = (
    "gene_symbol string, total_pubmed_count long, cilia_context_count long, sensory_context_count long, "
    "cytoskeleton_context_count long, cell_polarity_context_count long, direct_experimental_count long, hts_screen_count long"
)


def test_literature_tiers_and_score(spark):
    df = spark.createDataFrame(
        [
            ("direct", 100, 10, 5, 8, 3, 5, 0),
            ("screen", 50, 5, 3, 4, 2, 0, 3),
            ("mention", 30, 4, 0, 0, 0, 0, 0),
            ("few", 2, 1, 0, 0, 0, 0, 0),
            ("incidental", 40, 0, 0, 1, 0, 3, 2),
            ("none", 0, 0, 0, 0, 0, 0, 0),
            ("failed", None, None, None, None, None, None, None),
            ("famous", 100000, 5, 5, 0, 0, 1, 0),
            ("focused", 10, 5, 5, 0, 0, 1, 0),
        ],
        COUNTS,
    )
    out = T.literature_score(T.literature_tier(df))
    assert by_key(out, "gene_symbol", "evidence_tier") == {
        "direct": "direct_experimental",
        "screen": "hts_hit",
        "mention": "functional_mention",
        "few": "incidental",
        "incidental": "incidental",
        "none": "none",
        "failed": "none",
        "famous": "direct_experimental",
        "focused": "direct_experimental",
    }
    score = by_key(out, "gene_symbol", "literature_score_normalized")
    assert score["failed"] is None and score["none"] == pytest.approx(1 / 8)
    assert score["focused"] > score["famous"] and max(v for v in score.values() if v is not None) == 1.0
    ids = out.withColumn("gene_id", F.col("gene_symbol"))
    assert {r["gene_id"] for r in T.supported_at_least(ids, "hts_hit").collect()} == {"direct", "screen", "mention", "famous", "focused"}
    with pytest.raises(ValueError):
        T.supported_at_least(ids, "best")


def test_mentions_of_symbols_of_several_words(spark):
    texts = ["See AC01.1 and rp-4 here", "ac01 1, RP-4", "AC01 and 1", "none", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    names = spark.createDataFrame([("AC01.1",), ("RP-4",), ("A/B C",), ("...",), ("none",)], "gene_symbol string")
    out = T.mention_counts(docs, names, presets.SEARCH_CONTEXTS, presets.DIRECT_TERMS, presets.SCREEN_TERMS)
    assert by_key(out, "gene_symbol", "total_pubmed_count") == {"AC01.1": 2, "RP-4": 2, "A/B C": 0, "...": 0, "none": 1}


def test_mention_counts(spark):
    docs = spark.createDataFrame(
        [
            ("MYO7A knockout disturbs cilia in the hair cell, says myo7a.",),
            ("A proteomics screen found MYO7A and HLA-A",),
            ("actin, and MYO7A2, but no match",),
            (None,),
        ],
        "text string",
    )
    names = spark.createDataFrame([("MYO7A",), ("HLA-A",), ("ACTB",)], "gene_symbol string")
    out = T.mention_counts(docs, names, presets.SEARCH_CONTEXTS, presets.DIRECT_TERMS, presets.SCREEN_TERMS)
    assert rows(out) == [
        ("ACTB", 0, 0, 0, 0, 0, 0, 0),
        ("HLA-A", 1, 0, 0, 0, 0, 0, 1),
        ("MYO7A", 2, 1, 1, 0, 0, 1, 1),
    ]


def test_literature_layer_fans_out_and_resumes(spark):
    names = spark.createDataFrame([("E1", "A"), ("E2", "A"), ("E3", "B"), ("E4", None), ("E9", "Z")], "gene_id string, gene_symbol string")
    ids = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E4",)], "gene_id string")
    counts = spark.createDataFrame([("A", 9, 1, 0, 0, 0, 1, 0), ("B", 9, 0, 0, 0, 0, 0, 0), ("Z", 9, 9, 9, 9, 9, 9, 9)], COUNTS)
    done = spark.createDataFrame([("B", 5, 3, 0, 0, 0, 3, 0)], COUNTS)
    plain = by_key(T.literature_layer(names, counts, ids), "gene_id", "literature_score_normalized")
    assert plain == {"E1": 1.0, "E2": 1.0, "E3": 0.5, "E4": None}
    resumed = T.literature_layer(names, counts, ids, done)
    assert by_key(resumed, "gene_id", "total_pubmed_count") == {"E1": 9, "E2": 9, "E3": 5, "E4": None}
    assert by_key(resumed, "gene_id", "literature_score_normalized")["E3"] == 1.0


def test_protein_layer(spark):
    features = spark.createDataFrame(
        [("P1", 1000, ["PDZ", "IFT repeat"], 2, 30), ("P2", 100, [], 0, 0), ("P3", None, [], None, None)],
        "uniprot_id string, protein_length long, domain_names array<string>, coiled_coil_count long, transmembrane_count long",
    )
    domains = spark.createDataFrame([("P1", ["PDZ", "SH3"]), ("P2", [])], "uniprot_id string, domain_names array<string>")
    names = spark.createDataFrame(
        [("E1", "A", "P1"), ("E2", "B", "P2"), ("E3", "C", "P3"), ("E4", "D", None), ("E5", "E", "P1")],
        "gene_id string, gene_symbol string, uniprot_id string",
    )
    out = P.protein_layer(names, features, domains, presets.MOTIF_GROUPS, names)
    assert by_key(out, "gene_id", "domain_count") == {"E1": 3, "E2": 0, "E3": 0, "E4": None, "E5": 3}
    score = by_key(out, "gene_id", "protein_score_normalized")
    assert score["E1"] == pytest.approx(1.0) and score["E5"] == pytest.approx(1.0)
    assert score["E2"] == pytest.approx(0.15 * 0.5 + 0.20 * 0.5)
    assert score["E3"] is None and score["E4"] is None
    assert by_key(out, "gene_id", "has_cilia_domain") == {"E1": True, "E2": None, "E3": None, "E4": None, "E5": True}
    assert by_key(out, "gene_id", "coiled_coil")["E3"] is None
    assert [r["gene_id"] for r in P.motif_candidates(out).collect()] == ["E1", "E5"]


def test_coded_terms_hold_a_term_once(spark):
    from evidrank.operators import orthology as O

    df = spark.range(200_000).select(F.lit("e").alias("entity"), F.when(F.col("id") % 3 == 0, "it's; a b").otherwise("c").alias("term"))
    df = df.unionByName(spark.createDataFrame([("e", None), ("f", "c")], "entity string, term string"))
    coded = O.term_counts(df, "entity", "term", "x")
    got = {r["entity"]: (r["x_phenotype_count"], [tuple(t) for t in r["x_term_counts"]]) for r in coded.collect()}
    assert got == {"e": (200_000, [("c", 133_333), ("it's; a b", 66_667)]), "f": (1, [("c", 1)])}
    pieces = O.term_pieces(coded.where("entity = 'e'"), "entity", "x", "; ", 50_000).orderBy("piece").collect()
    assert [len(r["terms"]) for r in pieces] == [149_998, 149_998, 99_997, 549_998, 183_335]
    assert "; ".join(r["terms"] for r in pieces) == "; ".join(["c"] * 133_333 + ["it's; a b"] * 66_667)
