"""Domain vocabularies and member lists: parameters for the operators, nothing else."""

from __future__ import annotations

# Phenotype keywords per species.
MOUSE_KEYWORDS = [
    "hearing", "deaf", "vestibular", "balance", "retina", "photoreceptor", "vision", "blind", "cochlea", "stereocilia",
    "cilia", "cilium", "flagellum", "situs inversus", "laterality", "hydrocephalus", "kidney cyst", "polycystic",
]
FISH_KEYWORDS = [
    "hearing", "deaf", "vestibular", "balance", "retina", "photoreceptor", "vision", "blind", "eye", "ear", "otolith",
    "lateral line", "cilia", "cilium", "flagellum", "situs", "laterality", "hydrocephalus", "kidney cyst", "pronephros",
]

# Literature context terms. The first context also bounds direct evidence.
SEARCH_CONTEXTS = {
    "cilia": ["cilia", "cilium", "ciliary", "flagellum", "intraflagellar"],
    "sensory": ["retina", "cochlea", "hair cell", "photoreceptor", "vestibular", "hearing", "usher syndrome"],
    "cytoskeleton": ["cytoskeleton", "actin", "microtubule", "motor protein"],
    "cell_polarity": ["cell polarity", "planar cell polarity", "apicobasal", "tight junction"],
}
DIRECT_TERMS = ["knockout", "knockdown", "mutation", "CRISPR", "siRNA", "morpholino", "null allele"]
SCREEN_TERMS = ["screen", "proteomics", "transcriptomics"]

# Protein motif keyword groups.
MOTIF_GROUPS = {
    "scaffold_adaptor_domain": ["PDZ", "SH3", "Ankyrin", "WD40", "Coiled coil", "SAM", "FERM", "Harmonin"],
    "has_cilia_domain": [
        "IFT", "intraflagellar", "BBSome", "ciliary", "cilia", "basal body", "centrosome", "transition zone", "axoneme",
    ],
    "has_sensory_domain": ["stereocilia", "photoreceptor", "usher", "harmonin", "cadherin 23", "protocadherin"],
}

# Source categories and the columns they fill.
LEVEL_CATEGORIES = {
    "retina": "hpa_retina_tpm",
    "cerebellum": "hpa_cerebellum_tpm",
    "testis": "hpa_testis_tpm",
    "fallopian tube": "hpa_fallopian_tube_tpm",
}
WIDE_COLUMNS = {
    "Eye - Retina": "gtex_retina_tpm",
    "Brain - Cerebellum": "gtex_cerebellum_tpm",
    "Testis": "gtex_testis_tpm",
    "Fallopian Tube": "gtex_fallopian_tube_tpm",
}
TARGET_COLUMNS = [
    "hpa_retina_tpm", "hpa_cerebellum_tpm", "gtex_retina_tpm", "gtex_cerebellum_tpm",
    "cellxgene_photoreceptor_expr", "cellxgene_hair_cell_expr",
]
ALL_COLUMNS = [
    "hpa_retina_tpm", "hpa_cerebellum_tpm", "hpa_testis_tpm", "hpa_fallopian_tube_tpm",
    "gtex_retina_tpm", "gtex_cerebellum_tpm", "gtex_testis_tpm", "gtex_fallopian_tube_tpm",
    "cellxgene_photoreceptor_expr", "cellxgene_hair_cell_expr",
]

# Proteomics member lists.
PROTEOMICS_SETS = {
    "in_cilia_proteomics": [
        "BBS1", "BBS2", "BBS4", "BBS5", "BBS7", "BBS9", "BBS10", "BBS12", "CEP290", "CEP164", "CEP120", "RPGRIP1L",
        "TCTN1", "TCTN2", "TCTN3", "IFT88", "IFT81", "IFT140", "IFT172", "IFT80", "IFT52", "IFT57", "DYNC2H1",
        "DYNC2LI1", "WDR34", "WDR60", "TCTEX1D2", "NPHP1", "NPHP4", "INVS", "ANKS6", "NEK8", "ARL13B", "INPP5E",
        "CEP41", "TMEM67", "TMEM216", "TMEM231", "TMEM237", "MKS1", "TMEM17", "CC2D2A", "AHI1", "RPGRIP1", "NPHP3",
        "OFD1", "C5orf42", "CSPP1", "C2CD3", "CEP83", "SCLT1", "KIF7", "GLI2", "GLI3", "SUFU", "GPR161", "TALPID3",
        "B9D1", "B9D2", "KIAA0586", "NEK1", "DZIP1", "DZIP1L", "FUZ", "POC5", "POC1B", "CEP135", "CEP152", "CEP192",
        "ALMS1", "TTC21B", "IFT122", "IFT144", "WDR19", "WDR35", "SPAG1", "RSPH1", "RSPH4A", "RSPH9", "DNAH5",
        "DNAH11", "DNAI1", "DNAI2", "C21orf59", "CCDC39", "CCDC40", "CCDC65", "CCDC103", "CCDC114", "DRC1", "ARMC4",
        "TTC25", "ZMYND10", "LRRC6", "PIH1D3", "HYDIN", "SPEF2", "CFAP43", "CFAP44", "CFAP53", "CFAP54",
    ],
    "in_centrosome_proteomics": [
        "PCNT", "CDK5RAP2", "CEP192", "CEP152", "CEP135", "CEP120", "TUBG1", "TUBG2", "TUBGCP2", "TUBGCP3",
        "TUBGCP4", "TUBGCP5", "TUBGCP6", "NEDD1", "AKAP9", "NINL", "NIN", "CEP170", "CEP170B", "CEP131", "CEP63",
        "CEP72", "CEP97", "PLK1", "PLK4", "AURKA", "AURKB", "SASS6", "CENPJ", "STIL", "SAS6", "POC5", "POC1A",
        "POC1B", "CPAP", "CEP295", "OFD1", "C2CD3", "CCDC14", "CCDC67", "CCDC120", "KIAA0753", "SSX2IP", "CEP89",
        "CEP104", "CEP112", "CEP128", "CP110", "CNTROB", "CETN2", "CETN3",
    ],
}

# Control sets by source.
POSITIVE_CONTROLS = {
    "omim_usher": [
        "MYO7A", "USH1C", "CDH23", "PCDH15", "USH1G", "CIB2", "USH2A", "ADGRV1", "WHRN", "CLRN1",
    ],
    "syscilia_scgs_v2": [
        "IFT88", "IFT140", "IFT172", "BBS1", "BBS2", "BBS4", "BBS5", "BBS7", "BBS9", "BBS10", "RPGRIP1L", "CEP290",
        "ARL13B", "INPP5E", "TMEM67", "CC2D2A", "NPHP1", "NPHP3", "NPHP4", "RPGR", "CEP164", "OFD1", "MKS1", "TCTN1",
        "TCTN2", "TMEM216", "TMEM231", "TMEM138",
    ],
}
NEGATIVE_CONTROLS = {
    "literature_validated": [
        "RPL13A", "RPL32", "RPLP0", "GAPDH", "ACTB", "PGK1", "SDHA", "B2M", "HPRT1", "TBP", "PPIA", "UBC", "YWHAZ",
    ],
}

# Composite layers, the stage each is read from and its score column.
LAYER_STAGES = {
    "gnomad": ("gnomad_constraint", "loeuf_normalized"),
    "expression": ("tissue_expression", "expression_score_normalized"),
    "annotation": ("annotation_completeness", "annotation_score_normalized"),
    "localization": ("subcellular_localization", "localization_score_normalized"),
    "animal_model": ("animal_model_phenotypes", "animal_model_score_normalized"),
    "literature": ("literature_evidence", "literature_score_normalized"),
}
