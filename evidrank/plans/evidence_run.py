"""A whole run over stage tables: universe, layers, composite, quality, validation, report, run summary.

Every step reads stages and writes one, so a run can stop and resume anywhere, each stage is computed once, and plans
stay short. Step counts and layer statistics go to the run ledger.
"""

from __future__ import annotations

import platform
import uuid
from collections.abc import Callable, Mapping, Sequence

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.operators import annotation, constraint, expression, literature, localization, orthology, protein
from evidrank.operators import composite as J
from evidrank.operators import controls as K
from evidrank.operators import entities as E
from evidrank.operators import quality as Q
from evidrank.operators import report as P
from evidrank.operators import sweep as S
from evidrank.plans import presets
from evidrank.sources.stages import StageStore

UNIVERSE, SCORED, FINDINGS, SWEEP, VALIDATION, CANDIDATES = (
    "gene_universe",
    "scored_genes",
    "qc_findings",
    "weight_sweep",
    "validation_results",
    "candidates",
)

SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gnomad_constraint": constraint.constraint_summary,
    "tissue_expression": lambda df: expression.expression_summary(
        df,
        ["hpa_retina_tpm", "gtex_retina_tpm", "cellxgene_photoreceptor_expr"],
        ["cellxgene_hair_cell_expr"],
    ),
    "annotation_completeness": annotation.annotation_summary,
    "subcellular_localization": localization.localization_summary,
    "animal_model_phenotypes": orthology.animal_summary,
    "literature_evidence": literature.literature_summary,
    "protein_features": protein.protein_summary,
}


class EvidenceRun:
    """One run over a store. ``layers`` maps a layer name to (stage, score column)."""

    def __init__(
        self,
        store: StageStore,
        layers: Mapping[str, tuple[str, str]] = presets.LAYER_STAGES,
        run_id: str | None = None,
        entity: str = "gene_id",
        symbol: str = "gene_symbol",
    ):
        self.store, self.layers = store, dict(layers)
        self.run_id = run_id or str(uuid.uuid4())
        self.entity, self.symbol = entity, symbol

    def _need(self, name: str) -> DataFrame:
        table = self.store.load(name)
        if table is None:
            raise KeyError(f"stage {name} is missing; run the step that writes it first")
        return table

    def _record(self, step: str, inputs: int | None, outputs: int | None, criteria: str = "", details: DataFrame | Mapping | None = None):
        row = details.first().asDict() if isinstance(details, DataFrame) else details or {}
        self.store.record_step(self.run_id, step, inputs, outputs, criteria, row)

    # -- steps -----------------------------------------------------------------------------------------------------

    def universe(
        self, ids: DataFrame, mapping: DataFrame, prefix: str = "ENSG", low: int = E.MIN_ENTITIES, high: int = E.MAX_ENTITIES, force: bool = False
    ) -> DataFrame:
        """Map the requested ids, record both gates, and stage the universe."""
        if force or not self.store.exists(UNIVERSE):
            written = self.store.save(E.map_requested(ids.distinct(), mapping), UNIVERSE, "entity universe")
            mapped = self.store.load(UNIVERSE)
            self._record("universe_gate", written, written, prefix, E.universe_gate(mapped, prefix, low, high))
            self._record("mapping_gate", written, written, "symbol mapping", E.mapping_gate(E.mapping_report(mapped)))
        return self.store.load(UNIVERSE)

    def layer(self, stage: str, build: Callable[[], DataFrame], force: bool = False, description: str = "") -> DataFrame:
        """Stage a layer unless it exists, and record its statistics."""
        if force or not self.store.exists(stage):
            written = self.store.save(build(), stage, description)
            table = self.store.load(stage)
            details = SUMMARIES[stage](table) if stage in SUMMARIES else None
            self._record(f"load_{stage}", written, written, description, details)
        return self.store.load(stage)

    def joined(self) -> DataFrame:
        tables = {n: (self._need(stage), column) for n, (stage, column) in self.layers.items()}
        return J.evidence_join(self._need(UNIVERSE), tables, self.entity, self.symbol, dedupe=False)

    def score(self, weights: Mapping[str, float] = J.DEFAULT_WEIGHTS, force: bool = False) -> DataFrame:
        """Composite per entity, staged with its quality findings."""
        if force or not self.store.exists(SCORED):
            flags = ("sufficient_evidence", "moderate_evidence", "sparse_evidence", "no_evidence")
            counts = {"with_score": F.count("composite_score"), **{q: F.count_if(F.col("quality_flag") == q) for q in flags}}
            scored = J.weighted_composite(self.joined(), weights, self.entity, self.symbol)
            seen = self.store.save_measured(scored, SCORED, "weighted composite with contributions", counts)
            written = seen.pop("_rows")
            table = self.store.load(SCORED)
            self._record("score", self.store.rows_of(UNIVERSE), written, str(dict(weights)), seen)
            names = list(self.layers)
            severity = F.col("severity")
            counts = {"warnings": F.count_if(severity == "warning"), "errors": F.count_if(severity == "error")}
            seen = self.store.save_measured(Q.qc_findings(table, names), FINDINGS, "quality warnings and errors", counts)
            verdict = {"warnings": seen["warnings"], "errors": seen["errors"], "passed": seen["errors"] == 0}
            self._record("quality", written, written, "no errors", verdict)
        return self.store.load(SCORED)

    def validate(
        self,
        positives: DataFrame,
        negatives: DataFrame,
        weights: Mapping[str, float] | None = J.DEFAULT_WEIGHTS,
        deltas: Sequence[float] = S.DEFAULT_DELTAS,
        top_n: int = S.TOP_N,
        force: bool = False,
    ) -> DataFrame:
        """Control sets and weight sweep, staged as one verdict row. ``weights=None`` skips the sweep."""
        if force or not self.store.exists(VALIDATION):
            scored = self._need(SCORED)
            sides = {"plus": positives, "minus": negatives}
            both = [c.select(self.symbol, "source", F.lit(side).alias("side")) for side, c in sides.items()]
            ranked = K.rank_controls(scored, both[0].unionByName(both[1]), self.symbol, keep=("source", "side"), stored=True)  # scores are ranked once
            of = lambda side: ranked.where(F.col("side") == side).drop("side")
            plus = K.control_summary(of("plus"), positives, on=self.symbol)
            minus = K.control_summary(of("minus"), negatives, positive=False, on=self.symbol)
            summary = None
            if weights is not None:
                swept = S.sensitivity_sweep(self.joined(), weights, deltas, top_n, self.entity, self.symbol)
                self.store.save(swept, SWEEP, "rank agreement per weight scenario")
                summary = S.sweep_summary(self.store.load(SWEEP))
            row = K.validation_verdict(plus, minus, summary).withColumns(
                {
                    "median_percentile": plus.select("median_percentile").scalar(),
                    "top_quartile_fraction": plus.select("top_quartile_fraction").scalar(),
                }
            )
            self.store.save(row, VALIDATION, "validation verdict")
            self._record("validate", None, None, "positive, negative, sensitivity", self.store.load(VALIDATION))
        return self.store.load(VALIDATION)

    def report(self, folder: str, tiers: Mapping[str, Mapping[str, float]] = P.TIERS, base: str = "candidates") -> DataFrame:
        """Tiered candidates with their evidence summary, staged and written as TSV and Parquet."""
        scored = self._need(SCORED)
        tiered = P.evidence_summary(P.assign_tiers(scored, tiers), list(self.layers))
        written = self.store.save(tiered, CANDIDATES, "tiered candidates")
        stats = P.write_dual(self.store.load(CANDIDATES), folder, base, self.entity)
        self._record("report", self.store.rows_of(SCORED), written, "reaches a tier", stats)
        return self.store.load(CANDIDATES)

    def summary(self, weights: Mapping[str, float] = J.DEFAULT_WEIGHTS) -> DataFrame:
        """``section, name, value, input_count, output_count``: parameters, versions, tiers, steps and validation."""
        spark = self.store.spark
        fixed = [("parameter", n, str(w)) for n, w in weights.items()]
        fixed += [("run", "run_id", self.run_id), ("software", "spark", pyspark.__version__), ("software", "python", platform.python_version())]
        shape = "section string, name string, value string, input_count bigint, output_count bigint"
        out = spark.createDataFrame([(*row, None, None) for row in fixed], shape)
        nothing = F.lit(None).cast("bigint")
        tiers = P.category_counts(self._need(CANDIDATES), "confidence_tier").select(
            F.lit("tier").alias("section"), F.col("confidence_tier").alias("name"), F.lit(None).cast("string").alias("value"),
            nothing.alias("input_count"), F.col("n").alias("output_count"),
        )
        steps = self.store.steps(self.run_id).select(
            F.lit("step").alias("section"), F.col("step_name").alias("name"), F.col("criteria").alias("value"), "input_count", "output_count"
        )
        out = out.unionByName(tiers).unionByName(steps)
        verdict = self.store.load(VALIDATION)
        if verdict is not None:
            text = verdict.select(*[F.col(c).cast("string").alias(c) for c in verdict.columns])
            rows = text.unpivot([], verdict.columns, "name", "value").select(
                F.lit("validation").alias("section"), "name", "value", nothing.alias("input_count"), nothing.alias("output_count")
            )
            out = out.unionByName(rows)
        return out
