"""Controlled vocabularies: aliases of each level, normalisers and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import checks

UNKNOWN = "unknown"

#: Paper types, each with its aliases.
PAPER_TYPES = {
    "theoretical": "theory theoretical_paper",
    "conceptual": "conceptual_framework conceptual_paper conceptual_model",
    "empirical_archival": "archival archive empirical_archive empirical_archival_study archival_empirical archival_study observational",
    "empirical_experimental": "experimental experiment empirical_experiment randomized_experiment field_experiment lab_experiment",
    "empirical_survey": "survey survey_based questionnaire survey_research",
    "empirical_qualitative": "qualitative interview ethnography grounded_theory fieldwork discourse_analysis",
    "empirical_case_study": "case case_study empirical_case case_analysis",
    "empirical_mixed_methods": "mixed mixed_method mixed_methods",
    "methodological": "method methods methodology methodological_paper measurement_method",
    "computational": "computation computational_modeling machine_learning ml algorithmic",
    "simulation": "simulate simulation_study monte_carlo montecarlo agent_based_model scenario_simulation",
    "benchmark": "benchmarking benchmark_study leaderboard evaluation_benchmark task_benchmark",
    "system_design": "architecture system_architecture system_design_paper platform_design implementation",
    "review_narrative": "narrative_review literature_review review_article overview",
    "review_systematic": "systematic_review systematic_literature_review",
    "review_scoping": "scoping_review mapping_review evidence_map",
    "meta_analysis": "meta meta_analytic",
    "replication": "reproduction reproducibility replicated replication_study reanalysis",
    "registered_report": "preregistered pre_registered pre_registered_report stage1",
    "study_protocol": "protocol trial_protocol review_protocol study_design",
    "policy_analysis": "policy policy_brief policy_study policy_paper governance_analysis regulatory_analysis regulation_analysis",
    "perspective": "viewpoint",
    "commentary": "opinion comment response editorial letter note",
    "review": "",
    "dataset": "data data_paper database dataset_paper",
    "policy_report": "report",
    "book": "monograph text",
    "unknown": "na n_a none missing unclear",
}

#: Roles of an anchor reference.
ANCHOR_ROLES = {
    "theoretical_foundation": "theoretical theory",
    "conceptual_foundation": "conceptual conceptual_framework",
    "methodological_foundation": "methodological method",
    "empirical_benchmark": "empirical benchmark",
    "main_comparison": "main comparison",
    "motivation": "",
    "contrasting_view": "contrasting contrast",
    "problem_origin": "problem",
    "application_context": "application",
    "review_anchor": "review",
    "policy_context": "policy",
    "unknown": "",
}

#: How an anchor relates to the paper at hand.
RELATIONSHIPS = {
    "builds_on": "build_on",
    "extends": "extension",
    "tests": "test",
    "applies": "apply",
    "compares_with": "compare_with",
    "contradicts": "contradict",
    "critiques": "critique",
    "replicates": "replicate",
    "generalizes": "generalize",
    "narrows": "narrow",
    "uses_as_context": "use_as_context",
    "unknown": "",
}

#: Types of a claim's logic.
LOGIC_TYPES = {
    "A_improves_B": "improves",
    "A_reduces_B": "reduce reduces",
    "A_causes_B": "causes",
    "A_contributes_to_B": "contribute contributes",
    "A_is_associated_with_B": "associated associated_with",
    "A_predicts_B": "predicts predict",
    "A_mediates_B_and_C": "mediates",
    "A_moderates_B_and_C": "moderates",
    "A_mitigates_effect_of_B_on_C": "mitigates",
    "A_amplifies_effect_of_B_on_C": "amplifies",
    "A_has_limitation_B": "limitation",
    "A_faces_challenge_B": "challenge",
    "A_creates_risk_B": "risk",
    "A_requires_B": "requires",
    "A_depends_on_B": "depends",
    "A_constrains_B": "constrains",
    "A_enables_B": "enables",
    "A_outperforms_B": "outperforms",
    "A_underperforms_B": "underperforms",
    "A_is_better_than_B_for_C": "better_than",
    "A_is_worse_than_B_for_C": "worse_than",
    "A_extends_B": "extends",
    "A_contradicts_B": "contradicts",
    "A_supports_B": "supports",
    "A_represents_B": "represents",
    "A_is_proxy_for_B": "proxy",
    "A_measures_B": "measures",
    "A_operationalizes_B": "operationalizes",
    "A_can_be_classified_into_B_C_D": "classifies",
    "A_consists_of_B_C_D": "consists",
    "A_has_dimension_B_C_D": "dimension",
    "A_introduces_B": "introduces",
    "A_proposes_B": "proposes",
    "A_reviews_B": "reviews",
    "A_synthesizes_B": "synthesizes",
    "A_provides_evidence_for_B": "evidence",
    "A_provides_counterevidence_to_B": "counterevidence",
    "unknown": "",
}

#: Roles of a piece of evidence.
EVIDENCE_ROLES = {
    "main_finding": "",
    "secondary_finding": "",
    "theoretical_argument": "",
    "conceptual_argument": "",
    "methodological_claim": "",
    "review_synthesis": "",
    "policy_argument": "",
    "background_context": "",
    "counterevidence": "",
    "limitation_note": "limitation",
    "example": "",
    "unknown": "",
}

#: Fixed values.
CONFIDENCE = {"low": "", "medium": "", "high": "", "unknown": ""}

#: The three axes of an evidence shape.
EVIDENCE_SHAPE = {
    "evidence_mode": "empirical_quantitative empirical_qualitative experimental simulation benchmark theoretical_model conceptual_argument "
    "methodological_demonstration review_synthesis policy_analysis descriptive none unknown".split(),
    "inference_type": "causal associational predictive descriptive mechanistic formal interpretive comparative normative synthetic "
    "not_applicable unknown".split(),
    "strength_level": "very_low low medium high very_high not_applicable unknown".split(),
}


def aliases(vocabulary: dict[str, str]) -> dict[str, str]:
    """Level of each level's own key and of each alias."""
    out = {}
    for level, names in vocabulary.items():
        for name in (level.lower(), *names.split()):
            out[name] = level
    return out


def key(c: Column) -> Column:
    """Lower case, blanks and hyphens as single underscores, none at the ends; null is empty."""
    c = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def normalize(c: Column, vocabulary: dict[str, str]) -> Column:
    """Level of a value; ``unknown`` for anything else."""
    pairs = [F.lit(x) for kv in aliases(vocabulary).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key(c)), F.lit(UNKNOWN))


def known(c: Column, vocabulary: dict[str, str]) -> Column:
    """Whether a value is blank, a level, or an alias."""
    return (key(c) == "") | key(c).isin(list(aliases(vocabulary)))


def require(df: DataFrame, column: str, vocabulary: dict[str, str]) -> None:
    checks.require_none(df.where(~known(F.col(column), vocabulary)).select(column), f"{column} outside the vocabulary")
