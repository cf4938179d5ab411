"""Vocabularies and analysis settings.

Everything that steers an analysis (which level counts as a carrier, which
phenotype is compared with which threshold, ...) is data in this module, so that
operators can expand *all* settings inside one Spark plan instead of running
one plan per setting.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These vocabularies and thresholds must equal the published
# study's for results to agree.
# ---------------------------------------------------------------------------
CLINVAR_PATH_LEVELS = ("pathogenic", "likely pathogenic")
PATH_LEVELS = ("pathogenic", "likely pathogenic", "lof", "likely_lof")
BENIGN_LEVELS = ("likely benign", "benign", "likely_not_lof", "not_lof")
ALL_LEVELS = (
    "pathogenic", "likely pathogenic", "lof", "likely_lof", "vus",
    "likely benign", "benign", "likely_not_lof", "not_lof",
)
HIGH_CONFIDENCE_LABS = (
    "Invitae",
    "GeneDx",
    "Laboratory for Molecular Medicine,Partners HealthCare Personalized Medicine",
    "Genetic Services Laboratory, University of Chicago",
    "EGL Genetic Diagnostics,Eurofins Clinical Diagnostics",
    "PreventionGenetics,PreventionGenetics",
    "Ambry Genetics",
)
ANCESTRY_ORDER = (
    "East Asian", "South Asian", "European", "African American", "Hispanic", "Other",
)
ANCESTRY_CODES = {
    "asian": "Other", "other": "Other", "ea": "East Asian", "sa": "South Asian",
    "aa": "African American", "eu": "European", "hs": "Hispanic",
}
TRAIT_ORDER = (
    "High LDL", "Low LDL", "High HDL", "High triglycerides", "Obesity", "MODY",
    "MODY Extended", "Lipodystrophy", "Neonatal Diabetes",
)
TRAIT_DISPLAY = {
    "Obesity": "Monogenic obesity",
    "MODY Extended": "MODY extended",
    "Neonatal Diabetes": "Neonatal diabetes",
}
DISEASE_ORDER = (
    "High LDL", "Low LDL", "High HDL", "High triglycerides", "Monogenic obesity",
    "MODY", "MODY extended", "Lipodystrophy", "Neonatal diabetes",
)
CARRIER_ORDER = (
    "NC", "C", "Non Carrier", "Carrier", "ClinVar", "LOF", "Review",
    "ClinVar and LOF", "LOF and Review",
    "VUS Novel", "VUS <1/10000", "VUS <1/1000", "VUS >=1/1000",
)
EVIDENCE_RENAMES = {"ClinVar, LOF": "ClinVar and LOF", "LOF, Review": "LOF and Review"}
CORE_MODY_GENES = ("GCK", "HNF1A", "HNF1B", "PDX1", "HNF4A")
EXCLUDED_COHORTS = ("SEARCH", "SIGMA_extremes", "TODAY")
ASCERTAINED_PHENOTYPES = (
    "BMI_High", "BMI_High_Nondiab", "BMI_High_diab", "BMI_Low", "LDL_High", "LDL_Low",
)
THRESHOLDS = {
    "High HDL": 70.0, "High LDL": 190.0, "Low LDL": 80.0,
    "High triglycerides": 200.0, "Obesity": 30.0,
}
GENE_SET = (
    "ABCC8", "AKT2", "APOA1", "APOA5", "APOB", "APPL1", "BLK", "CEL", "CETP",
    "GATA4", "GATA6", "GCK", "HNF1A", "HNF1B", "HNF4A", "INS", "KCNJ11", "KLF11",
    "LDLR", "LMNA", "LPL", "MC4R", "NEUROD1", "PAX4", "PCSK9", "PDX1", "PLIN1",
    "PPARG",
)
LOF_GENE_SET = (
    "APOA5", "APOB", "CEL", "CETP", "GCK", "HNF1A", "HNF1B", "HNF4A", "INS",
    "LDLR", "LMNA", "LPL", "MC4R", "PCSK9", "PDX1", "PPARG",
)
TISSUES = (
    "Spleen", "Brain_FrontalCortex_BA9_", "SmallIntestine_TerminalIleum",
    "Skin_SunExposed_Lowerleg_", "Artery_Coronary", "Brain_Hippocampus",
    "Esophagus_Muscularis", "Brain_Nucleusaccumbens_basalganglia_",
    "Artery_Tibial", "Brain_Hypothalamus", "Adipose_Visceral_Omentum_",
    "Nerve_Tibial", "Brain_CerebellarHemisphere", "Breast_MammaryTissue",
    "Liver", "Skin_NotSunExposed_Suprapubic_", "AdrenalGland", "Pancreas",
    "Lung", "Pituitary", "Muscle_Skeletal", "Colon_Transverse",
    "Artery_Aorta", "Heart_AtrialAppendage", "Adipose_Subcutaneous",
    "Esophagus_Mucosa", "Heart_LeftVentricle", "Brain_Cerebellum",
    "Brain_Cortex", "Thyroid", "Stomach", "WholeBlood",
    "Brain_Anteriorcingulatecortex_BA24_", "Brain_Putamen_basalganglia_",
    "Brain_Caudate_basalganglia_", "Colon_Sigmoid",
    "Esophagus_GastroesophagealJunction", "Brain_Amygdala",
)
# Coding consequences, the most severe first.
CODING_SEVERITY = (
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant",
    "stop_lost", "start_lost", "transcript_amplification", "inframe_insertion", "inframe_deletion",
    "missense_variant", "protein_altering_variant", "splice_region_variant", "incomplete_terminal_codon_variant",
    "start_retained_variant", "stop_retained_variant", "synonymous_variant", "coding_sequence_variant",
)
HIGH_VOLUME_MIN_SUBMISSIONS = 15000
HIGH_VOLUME_SINCE = "2017-01-01"
INTERVAL_BUFFER = 100_000
MIN_GQ, MIN_DP, MIN_ALLELE_BALANCE = 20, 10, 0.25
# ---------------------------------------------------------------------------

COVARIATES = ("age", "sex") + tuple(f"pc{i}" for i in range(1, 11))


@dataclass(frozen=True)
class OutcomeSetting:
    """One row of the penetrance table: how a trait turns into a yes/no outcome."""

    trait: str
    phenotype: str
    rule: str  # one of ">", "<", "=", ">="
    threshold: float
    label: str
    no_meds: bool = False
    simple: str | None = None

    @property
    def condition(self) -> str:
        return self.label + (" no lipid meds" if self.no_meds else "")

    @property
    def condition_simple(self) -> str:
        return self.simple or self.trait


@dataclass(frozen=True)
class MeanSetting:
    """One row of the group-mean table."""

    trait: str
    phenotype: str
    label: str
    no_meds: bool = False
    log_value: bool = False

    @property
    def association_trait(self) -> str:
        return self.phenotype + ("_ln" if self.log_value else "")


@dataclass(frozen=True)
class ScoreSetting:
    """One polygenic-score analysis."""

    trait: str
    phenotype: str
    rule: str
    threshold: float
    no_meds: bool = False
    binary: bool = False
    in_percentile_table: bool = False

    @property
    def lower_is_worse(self) -> bool:
        return self.rule == "<"


def _both_medication_variants(setting):
    return [setting, replace(setting, no_meds=True)]


def outcome_settings(include_diabetes: bool = True) -> list[OutcomeSetting]:
    """The 22 outcome settings (14 when diabetes traits are left out)."""
    out: list[OutcomeSetting] = []
    if include_diabetes:
        for trait in ("MODY", "MODY Extended", "Lipodystrophy", "Neonatal Diabetes"):
            shown = TRAIT_DISPLAY.get(trait, trait)
            for phenotype, words in (
                ("t2d", "T2D"),
                ("t2d_with_pre", "T2D and pre-diabetes"),
            ):
                out.append(OutcomeSetting(trait, phenotype, "=", 1.0, f"{shown} ({words})"))
    out.append(
        OutcomeSetting("Obesity", "bmi", ">", THRESHOLDS["Obesity"],
                       "Monogenic obesity (BMI >30)", simple="Monogenic obesity")
    )
    out.append(
        OutcomeSetting("High HDL", "hdl_mgdl", ">", THRESHOLDS["High HDL"],
                       "High HDL (>70 mg/dl)")
    )
    for trait, rule, simple in (
        ("High LDL", ">", None), ("Low LDL", "<", None), ("High triglycerides", ">", "High TG"),
    ):
        measure = "tg_mgdl" if trait == "High triglycerides" else "ldl_mgdl"
        limit = THRESHOLDS[trait]
        for phenotype, adjusted in ((measure, ""), (measure + "_adj", " ADJ")):
            label = f"{trait}{adjusted} ({rule}{limit:.0f} mg/dl)"
            out += _both_medication_variants(
                OutcomeSetting(trait, phenotype, rule, limit, label, simple=simple)
            )
    return out


def mean_settings() -> list[MeanSetting]:
    """The 14 continuous settings of the group-mean table."""
    return [
        MeanSetting(s.trait, s.phenotype, s.condition, s.no_meds,
                    s.trait in ("Obesity", "High triglycerides"))
        for s in outcome_settings(include_diabetes=False)
    ]


def score_settings() -> list[ScoreSetting]:
    """The 8 polygenic-score analyses."""
    t = THRESHOLDS
    low = ScoreSetting("Low LDL", "ldl_mgdl", "<", t["Low LDL"], in_percentile_table=True)
    high = ScoreSetting("High LDL", "ldl_mgdl", ">=", t["High LDL"], in_percentile_table=True)
    return [
        low, replace(low, no_meds=True, in_percentile_table=False),
        high, replace(high, no_meds=True, in_percentile_table=False),
        ScoreSetting("High HDL", "hdl_mgdl", ">=", t["High HDL"], in_percentile_table=True),
        ScoreSetting("High triglycerides", "tg_mgdl", ">=", t["High triglycerides"],
                     in_percentile_table=True),
        ScoreSetting("Obesity", "bmi", ">=", t["Obesity"], in_percentile_table=True),
        ScoreSetting("MODY", "t2d", "=", 1.0, binary=True),
    ]
