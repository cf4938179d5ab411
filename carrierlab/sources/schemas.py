"""Schemas of the input files. Large inputs are never schema-inferred."""

from __future__ import annotations

GENE_TRAIT = (
    "Gene_name string, Trait string, lof_in_gene string, pLI double, LoF int, "
    "has_clinical_submissions boolean"
)
GENE_PHENOTYPE = "Gene_name string, Disease string, phenotype string, Stratify string, Transform string"
SUBMISSIONS = (
    "VariationID string, submitter_clinical_significance string, "
    "submitter_date_last_evaluated string, submitter_description string, "
    "submitted_phenotype_info string, reported_phenotype_info string, "
    "submitter_review_status string, submitter_collection_method string, "
    "submitter_origin_counts string, submitter string, submitterSCV string, "
    "submitted_gene_symbol string, ExplanationOfInterpretation string"
)
VARIANT_SUMMARY_COLUMNS = {
    "VariationID": "int", "AlleleID": "int", "Type": "string", "Name": "string",
    "GeneSymbol": "string", "ClinSigSimple": "int", "Assembly": "string",
    "LastEvaluated": "string", "PhenotypeList": "string", "NumberSubmitters": "int",
    "HGNC_ID": "string",
}
SITES = (
    "CHROM string, POS int, ID int, REF string, ALT string, QUAL string, FILTER string, INFO string"
)
FILTERED_VARIANTS = (
    "locus string, alleles string, variant string, n_called int, n_not_called int, AC string, "
    "AF string, n_non_ref int, n_het int"
)
SAMPLE_FLAGS = "s string, project string, sample string, is_forbidden boolean"
ASSOCIATIONS = (
    "Condition string, Trait string, Gene string, type string, subset string, "
    "additional_covariates string, PVALUE double, BETA double, SEBETA double"
)
CARRIERS = "SubjectID string, Variant string, Gene string, ClinVarOrLOF string"
LOF_CURATED_COLUMNS = {"Variant": "string", "Variant_b37": "string", "GeneSymbol": "string",
                       "Level": "string", "Notes": "string"}
FREQUENCIES_COLUMNS = {"locus": "string", "alleles": "string",
                       "gnomad_exomes_popmax_AF": "double", "gnomad_exomes_AC": "int",
                       "gnomad_exomes_52K_adj_AC": "int"}
ALIGNMENT_BLOCKS = (
    "src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string"
)
TRANSCRIPT_EXPRESSION = "gene string, transcript string, tissue string, value double"
