"""Closed vocabularies that results must agree on, as plain values."""

#: Words for relations and the relation type each stands for; any other is associated_with.
RELATION_TYPES = {
    "activates": "activates", "activate": "activates", "activation": "activates", "stimulates": "activates", "upregulates": "activates", "up_regulates": "activates", "increases": "activates",
    "inhibits": "inhibits", "inhibit": "inhibits", "inhibition": "inhibits", "suppresses": "inhibits", "downregulates": "inhibits", "down_regulates": "inhibits", "decreases": "inhibits", "blocks": "inhibits",
    "associated_with": "associated_with", "associates_with": "associated_with", "association": "associated_with", "related_to": "associated_with", "linked_to": "associated_with",
    "regulates": "regulates", "regulate": "regulates", "regulation": "regulates", "modulates": "regulates", "controls": "regulates",
    "binds_to": "binds_to", "binds": "binds_to", "binding": "binds_to",
    "interacts_with": "interacts_with", "interacts": "interacts_with", "interaction": "interacts_with",
    "cooccurs_with": "cooccurs_with", "co_occurs_with": "cooccurs_with", "cooccurrence": "cooccurs_with",
    "hypothesized": "hypothesized", "predicted": "hypothesized",
}
#: Relation types that an extractor may name; any other is associated_with.
EXTRACTED_TYPES = ("activates", "inhibits", "associated_with", "regulates", "binds_to", "cooccurs_with")
#: Words for entity types and the type each stands for.
ENTITY_TYPES = {
    "gene": "gene", "protein": "protein", "disease": "disease", "chemical": "chemical", "drug": "chemical", "compound": "chemical", "species": "species", "organism": "species", "cellline": "cell_line", "cell_line": "cell_line",
    "mutation": "mutation", "variant": "mutation", "snp": "mutation", "pathway": "pathway", "biological_process": "pathway", "molecular_function": "pathway", "cellular_component": "pathway",
}
#: Names of entities and their synonyms.
SYNONYMS_OF = {
    "HCRTR1": ["ox1r", "ox-1r", "ox 1r", "orexin receptor 1", "orexin receptor type 1", "orexin-1 receptor", "hcrtr-1"],
    "HCRTR2": ["ox2r", "ox-2r", "ox 2r", "orexin receptor 2", "orexin receptor type 2", "orexin-2 receptor", "hcrtr-2"],
    "HCRT": ["orexin", "orexins", "orexin a", "orexin b", "orexin-a", "orexin-b", "hypocretin", "hypocretins", "hcrt/orexin", "orexin/hcrt", "prepro-orexin", "preproorexin", "hcrt"],
    "APP": ["amyloid beta", "amyloidbeta", "amyloid-beta", "amyloid-β", "aβ", "abeta", "a-beta", "beta-amyloid", "β-amyloid", "beta amyloid", "amyloid beta peptide", "amyloid beta protein", "amyloid precursor protein", "amyloid-beta peptide", "aβ peptide", "aβ42", "aβ40", "abeta42", "abeta40"],
    "MAPT": ["tau", "tau protein", "microtubule-associated protein tau", "microtubule associated protein tau", "p-tau", "ptau", "phospho-tau", "phosphorylated tau", "hyperphosphorylated tau", "tau tangles", "neurofibrillary tangles"],
    "APOE": ["apoe", "apoe4", "apoe ε4", "apoe epsilon4", "apoe epsilon 4", "apoe-ε4", "apoe-4", "apoe3", "apoe2", "apolipoprotein e", "apolipoprotein e4", "apo e", "apo-e"],
    "Alzheimer disease": ["alzheimer's disease", "alzheimers disease", "alzheimer", "alzheimers", "ad"],
    "Parkinson disease": ["parkinson's disease", "parkinsons disease", "parkinson", "pd"],
    "Huntington disease": ["huntington's disease", "huntingtons disease", "huntington", "hd"],
    "alpha-tocopherol": ["vitamin e", "vit e", "tocopherol"],
    "BRCA1": ["brca-1", "brca 1"],
    "BRCA2": ["brca-2", "brca 2"],
    "INSR": ["insulin receptor", "ir"],
    "IGF1R": ["igf-1r", "igf1 receptor", "igf-1 receptor"],
    "TREM2": ["trem-2", "triggering receptor expressed on myeloid cells 2"],
    "GSK3B": ["gsk-3β", "gsk-3b", "gsk3β", "gsk3 beta", "glycogen synthase kinase 3 beta"],
}
SYNONYMS = {word: name for name, words in SYNONYMS_OF.items() for word in words}
