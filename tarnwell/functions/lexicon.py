"""Injectable domain tables.  They are data: pass others for another domain."""

from __future__ import annotations

SYMBOLS = {"–": "-", "—": "-", "‐": "-", "“": '"', "”": '"', "’": "'", "•": "-", "…": "..."}
COMMON_WORDS = ["the", "and", "with", "for", "that", "should", "patients", "people", "women", "was", "after", "from", "than", "treatment"]
TOPICS = {
    "pregnancy": r"pregnan|gestation|conception|breastfeed",
    "blood_pressure": r"blood pressure|hypertens|mmhg",
    "anaemia": r"anaemia|haemoglobin|ferritin|transferrin",
    "kidney_function": r"egfr|creatinine|cystatin|filtration",
    "proteinuria": r"albumin|proteinuria|urinary protein",
    "diet": r"diet|protein intake|sodium|low-protein",
    "potassium": r"potassium|hyperkalaemia",
    "dialysis": r"dialysis",
    "transplant": r"transplant|graft",
    "stones": r"stones|uropathy",
}
#: triggers in a query and the terms that they add
EXPANSIONS = {
    "egfr": ["glomerular", "filtration", "rate"],
    "albumin": ["albuminuria", "acr", "proteinuria"],
    "blood pressure": ["hypertension", "mmhg", "systolic"],
    "potassium": ["hyperkalaemia", "electrolytes"],
    "pregnan": ["gestational", "conception", "teratogenic"],
    "ferritin": ["iron", "anaemia"],
    "dialysis": ["kidney", "replacement"],
    "stop": ["discontinue", "suspend"],
}
#: how texts name the quantities of claims, as patterns for lower-case text
QUANTITIES = {
    "acr": [r"\bacr\b", "albumin", r"mg ?/ ?(?:mmol|g)\b"],
    "egfr": ["gfr", "filtration", r"ml ?/ ?min"],
    "ferritin": ["ferritin", r"ng ?/ ?ml"],
    "haemoglobin": ["ha?emoglobin", r"\bhb\b", r"\bg ?/ ?l\b"],
    "kidney_failure_risk": ["kidney failure", "risk of failure"],
    "potassium": ["potassium", "hyperkal", r"mmol ?/ ?l"],
    "protein_intake": ["protein intake", "dietary protein", r"g ?/ ?kg"],
    "systolic_blood_pressure": ["systolic", "blood pressure", r"mm ?hg"],
}
#: multiplicative priors by kind of chunk
TYPE_PRIOR = {"recommendation_atom": 1.15, "practice_point": 1.10, "table_row": 1.05, "section_passage": 1.0, "figure_caption": 0.9, "appendix_passage": 0.85}
#: quality rules of texts: name, pattern
APPARATUS = {
    "dot_leaders": r"\.{4,}",
    "markup": r"</?[a-z]+>",
    "copyright": r"©|all rights reserved",
    "reference_list": r"doi:|et al\.",
    "unfilled": r"lorem ipsum|\bTODO\b",
    "line_break_hyphen": r"[a-z]-\n[a-z]",
}
GENRES = {"greeting": r"^(hello|hi|hey|thanks)\b", "meta": r"^(who are you|what can you)", "request": r"^(please |write |translate )"}
SCOPES = {
    "pregnancy": r"pregnan|breastfeed|gestation",
    "paediatric": r"child|adolescent|paediatric",
    "transplant": r"transplant",
    "dosing": r"\bdose|dosage|mg per day",
}
DOMAIN = r"kidney|renal|egfr|creatinine|albumin|dialysis|protein|potassium|haemoglobin|ferritin|pressure|urin|neph"
#: questions that are refused, in this order, and what lifts the first
REFUSED = {"emergency": r"unconscious|collaps|chest pain|seizure|bleeding heavily", "self_harm": r"kill myself|overdose on purpose", "record": r"my (?:test )?results|my record"}
POST_ACUTE = r"after (?:the )?(?:discharge|recovery|emergency)|has recovered|last (?:week|month|year)|follow-up"
SPECIALTIES = r"fracture|cataract|asthma|eczema|migraine"
#: kinds of chunks that may be quoted
QUOTABLE = ["recommendation_atom", "practice_point", "table_row", "section_passage"]
