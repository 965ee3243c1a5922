"""Controlled vocabularies. Results depend on exactly these words and codes."""

FORMS = {
    "tab": "tablet", "tabs": "tablet", "tablet": "tablet", "tablets": "tablet", "chewable tablet": "tablet",
    "cap": "capsule", "caps": "capsule", "capsule": "capsule", "capsules": "capsule",
    "liquid": "liquid", "cream": "cream", "ointment": "ointment", "gel": "gel",
    "solution": "solution", "suspension": "suspension", "inhaler": "inhaler", "spray": "spray",
    "drop": "drops", "drops": "drops", "patch": "patch", "patches": "patch",
    "injection": "injection", "injectable": "injection",
    "suppository": "suppository", "suppositories": "suppository",
    "powder": "powder", "lozenge": "lozenge", "lozenges": "lozenge",
}

QUANTITY_UNITS = {
    "tab": "tablet", "tabs": "tablet", "tablet": "tablet", "tablets": "tablet",
    "cap": "capsule", "caps": "capsule", "capsule": "capsule", "capsules": "capsule",
    "ml": "ml", "milliliter": "ml", "milliliters": "ml", "millilitre": "ml", "millilitres": "ml",
    "g": "g", "gram": "g", "grams": "g", "patch": "patch", "patches": "patch",
    "inhaler": "inhaler", "inhalers": "inhaler", "vial": "vial", "vials": "vial",
    "syringe": "syringe", "syringes": "syringe", "pen": "pen", "pens": "pen",
    "ampule": "ampule", "ampules": "ampule", "ampoule": "ampule", "ampoules": "ampule",
    "suppository": "suppository", "suppositories": "suppository",
    "lozenge": "lozenge", "lozenges": "lozenge", "dose": "dose", "doses": "dose",
}

STRENGTH_UNITS = {
    "mcg": "mcg", "ug": "mcg", "μg": "mcg", "µg": "mcg", "microgram": "mcg", "micrograms": "mcg",
    "mg": "mg", "milligram": "mg", "milligrams": "mg", "g": "g", "gram": "g", "grams": "g",
    "ml": "ml", "milliliter": "ml", "milliliters": "ml", "millilitre": "ml", "millilitres": "ml",
    "l": "l", "liter": "l", "liters": "l", "litre": "l", "litres": "l",
    "u": "units", "unit": "units", "units": "units",
    "iu": "iu", "international unit": "iu", "international units": "iu",
    "meq": "meq", "milliequivalent": "meq", "milliequivalents": "meq", "%": "percent", "percent": "percent",
}

UNIT_DISPLAY = {"ml": "mL", "l": "L", "iu": "IU", "meq": "mEq", "percent": "%"}

ROUTES = {
    "oral": "oral", "by mouth": "oral", "topical": "topical", "ophthalmic": "ophthalmic", "otic": "otic",
    "nasal": "nasal", "inhalation": "inhalation", "rectal": "rectal", "vaginal": "vaginal",
    "subcutaneous": "subcutaneous", "intramuscular": "intramuscular", "intravenous": "intravenous",
    "transdermal": "transdermal",
}

RELEASES = {
    "immediate": "immediate", "immediate release": "immediate", "ir": "immediate", "conventional": "immediate",
    "extended": "extended", "extended release": "extended", "er": "extended", "xr": "extended",
    "xl": "extended", "sr": "extended", "delayed": "delayed", "delayed release": "delayed", "dr": "delayed",
    "enteric coated": "delayed", "ec": "delayed",
    "not applicable": "not_applicable", "na": "not_applicable", "n a": "not_applicable",
}

SOLID_FORMS = ["tablet", "capsule", "lozenge"]

AVAILABILITIES = ["in_stock", "out_of_stock", "unknown"]
MATCH_STATUSES = ["unmatched", "verified", "needs_review"]
RUN_STATUSES = ["running", "succeeded", "partial", "failed", "interrupted"]
PAGE_TYPES = ["unknown", "directory", "product", "content", "policy", "ignored"]
PAGE_RESULTS = ["success", "failed", "blocked", "not_found"]

# Short forms printed on one seller's price panel.
PANEL_FORMS = {
    "tab": "tablet", "tabs": "tablet", "tablet": "tablet", "tablets": "tablet",
    "cap": "capsule", "caps": "capsule", "capsule": "capsule", "capsules": "capsule",
    "sol": "solution", "soln": "solution", "solution": "solution",
    "susp": "suspension", "suspension": "suspension", "cream": "cream", "crm": "cream",
    "ointment": "ointment", "oint": "ointment", "gel": "gel",
}

# Dose and form words that do not identify a drug in the reference list.
DOSAGE_WORDS = (
    r"\b(?:\d+(?:\.\d+)?|mg|mcg|g|gm|ml|iu|tablet|tablets|tab|tabs|capsule|capsules|cap|caps|cream|"
    r"solution|oral|topical|injection|inhaler|suspension|extended|immediate|release|xr|er|dr)\b"
)

MASS_TO_MG = {"mcg": "0.001", "mg": "1", "g": "1000"}
