"""Type names, relation names, word lists and patterns of the terminology and of clinical shorthand.

Everything here must equal the established values for results to agree; it is data, in natural order.
"""

from __future__ import annotations

# --- fixed values: term types, in order of preference -------------------------------------------------------------
TARGET_TYPES = ("SBD", "SCD", "GPCK", "BPCK", "BN", "SCDC", "IN", "PIN", "MIN")
NON_DRUG_TYPES = ("DF", "DFG", "SCDG", "SBDG", "SCDF", "SBDF")
BRAND_TYPES = ("BN", "SBD", "BPCK")

# --- fixed values: relations, as pairs of a name and its inverse ---------------------------------------------------
RELATION_PAIRS = {
    "consists": ("consists_of", "constitutes"),
    "tradename": ("has_tradename", "tradename_of"),
    "ingredient": ("has_ingredient", "ingredient_of"),
    "ingredients": ("has_ingredients", "ingredients_of"),
    "part": ("has_part", "part_of"),
    "contains": ("contains", "contained_in"),
    "isa": ("isa", "inverse_isa"),
    "form": ("has_form", "form_of"),
    "quantified": ("has_quantified_form", "quantified_form_of"),
    "precise": ("has_precise_ingredient", "precise_ingredient_of"),
}


def relations(pairs: str) -> list[str]:
    return [name for pair in pairs.split() for name in RELATION_PAIRS[pair]]


TARGET_RELATIONS = {
    "SBD": relations("consists tradename ingredient ingredients part contains isa form quantified"),
    "SCD": relations("consists tradename ingredient ingredients part contains isa form quantified"),
    "GPCK": relations("consists ingredients part contains"),
    "BPCK": relations("consists ingredients part contains"),
    "BN": relations("consists tradename ingredient"),
    "SCDC": relations("consists ingredient form precise"),
    "IN": relations("consists tradename ingredient part form precise"),
    "PIN": relations("consists tradename ingredient form precise"),
    "MIN": relations("consists ingredient ingredients part contains"),
}
DIRECT_INGREDIENT_RELATIONS = relations("ingredient ingredients part form precise")
BRIDGE_RELATIONS = relations("consists tradename ingredient contains form")
SECOND_HOP_RELATIONS = relations("consists part contains")
SECOND_HOP_TYPES = ("SBD", "SCD", "BN", "GPCK", "BPCK")

# --- fixed values: characters that look like ASCII ones --------------------------------------------------------------
CONFUSABLE_FROM = "∕／⁄÷øØðÐłŁυΥαΑβΒοΟρΡеЕаАсСрРхХкК"
CONFUSABLE_TO = "////oOdDlLuUaAbBoOpPeEaAcCpPxXkK"

# --- fixed values: words ---------------------------------------------------------------------------------------------
CONTEXT_WORDS = (
    "po oral iv im sq sc subcutaneous daily nightly bid tid qid qd qhs prn qod continue med start meds medications take takes "
    "tablet capsule tab cap pill and with for x7d x10d hfa mdi inh inhaler spray aerosol er xr ec"
).split()
STRENGTH_UNITS = "mg mcg g ml unit units meq pct percent".split()
NON_DRUG_TERMS = ("pill", "sugar pill", "cholesterol", "lactate", "water")
TOKEN_REPLACEMENTS = {
    "losrtan": "losartan",
    "liptor": "lipitor",
    "atorvstatin": "atorvastatin",
    "atorvststin": "atorvastatin",
    "carvadiol": "carvedilol",
    "furosemid": "furosemide",
    "albterol": "albuterol",
    "albutrol": "albuterol",
    "amxclv": "amoxicillin clavulanate",
    "amoxclv": "amoxicillin clavulanate",
    "amoxclav": "amoxicillin clavulanate",
    "hctz": "hydrochlorothiazide",
    "asa": "aspirin",
    "apap": "acetaminophen",
    "oxyapap": "acetaminophen oxycodone",
    "pred": "prednisone",
    "traz": "trazodone",
    "trazadone": "trazodone",
    "glipzide": "glipizide",
    "inslin": "insulin",
    "duoneb": "albuterol ipratropium",
    "norepi": "norepinephrine",
    "levophed": "norepinephrine",
    "dex": "dexmedetomidine",
    "vanc": "vancomycin",
    "zosyn": "piperacillin tazobactam",
}
DENSE_LINE_TERMS = {
    "dexmedetomidine": "dexmedetomidine",
    "metoprolol": "metoprolol",
    "lisinopril": "lisinopril",
    "metformin": "metformin",
    "glyburide": "glyburide",
    "atorvastatin": "atorvastatin",
    "rosuvastatin": "rosuvastatin",
    "propofol": "propofol",
    "fentanyl": "fentanyl",
    "prednisone": "prednisone",
    "heparin": "heparin",
    "eliquis": "eliquis",
    "apixaban": "apixaban",
    "vanc": "vancomycin",
    "vancomycin": "vancomycin",
    "zosyn": "zosyn",
    "norepi": "norepinephrine",
    "dex": "dexmedetomidine",
}
FORM_HINTS = {
    "inhaler": ("inhaler", "hfa", "mdi", "actuat", "metered dose", "aerosol", "spray"),
    "dry_powder": ("dry powder", "diskus"),
    "tablet": ("tablet", "tab", "oral tablet"),
    "capsule": ("capsule", "cap"),
    "solution": ("solution", "soln"),
    "suspension": ("suspension",),
    "injection": ("inject", "injection", "intravenous", "subcutaneous", "intramuscular", "iv", "ivp", "ivpb", "gtt", "drip", "infusion"),
    "dr": ("delayed release", "dr"),
    "xl24": ("xl", "24 hr"),
    "cream": ("cream",),
    "ointment": ("ointment",),
    "patch": ("patch", "transdermal"),
    "sublingual": ("sublingual",),
    "nasal": ("nasal",),
    "ophthalmic": ("ophthalmic", "eye"),
    "otologic": ("otic", "ear"),
    "er": ("extended release", "er", "xr", "xl", "sr", "24 hr", "12 hr"),
    "ec": ("enteric", "ec"),
}
IV_ROUTES = ("iv", "ivp", "ivpb", "intravenous")
ORAL_ROUTES = ("po", "oral")

# --- fixed values: patterns ------------------------------------------------------------------------------------------
TOKEN = r"[A-Za-z0-9]+(?:[+/%_-][A-Za-z0-9]+)*(?:\.[A-Za-z0-9]+)*"
NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"mg|mcg|g|ml|units?|meq|%"
STRENGTH = rf"\b{NUMBER}\s*(?:{UNIT})\b(?!\s*(?:/|per)\s*(?:dl|l|ml|kg|m2|hr|h)\b)"
RATIO_STRENGTH = rf"\b({NUMBER})\s*(?:[-/]|to|\s+)\s*({NUMBER})\s*({UNIT})\b"
SINGLE_STRENGTH = rf"\b({NUMBER})\s*({UNIT})\b"
SLASH_RATIO = rf"\b({NUMBER})\s*/\s*({NUMBER})\b"
BARE_NUMBER = rf"\b{NUMBER}\b"
SCHEDULE = r"\b(?:daily|qd|qam|qhs|bid|tid|qid|nightly|weekly|monthly|q\d+h)\b"
CONTINUOUS = r"\b(?:gtt|drip|infusion|cont|continuous)\b"
INFUSION_RATE = r"\b(?:mcg|mg|u|unit|units)\s*(?:/|\s+)?\s*(?:kg\s*(?:/|\s+)?\s*h(?:r)?|kgh?r)\w*"
UNITS_PER_KG_HOUR = rf"\b{NUMBER}\s*(?:u|unit|units)\s*(?:/|\s+)\s*kg\s*(?:/|\s+)\s*h(?:r)?\b"
SEGMENT_BREAKS = (r"\?", "!", ";", ":", r"\+", r"\bbut\b", r"\bplus\b")
ORAL_ROUTE = r"\b(?:po|oral)\b"
IV_ROUTE = r"\b(?:iv|ivp|ivpb|intravenous)\b"
CONTINUOUS_SCHEDULES = ("cont", "continuous")
PER_UNIT = r"\b(?:kg|hr|h|min|sec)\b"
SOLID_FORMS = ("tablet", "capsule", "er", "ec", "xl24", "oral")
XML_VALUE = r"""value\s*=\s*(['"])(.*?)\1"""
BRACKETED = r"[\(\[]([^)\]]{2,60})[\)\]]"
NEGATION_CUES = "no|denies|deny|denied|without|not taking|not on|off|hold|held|stop|stopped|discontinue|discontinued|allergic to|allergy to"
NEGATION_BREAK_WORDS = "but however though although except".split()
NEGATION_BREAKS = rf"\b(?:{'|'.join(NEGATION_BREAK_WORDS)})\b"
LATE_NEGATIONS = "held|stopped|discontinued"
