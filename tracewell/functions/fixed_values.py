"""Fixed values.

Word lists, lookup tables, cut-offs and patterns that decide results. They are
data, not logic: every operator takes them as arguments and uses these as the
defaults.
"""

# --- drugs ------------------------------------------------------------------
SPECIFIC_ANTIDOTES = {
    "naloxone": "opioid oversedation",
    "flumazenil": "benzodiazepine oversedation",
    "protamine": "heparin over-anticoagulation",
    "idarucizumab": "dabigatran reversal",
    "andexanet": "factor Xa inhibitor reversal",
    "digoxin immune fab": "digoxin toxicity",
    "dantrolene": "malignant hyperthermia",
}

CONTEXT_REVERSAL_AGENTS = {
    "phytonadione": "warfarin reversal, or routine vitamin K repletion",
    "vitamin k": "warfarin reversal, or routine vitamin K repletion",
    "glucagon": "hypoglycemia rescue, or a motility agent for imaging",
    "dextrose 50": "hypoglycemia rescue, or protocol glucose replacement",
    "d50": "hypoglycemia rescue, or protocol glucose replacement",
    "acetylcysteine": "acetaminophen toxicity, or a mucolytic",
    "calcium gluconate": "hyperkalemia rescue, or calcium repletion",
    "sodium polystyrene": "hyperkalemia rescue, or routine potassium binding",
    "sugammadex": "residual blockade, but used routinely at the end of anesthesia",
}

BLOOD_PRODUCT_TERMS = [
    "transfus",
    "prbc",
    "packed red",
    "packed rbc",
    "whole blood",
    "fresh frozen plasma",
    "cryoprecipitate",
    "platelets",
]

# --- units, procedures, calls -----------------------------------------------
ESCALATION_UNIT_TERMS = [
    "icu",
    "intensive",
    "ccu",
    "coronary care",
    "step-down",
    "stepdown",
    "neuro intermediate",
]

REOPERATION_TERMS = [
    "reopening of",
    "reclosure",
    "control bleeding",
    "control of hemorrhage",
    "re-exploration",
    "reexploration",
    "evacuation of hematoma",
]

OPERATING_PLACE_TERMS = [
    "operating room",
    " or ",
    "reoperation",
    "re-operation",
    "surgery",
    "washout",
]

UNPLANNED_TERMS = [
    "unplanned",
    "emergent",
    "return to",
    "takeback",
    "take-back",
    "unscheduled",
]

RAPID_RESPONSE_TERMS = ["rapid response", "code blue"]

# --- labs: name -> (direction, abnormal cut, critical cut) -------------------
LAB_RULES = {
    "hemoglobin": ("low", 9.0, 7.0),
    "hgb": ("low", 9.0, 7.0),
    "platelets": ("low", 100.0, 50.0),
    "glucose": ("low", 70.0, 50.0),
    "creatinine": ("high", 1.5, 2.5),
    "potassium": ("high", 5.5, 6.5),
    "lactate": ("high", 2.5, 4.0),
    "inr": ("high", 3.0, 4.5),
    "troponin": ("high", 0.04, 0.50),
    "wbc": ("high", 12.0, 18.0),
    "bilirubin": ("high", 2.0, 5.0),
    "alt": ("high", 120.0, 400.0),
}

HEMOGLOBIN_DROP = 2.0
CREATININE_RATIO = 2.0

TRIGGER_MEANINGS = {
    "antidote_given": "A specific antidote was administered",
    "antidote_after_treatment_start": "Antidote given after our treatment began, not on arrival",
    "context_dependent_reversal_agent": "A reversal agent that also has routine uses was given",
    "unplanned_icu_transfer": "Unplanned transfer to a higher level of care",
    "repeat_icu_escalation": "Escalated to intensive care more than once in one stay",
    "unplanned_return_to_or": "Unplanned return to the operating room",
    "readmission_30d": "Readmission within 30 days of discharge",
    "rapid_response_called": "Rapid response or code team activated",
    "transfusion_given": "Blood product transfused",
    "abnormal_post_treatment_lab": "Abnormal lab drawn after treatment began",
    "critical_post_treatment_lab": "Critically abnormal lab drawn after treatment began",
    "hemoglobin_drop": "Hemoglobin fell 2 g/dL or more between draws",
    "creatinine_doubled": "Creatinine at least doubled from baseline (AKI pattern)",
    "abnormal_lab_types_count": "How many distinct lab types were abnormal after treatment",
}

# --- note language ----------------------------------------------------------
PROCESS_FAILURE_TERMS = [
    "wrong dose",
    "wrong site",
    "wrong patient",
    "wrong medication",
    "wrong concentration",
    "duplicate dose",
    "order entry",
    "omitted dose",
    "missed dose",
    "failure to",
    "delay in",
    "delayed recognition",
    "not recognized",
    "inadvertent",
    "inadvertently",
    "accidental",
    "unintended",
    "unintentional",
    "retained",
    "iatrogenic",
    "preventable",
    "avoidable",
    "should have been",
    "medication error",
    "documented but",
]

DETERIORATION_TERMS = [
    "worsening",
    "deteriorat",
    "decompensat",
    "acute distress",
    "hemodynamically unstable",
    "required intubation",
    "reintubat",
    "respiratory arrest",
    "cardiac arrest",
    "code blue",
    "rapid response",
    "hemorrhag",
    "sepsis",
    "septic",
    "obtunded",
    "unresponsive",
    "hypoxic",
    "hypoxemia",
    "emergent",
    "took a turn for the worse",
    "abrupt turn",
]

NEGATION_CUES = [
    "no ",
    "not ",
    "non",
    "without",
    "denies",
    "denied",
    "negative for",
    "ruled out",
    "r/o",
    "free of",
    "absence of",
    "no evidence of",
    "resolved",
]

STOP_WORDS = (
    "a an the and or of to in on at for with by from as that this these those it its "
    "was were is are be been being am do does did has have had he she his her they "
    "them their we our you your i patient patients pt"
).split()

SENTENCE_BREAK = r"(?<=[.!?;])\s+|\n+"
CLAUSE_BREAK = r",|\bbut\b|\bhowever\b|\balthough\b|\bwhereas\b"
TOKEN = r"(?U)\w\w+"

FRAMING_CLASSES = ["expected_risk", "neutral", "unanticipated"]
FRAMING_CONFIDENCE = 0.45

EXPECTED_CUES = [
    "known risk",
    "known complication",
    "anticipated",
    "expected",
    "consent",
    "counseled",
    "typical",
    "common",
    "within normal limits",
    "per protocol",
    "planned",
    "scheduled",
    "natural history",
    "recognized",
    "complication rate",
    "reviewed with",
    "discussed",
]

UNANTICIPATED_CUES = [
    "did not anticipate",
    "not anticipate",
    "not anticipated",
    "unanticipated",
    "unexpected",
    "not predicted",
    "not consistent with the expected",
    "not part of the expected",
    "out of proportion",
    "out of keeping",
    "should have been",
    "went wrong",
    "surprised",
    "abrupt turn",
    "turn for the worse",
    "inadvertent",
    "unintended",
    "avoidable",
    "preventable",
    "iatrogenic",
    "retained",
    "failure to",
    "delay in",
    "duplicate dose",
    "wrong ",
    "error",
]

NOTE_MEANINGS = {
    "note_unanticipated_language": "Note language framed as unanticipated / not supposed to happen",
    "note_expected_risk_language": "Note language framing the event as a known, consented risk",
    "note_max_unanticipated_prob": "Strongest unanticipated-framing sentence in the chart",
    "note_framing_margin": "Unanticipated framing minus expected-risk framing",
    "note_explicit_error_language": "Explicit process failure wording (wrong dose, delay, failure to)",
    "note_harm_state_language": "Clinical deterioration wording, negation-aware",
    "note_negated_harm_mentions": "Harm words that were explicitly negated (ruled out, no evidence of)",
}

# --- hospital extract headers and names ---------------------------------------
ENCOUNTER_ALIASES = ["encounter_id", "pat_enc_csn_id", "csn", "visit_id", "encounter", "hadm_id"]

FIELD_ALIASES = {
    "stays": {
        "encounter_id": ENCOUNTER_ALIASES,
        "age": ["age"],
        "sex": ["sex", "gender"],
        "admitted": ["admitted", "hosp_admsn_time", "admit_time", "admission_time", "start"],
        "discharged": ["discharged", "hosp_disch_time", "discharge_time", "disch_time", "stop"],
    },
    "labs": {
        "encounter_id": ENCOUNTER_ALIASES,
        "time": ["time", "date", "result_time", "taken_time", "observation_time"],
        "name": ["name", "component_name", "lab_name", "description", "test"],
        "value": ["value", "ord_value", "result", "numeric_value"],
        "units": ["units", "unit"],
    },
    "meds": {
        "encounter_id": ENCOUNTER_ALIASES,
        "time": ["time", "date", "taken_time", "start", "administered_at"],
        "name": ["name", "medication_name", "drug", "description", "med"],
    },
    "transfers": {
        "encounter_id": ENCOUNTER_ALIASES,
        "time": ["time", "date", "effective_time", "start"],
        "to_unit": ["to_unit", "department_name", "unit", "ward", "department"],
    },
}

REQUIRED_FIELDS = {
    "stays": ["encounter_id", "admitted"],
    "labs": ["encounter_id", "time", "name", "value"],
    "meds": ["encounter_id", "time", "name"],
    "transfers": ["encounter_id", "time", "to_unit"],
}

NAME_SYNONYMS = {
    "narcan": "Naloxone",
    "naloxone hcl": "Naloxone",
    "naloxone hydrochloride": "Naloxone",
    "creat": "Creatinine",
    "creatinine serpl": "Creatinine",
    "wbc count": "WBC",
    "white blood cell": "WBC",
    "lactate venous": "Lactate",
    "lactic acid": "Lactate",
}

# --- admission dataset --------------------------------------------------------
ICU_UNIT_TERMS = [
    "intensive care",
    "icu",
    "ccu",
    "coronary care",
    "neuro stepdown",
    "neuro intermediate",
]
PLANNED_ROUTE_TERMS = ["emergency department", "pacu", "discharge lounge"]

LAB_LABELS = {
    "Hemoglobin": "Hemoglobin",
    "Creatinine": "Creatinine",
    "Potassium": "Potassium",
    "Lactate": "Lactate",
    "INR(PT)": "INR",
    "Platelet Count": "Platelets",
    "White Blood Cells": "WBC",
    "Glucose": "Glucose",
    "Bilirubin, Total": "Bilirubin",
    "Alanine Aminotransferase (ALT)": "ALT",
    "Troponin T": "Troponin",
}

GIVEN_STATUSES = ["Administered", "Administered in Other Location", "Started"]
BLOOD_CATEGORY = "Blood Products/Colloids"
BLOOD_EXCLUDED_TERMS = ["consent", "autologous"]

# Complication-of-care code families, per code version.
COMPLICATION_CODES = {
    10: r"^(T8[0-8]|Y6[2-9]|Y7\d|Y8[0-4])",
    9: r"^(99[6-9]|E87[0-9]|E9[3-4]\d)",
}

READMISSION_DAYS = 30
TIME_COLUMN_ENDINGS = ("time", "date")
TIME_COLUMN_NAMES = ("dod",)

# --- encounter warehouse --------------------------------------------------------
HARM_CONDITIONS = [
    "Postoperative hemorrhage",
    "Hospital-acquired surgical site infection",
    "Severe iatrogenic hypoglycemia",
    "Acute kidney injury due to contrast and medication",
    "Warfarin coagulopathy / adverse bleeding",
    "Benzodiazepine oversedation / toxic encephalopathy",
    "Adverse reaction to anticoagulant therapy",
    "Accidental puncture or laceration during a procedure",
    "Opioid oversedation and respiratory depression",
    "Severe hyperkalemia with cardiac toxicity",
]

# --- review and measures ---------------------------------------------------------
DECISIONS = ["harm", "no_harm", "unclear"]
STALE_DAYS = 7
DEFAULT_REASON = "Flagged for a second look"
REVIEW_CAPACITIES = [10, 25, 50, 100, 200]
SWEEP_CUTS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
              0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
FLAG_THRESHOLD = 0.4
MIN_SUPPORT = 30
SEPARATION_TOLERANCE = 0.995
GIVEAWAY_PURITY = 0.98
WEAK_MIN_CASES = 5
TARGET_PREVALENCE = 0.10

# --- counterfactual evidence -------------------------------------------------------
SILENT_SHARE = 0.45
DARK_SHARE = 0.15
BENIGN_SHARE = 0.18
SIDE_PROCEDURE_RATE = 0.85
SIDE_LAB_RATE = 0.45
# Hours after the start of the stay, lowest and highest.
MED_DELAY = (4, 30)
PROCEDURE_DELAY = (2, 20)
LAB_DELAY = (6, 40)

SIGNATURE_MEDS = [
    "Packed Red Blood Cells (PRBC)",
    "Vancomycin 1g",
    "Dextrose 50% Injectable Solution",
    "Sodium bicarbonate 8.4%",
    "Phytonadione 10 MG/ML Injectable Solution",
    "Flumazenil 0.1 MG/ML Injectable Solution",
    "Protamine Sulfate 10 MG/ML Injectable Solution",
    "Naloxone 0.4 MG/ML Injectable Solution",
    "Cefazolin 1g",
    "Calcium gluconate 10% IV Solution",
]

SIGNATURE_PROCEDURES = [
    "Reopening of recent laparotomy site to control hemorrhage",
    "Incision and drainage of wound infection",
    "Intravenous catheter insertion",
    "Hemodialysis catheter placement",
    "Control of hemorrhage",
    "Bag-valve mask ventilation",
    "Endoscopic control of gastric bleeding",
    "Emergency endotracheal intubation",
    "Repair of accidental surgical laceration",
    "Continuous cardiac monitoring",
]

EXPLAINED_MEDS = [
    ("Naloxone 0.4 MG/ML Injectable Solution",
     "Reversal of procedural sedation at end of endoscopy; patient recovered uneventfully."),
    ("Protamine Sulfate 10 MG/ML Injectable Solution",
     "Routine heparin reversal at separation from cardiopulmonary bypass."),
    ("Phytonadione 10 MG/ML Injectable Solution",
     "Nutritional vitamin K repletion for prolonged poor oral intake."),
    ("Calcium gluconate 10% IV Solution",
     "Scheduled calcium repletion for hypocalcaemia of chronic kidney disease."),
    ("Dextrose 50% Injectable Solution",
     "Protocol treatment of asymptomatic hypoglycaemia; resolved, no sequelae."),
    ("Packed Red Blood Cells (PRBC)",
     "Elective transfusion for chronic symptomatic anaemia."),
    ("Flumazenil 0.1 MG/ML Injectable Solution",
     "Reversal of midazolam after planned sedation; expected and documented."),
    ("Cefazolin 1g",
     "Standard single-dose surgical antibiotic prophylaxis on induction."),
    ("Vancomycin 1g",
     "Surgical prophylaxis for a penicillin-allergic patient with MRSA colonisation."),
    ("Sodium bicarbonate 8.4%",
     "Correction of chronic metabolic acidosis of established kidney disease."),
]

EXPLAINED_PROCEDURES = [
    ("Intravenous catheter insertion", "Routine peripheral access for scheduled infusion."),
    ("Continuous cardiac monitoring", "Standard telemetry for an observation admission."),
    ("Emergency endotracheal intubation",
     "Planned airway management for elective general anaesthesia."),
    ("Bag-valve mask ventilation", "Pre-oxygenation during planned induction of anaesthesia."),
    ("Reopening of recent laparotomy site to control hemorrhage",
     "Planned second-look laparotomy after staged damage-control surgery; no new bleeding found."),
    ("Control of hemorrhage",
     "Expected intraoperative haemostasis during a scheduled resection."),
    ("Endoscopic control of gastric bleeding",
     "Elective endoscopic banding of known varices; prophylactic, no acute bleed."),
    ("Repair of accidental surgical laceration",
     "Planned repair of a deliberate serosal incision made for exposure."),
    ("Incision and drainage of wound infection",
     "Scheduled drainage of a pre-existing chronic abscess present on admission."),
    ("Hemodialysis catheter placement",
     "Elective access placement for maintenance dialysis in established renal failure."),
]

EXPLAINED_LABS = [
    ("Hemoglobin", "6.8", "g/dL"),
    ("Creatinine", "2.7", "mg/dL"),
    ("Potassium", "6.6", "mmol/L"),
    ("Glucose", "48", "mg/dL"),
    ("INR", "4.7", "{INR}"),
]
