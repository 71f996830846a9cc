"""The built-in terminology codes, and the fixed maps between system names, URIs and confidence words."""

from __future__ import annotations

# Code systems and their URIs.
SYSTEM_URIS = {
    "SNOMED-CT": "http://snomed.info/sct",
    "RxNorm": "http://www.nlm.nih.gov/research/umls/rxnorm",
    "LOINC": "http://loinc.org",
    "ICD-10-CM": "http://hl7.org/fhir/sid/icd-10-cm",
    "CPT": "http://www.ama-assn.org/go/cpt",
    "HCPCS": "https://www.cms.gov/Medicare/Coding/HCPCSReleaseCodeSets",
}

# The order in which systems are listed.
SYSTEMS = ("ICD-10-CM", "SNOMED-CT", "LOINC", "RxNorm", "CPT", "HCPCS")

# Confidence words as numbers; any other word is 0.5.
CONFIDENCE = {"high": 0.8, "medium": 0.6, "low": 0.4}

# Name, system, code, display, release (where one is pinned), confidence.
SEED: tuple[tuple[str, str, str, str, str | None, str], ...] = (
    ("hypertension", "ICD-10-CM", "I10", "Essential (primary) hypertension", "FY2026", "medium"),
    ("hypertension", "SNOMED-CT", "38341003", "Hypertensive disorder, systemic arterial", None, "medium"),
    ("type 2 diabetes mellitus", "ICD-10-CM", "E11.9", "Type 2 diabetes mellitus without complications", "FY2026", "low"),
    ("type 2 diabetes mellitus", "SNOMED-CT", "44054006", "Type 2 diabetes mellitus", None, "medium"),
    ("hyperlipidemia", "ICD-10-CM", "E78.5", "Hyperlipidemia, unspecified", "FY2026", "medium"),
    ("hyperlipidemia", "SNOMED-CT", "55822004", "Hyperlipidemia", None, "medium"),
    ("asthma", "ICD-10-CM", "J45.909", "Unspecified asthma, uncomplicated", "FY2026", "low"),
    ("asthma", "SNOMED-CT", "195967001", "Asthma", None, "medium"),
    ("chronic obstructive pulmonary disease", "ICD-10-CM", "J44.9", "Chronic obstructive pulmonary disease, unspecified", "FY2026", "low"),
    ("chronic obstructive pulmonary disease", "SNOMED-CT", "13645005", "Chronic obstructive lung disease", None, "medium"),
    ("coronary artery disease", "ICD-10-CM", "I25.10", "Atherosclerotic heart disease of native coronary artery without angina pectoris", "FY2026", "low"),
    ("coronary artery disease", "SNOMED-CT", "53741008", "Coronary arteriosclerosis", None, "medium"),
    ("congestive heart failure", "ICD-10-CM", "I50.9", "Heart failure, unspecified", "FY2026", "low"),
    ("congestive heart failure", "SNOMED-CT", "42343007", "Congestive heart failure", None, "medium"),
    ("chronic kidney disease", "ICD-10-CM", "N18.9", "Chronic kidney disease, unspecified", "FY2026", "low"),
    ("chronic kidney disease", "SNOMED-CT", "709044004", "Chronic kidney disease", None, "medium"),
    ("obstructive sleep apnea", "ICD-10-CM", "G47.33", "Obstructive sleep apnea (adult) (pediatric)", "FY2026", "medium"),
    ("obstructive sleep apnea", "SNOMED-CT", "78275009", "Obstructive sleep apnea syndrome", None, "medium"),
    ("obesity", "ICD-10-CM", "E66.9", "Obesity, unspecified", "FY2026", "low"),
    ("obesity", "SNOMED-CT", "414916001", "Obesity", None, "medium"),
    ("chest pain", "ICD-10-CM", "R07.9", "Chest pain, unspecified", "FY2026", "low"),
    ("chest pain", "SNOMED-CT", "29857009", "Chest pain", None, "medium"),
    ("shortness of breath", "ICD-10-CM", "R06.02", "Shortness of breath", "FY2026", "medium"),
    ("shortness of breath", "SNOMED-CT", "267036007", "Dyspnea", None, "medium"),
    ("cough", "ICD-10-CM", "R05.9", "Cough, unspecified", "FY2026", "medium"),
    ("fever", "ICD-10-CM", "R50.9", "Fever, unspecified", "FY2026", "medium"),
    ("fatigue", "ICD-10-CM", "R53.83", "Other fatigue", "FY2026", "medium"),
    ("dizziness", "ICD-10-CM", "R42", "Dizziness and giddiness", "FY2026", "medium"),
    ("nausea", "ICD-10-CM", "R11.0", "Nausea", "FY2026", "medium"),
    ("diarrhea", "ICD-10-CM", "R19.7", "Diarrhea, unspecified", "FY2026", "medium"),
    ("headache", "ICD-10-CM", "R51.9", "Headache, unspecified", "FY2026", "medium"),
    ("hemoglobin a1c", "LOINC", "4548-4", "Hemoglobin A1c/Hemoglobin.total in Blood", None, "high"),
    ("body mass index", "LOINC", "39156-5", "Body mass index (BMI) [Ratio]", None, "high"),
    ("blood pressure", "LOINC", "85354-9", "Blood pressure panel with all children optional", None, "high"),
    ("heart rate", "LOINC", "8867-4", "Heart rate", None, "high"),
    ("respiratory rate", "LOINC", "9279-1", "Respiratory rate", None, "high"),
    ("oxygen saturation", "LOINC", "59408-5", "Oxygen saturation in Arterial blood by Pulse oximetry", None, "medium"),
    ("body temperature", "LOINC", "8310-5", "Body temperature", None, "high"),
    ("body weight", "LOINC", "29463-7", "Body weight", None, "high"),
    ("comprehensive metabolic panel", "LOINC", "24323-8", "Comprehensive metabolic 2000 panel - Serum or Plasma", None, "medium"),
    ("complete blood count", "LOINC", "58410-2", "Complete blood count (hemogram) panel - Blood by Automated count", None, "medium"),
    ("basic metabolic panel", "LOINC", "51990-0", "Basic metabolic 2000 panel - Blood", None, "low"),
    ("liver function tests", "LOINC", "24325-3", "Hepatic function 2000 panel - Serum or Plasma", None, "low"),
    ("lipid panel", "LOINC", "24331-1", "Lipid panel - Serum or Plasma", None, "medium"),
    ("hemoglobin", "LOINC", "718-7", "Hemoglobin [Mass/volume] in Blood", None, "medium"),
    ("white blood cell count", "LOINC", "6690-2", "Leukocytes [#/volume] in Blood by Automated count", None, "medium"),
    ("platelet count", "LOINC", "777-3", "Platelets [#/volume] in Blood by Automated count", None, "medium"),
    ("thyroid stimulating hormone", "LOINC", "3016-3", "Thyrotropin [Units/volume] in Serum or Plasma", None, "medium"),
    ("creatinine", "LOINC", "2160-0", "Creatinine [Mass/volume] in Serum or Plasma", None, "medium"),
    ("estimated glomerular filtration rate", "LOINC", "33914-3", "Glomerular filtration rate/1.73 sq M.predicted", None, "low"),
    ("low density lipoprotein cholesterol", "LOINC", "13457-7", "Cholesterol in LDL [Mass/volume] in Serum or Plasma by calculation", None, "medium"),
    ("high density lipoprotein cholesterol", "LOINC", "2085-9", "Cholesterol in HDL [Mass/volume] in Serum or Plasma", None, "medium"),
    ("triglycerides", "LOINC", "2571-8", "Triglyceride [Mass/volume] in Serum or Plasma", None, "medium"),
    ("total cholesterol", "LOINC", "2093-3", "Cholesterol [Mass/volume] in Serum or Plasma", None, "medium"),
    ("major depressive disorder", "ICD-10-CM", "F32.9", "Major depressive disorder, single episode, unspecified", "FY2026", "low"),
    ("major depressive disorder", "SNOMED-CT", "370143000", "Major depressive disorder", None, "medium"),
    ("depression", "ICD-10-CM", "F32.A", "Depression, unspecified", "FY2026", "low"),
    ("depression", "SNOMED-CT", "35489007", "Depressive disorder", None, "low"),
    ("generalized anxiety disorder", "ICD-10-CM", "F41.1", "Generalized anxiety disorder", "FY2026", "medium"),
    ("generalized anxiety disorder", "SNOMED-CT", "21897009", "Generalized anxiety disorder", None, "medium"),
    ("anxiety", "ICD-10-CM", "F41.9", "Anxiety disorder, unspecified", "FY2026", "low"),
    ("anxiety", "SNOMED-CT", "48694002", "Anxiety", None, "medium"),
    ("post-traumatic stress disorder", "ICD-10-CM", "F43.10", "Post-traumatic stress disorder, unspecified", "FY2026", "medium"),
    ("post-traumatic stress disorder", "SNOMED-CT", "47505003", "Posttraumatic stress disorder", None, "medium"),
    ("auditory/visual hallucinations", "ICD-10-CM", "R44.3", "Hallucinations, unspecified", "FY2026", "low"),
    ("auditory/visual hallucinations", "SNOMED-CT", "7011001", "Hallucinations", None, "low"),
    ("patient health questionnaire-9", "LOINC", "44261-6", "Patient Health Questionnaire 9 item total score", None, "medium"),
    ("generalized anxiety disorder-7", "LOINC", "70274-6", "Generalized anxiety disorder 7 item total score", None, "medium"),
    ("sertraline", "RxNorm", "36437", "Sertraline", None, "medium"),
    ("lisinopril", "RxNorm", "29046", "Lisinopril", None, "medium"),
    ("metformin", "RxNorm", "6809", "Metformin", None, "medium"),
    ("ibuprofen", "RxNorm", "5640", "Ibuprofen", None, "medium"),
    ("acetaminophen", "RxNorm", "161", "Acetaminophen", None, "medium"),
    ("albuterol", "RxNorm", "435", "Albuterol", None, "medium"),
    ("atorvastatin", "RxNorm", "83367", "Atorvastatin", None, "medium"),
    ("amlodipine", "RxNorm", "17767", "Amlodipine", None, "medium"),
    ("losartan", "RxNorm", "52175", "Losartan", None, "medium"),
    ("levothyroxine", "RxNorm", "10582", "Levothyroxine", None, "medium"),
    ("omeprazole", "RxNorm", "7646", "Omeprazole", None, "medium"),
    ("fluoxetine", "RxNorm", "4493", "Fluoxetine", None, "medium"),
    ("escitalopram", "RxNorm", "321988", "Escitalopram", None, "medium"),
    ("bupropion", "RxNorm", "42347", "Bupropion", None, "medium"),
    ("duloxetine", "RxNorm", "72625", "Duloxetine", None, "medium"),
    ("gabapentin", "RxNorm", "25480", "Gabapentin", None, "medium"),
    ("low back pain", "ICD-10-CM", "M54.50", "Low back pain, unspecified", "FY2026", "medium"),
    ("low back pain", "SNOMED-CT", "279039007", "Low back pain", None, "medium"),
    ("shoulder pain", "ICD-10-CM", "M25.519", "Pain in unspecified shoulder", "FY2026", "low"),
    ("shoulder pain", "SNOMED-CT", "45326000", "Shoulder pain", None, "medium"),
    ("neck pain", "ICD-10-CM", "M54.2", "Cervicalgia", "FY2026", "medium"),
    ("knee pain", "ICD-10-CM", "M25.569", "Pain in unspecified knee", "FY2026", "low"),
    ("hip pain", "ICD-10-CM", "M25.559", "Pain in unspecified hip", "FY2026", "low"),
    ("pain rating", "LOINC", "72514-3", "Pain severity - 0-10 verbal numeric rating [Score] - Reported", None, "medium"),
    ("tobacco use", "SNOMED-CT", "110483000", "Tobacco user", None, "low"),
    ("alcohol use", "SNOMED-CT", "228273003", "Finding relating to alcohol drinking behavior", None, "low"),
    ("substance use", "SNOMED-CT", "66214007", "Substance abuse", None, "low"),
    ("family history of diabetes mellitus", "SNOMED-CT", "160303001", "Family history of diabetes mellitus", None, "medium"),
    ("family history of colon cancer", "SNOMED-CT", "312824007", "Family history of cancer of colon", None, "medium"),
    ("gait abnormality", "SNOMED-CT", "22325002", "Abnormal gait", None, "medium"),
    ("fall risk", "SNOMED-CT", "129839007", "At risk for falls", None, "medium"),
    ("colonoscopy", "CPT", "45378", "Diagnostic colonoscopy", None, "low"),
    ("colonoscopy", "SNOMED-CT", "73761001", "Colonoscopy", None, "medium"),
    ("dysphagia", "ICD-10-CM", "R13.10", "Dysphagia, unspecified", "FY2026", "low"),
    ("dysphagia", "SNOMED-CT", "40739000", "Dysphagia", None, "medium"),
    ("aphasia", "ICD-10-CM", "R47.01", "Aphasia", "FY2026", "medium"),
    ("dysarthria", "ICD-10-CM", "R47.1", "Dysarthria and anarthria", "FY2026", "medium"),
    ("modified barium swallow study", "CPT", "92611", "Motion fluoroscopic evaluation of swallowing function by cine or video recording", None, "low"),
    ("videofluoroscopic swallowing study", "CPT", "92611", "Motion fluoroscopic evaluation of swallowing function by cine or video recording", None, "low"),
    ("speech therapy", "CPT", "92507", "Treatment of speech, language, voice, communication, and/or auditory processing disorder", None, "low"),
)


def seed_rows() -> list[tuple[str, str, str, str, str | None, str]]:
    return list(SEED)
