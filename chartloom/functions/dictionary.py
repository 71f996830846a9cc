"""The dictionary of concepts (canonical name, entity type, terms, specialties, confidence or None).

Without a fixed confidence, a term of up to three signs has medium confidence and any other high.
"""

from __future__ import annotations

# Fixed values, in the order in which they are tried.
DICTIONARY = (
    ("follow up", "plan", ("f/u", "follow up", "follow-up"), ("mixed",), None),
    ("hypertension", "problem", ("HTN", "hypertension"), ("primary-care",), None),
    ("type 2 diabetes mellitus", "problem", ("T2DM", "diabetes mellitus", "DM"), ("primary-care",), None),
    ("hyperlipidemia", "problem", ("HLD", "hyperlipidemia"), ("primary-care",), None),
    ("asthma", "problem", ("asthma", "reactive airway disease"), ("primary-care", "mixed"), None),
    ("chronic obstructive pulmonary disease", "problem", ("COPD", "chronic obstructive pulmonary disease"), ("primary-care", "mixed"), None),
    ("coronary artery disease", "problem", ("CAD", "coronary artery disease"), ("primary-care", "mixed"), None),
    ("congestive heart failure", "problem", ("CHF", "congestive heart failure", "heart failure"), ("primary-care", "mixed"), None),
    ("chronic kidney disease", "problem", ("CKD", "chronic kidney disease"), ("primary-care", "mixed"), None),
    ("obstructive sleep apnea", "problem", ("OSA", "obstructive sleep apnea", "sleep apnea"), ("primary-care", "mental-health", "mixed"), None),
    ("obesity", "problem", ("obesity", "obese"), ("primary-care", "mixed"), None),
    ("chest pain", "symptom", ("CP", "chest pain"), ("primary-care", "mixed"), None),
    ("shortness of breath", "symptom", ("SOB", "shortness of breath"), ("primary-care", "mixed"), None),
    ("cough", "symptom", ("cough", "coughing"), ("primary-care", "mixed"), None),
    ("fever", "symptom", ("fever", "febrile"), ("primary-care", "mixed"), None),
    ("fatigue", "symptom", ("fatigue", "tiredness"), ("primary-care", "mental-health", "mixed"), None),
    ("dizziness", "symptom", ("dizziness", "dizzy", "lightheadedness"), ("primary-care", "physical-therapy", "mixed"), None),
    ("nausea", "symptom", ("nausea", "nauseated"), ("primary-care", "mixed"), None),
    ("diarrhea", "symptom", ("diarrhea",), ("primary-care", "mixed"), None),
    ("headache", "symptom", ("headache", "HA"), ("primary-care", "mixed"), None),
    ("hemoglobin A1c", "lab", ("A1c", "hemoglobin A1c"), ("primary-care", "mixed"), None),
    ("body mass index", "vital", ("BMI", "body mass index"), ("primary-care", "mixed"), None),
    ("comprehensive metabolic panel", "lab", ("CMP", "comprehensive metabolic panel"), ("primary-care",), None),
    ("complete blood count", "lab", ("CBC", "complete blood count"), ("primary-care", "mixed"), None),
    ("basic metabolic panel", "lab", ("BMP", "basic metabolic panel"), ("primary-care", "mixed"), None),
    ("liver function tests", "lab", ("LFTs", "LFT", "liver function tests", "hepatic function panel"), ("primary-care", "mixed"), None),
    ("lipid panel", "lab", ("lipid panel",), ("primary-care",), None),
    ("lisinopril", "medication", ("lisinopril",), ("primary-care", "mixed"), None),
    ("atorvastatin", "medication", ("atorvastatin", "Lipitor"), ("primary-care", "mixed"), None),
    ("amlodipine", "medication", ("amlodipine", "Norvasc"), ("primary-care", "mixed"), None),
    ("losartan", "medication", ("losartan", "Cozaar"), ("primary-care", "mixed"), None),
    ("levothyroxine", "medication", ("levothyroxine", "Synthroid"), ("primary-care", "mixed"), None),
    ("omeprazole", "medication", ("omeprazole", "Prilosec"), ("primary-care", "mixed"), None),
    ("major depressive disorder", "problem", ("MDD", "major depressive disorder", "major depression", "clinical depression", "depressive disorder"), ("primary-care", "mental-health", "mixed"), None),
    ("depression", "symptom", ("depression", "depressed"), ("primary-care", "mental-health", "mixed"), "medium"),
    ("generalized anxiety disorder", "problem", ("GAD", "generalized anxiety disorder", "generalized anxiety"), ("primary-care", "mental-health", "mixed"), None),
    ("anxiety", "symptom", ("anxiety", "anxious"), ("primary-care", "mental-health", "mixed"), "medium"),
    ("post-traumatic stress disorder", "problem", ("PTSD", "post-traumatic stress disorder", "post traumatic stress disorder"), ("primary-care", "mental-health", "mixed"), None),
    ("auditory/visual hallucinations", "symptom", ("AVH", "auditory hallucinations", "visual hallucinations", "hallucinations"), ("mental-health", "mixed"), None),
    ("low mood", "symptom", ("low mood", "depressed mood"), ("mental-health",), None),
    ("anhedonia", "symptom", ("anhedonia",), ("mental-health",), None),
    ("poor sleep", "symptom", ("poor sleep", "insomnia"), ("mental-health",), None),
    ("suicidal ideation", "risk", ("SI", "suicidal ideation"), ("mental-health", "mixed"), None),
    ("homicidal ideation", "risk", ("HI", "homicidal ideation"), ("mental-health", "mixed"), None),
    ("Patient Health Questionnaire-9", "score", ("PHQ-9", "Patient Health Questionnaire-9"), ("mental-health", "mixed"), None),
    ("Generalized Anxiety Disorder-7", "score", ("GAD-7", "Generalized Anxiety Disorder-7"), ("mental-health", "mixed"), None),
    ("Alcohol Use Disorders Identification Test-Consumption", "score", ("AUDIT-C", "Alcohol Use Disorders Identification Test-Consumption"), ("primary-care", "mental-health", "mixed"), None),
    ("Columbia Suicide Severity Rating Scale", "score", ("C-SSRS", "Columbia Suicide Severity Rating Scale"), ("mental-health", "mixed"), None),
    ("sertraline", "medication", ("sertraline", "Zoloft"), ("mental-health", "mixed"), None),
    ("fluoxetine", "medication", ("fluoxetine", "Prozac"), ("mental-health", "primary-care", "mixed"), None),
    ("escitalopram", "medication", ("escitalopram", "Lexapro"), ("mental-health", "primary-care", "mixed"), None),
    ("bupropion", "medication", ("bupropion", "Wellbutrin"), ("mental-health", "primary-care", "mixed"), None),
    ("duloxetine", "medication", ("duloxetine", "Cymbalta"), ("mental-health", "primary-care", "physical-therapy", "mixed"), None),
    ("metformin", "medication", ("metformin",), ("primary-care", "mixed"), None),
    ("ibuprofen", "medication", ("ibuprofen", "Advil", "Motrin"), ("primary-care", "physical-therapy", "mixed"), None),
    ("gabapentin", "medication", ("gabapentin", "Neurontin"), ("primary-care", "physical-therapy", "mixed"), None),
    ("acetaminophen", "medication", ("acetaminophen", "Tylenol"), ("primary-care", "physical-therapy", "mixed"), None),
    ("albuterol", "medication", ("albuterol",), ("primary-care", "mixed"), None),
    ("cognitive behavioral therapy", "plan", ("CBT", "cognitive behavioral therapy"), ("mental-health",), None),
    ("dialectical behavior therapy", "plan", ("DBT", "dialectical behavior therapy"), ("mental-health",), None),
    ("low back pain", "problem", ("LBP", "low back pain", "back pain"), ("physical-therapy", "primary-care", "mixed"), None),
    ("dysphagia", "problem", ("dysphagia", "swallowing difficulty", "difficulty swallowing"), ("physical-therapy", "primary-care", "mixed"), None),
    ("aphasia", "problem", ("aphasia",), ("physical-therapy", "primary-care", "mixed"), None),
    ("dysarthria", "problem", ("dysarthria", "slurred speech"), ("physical-therapy", "primary-care", "mixed"), None),
    ("augmentative and alternative communication", "functional-limitation", ("AAC", "augmentative and alternative communication"), ("physical-therapy", "mixed"), None),
    ("speech therapy", "referral", ("ST", "speech therapy"), ("physical-therapy", "mixed"), "medium"),
    ("speech-language pathology", "referral", ("SLP", "speech-language pathologist", "speech language pathologist"), ("physical-therapy", "mixed"), "medium"),
    ("modified barium swallow study", "imaging", ("MBSS", "modified barium swallow study"), ("physical-therapy", "primary-care", "mixed"), None),
    ("videofluoroscopic swallowing study", "imaging", ("VFSS", "videofluoroscopic swallowing study"), ("physical-therapy", "primary-care", "mixed"), None),
    ("aspiration risk", "risk", ("aspiration risk", "risk for aspiration"), ("physical-therapy", "primary-care", "mixed"), None),
    ("diet texture modification", "plan", ("diet texture modification", "mechanical soft diet", "pureed diet", "thickened liquids"), ("physical-therapy", "primary-care", "mixed"), None),
    ("neck pain", "problem", ("neck pain", "cervical pain"), ("physical-therapy", "primary-care", "mixed"), None),
    ("knee pain", "problem", ("knee pain", "R knee pain", "right knee pain", "L knee pain", "left knee pain"), ("physical-therapy", "primary-care", "mixed"), None),
    ("hip pain", "problem", ("hip pain", "R hip pain", "right hip pain", "L hip pain", "left hip pain"), ("physical-therapy", "primary-care", "mixed"), None),
    ("shoulder pain", "problem", ("shoulder pain", "R shoulder pain", "right shoulder pain", "L shoulder pain", "left shoulder pain"), ("physical-therapy", "mixed"), None),
    ("range of motion", "finding", ("ROM", "range of motion"), ("physical-therapy", "mixed"), None),
    ("active range of motion", "finding", ("AROM", "active range of motion"), ("physical-therapy",), None),
    ("flexion", "finding", ("flex", "flexion"), ("physical-therapy", "mixed"), None),
    ("abduction", "finding", ("abd", "abduction"), ("physical-therapy",), None),
    ("external rotation", "finding", ("ER", "external rotation"), ("physical-therapy",), None),
    ("Hawkins test", "special-test", ("Hawkins", "Hawkins test"), ("physical-therapy",), None),
    ("Neer test", "special-test", ("Neer", "Neer test"), ("physical-therapy",), None),
    ("straight leg raise", "special-test", ("SLR", "straight leg raise"), ("physical-therapy", "mixed"), None),
    ("FABER test", "special-test", ("FABER", "FABER test"), ("physical-therapy",), None),
    ("McMurray test", "special-test", ("McMurray", "McMurray test"), ("physical-therapy",), None),
    ("Lachman test", "special-test", ("Lachman", "Lachman test"), ("physical-therapy",), None),
    ("Timed Up and Go", "functional-limitation", ("TUG", "Timed Up and Go"), ("physical-therapy", "mixed"), None),
    ("five times sit to stand", "functional-limitation", ("5xSTS", "five times sit to stand"), ("physical-therapy", "mixed"), None),
    ("home exercise program", "exercise", ("HEP", "home exercise program"), ("physical-therapy",), None),
    ("overhead reach", "functional-limitation", ("overhead reach", "reaching overhead"), ("physical-therapy",), None),
    ("numbness", "symptom", ("numbness",), ("physical-therapy", "primary-care", "mixed"), None),
    ("tingling", "symptom", ("tingling",), ("physical-therapy", "primary-care", "mixed"), None),
    ("leg radiation", "symptom", ("radiates to R leg", "radiates to right leg", "R leg", "right leg"), ("physical-therapy", "mixed"), "medium"),
)
