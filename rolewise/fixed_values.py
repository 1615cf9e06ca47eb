"""Constants and word lists that decide results.

Everything here is data. Changing a value changes published scores, so the
values are kept together and in natural order instead of next to the code
that reads them.
"""

ENGINE_VERSION = "1.2.0"

# --- Fixed values: criterion weights --------------------------------------
DEFAULT_WEIGHTS = {
    "skills": 0.45,
    "experience": 0.20,
    "education": 0.10,
    "languages": 0.10,
    "certifications": 0.05,
    "location": 0.10,
}
CRITERIA = tuple(DEFAULT_WEIGHTS)
WEIGHT_MIN, WEIGHT_MAX = 0.0, 3.0

# --- Fixed values: scoring -------------------------------------------------
SEMANTIC_FLOOR, SEMANTIC_CEILING = 0.70, 0.80
GAP_THRESHOLD = 0.50
PREFERRED_SHARE = 0.15
ADMISSIBILITY_FLOOR, ADMISSIBILITY_FULL_AT = 0.20, 0.50
UNKNOWN_YEARS_COVERAGE = 0.85
COVERAGE_FLOOR = 0.70
UNKNOWN_RECENCY = 0.85
RECENCY_STEPS = ((1, 1.0), (3, 0.90), (6, 0.75))
RECENCY_OLD = 0.55
EXPERIENCE_EXPONENT = 0.7
LANGUAGE_STEP_PENALTY = 0.25
OPTIONAL_LANGUAGE_WEIGHT = 0.5
LOCATION_HYBRID, LOCATION_ONSITE = 0.45, 0.25
LANGUAGE_LEVELS = {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5, "C2": 6, "NAT": 7}
DEFAULT_LANGUAGE_LEVEL = "B1"
EDUCATION_LEVELS = (0, 1, 3, 5, 8)
IMPLICATION_DEGREE, PREREQUISITE_DEGREE = 0.85, 0.45

# --- Fixed values: application stages, furthest last ------------------------
STAGE_ORDER = {
    "withdrawn": 0,
    "rejected": 1,
    "received": 2,
    "screening": 3,
    "phone": 4,
    "technical": 5,
    "final": 6,
    "offer": 7,
    "hired": 8,
}
CLOSED_STAGES = ("rejected", "withdrawn")

# --- Fixed values: filters --------------------------------------------------
SKILL_FILTER_FLOOR = 0.80
FILTER_DEFAULT_LIMIT, FILTER_MAX_LIMIT, FILTER_MAX_ITEMS = 10, 25, 12
SPOKEN_LANGUAGES = (
    "francais", "anglais", "arabe", "espagnol", "allemand", "italien",
    "portugais", "neerlandais", "russe", "chinois", "mandarin", "japonais",
    "berbere", "amazigh", "turc", "polonais", "roumain", "french", "english",
    "arabic", "spanish", "german", "italian", "portuguese", "dutch",
)

# --- Fixed values: search ---------------------------------------------------
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
TOKEN_MIN_LENGTH = 2
STOP_WORDS = (
    "de", "du", "des", "le", "la", "les", "un", "une", "et", "en", "au", "aux",
    "pour", "par", "sur", "avec", "dans", "sans", "chez", "que", "qui", "quoi",
    "est", "sont", "ete", "etre", "avoir", "plus", "moins", "tres", "ans",
    "the", "and", "for", "with", "from", "was", "were", "been", "has", "have",
    "this", "that", "our", "their", "its", "into", "over", "years", "year",
)

# --- Fixed values: record linkage -------------------------------------------
LINK_WEIGHTS = {"email": 0.70, "phone": 0.55, "name": 0.30, "career": 0.25}
LINK_THRESHOLD = 0.55
LINK_CERTAIN = 0.9
NAME_PARTICLES = (
    "de", "du", "des", "le", "la", "el", "al", "ben", "bin", "van", "von", "di",
)

# --- Fixed values: coherence of dated histories -----------------------------
OVERLAP_TOLERANCE_DAYS = 62
BREAK_DAYS = 183
TENURE_GAP_YEARS = 2.0
DIPLOMA_GAP_YEARS = 2
DIPLOMA_MIN_YEAR = 1980
DAYS_PER_YEAR = 365.25

# --- Fixed values: evaluation -----------------------------------------------
RELEVANT_FROM = 2
CALIBRATION_BETA = 2.0
DEFAULT_THRESHOLD = 0.75
RANKING_MINIMUMS = {
    "ndcg_at_5": 0.90, "precision_at_3": 0.85, "pair_accuracy": 0.85, "spearman": 0.75,
}
SEARCH_MINIMUMS = {"recall_at_5": 0.90, "mrr": 0.80, "precision_at_3": 0.55}
EXTRACTION_MINIMUMS = {
    "identity_accuracy": 0.80, "skills_f1": 0.80, "languages_f1": 0.75,
    "evidence_anchored": 0.85, "experience_years_mae": 1.5,
}
LOWER_IS_BETTER = ("experience_years_mae",)
SHORTLIST_SIZE = 3
IMPACT_RATIO_LEGAL = 0.80
IMPACT_DRIFT = 0.05
DELTA_TOLERANCE = 0.001
EXTRA_SENIORITY_YEARS = 15
MIN_COMMON_DOSSIERS = 5
KAPPA_STEPS = (
    (0.81, "almost perfect"),
    (0.61, "substantial"),
    (0.41, "moderate"),
    (0.21, "fair"),
    (0.01, "slight"),
)
KAPPA_LOWEST = "none or worse than chance"

# --- Fixed values: counterfactual levers, comparison, redirection -----------
LEVER_TARGET, LEVER_MAX_STEPS, LEVER_ASSUMED_YEARS = 0.75, 6, 1.0
LEVER_DONE = 0.999
TIE_MARGIN = 0.05
COMPARED_CANDIDATES, LISTED_SKILLS, LISTED_EXPERIENCES = 4, 12, 4
MAX_SUGGESTIONS = 5

# --- Fixed values: dashboards ------------------------------------------------
EXPERIENCE_BANDS = (
    ("under 1 year", 0.0, 1.0),
    ("1 to 3 years", 1.0, 3.0),
    ("3 to 5 years", 3.0, 5.0),
    ("5 to 8 years", 5.0, 8.0),
    ("8 years and over", 8.0, float("inf")),
)
SCORE_BANDS = (
    ("under 25 %", 0.0, 0.25),
    ("25 to 50 %", 0.25, 0.50),
    ("50 to 75 %", 0.50, 0.75),
    ("75 % and over", 0.75, 1.01),
)
CHART_TOP = 8
RETENTION_DAYS, RETENTION_WARNING_DAYS = 365, 30
INVOCATION_WINDOW_DAYS = 30
DECISION_NOTE_MIN = 10
AUDIT_ACTIONS_PURGE = "data_purged"

# --- Fixed values: ingest, evidence and document quality --------------------
UPLOAD_SUFFIXES = (".pdf", ".docx")
UPLOAD_MAX_BYTES = 10 * 1024 * 1024
EVIDENCE_MIN_RATIO = 0.60
EVIDENCE_MIN_LENGTH, EVIDENCE_SHORT_LENGTH, EVIDENCE_SHORT_RATIO = 3, 12, 0.75
SCANNED_BELOW_CHARS = 180
GUTTER_BINS, GUTTER_MIN_BINS, GUTTER_MIN_SHARE, GUTTER_MIN_WORDS = 50, 3, 0.15, 40

# --- Fixed values: month names ----------------------------------------------
MONTH_NAMES = {
    "janvier": 1, "january": 1, "jan": 1, "fevrier": 2, "february": 2, "feb": 2,
    "mars": 3, "march": 3, "mar": 3, "avril": 4, "april": 4, "apr": 4,
    "mai": 5, "may": 5, "juin": 6, "june": 6, "jun": 6,
    "juillet": 7, "july": 7, "jul": 7, "aout": 8, "august": 8, "aug": 8,
    "septembre": 9, "september": 9, "sep": 9, "sept": 9,
    "octobre": 10, "october": 10, "oct": 10,
    "novembre": 11, "november": 11, "nov": 11,
    "decembre": 12, "december": 12, "dec": 12,
}

# --- Fixed values: extraction patterns and lexicons -------------------------
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE_PATTERN = r"\+?\d[\d\s.-]{7,15}\d"
LINKEDIN_PATTERN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/\S+"
GITHUB_PATTERN = r"(?i)(?:https?://)?(?:www\.)?github\.com/\S+"
YEAR_PATTERN = r"\b(19[89]\d|20[0-4]\d)\b"
SKILL_LEXICON = (
    "Python", "Django", "Django REST Framework", "DRF", "Flask", "FastAPI",
    "PostgreSQL", "MySQL", "SQL", "Redis", "Docker", "Kubernetes", "Terraform",
    "JavaScript", "TypeScript", "React", "Vue", "Angular", "Next.js",
    "Java", "Spring Boot", "Go", "Rust", "C#", "PHP",
    "PyTorch", "TensorFlow", "LLM", "RAG", "Transformers", "Airflow", "Spark",
    "Git", "CI-CD", "Linux", "AWS", "Azure", "Celery", "GraphQL",
)
LANGUAGE_LEXICON = {
    "francais": "Francais", "français": "Francais",
    "anglais": "Anglais", "english": "Anglais",
    "arabe": "Arabe", "espagnol": "Espagnol", "allemand": "Allemand",
}

# --- Fixed values: bias probes ------------------------------------------------
BIAS_VARIANTS = {
    "name": (
        ("Marc Dupont", "Marc Dupont"),
        ("Marie Dupont", "Marie Dupont"),
        ("Youssef El Amrani", "Youssef El Amrani"),
        ("Fatima El Amrani", "Fatima El Amrani"),
        ("Wei Chen", "Wei Chen"),
    ),
    "location": (("Casablanca", "Casablanca"), ("Rabat", "Rabat"), ("Tanger", "Tanger")),
    "graduation_year": (
        ("2024 (young profile)", "2024"), ("2010", "2010"), ("1996 (senior profile)", "1996"),
    ),
    "institution": (
        ("Grande ecole", "Ecole Polytechnique"),
        ("Public university", "Universite Hassan II"),
        ("Local private institute", "Institut prive de Fes"),
    ),
}

# --- Fixed values: skill ontology ---------------------------------------------
SKILL_ALIASES = {
    "drf": "django rest framework",
    "django-rest-framework": "django rest framework",
    "django rest": "django rest framework",
    "py": "python",
    "python3": "python",
    "js": "javascript",
    "ts": "typescript",
    "node": "node.js",
    "nodejs": "node.js",
    "postgres": "postgresql",
    "psql": "postgresql",
    "pgsql": "postgresql",
    "k8s": "kubernetes",
    "gcp": "google cloud",
    "aws cloud": "aws",
    "amazon web services": "aws",
    "ms sql": "sql server",
    "mssql": "sql server",
    "sklearn": "scikit-learn",
    "scikit learn": "scikit-learn",
    "tf": "tensorflow",
    "llms": "llm",
    "large language models": "llm",
    "modeles de langage": "llm",
    "grands modeles de langage": "llm",
    "retrieval augmented generation": "rag",
    "ci/cd": "ci-cd",
    "cicd": "ci-cd",
    "integration continue": "ci-cd",
    "html5": "html",
    "css3": "css",
    "reactjs": "react",
    "react.js": "react",
    "vuejs": "vue",
    "vue.js": "vue",
    "restful": "rest",
    "api rest": "rest",
    "apis rest": "rest",
    "gestion de version": "git",
    "anglais professionnel": "anglais",
}
SKILL_IMPLIES = {
    "django": ("python",),
    "django rest framework": ("django", "python", "rest"),
    "flask": ("python",),
    "fastapi": ("python", "rest"),
    "celery": ("python",),
    "pandas": ("python",),
    "numpy": ("python",),
    "scikit-learn": ("python", "machine learning"),
    "pytorch": ("python", "deep learning", "machine learning"),
    "tensorflow": ("python", "deep learning", "machine learning"),
    "deep learning": ("machine learning",),
    "llm": ("machine learning", "nlp"),
    "rag": ("llm", "nlp"),
    "transformers": ("deep learning", "nlp", "python"),
    "spring boot": ("java", "rest"),
    "spring": ("java",),
    "react": ("javascript",),
    "vue": ("javascript",),
    "angular": ("typescript", "javascript"),
    "next.js": ("react", "javascript"),
    "typescript": ("javascript",),
    "node.js": ("javascript",),
    "kubernetes": ("docker", "linux"),
    "terraform": ("infrastructure as code",),
    "ansible": ("infrastructure as code", "linux"),
    "postgresql": ("sql",),
    "mysql": ("sql",),
    "sql server": ("sql",),
    "oracle": ("sql",),
    "sqlite": ("sql",),
    "airflow": ("python", "etl"),
    "dbt": ("sql", "etl"),
    "spark": ("big data",),
    "hadoop": ("big data",),
    "elasticsearch": ("recherche",),
    "graphql": ("api",),
    "rest": ("api",),
    "ci-cd": ("devops",),
    "jenkins": ("ci-cd", "devops"),
    "github actions": ("ci-cd", "devops"),
    "gitlab ci": ("ci-cd", "devops"),
    "docker": ("linux",),
    "bash": ("linux",),
    "aws": ("cloud",),
    "azure": ("cloud",),
    "google cloud": ("cloud",),
}
SKILL_RELATED = (
    ("pytorch", "tensorflow", 0.75),
    ("react", "vue", 0.65),
    ("react", "angular", 0.60),
    ("vue", "angular", 0.60),
    ("postgresql", "mysql", 0.80),
    ("postgresql", "sql server", 0.70),
    ("aws", "azure", 0.65),
    ("aws", "google cloud", 0.65),
    ("azure", "google cloud", 0.65),
    ("django", "flask", 0.70),
    ("django", "fastapi", 0.70),
    ("flask", "fastapi", 0.80),
    ("java", "c#", 0.60),
    ("jenkins", "github actions", 0.75),
    ("jenkins", "gitlab ci", 0.75),
    ("github actions", "gitlab ci", 0.85),
    ("terraform", "ansible", 0.60),
    ("spark", "hadoop", 0.70),
    ("mongodb", "postgresql", 0.45),
    ("redis", "memcached", 0.80),
)
