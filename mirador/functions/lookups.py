"""Fixed values that results depend on.

FIXED VALUES: these numbers, words and patterns must equal the behaviour being
reproduced (format scores, weights, thresholds, synonym and acronym packs,
blocked SQL words). They are stated here plainly, in their natural order, and
every operator reads them from this module.
"""

from __future__ import annotations

# ---------------------------------------------------------------- scoring
# Format -> structure score (lookup key is the lower-cased, trimmed format).
FORMAT_SCORES = {
    "csv": 0.95,
    "tsv": 0.90,
    "parquet": 0.95,
    "json": 0.85,
    "geojson": 0.80,
    "xml": 0.70,
    "xls": 0.65,
    "xlsx": 0.65,
    "ods": 0.60,
    "shp": 0.55,
    "kml": 0.55,
    "zip": 0.40,
    "html": 0.30,
    "pdf": 0.15,
}
DEFAULT_FORMAT_SCORE = 0.10

# Completeness field weights, in field order (sum = 1.0).
COMPLETENESS_WEIGHTS = [
    ("title", 0.15),
    ("description", 0.25),
    ("organization", 0.15),
    ("tags", 0.15),
    ("license", 0.10),
    ("resources", 0.10),
    ("modifiedAt", 0.05),
    ("createdAt", 0.05),
]
MIN_DESCRIPTION_LENGTH = 20

# Dimension weights; usability is deferred (weight 0), the active four sum to 1.
QUALITY_WEIGHTS = {
    "accessibility": 0.3125,
    "structure": 0.3125,
    "freshness": 0.25,
    "usability": 0.0,
    "completeness": 0.125,
}
# Order in which the overall score adds the dimensions.
OVERALL_ORDER = ["completeness", "freshness", "structure", "accessibility"]
DIMENSIONS = ["accessibility", "structure", "freshness", "usability", "completeness"]

FRESHNESS_HALF_LIFE_DAYS = 180
RESCORE_DAYS = 7
SWEEP_CHUNK_SIZE = 1000
SWEEP_ACCESS_EVERY = 20

# HTTP status -> accessibility score.
STATUS_OK_SCORE = 1.0            # 200..299
STATUS_REDIRECTS = (301, 302, 307, 308)
STATUS_REDIRECT_SCORE = 0.9
STATUS_FORBIDDEN_SCORE = 0.3     # 403
STATUS_SERVER_ERROR_SCORE = 0.2  # >= 500
ACCESSIBLE_MIN_SCORE = 0.9

# Score level thresholds (score >= threshold), best first.
SCORE_LEVELS = [
    ("excellent", 0.8),
    ("good", 0.6),
    ("fair", 0.4),
    ("poor", 0.2),
]
LOWEST_LEVEL = "critical"

# Failure handling of catalogs.
UNREACHABLE_AFTER_FAILURES = 3
RETRY_AFTER_DAYS = 7

# Endpoint outage (circuit) rules.
OUTAGE_FAILURE_THRESHOLD = 5
OUTAGE_RESET_SECONDS = 60
OUTAGE_HALF_OPEN_SUCCESSES = 2

# Health cache.
HEALTH_TTL_HOURS = 48
HEALTH_OK_MIN, HEALTH_OK_MAX = 200, 399

# Resource load plan.
FILE_CACHE_TTL_HOURS = 24
DIRECT_SCAN_THRESHOLD_BYTES = 200 * 1024 * 1024

# ---------------------------------------------------------------- search
FIELD_WEIGHTS = {
    "title": 3.0,
    "tags": 2.5,
    "organization": 2.0,
    "description": 1.0,
}
BM25_K = 1.2
BM25_B = 0.75
# Text index tokenizer: characters other than a..z (and dots) separate tokens.
TOKEN_IGNORE_PATTERN = r"(\.|[^a-z])+"
DEFAULT_FTS_LIMIT = 20
DEFAULT_SEARCH_LIMIT = 10
OVERFETCH_FACTOR = 3

RRF_K = 60
RRF_SEMANTIC_WEIGHT = 0.6
RRF_LEXICAL_WEIGHT = 0.4

EMBEDDING_DIM = 384
EMBED_BATCH = 64

# Accent folding for Latin letters (lower case, after lower()).
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"

STEMMERS = {
    "es": "spanish",
    "en": "english",
    "pt": "portuguese",
    "fr": "french",
    "de": "german",
    "it": "italian",
    "nl": "dutch",
    "ca": "catalan",
}

# Language packs: key -> synonyms (phrases allowed).
SYNONYMS = {
    "es": {
        "presupuesto": ["gasto", "erogaciones", "partidas", "gasto público"],
        "empleo": ["trabajo", "ocupación", "mercado laboral"],
        "salud": ["sanitario", "epidemiología", "hospitalario"],
        "educación": ["escolar", "universitario", "matrícula"],
        "transporte": ["movilidad", "tránsito", "vialidad"],
        "seguridad": ["delito", "criminalidad", "policial"],
        "ambiente": ["medioambiental", "ecología", "contaminación"],
        "población": ["censo", "demográfico", "habitantes"],
        "comercio": ["exportación", "importación", "balanza comercial"],
        "deuda": ["endeudamiento", "obligaciones", "bonos"],
        "vivienda": ["habitacional", "inmobiliario", "alquiler"],
        "energía": ["electricidad", "hidrocarburos", "gas natural"],
        "turismo": ["hotelería", "visitantes", "alojamiento"],
        "justicia": ["judicial", "penal", "tribunales"],
        "agro": ["agropecuario", "agrícola", "ganadería", "cultivo"],
        "inflación": ["precios", "IPC", "costo de vida"],
        "pobreza": ["indigencia", "carencia", "vulnerabilidad"],
        "mortalidad": ["defunciones", "fallecimientos", "muertes"],
        "natalidad": ["nacimientos", "fecundidad", "partos"],
        "elecciones": ["electoral", "votación", "sufragio"],
    },
    "en": {
        "budget": ["spending", "expenditure", "appropriations", "public spending"],
        "employment": ["jobs", "labor", "workforce", "labor market"],
        "health": ["healthcare", "epidemiology", "hospital", "medical"],
        "education": ["school", "university", "enrollment", "academic"],
        "transport": ["transportation", "transit", "mobility", "traffic"],
        "crime": ["security", "policing", "criminal", "offense"],
        "environment": ["ecology", "pollution", "emissions", "climate"],
        "population": ["census", "demographic", "inhabitants", "residents"],
        "trade": ["export", "import", "commerce", "trade balance"],
        "debt": ["borrowing", "bonds", "obligations", "fiscal"],
        "housing": ["residential", "real estate", "rental", "dwelling"],
        "energy": ["electricity", "oil", "gas", "renewable"],
        "tourism": ["hospitality", "visitors", "accommodation", "travel"],
        "justice": ["judicial", "court", "legal", "tribunal"],
        "agriculture": ["farming", "livestock", "crop", "agri"],
        "inflation": ["prices", "CPI", "cost of living"],
        "poverty": ["deprivation", "inequality", "vulnerability"],
        "mortality": ["deaths", "fatalities", "life expectancy"],
        "elections": ["electoral", "voting", "ballot", "referendum"],
    },
}

# Acronym packs: country -> acronym -> expansion.
ACRONYMS = {
    "AR": {
        "INDEC": "Instituto Nacional de Estadística y Censos",
        "ANSES": "Administración Nacional de Seguridad Social",
        "AFIP": "Administración Federal de Ingresos Públicos",
        "BCRA": "Banco Central de la República Argentina",
        "SENASA": "Servicio Nacional de Sanidad y Calidad Agroalimentaria",
        "CONICET": "Consejo Nacional de Investigaciones Científicas y Técnicas",
        "INTA": "Instituto Nacional de Tecnología Agropecuaria",
        "ENACOM": "Ente Nacional de Comunicaciones",
        "PAMI": "Programa de Atención Médica Integral",
        "ENRE": "Ente Nacional Regulador de la Electricidad",
        "ENARGAS": "Ente Nacional Regulador del Gas",
        "CNE": "Cámara Nacional Electoral",
        "RENAPER": "Registro Nacional de las Personas",
        "IGN": "Instituto Geográfico Nacional",
        "SMN": "Servicio Meteorológico Nacional",
    },
    "CA": {
        "StatCan": "Statistics Canada",
        "CRA": "Canada Revenue Agency",
        "PHAC": "Public Health Agency of Canada",
        "NRCan": "Natural Resources Canada",
        "ECCC": "Environment and Climate Change Canada",
        "AAFC": "Agriculture and Agri-Food Canada",
        "IRCC": "Immigration, Refugees and Citizenship Canada",
        "DFO": "Fisheries and Oceans Canada",
        "CBSA": "Canada Border Services Agency",
        "TC": "Transport Canada",
    },
    "CL": {
        "INE": "Instituto Nacional de Estadísticas",
        "SII": "Servicio de Impuestos Internos",
        "SERVEL": "Servicio Electoral de Chile",
        "SAG": "Servicio Agrícola y Ganadero",
        "CONAF": "Corporación Nacional Forestal",
        "SERNAC": "Servicio Nacional del Consumidor",
        "MINSAL": "Ministerio de Salud",
        "MINEDUC": "Ministerio de Educación",
        "MOP": "Ministerio de Obras Públicas",
        "JUNAEB": "Junta Nacional de Auxilio Escolar y Becas",
    },
    "CO": {
        "DANE": "Departamento Administrativo Nacional de Estadística",
        "DNP": "Departamento Nacional de Planeación",
        "DIAN": "Dirección de Impuestos y Aduanas Nacionales",
        "IDEAM": "Instituto de Hidrología, Meteorología y Estudios Ambientales",
        "IGAC": "Instituto Geográfico Agustín Codazzi",
        "INVIMA": "Instituto Nacional de Vigilancia de Medicamentos y Alimentos",
        "SENA": "Servicio Nacional de Aprendizaje",
        "ANI": "Agencia Nacional de Infraestructura",
        "ICBF": "Instituto Colombiano de Bienestar Familiar",
        "ICFES": "Instituto Colombiano para la Evaluación de la Educación",
        "COLCIENCIAS": "Departamento Administrativo de Ciencia, Tecnología e Innovación",
        "SUPERFINANCIERA": "Superintendencia Financiera de Colombia",
        "MINTIC": "Ministerio de Tecnologías de la Información y las Comunicaciones",
        "MINSALUD": "Ministerio de Salud y Protección Social",
        "MINTRANSPORTE": "Ministerio de Transporte",
    },
    "GB": {
        "ONS": "Office for National Statistics",
        "HMRC": "His Majesty's Revenue and Customs",
        "NHS": "National Health Service",
        "DEFRA": "Department for Environment, Food and Rural Affairs",
        "DfT": "Department for Transport",
        "DfE": "Department for Education",
        "DLUHC": "Department for Levelling Up, Housing and Communities",
        "MOD": "Ministry of Defence",
        "MOJ": "Ministry of Justice",
        "EA": "Environment Agency",
    },
    "MX": {
        "INEGI": "Instituto Nacional de Estadística y Geografía",
        "SAT": "Servicio de Administración Tributaria",
        "CONEVAL": "Consejo Nacional de Evaluación de la Política de Desarrollo Social",
        "CONAGUA": "Comisión Nacional del Agua",
        "CONAPO": "Consejo Nacional de Población",
        "SEMARNAT": "Secretaría de Medio Ambiente y Recursos Naturales",
        "SEP": "Secretaría de Educación Pública",
        "IMSS": "Instituto Mexicano del Seguro Social",
        "BANXICO": "Banco de México",
        "SHCP": "Secretaría de Hacienda y Crédito Público",
    },
    "US": {
        "EPA": "Environmental Protection Agency",
        "FDA": "Food and Drug Administration",
        "CDC": "Centers for Disease Control and Prevention",
        "USDA": "United States Department of Agriculture",
        "DOT": "Department of Transportation",
        "HHS": "Department of Health and Human Services",
        "DOE": "Department of Energy",
        "NOAA": "National Oceanic and Atmospheric Administration",
        "FEMA": "Federal Emergency Management Agency",
        "IRS": "Internal Revenue Service",
        "BLS": "Bureau of Labor Statistics",
        "NHTSA": "National Highway Traffic Safety Administration",
    },
    "UY": {
        "INE": "Instituto Nacional de Estadística",
        "DGI": "Dirección General Impositiva",
        "AGESIC": "Agencia de Gobierno Electrónico y Sociedad de la Información y del Conocimiento",
        "ANEP": "Administración Nacional de Educación Pública",
        "ASSE": "Administración de los Servicios de Salud del Estado",
        "BPS": "Banco de Previsión Social",
        "OSE": "Obras Sanitarias del Estado",
        "UTE": "Usinas y Trasmisiones Eléctricas",
        "MGAP": "Ministerio de Ganadería, Agricultura y Pesca",
        "MSP": "Ministerio de Salud Pública",
    },
}

# ---------------------------------------------------------------- SQL guard
BLOCKED_STATEMENTS = [
    "CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "ATTACH",
    "DETACH", "INSTALL", "LOAD", "COPY", "EXPORT", "IMPORT", "PRAGMA", "SET", "CALL",
    "EXECUTE", "PREPARE", "BEGIN", "COMMIT", "ROLLBACK", "GRANT", "REVOKE", "VACUUM",
    "CHECKPOINT",
]
BLOCKED_FUNCTIONS = [
    "read_csv", "read_csv_auto", "read_parquet", "read_json", "read_json_auto",
    "write_csv", "write_parquet", "read_blob", "read_text", "glob", "httpfs", "s3",
]
SIMPLE_MODE_TABLE = "datos"
RESERVED_TABLE_NAMES = ["datos", "__q", "information_schema", "pg_catalog"]
MAX_TEMP_TABLES = 10
MAX_SESSION_TABLES = 10
TABLE_NAME_PATTERN = r"^[a-z_][a-z0-9_]*$"

# Paged queries.
DEFAULT_PAGE_LIMIT = 1000
MAX_PAGE_LIMIT = 10000
INSPECT_SAMPLE_ROWS = 5
DATASET_PAGE_SIZE = 20

# ---------------------------------------------------------------- series
FREQUENCY_MAP = {
    "R/P1D": "daily",
    "R/P1M": "monthly",
    "R/P3M": "quarterly",
    "R/P6M": "semiannual",
    "R/P1Y": "yearly",
    "day": "daily",
    "month": "monthly",
    "quarter": "quarterly",
    "year": "yearly",
}
SERIES_DEFAULT_LIMIT = 100
SERIES_MAX_LIMIT = 5000
SERIES_SEARCH_DEFAULT = 10
SERIES_SEARCH_MAX = 50

# ---------------------------------------------------------------- events
MAX_EVENT_BATCH = 1000
EVENT_TYPES = ["search", "query", "inspect", "error"]
