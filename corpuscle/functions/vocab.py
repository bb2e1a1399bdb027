"""Word lists, phrases, patterns and formats that results depend on.

Everything here is data. The rules that use it are in the sibling modules.
Patterns are written with explicit Unicode classes, so that every regex engine
reads them alike.
"""

# --- fixed values: line and chunk cleaning -------------------------------------

# Every character that counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

PAGE_NUMBER_PATTERN = r"^\s*\p{Nd}+/\p{Nd}+\s*$"
LEGAL_PATTERN = r"^(©|copyright|all rights reserved)"

# Each rule marks a text as carrying data worth keeping.
SIGNAL_PATTERNS_STRIPPED = (
    r"(?i)\p{Nd}+\s*(mg|kg|g|μm|nm|mm|cm|m|°C|°F|K|%|ppm|pH|ml|l|h|min|sec|s|Hz|kHz|V|mV|A|mA|W|kW|um)",
    r"\p{Nd}+\.?\p{Nd}*\s*±\s*\p{Nd}+\.?\p{Nd}*",
    r"\(\s*\p{Nd}+\.?\p{Nd}*\s*\)",
    r"(?i)p\s*[=<>]\s*0?\.\p{Nd}+",
    r"(?i)n\s*=\s*\p{Nd}+",
    r"\p{Nd}+[:/]\p{Nd}+",
    r"^(Table|Figure|Tabela|Figura|Fig|Tab)",
    r"(^|[^\p{L}\p{N}_])[A-Z]{2,}([^\p{L}\p{N}_]|$)",
    r"%",
    r"[=±×÷∑∫√∞≤≥≠<>]",
)
# A capital and, later in the same line, a digit.
CAPITAL_THEN_DIGIT_PATTERN = r"[A-Z].*\p{Nd}"
SIGNAL_WORDS = (
    # sections
    "introduction", "material", "method", "results", "discussion", "conclusion", "abstract", "resumo",
    "experimental", "analysis", "table", "tabela", "figure", "figura",
    # treatments
    "treatment", "group", "control", "contrast", "trial", "experiment",
    # results
    "result", "finding", "observation", "data", "measurement", "value", "parameter",
)

GARBLED_MIN_CHARS = 50
GARBLED_MAX_RATIO = 0.04
POOR_CONTEXT_MIN_CHARS = 200

# --- fixed values: answer checks ---------------------------------------------------

SUPERSCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
PLAIN_DIGITS = "0123456789"
TYPOGRAPHIC_MARKS = "“”‘’–—"
PLAIN_MARKS = "\"\"''--"

NUMBER_PATTERN = r"\p{Nd}+(?:[.,]\p{Nd}+)?%?"
TOKEN_PATTERN = r"[a-záàâãéêíóôõúç0-9][a-záàâãéêíóôõúç0-9,.%-]*"

SKELETON_MARKERS = (
    "não disponível no contexto",
    "nao disponivel no contexto",
    "não disponíveis no contexto",
    "nao disponiveis no contexto",
    "não fornece informações",
    "nao fornece informacoes",
    "não fornece informação",
    "nao fornece informacao",
    "não há dados",
    "nao ha dados",
    "não há informações",
    "nao ha informacoes",
    "não consta no contexto",
    "nao consta no contexto",
    "não foi possível encontrar",
    "nao foi possivel encontrar",
    "not available in the context",
    "no data available in the context",
    "does not provide information",
    "does not provide specific information",
)
SKELETON_SHORT_CHARS = 300

NO_ANSWER_SENTINEL = "SEM_RESPOSTA_NO_CONTEXTO"

REFUSAL_MESSAGES = {
    "pt-BR": (
        "Não encontrei informações suficientes na base de documentos disponível para "
        "responder a essa pergunta com confiança. Posso ajudar com outra pergunta "
        "relacionada aos temas cobertos pela base de conhecimento?"
    ),
    "en": (
        "I couldn't find enough relevant information in the available documents to answer "
        "this question confidently. Feel free to ask something else related to the topics "
        "covered in the knowledge base."
    ),
}

RELEVANCE_STOPWORDS = (
    "o", "a", "os", "as", "um", "uma", "de", "da", "do", "em", "para",
    "com", "por", "que", "foi", "the", "an", "of", "in", "for", "is",
    "are", "was", "what", "how", "which", "qual", "como", "quais",
)
RELEVANCE_EDGE_MARKS = "?.,!():"

# --- fixed values: question analysis -------------------------------------------------

LANGUAGE_PT_WORDS = (
    "como", "qual", "quais", "não", "tilápia", "restrição", "alimentar", "viveiro",
    "crescimento", "alevinos", "o que", "por que",
)
LANGUAGE_EN_WORDS = (
    "what", "how", "which", "feed", "restriction", "restricted", "diet", "under",
    "growth", "fingerlings", "why", "describe",
)
LANGUAGE_PT_ACCENTS = "[áéíóúãõçÁÉÍÓÚÃÕÇ]"

QUANTITATIVE_PHRASES = (
    "quanto pesa", "quanto pesam", "quanto foi", "quanto cresceu", "quanto mede",
    "qual o valor", "qual foi o valor", "qual a taxa", "qual foi a taxa",
    "qual o percentual", "qual a porcentagem", "qual o índice",
    "qual o ganho de peso", "qual foi o ganho", "qual a média", "qual o fcr",
    "qual a conversão alimentar", "qual a sobrevivência", "qual foi a sobrevivência",
    "qual a biomassa", "qual o peso final", "qual o comprimento",
    "quantos gramas", "quantos cm", "quantos dias", "quantas semanas",
    "how much", "how many", "what is the rate", "what is the value",
    "what percentage", "what was the growth", "what were the values",
    "survival rate", "feed conversion ratio", "specific growth rate",
)
CONCEPTUAL_PHRASES = (
    "o que é", "o que são", "como funciona", "como funcionam", "explique",
    "defina", "definição", "por que", "porque", "o que significa",
    "descreva", "qual a importância", "qual é a importância",
    "consequencia", "consequências", "consequência", "consequencias",
    "efeito", "efeitos", "impacto", "impactos",
    "benefício", "benefícios", "vantagem", "vantagens",
    "desvantagem", "desvantagens",
    "acarreta", "acarretam", "provoca", "provocam", "causa ", "causam",
    "implica", "implicam", "resulta", "resultam", "ocorre", "acontece",
    "leva a", "levam a", "afeta", "afetam", "influencia", "influenciam",
    "prejudica", "prejudicam", "interfere", "interferecem",
    "what is a ", "what is an ", "what are", "how does", "how do", "explain",
    "define", "definition", "why", "what does", "describe",
    "consequences", "effects", "impacts", "benefits", "advantages",
)
COMPARATIVE_PHRASES = (
    "compare", "comparação", "diferença", "diferenças", "melhor que",
    "pior que", "versus", " vs ", "entre os", "entre as", "comparar",
    "qual é melhor", "comparison", "difference", "differences",
    "better than", "worse than", "between", "which is better",
)
METHODOLOGICAL_PHRASES = (
    "metodologia", "método", "métodos", "delineamento", "procedimento",
    "protocolo", "como foi conduzido", "como foi realizado", "como foi feito",
    "materiais e métodos", "methodology", "method", "methods", "procedure",
    "experimental design", "protocol", "how was conducted", "how was performed",
    "materials and methods",
)
CONCEPTUAL_OPENINGS = ("o que ", "quais ")

# Cross-language synonyms appended to a query.
RESTRICTION_TERMS = (
    "restrição alimentar", "dieta restrita", "restrição dieta", "feed restriction", "restricted diet",
)
SPECIES_PT = ("tilápia", "nilo")
SPECIES_EN = ("oreochromis", "niloticus")
SPECIES_LATIN_SUFFIX = " Oreochromis niloticus"
SPECIES_PT_SUFFIX = " tilápia do nilo"
RESTRICTION_EN_SUFFIX = " feed restriction"
RESTRICTION_PT_SUFFIX = " restrição alimentar"
METABOLISM_PT, METABOLISM_EN = "metabolismo", "metabolism"
RETRY_COMMON_SUFFIX = " tilapia tilápia"

LEXICAL_STOPWORDS = (
    "o", "a", "os", "as", "um", "uma", "de", "da", "do", "dos", "das",
    "em", "no", "na", "nos", "nas", "para", "com", "por", "que", "foi",
    "qual", "quais", "como", "quando", "onde", "quanto", "quantos",
    "the", "an", "of", "in", "for", "is", "are", "was", "what", "how",
    "which", "and", "or", "to", "from", "this", "that", "with",
)
LEXICAL_TOKEN_PATTERN = r"[a-z0-9]+(?:\.[0-9]+)*"
CONTENT_TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"

# Letters with marks and their plain forms (Latin-1 and the marks used in pt/es/fr/de).
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"

# --- fixed values: files and uploads -----------------------------------------------------

TEMP_PATH_MARKS = ("Temp", "tmp", "AppData", "Local")
UNSAFE_FILENAME_PATTERN = r"[^A-Za-z0-9._ -]+"
DEFAULT_FILENAME = "arquivo"
UPLOAD_KINDS = {
    # kind: (allowed extensions, accepted types, size cap in MB)
    "document": ((".pdf",), ("application/pdf",), 25),
    "video": ((".mp4", ".webm", ".mov"), ("video/mp4", "video/webm", "video/quicktime"), 200),
    "image": ((".jpg", ".jpeg", ".png", ".webp", ".bmp"),
              ("image/jpeg", "image/png", "image/webp", "image/bmp"), 10),
}

# --- fixed values: profiles and listings ---------------------------------------------------

FARMING_TYPES = ("piscicultura", "carcinicultura")
STATES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG",
    "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)
PROFILE_MAX_LENGTHS = {
    "full_name": 200, "phone": 30, "instagram": 100, "linkedin": 200,
    "company_name": 200, "cnpj": 18, "contact_role": 100, "predominant_species": 100,
    "company_website": 200, "address_street": 200, "address_number": 20,
    "address_complement": 100, "address_zip_code": 9, "address_city": 100,
}
DEFAULT_CATEGORY = "geral"

# --- fixed values: jobs and costs ------------------------------------------------------------

ACTIVE_JOB_STATUSES = ("queued", "processing")
STALE_JOB_MESSAGE = "Processamento interrompido. Tente novamente."

# USD per one million tokens: model, input, output.
MODEL_PRICES = (
    ("text-embedding-ada-002", 0.10, 0.0),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
)

EXTRACTION_METHODS = ("pypdf", "pdfplumber", "tesseract_ocr", "vision_ocr")
EXTRACTION_OK_REASON = "extração adequada"
EXTRACTION_EMPTY_REASON = "nenhuma página extraída"
