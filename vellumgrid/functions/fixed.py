"""Constants and patterns that results depend on, in Java's regular expressions.

``(?U)`` gives \\w, \\s, \\b and \\d their Unicode meaning, as the figures and words of filings need.
"""

CHUNK_TOKENS = 200
OVERLAP_TOKENS = 40
FUSION_DEPTH = 50
RRF_K = 60
DEFAULT_K = 5
CONTEXT_TOKENS = 6000
EXPANSION_SEEDS = 8
MIN_SIMILARITY = 0.67
RERANK_DEPTH = 20

SIZE_TOLERANCE = 0.3
MARGIN_FRACTION = 0.15
Y_TOLERANCE = 3.0
MIN_FURNITURE_SHARE = 0.10
MIN_FURNITURE_PAGES = 3
SPANNING_WIDTH = 0.6
COLUMN_GAP = 0.15
PROSE_MIN_WIDTH = 0.3
PROSE_MAX_FIGURES = 0.2
PROSE_MIN_SHARE = 0.15
GRID_ALIGNMENT = 0.5
ALIGN_TOLERANCE = 2.0
SPREAD_ASPECT = 1.2
SPREAD_MAX_CROSSING = 0.02
MIN_BODY_WORDS = 50
MAX_UNIT_WORDS = 8
MAX_LONG_UNIT_WORDS = 24
MAX_CELL_CHARS = 120
INTERLEAVED_ROWS, INTERLEAVED_CELLS, INTERLEAVED_WORDS = 8, 2, 4
SCOPE_HEADING_CHARS = 240
TEXTLESS_SHARE = 0.20
ELIGIBLE_RANK = 10
PER_VISITOR_DAILY, GLOBAL_DAILY, PER_SESSION = 25, 500, 10
MAX_EVIDENCE_WORDS, MAX_MEMO_WORDS, MAX_SELECTED = 200, 450, 8
MAX_TURNS, MAX_TOOLS, MAX_CALLS = 6, 8, 12
BM25_K1, BM25_B = 1.2, 0.75

REFUSAL = "Not in the filing."

QUESTION_WORDS = (
    "what were was is are how did does do the a an at end of for to from in on its their s as and by with "
    "please give state report filing standalone consolidated financial year"
).split()

MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE = rf"(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+\d{{4}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})"
PERIOD_WORDS = r"(?:as at|as on|year ended|for the year ended|for the period(?: ended)?|period ended|quarter ended|half year ended|nine months ended)"
PERIOD_OPENER = rf"(?iU)^{PERIOD_WORDS}(?:\s+{DATE}(?:\s+to)?)?$"
PERIOD_PART = rf"(?iU)^(?:{DATE}(?:\s+to)?|(?:f\.?\s?y\.?\s*)?\d{{4}}\s*-\s*\d{{2,4}}|f\.?\s?y\.?\s*\d{{2}}(?:\d{{2}}|\s*-\s*\d{{2}})?)$"
PERIOD_COMPLETE = rf"(?iU)^{PERIOD_WORDS}\s+{DATE}(?:\s+to\s+{DATE})?$"
STATEMENT_TITLE = (
    r"(?iU)^(?:(?:standalone|consolidated|consolidation)\s+)?"
    r"(?:balance sheet|cash flow statement|statement of (?:profit and loss|cash flows?|changes? in equity))"
    rf"(?:\s+(?:as at and for the year ended|{PERIOD_WORDS})\s+{DATE})?(?:\s*\(?contd\.?\)?)?$"
)
VALUE = r"(?U)^\(?[-–]?[\d,]*\.?\d+\)?%?$|^[-–]$"
CURRENCY = r"(?iU)₹|\brs\b|\binr\b|\bamounts?\b|\bcurrency\b|\bfigures\b|\brupees\b"
MAGNITUDE = r"(?iU)\b(?:crores?|lakhs?|lacs?|millions?|billions?|thousands?)\b"
OMITTED = r"(?i)^\(?000s? omitted\)?$"
ALL_AMOUNTS = r"(?iU)^\(?all amounts?\b"
LIST_MARKER = r"(?i)^(?:[•▪◦\-–]|\(?[a-z]\)|[a-z]\.|\(?[ivx]{1,5}\)|\(?\d{1,2}[.)])$"

RUPEE_BACKTICK = r"(?<![A-Za-z])`|`(?![A-Za-z])"
CURRENCY_LABEL = r"(?U)^(\s*[(\[]?)[CHvIK](?i:(\s+(?:in\s+)?(?:crores?|millions?|thousands?|[‘’']?000s?)[)\]]?\s*))$"
THOUSANDS_LABEL = r"(?iU)^(\s*[(\[]?₹\s+in\s+)[‘’']?000s?([)\]]?\s*)$"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CONTROL_CHARS = r"[\x00-\x08\x0b-\x1f\x7f]"

CITATION = r"\[page (\d+)\]"
CITATION_RUN = r"(?U)(?:\s*\[page \d+\])+"
FIGURE = r"(?U)(?<![\w.])\d(?:[\d,]*\d)?(?:\.\d+)?(?!\w)"
REFERENCE = r"(?iU)\b(?:pages?|extracts?|chunks?|notes?)\s*\[?\d+(?:\.\d+)*\]?"
COMPUTED = r"(?iU)\b(?:computed|calculated)\b"
TRAILING_LABEL = r"(?iU)^[\s.]*\((?:computed|calculated)\b"
ADVICE = (
    r"(?iU)\b(?:buy|sell|short)\s+(?:the\s+)?(?:stock|shares?|scrip)\b"
    r"|\b(?:price\s+target|target\s+price)\b"
    r"|\b(?:strong\s+)?(?:buy|sell|hold)\s+(?:rating|call|recommendation)\b"
    r"|\bwe\s+recommend\s+(?:buying|selling|holding|investing)\b"
    r"|\b(?:over|under)weight\s+(?:the\s+)?(?:stock|shares)\b"
    r"|\b(?:under|over)valued\b"
    r"|\binvestment\s+advice\b"
)
FISCAL_YEAR = r"(?iU)\bFY\s?(\d{4}|\d{2})(?:\s*[-–]\s*(\d{4}|\d{2}))?\b"
YEAR_SPAN = r"(?U)\b(20\d{2})\s*[-–/]\s*(?:20)?(\d{2})\b"
SCOPE_WORD = r"(?iU)\b(standalone|consolidated)\b"
SCOPE_STATEMENT = r"(?i)balance sheet|statement|financial|notes to|cash flow"
SCOPE_HEADING = r"(?iU)^(?:standalone|consolidated|notes\b|summary of material accounting)"
BALANCE_QUESTION = r"(?iU)\btotal (?:assets|liabilities|equity)\b"
NUMERIC_CELL = r"(?U)^[\d,.()%₹\s−–-]+$"
DOT_LEADERS = r"\.{4,}"
SEPARATOR_ROW = r"^\|(?:\s*:?-{3,}:?\s*\|)+$"
PLACEHOLDER_HEADER = r"^Col\d+$"

FUND_ADVICE = r"(?iU)\b(?:recommend\w*|advice|buy|sell|switch|invest|best|better|should|forecast|predict\w*)\b"
FUND_UNSUPPORTED = r"(?iU)\b(?:regular|idcw|revenue|profit|earnings|dividend|returns?|performance|risk|tax|fy\d+|forecast)\b"
RELATIVE_TIME = r"(?U)\b(?:previous|historical|today|current|now|latest|yesterday|tomorrow)\b"
ISO_DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
NUMERIC_DATE = r"(?U)\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COMPANY_CODE = r"^[A-Z0-9]{2,20}$"
SHA256 = r"^[a-f0-9]{64}$"
LINK = r"""(?is)<a\b[^>]*?href=["']([^"']+?)(?:[?#][^"']*)?["'][^>]*>(.*?)</a>"""

#: The reasons that verdicts, memos, tools and table gates give, as results hold them.
BELOW_FLOOR = "best similarity %s is below the %s floor"
NO_ANSWER, CUT_OFF = "the model found no answer in the extracts", " (text after the refusal removed)"
FOREIGN_PAGES, UNCITED = "every citation was to a page not retrieved ([%s])", "the answer carried no citation"
NO_SELECTION, BAD_SELECTION = "The agent did not return an evidence selection", "Invalid evidence selection"
BAD_EVIDENCE, LONG_MEMO = "Missing, repeated or unknown evidence", "The memo exceeds one page of text"
NOT_AN_OBJECT, BAD_CALL = "Tool input must be an object", "Unknown tool or invalid arguments"
BAD_COUNT, BAD_FIELD = "Holdings count must be between one and ten", "Unknown disclosure field"
NO_TABLE, WIDE_CELL, REPEATED_ROWS, LOST_FIGURES = "no table found", "a cell swallowed a column", "rows repeated", "%d figure(s) lost"
