"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour
being reproduced (word lists, ordered lookup tables, patterns, limits).
The values are listed plainly, in their natural order; code elsewhere
builds Spark expressions from them.
"""

# --- FIXED VALUES: limits ---------------------------------------------------
MAX_AMOUNT = 10_000_000
MAX_MERCHANT_LEN = 50
MAX_MERCHANT_WORDS = 6
MIN_MERCHANT_LEN = 3
REVIEW_PAGE_SIZE = 3
SEARCH_K = 5
TOP_MERCHANTS = 20
MESSAGE_WINDOW_DAYS = 30
MAX_MESSAGES = 100
UNKNOWN_MERCHANT = "Unknown"
OTHER_CATEGORY = "Other"
UPI_TRANSFER = "UPI Transfer"
DEFAULT_CURRENCY = "INR"

# --- FIXED VALUES: message selection -----------------------------------------
# A message is a transaction alert when at least two of these occur (lower case).
TRANSACTION_KEYWORDS = ["debited", "credited", "upi txn", "rs.", "inr", "a/c", "account"]
# Source query terms and allowed senders of the mail export.
MAIL_QUERY_TERMS = ["debited", "spent", "transaction", "UPI", "INR"]
MAIL_SENDERS = ["alerts@hdfcbank.bank.in", "cbsalerts@sbi.co.in", "alerts@axis.bank.in"]
MAIL_CATEGORY = "primary"

# Sender substring -> bank, first match in this order wins.
SENDER_BANKS = [
    ("hdfcbank", "HDFC"),
    ("sbi.co.in", "SBI"),
    ("axis.bank", "Axis"),
    ("icicibank", "ICICI"),
    ("kotakbank", "Kotak"),
    ("yesbank", "Yes Bank"),
    ("paytm", "Paytm"),
]

# --- FIXED VALUES: alert text patterns (Java regex syntax) ---------------------
PAYMENT_METHOD_RE = r"(?i)\b(UPI|NEFT|IMPS|RTGS|credit card|debit card|net banking)\b"
NUMERIC_DATE_RE = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
NAMED_DATE_RE = r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})\b"
AMOUNT_RE = r"(?i)(?:INR|Rs\.?)\s?([0-9,]+(?:\.[0-9]{1,2})?)"
MERCHANT_RE = r"(?i)(?:paid to|payment to|at|for|name|to)\s+([A-Za-z0-9 &.\-]+)"
VPA_RE = r"(?i)VPA\s+([A-Za-z0-9.\-_]+@[A-Za-z0-9.\-_]+)"

# Date formats tried in order: d/m/Y, d-m-Y, d/m/y, d-m-y, d Month Y, d Mon Y.
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "d MMMM yyyy", "d MMM yyyy"]
TWO_DIGIT_YEAR_PIVOT = 69  # 69..99 -> 19xx, 00..68 -> 20xx

# --- FIXED VALUES: merchant cleaning -----------------------------------------
# Cities removed when they end a merchant name.
CITY_SUFFIXES = [
    "BANGALORE", "BENGALURU", "MUMBAI", "BOMBAY", "PUNE", "DELHI", "NEW DELHI", "HYDERABAD",
    "CHENNAI", "MADRAS", "KOLKATA", "CALCUTTA", "SATARA", "GURGAON", "GURUGRAM", "NOIDA",
    "AHMEDABAD", "SURAT", "JAIPUR", "LUCKNOW", "NAGPUR", "VADODARA", "INDORE", "BHOPAL", "PATNA",
    "KOCHI", "COCHIN", "COIMBATORE", "VISAKHAPATNAM", "VIZAG",
    "FARIDABAD", "GHAZIABAD", "MEERUT", "AGRA", "THANE", "NAVI MUMBAI",
    "CHANDIGARH", "MYSURU", "MYSORE", "MANGALORE", "MANGALURU", "HUBLI",
]
# Cities removed when glued to "IN" at the end ("PHARMEASY INMUMBAI").
IN_CITY_SUFFIXES = [
    "BANGALORE", "BENGALURU", "MUMBAI", "BOMBAY", "PUNE", "DELHI", "HYDERABAD",
    "CHENNAI", "KOLKATA", "SATARA", "GURGAON", "GURUGRAM", "NOIDA", "AHMEDABAD", "SURAT",
    "JAIPUR", "LUCKNOW", "NAGPUR", "VADODARA", "INDORE", "BHOPAL", "PATNA", "KOCHI",
    "COIMBATORE", "VISAKHAPATNAM", "FARIDABAD", "CHANDIGARH", "MYSURU", "MYSORE",
]
LEGAL_SUFFIX_RE = r"(?i)\s+(?:PVT\.?\s*LTD\.?|PRIVATE LIMITED|LIMITED|LLP|LLC|INC\.?|CORP\.?|PVT\.?)\s*$"
TRAILING_DIGITS_RE = r"\s*\d{6,}\s*$"
EMI_PREFIX_RE = r"(?i)^EMI\s+"
# A merchant containing any of these words is a sentence fragment.
SENTENCE_WORDS = [
    "wish", "inform", "kindly", "regards", "sincerely",
    "notify", "notification", "alert", "dear", "please",
    "thank", "welcome", "greet",
]

# --- FIXED VALUES: VPA handles ------------------------------------------------
VPA_ALL_DIGITS_RE = r"^[\d.]+$"
VPA_Q_CODE_RE = r"(?i)^q\d+$"
VPA_GPAY_DIGITS_RE = r"(?i)^gpay-\d+$"
VPA_GPAY_UTILITY_RE = r"(?i)^gpay-(utility|p2p|merchant|upi)$"
VPA_TRANSFER_PREFIXES = ["phonepe-", "pe.", "ybl."]
VPA_PAYTM_PREFIX = "paytm"
VPA_GPAY_PREFIX = "gpay-"

# --- FIXED VALUES: redaction, applied in this order ----------------------------
PII_RULES = [
    (r"\b[A-Z0-9]{4,6}[\*Xx]+\d{4}\b", "[REDACTED_CARD]"),
    (r"\b\d{12,19}\b", "[REDACTED_ACCT]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b\d{6}\b", "[REDACTED_PIN]"),
    (r"Ref#\s*\d+", "Ref#[REDACTED]"),
]
# One of these stands in every match of a rule (named by its replacement).
PII_NEEDS = {"[REDACTED_CARD]": ["X", "x", "*"], "[REDACTED_EMAIL]": ["@"], "Ref#[REDACTED]": ["Ref#"]}

# --- FIXED VALUES: built-in category map, checked in this order ----------------
CATEGORY_MAP = [
    ("Amazon", "Shopping", "Online Shopping"),
    ("Flipkart", "Shopping", "Online Shopping"),
    ("Meesho", "Shopping", "Online Shopping"),
    ("Myntra", "Shopping", "Fashion"),
    ("Ajio", "Shopping", "Fashion"),
    ("Nykaa", "Shopping", "Beauty"),
    ("Swiggy", "Food", "Food Delivery"),
    ("Zomato", "Food", "Food Delivery"),
    ("Blinkit", "Food", "Grocery Delivery"),
    ("BigBasket", "Food", "Grocery Delivery"),
    ("Dunzo", "Food", "Grocery Delivery"),
    ("Uber Eats", "Food", "Food Delivery"),
    ("Uber", "Transport", "Ride Hailing"),
    ("Ola", "Transport", "Ride Hailing"),
    ("Rapido", "Transport", "Ride Hailing"),
    ("RedBus", "Transport", "Bus"),
    ("IRCTC", "Transport", "Train"),
    ("IndiGo", "Transport", "Flight"),
    ("Air India", "Transport", "Flight"),
    ("Netflix", "Entertainment", "Streaming"),
    ("Hotstar", "Entertainment", "Streaming"),
    ("Spotify", "Entertainment", "Streaming"),
    ("Apple Music", "Entertainment", "Streaming"),
    ("YouTube", "Entertainment", "Streaming"),
    ("BookMyShow", "Entertainment", "Events"),
    ("HDFC", "Bills", "Bank"),
    ("SBI", "Bills", "Bank"),
    ("Axis", "Bills", "Bank"),
    ("ICICI", "Bills", "Bank"),
    ("Kotak", "Bills", "Bank"),
    ("Airtel", "Bills", "Telecom"),
    ("Jio", "Bills", "Telecom"),
    ("Vi", "Bills", "Telecom"),
    ("BESCOM", "Bills", "Electricity"),
    ("Tata Power", "Bills", "Electricity"),
    ("PhonePe", "Finance", "UPI"),
    ("GPay", "Finance", "UPI"),
    ("Paytm", "Finance", "Wallet"),
    ("Apollo", "Health", "Pharmacy"),
    ("Practo", "Health", "Consultation"),
    ("1mg", "Health", "Pharmacy"),
    ("MakeMyTrip", "Travel", "Booking"),
    ("Goibibo", "Travel", "Booking"),
]

# --- FIXED VALUES: statements ----------------------------------------------------
# Header signature of multi-column account statements, checked in this order.
BANK_SIGNATURES = [
    ("axis", ["withdrawal amt", "deposit amt"]),
    ("hdfc", ["debit amt", "credit amt", "narration"]),
    ("sbi", ["txn date", "debit", "credit", "ref no"]),
]
# 0-based cell positions per bank: date, description, debit, credit.
BANK_COLUMNS = {
    "axis": (0, 1, 4, 5),
    "hdfc": (0, 1, 3, 4),
    "sbi": (0, 2, 4, 5),
}
# A single-cell card statement has a header containing all of these.
CARD_CELL_KEYWORDS = ["date & time", "transaction", "description", "amount"]
CARD_CELL_ROW_RE = (
    r"(?s)(\d{2}/\d{2}/\d{4})\|\s*\d{2}:\d{2}\s+(.+?)\s+(\+)?\s*[A-Z]\s+([0-9,]+(?:\.[0-9]{2})?)\s"
)
# A text card statement contains both phrases (lower case).
CARD_TEXT_PHRASES = ["american express", "membership number"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
CARD_TEXT_LINE_RE = (
    r"(?i)^(January|February|March|April|May|June|July|August|"
    r"September|October|November|December)\s+(\d{1,2})\s+(.+)\s+([0-9,]+\.[0-9]{2})\s*$"
)
CARD_TEXT_SKIP_RE = (
    r"(?i)FINANCE CHARGES|GST/IGST|INSTALLMENT PRINCIPAL AMOUNT|"
    r"New domestic transactions|New overseas transactions|"
    r"Total of Installments|TOTAL OVERSEAS SPEND|"
    r"Card Number XXXX|UNITED STATES DOLLAR|"
    r"Foreign Spending|Amount Rs|^Details\b|"
    r"Page \d+ of \d+|americanexpress\.co\.in|Statement of Account|"
    r"Membership Number|Prepared for|Credit Summary|Credit Limit|"
    r"Installment Plan|CardMember|Payment Information|Payment Methods|"
    r"NEFT details|IFSC Code|Drop Box|Mailing Preference|"
    r"Foreign Exchange Currency|Permanent Account Number|GSTIN|"
    r"Current Rates of Interest|Opening Balance|Closing Balance|"
    r"Min Payment Due|Minimum Payment"
)
INSTALLMENT_HEADER_RE = r"(?i)installment plan transactions"
INSTALLMENT_DROP_RE = r"(?i)FINANCE CHARGES|GST/IGST|INSTALLMENT PRINCIPAL"
PAYMENT_RECEIVED_RE = r"(?i)PAYMENT RECEIVED"
STATEMENT_YEAR_RE = r"\b\d{2}/\d{2}/(\d{4})\b"
STATEMENT_END_MONTH_RE = (
    r"(?i)to\s+(January|February|March|April|May|June|July|August|"
    r"September|October|November|December)"
)
FX_TAIL_RE = r"\s+\d+\.\d+\s*$"

# --- FIXED VALUES: rule suggestion -------------------------------------------------
PATTERN_NOISE_WORDS = [
    "debit", "credit", "bank", "inr", "upi", "neft", "imps", "rtgs",
    "amount", "transaction", "account", "card", "your", "has", "been",
    "used", "for", "the", "and", "via", "ref", "no", "date", "time",
    "balance", "available", "total", "rupees", "rs", "statement",
]
PAYMENT_PHRASE_RE = r"(?i)(?:paid to|payment to|at|for merchant|to merchant)\s+([A-Za-z0-9 &.\-]{3,40})"
UPPER_RUN_RE = r"\b[A-Z][A-Z0-9&/\-]{2,}(?:\s+[A-Z][A-Z0-9&/\-]{2,}){0,3}\b"
VPA_HANDLE_RE = r"([A-Za-z][A-Za-z0-9.\-_]{2,})@[A-Za-z0-9.\-_]+"
MAX_PATTERN_CANDIDATES = 5

# --- FIXED VALUES: questions and SQL guard --------------------------------------------
STRUCTURED_KEYWORDS = [
    "how much", "total", "sum", "spent",
    "count", "average", "monthly", "last month",
    "this year", "more than", "less than", "greater than",
    "above", "below", "over", "under", "between",
    "highest", "lowest", "biggest", "largest", "maximum", "minimum",
    "last week", "this month", "yesterday", "today",
    "transactions", "show me", "list", "find",
]
QUESTION_CATEGORIES = ["food", "shopping", "transport", "travel"]
SQL_FORBIDDEN = ["drop", "delete", "update", "insert", "alter", "truncate"]
BAD_MERCHANTS = ["the", "a", "an"]

# Functions by which a query could call into the JVM.
JAVA_CALL_RE = r"\b(?:try_)?reflect\b|\bjava_method\b"
