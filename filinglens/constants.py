"""Word lists, code tables, patterns and thresholds.

Everything here defines a result (a label, a code, a cut-off) and is therefore
stated literally; no logic lives in this module.
"""

from __future__ import annotations

# --- fixed values: encodings -------------------------------------------------
FILER_TYPE_CODES = {"member": 0, "spouse": 1, "dependent": 2, "joint": 3}
PARTY_CODES = {"Democrat": 0, "Democratic": 0, "Republican": 1, "Independent": 2}
CHAMBER_CODES = {"house": 0, "senate": 1}
DIRECTION_CODES = {
    "purchase": 1, "sale": -1, "sale_full": -1, "sale_partial": -1, "exchange": 0,
}
PARTY_NAMES_BY_CODE = {100: "Democratic", 200: "Republican", 328: "Independent"}

# --- fixed values: amount ranges (label, low, high) --------------------------
AMOUNT_RANGES = [
    ("$1,001 - $15,000", 1001, 15000),
    ("$15,001 - $50,000", 15001, 50000),
    ("$50,001 - $100,000", 50001, 100000),
    ("$100,001 - $250,000", 100001, 250000),
    ("$250,001 - $500,000", 250001, 500000),
    ("$500,001 - $1,000,000", 500001, 1000000),
    ("$1,000,001 - $5,000,000", 1000001, 5000000),
    ("$5,000,001 - $25,000,000", 5000001, 25000000),
    ("$25,000,001 - $50,000,000", 25000001, 50000000),
    ("$50,000,001 +", 50000001, 50000001),
]

# --- fixed values: training universe -----------------------------------------
TRAINING_START = "2016-01-01"
EXCLUDED_ETFS = [
    "SPY", "QQQ", "IWM", "DIA", "VOO", "VTI", "VEA", "VWO", "EFA", "EEM",
    "AGG", "BND", "TLT", "IEF", "SHY", "LQD", "HYG", "GLD", "SLV", "USO",
    "XLF", "XLK", "XLE", "XLV", "XLI", "XLY", "XLP", "XLB", "XLU", "XLRE",
    "ARKK", "ARKW", "ARKG", "ARKF", "ARKQ",
    "VGT", "VHT", "VFH", "VIS", "VNQ", "VXUS", "VB", "VO",
    "IVV", "IJH", "IJR", "IEMG", "IEFA",
    "SCHD", "SCHX", "SCHF",
]
OPTION_NAME_PATTERNS = ["%option%", "% call %", "% put %"]
OPTION_TYPE_PATTERN = "%option%"
# trading rows between the trade and the label price, and the calendar buffer
HORIZON_ROWS = {"5d": 4, "21d": 20, "63d": 62, "90d": 89, "180d": 179}
HORIZON_BUFFER_DAYS = {"5d": 10, "21d": 35, "63d": 100, "90d": 140, "180d": 270}
PROFIT_THRESHOLD = 0.02
ELECTION_YEARS = [2016, 2020, 2024, 2028]
MIDTERM_YEARS = [2018, 2022, 2026]
BENCHMARK_TICKER = "SPY"

# --- fixed values: committee prefix -> sector names --------------------------
COMMITTEE_SECTORS = {
    "HSBA": ["Financial Services", "Finance", "Banking"],
    "SSBA": ["Financial Services", "Finance", "Banking"],
    "HSAG": ["Consumer Defensive", "Agriculture"],
    "SSAF": ["Consumer Defensive", "Agriculture"],
    "HSIF": ["Energy", "Utilities"],
    "SSCM": ["Energy", "Utilities", "Communication Services"],
    "HSHM": ["Healthcare"],
    "SSHR": ["Healthcare"],
    "HSAS": ["Industrials", "Aerospace & Defense"],
    "SSAS": ["Industrials", "Aerospace & Defense"],
    "HSSM": ["Technology", "Communication Services"],
    "HSSY": ["Technology", "Communication Services"],
}

# --- fixed values: committee prefix -> asset-name keywords -------------------
COMMITTEE_KEYWORDS = {
    "HSAG": ["agriculture", "farm", "food", "crop"],
    "HSAP": [],
    "HSAS": ["defense", "military", "aerospace", "arms"],
    "HSBA": ["bank", "finance", "insurance", "fintech", "credit", "crypto"],
    "HSBU": [],
    "HSED": ["education", "school", "university", "workforce"],
    "HSIF": ["energy", "telecom", "health", "pharma", "biotech", "internet", "media"],
    "HSFA": ["defense", "international", "foreign"],
    "HSHA": ["government", "federal"],
    "HSHM": ["security", "cyber", "border"],
    "HSII": ["native", "water", "land", "mining", "oil", "gas", "energy"],
    "HSJU": ["legal", "tech", "patent", "immigration"],
    "HSPW": ["transport", "infrastructure", "aviation", "rail", "highway", "water"],
    "HSRU": [],
    "HSSM": ["small business"],
    "HSSY": ["tech", "science", "space", "nasa", "research", "ai"],
    "HSVR": ["veteran", "health"],
    "HSWM": ["tax", "trade", "social security", "medicare", "health"],
    "SSAF": ["agriculture", "farm", "food", "forestry"],
    "SSAP": [],
    "SSAS": ["defense", "military", "aerospace"],
    "SSBK": ["bank", "finance", "housing", "insurance", "crypto"],
    "SSBU": [],
    "SSCM": ["telecom", "tech", "media", "internet", "transport", "science"],
    "SSEG": ["energy", "natural", "oil", "gas", "nuclear", "water"],
    "SSEV": ["environment", "climate", "pollution"],
    "SSFI": ["tax", "trade", "social security", "health", "tariff"],
    "SSFR": ["defense", "foreign", "international"],
    "SSHR": ["health", "pharma", "biotech", "labor", "pension", "education"],
    "SSHI": ["security", "government"],
    "SSGA": ["government", "regulatory"],
    "SSIN": ["intelligence", "cyber", "security"],
    "SSJU": ["legal", "tech", "immigration", "patent"],
    "SSRA": [],
    "SSSB": ["small business"],
    "SSVA": ["veteran", "health"],
}

# --- fixed values: company names ----------------------------------------------
CORPORATE_WORDS_PATTERN = (
    r"(?i)\b(inc\.?|corp\.?|corporation|company|co\.?|ltd\.?|llc|lp|plc|"
    r"group|holdings?|enterprises?|international|intl\.?|"
    r"technologies|technology|tech|systems?|solutions?|"
    r"pharmaceuticals?|pharma|therapeutics?|biosciences?|"
    r"industries|industrial|services?|financial|bancorp|"
    r"communications?|networks?|software|platforms?|"
    r"the|of|and|&)\s*"
)
NAME_OVERRIDES = [
    ("alphabet", "GOOGL"), ("google", "GOOGL"), ("meta platforms", "META"),
    ("facebook", "META"), ("amazon.com", "AMZN"), ("amazon", "AMZN"),
    ("microsoft", "MSFT"), ("apple", "AAPL"), ("nvidia", "NVDA"), ("tesla", "TSLA"),
    ("berkshire hathaway", "BRK-B"), ("johnson & johnson", "JNJ"),
    ("jpmorgan chase", "JPM"), ("jp morgan", "JPM"), ("jpmorgan", "JPM"),
    ("bank of america", "BAC"), ("wells fargo", "WFC"), ("goldman sachs", "GS"),
    ("morgan stanley", "MS"), ("pfizer", "PFE"), ("unitedhealth", "UNH"),
    ("exxon mobil", "XOM"), ("exxonmobil", "XOM"), ("chevron", "CVX"), ("at&t", "T"),
    ("verizon", "VZ"), ("comcast", "CMCSA"), ("walt disney", "DIS"), ("disney", "DIS"),
    ("boeing", "BA"), ("lockheed martin", "LMT"), ("raytheon", "RTX"),
    ("general dynamics", "GD"), ("northrop grumman", "NOC"), ("general electric", "GE"),
    ("honeywell", "HON"), ("3m", "MMM"), ("caterpillar", "CAT"), ("deere", "DE"),
    ("john deere", "DE"), ("procter & gamble", "PG"), ("coca-cola", "KO"),
    ("pepsico", "PEP"), ("walmart", "WMT"), ("home depot", "HD"), ("costco", "COST"),
    ("salesforce", "CRM"), ("oracle", "ORCL"), ("intel", "INTC"), ("amd", "AMD"),
    ("advanced micro devices", "AMD"), ("broadcom", "AVGO"), ("qualcomm", "QCOM"),
    ("texas instruments", "TXN"), ("cisco", "CSCO"), ("cisco systems", "CSCO"),
    ("ibm", "IBM"), ("adobe", "ADBE"), ("uber", "UBER"), ("lyft", "LYFT"),
    ("airbnb", "ABNB"), ("robinhood", "HOOD"), ("coinbase", "COIN"),
    ("palantir", "PLTR"),
]
OVERRIDE_CONFIDENCE = 0.99
EXACT_CONFIDENCE = 1.0
FUZZY_HIGH = 0.90
FUZZY_MIN = 0.80

# --- fixed values: ticker extraction from asset names --------------------------
ASSET_NAME_TICKERS = [
    ("Apple, Inc.", "AAPL"), ("Amazon", "AMZN"), ("Amazon.com", "AMZN"),
    ("AMAZON COM INC", "AMZN"), ("Google", "GOOG"), ("Alphabet Inc", "GOOG"),
    ("Facebook", "META"), ("Meta Platforms", "META"), ("Microsoft", "MSFT"),
    ("MICROSOFT CORP", "MSFT"), ("Tesla", "TSLA"), ("TESLA INC", "TSLA"),
    ("NVIDIA", "NVDA"), ("NVIDIA CORP", "NVDA"), ("UNIVAR INC.", "UNVR"),
    ("POST HOLDINGS INC.", "POST"), ("DIGITAL REALTY TRUST INC", "DLR"),
    ("ANTERO MIDSTREAM GP LP", "AM"), ("DOWDUPONT INC.", "DD"),
    ("Cabela's Inc CMN", "CAB"), ("Kite Pharma, Inc (stock) NASDAQ", "KITE"),
    ("Centurylink Inc. (stock) NYSE", "CTL"),
    ("OCI NV Sponsored ADR (stock) NYSE", "OCI"),
    ("Wynn Resorts LTD (stock) NASDAQ", "WYNN"), ("Univar Inc. (stock)", "UNVR"),
    ("REALNETWORKS INC (stock) NASDAQ", "RNWK"),
    ("Esterline Technologies Corporation (stock) NYSE", "ESL"),
    ("CSX Corporation (stock) NASDAQ", "CSX"),
    ("Devon Energy Corp. (stock) NYSE", "DVN"),
    ("CEMEX - SAB DE CV sponsored ADR Part CER (stock) NYSE", "CX"),
    ("Mohawk Industries Inc. (stock) NYSE", "MHK"),
    ("Post Holdings Inc. (stock)", "POST"),
    ("Applied Materials Incorporated (stock) NASDAQ", "AMAT"),
    ("Zimmer Biomet Holdings, Inc. (stock) NYSE", "ZBH"),
    ("Lowes Corporation (stock) NYSE", "LOW"),
    ("Park Hotels and Resorts Inc. (stock) NYSE", "PK"),
    ("Ingersoll Rand PLC (stock) NYSE", "IR"),
    ("Energy Transfer Equity (ETE)", "ET"), ("Tesoro Logistics LP CMN", "ANDX"),
    ("Advanced Disposal Services Inc., Del common stock", "ADSW"),
    ("APPLE INC", "AAPL"), ("BOEING CO", "BA"), ("BOEING COMPANY", "BA"),
    ("WALT DISNEY CO", "DIS"), ("DISNEY", "DIS"), ("EXXON MOBIL CORP", "XOM"),
    ("CHEVRON CORP", "CVX"), ("JOHNSON & JOHNSON", "JNJ"),
    ("PROCTER & GAMBLE CO", "PG"), ("JPMORGAN CHASE", "JPM"),
    ("BANK OF AMERICA", "BAC"), ("WELLS FARGO", "WFC"), ("GOLDMAN SACHS", "GS"),
    ("MORGAN STANLEY", "MS"), ("INTEL CORP", "INTC"), ("CISCO SYSTEMS", "CSCO"),
    ("PFIZER INC", "PFE"), ("MERCK & CO", "MRK"), ("ABBVIE INC", "ABBV"),
    ("COMCAST CORP", "CMCSA"), ("AT&T INC", "T"), ("VERIZON", "VZ"),
    ("HOME DEPOT", "HD"), ("WALMART INC", "WMT"), ("COSTCO", "COST"),
    ("BERKSHIRE HATHAWAY", "BRK.B"), ("SALESFORCE", "CRM"), ("ADOBE INC", "ADBE"),
    ("NETFLIX INC", "NFLX"), ("PAYPAL", "PYPL"), ("VISA INC", "V"),
    ("MASTERCARD", "MA"), ("UNITEDHEALTH", "UNH"),
]
FUND_WORDS = [
    "fund", "trust", "portfolio", "bond", "tiaa", "vanguard", "fidelity",
    "schwab", "morgan stanley institutional", "age-based", "lifecycle",
    "retirement", "savings plan", "municipal", "treasury", "money market",
    "certificate", "annuity", "reit", "index", "etf",
]
BARE_TICKER_PATTERN = r"^[A-Z]{1,5}$"
PAREN_TICKER_PATTERN = r"\(([A-Z]{1,5}(?:\.[A-Z])?)\)"
ASSET_SUFFIX_PATTERN = (
    r"(?i),?\s*(?:Inc\.?|Corp\.?|Corporation|Company|Co\.?|Ltd\.?|PLC|LP|LLC|CMN|N\.?V\.?|SA|AG|SE|"
    r"common\s+stock|sponsored\s+ADR|Del|New|Class\s+[A-Z])\s*\.?\s*"
)
STOCK_TAIL_PATTERN = r"(?i)\s*\(stock\)\s*(NYSE|NASDAQ)?\s*$"

# --- fixed values: ticker mentions in text --------------------------------------
MENTION_PATTERN = r"\$?([A-Z]{1,5})\b"
MENTION_STOP_WORDS = [
    "A", "I", "AM", "PM", "AN", "AS", "AT", "BE", "BY", "DO",
    "GO", "HE", "IF", "IN", "IS", "IT", "ME", "MY", "NO", "OF",
    "OK", "ON", "OR", "SO", "TO", "UP", "US", "WE", "CEO", "CFO",
    "CTO", "VP", "HR", "PR", "TV", "UK", "EU", "UN", "GDP", "FBI",
    "CIA", "SEC", "FEC", "IRS", "DOJ", "EPA", "FDA", "FCC", "FTC",
    "NASA", "NATO", "NYSE", "IPO", "ETF", "LLC", "INC", "CORP",
    "THE", "FOR", "AND", "BUT", "NOT", "YOU", "ALL", "CAN", "HER",
    "WAS", "ONE", "OUR", "OUT", "HAS", "HAD", "HOW", "NEW", "NOW",
    "OLD", "SEE", "WAY", "WHO", "DID", "GET", "HIS", "LET", "SAY",
    "SHE", "TOO", "USE", "ACT", "MAY", "USA", "RSS",
]

# --- fixed values: lobbying -------------------------------------------------------
BILL_REFERENCE_PATTERN = (
    r"(?i)\b(?:H\.?\s*R\.?|S\.?|H\.?\s*J\.?\s*Res\.?|S\.?\s*J\.?\s*Res\.?)\s*(\d+)\b"
)
FORMER_LEGISLATURE_WORDS = [
    "senator", "representative", "congressman", "congresswoman",
    "house", "senate", "staff director", "chief of staff",
    "legislative director", "counsel to", "chief counsel",
]
FORMER_EXECUTIVE_WORDS = [
    "white house", "executive office", "department of",
    "secretary", "administrator", "commissioner",
    "director of", "assistant secretary",
]

# --- fixed values: filing text ------------------------------------------------------
FILING_ROW_PATTERN = (
    r"([PSE](?:\s*\((?:partial|full)\))?)\s+(\d{2}/\d{2}/\d{4})(\d{2}/\d{2}/\d{4})"
    r"(\$[\d,]+\s*-\s*\$[\d,]+(?:\+)?|\$[\d,]+\+)"
)
FILING_STATE_PATTERN = r"State/District:\s*([A-Z]{2}\d{0,2})"
FILING_TICKER_PATTERN = r"\(([A-Z]{1,5})\)"
ASSET_CLASS_TAG_PATTERN = r"\[(?:ST|OP|OT|CS|EF|MF|BN|DC|OI)\]"

# --- fixed values: member linking ----------------------------------------------------
NAME_SUFFIX_PATTERN = r"(?i)\s+(Jr\.?|Sr\.?|III\.?|II\.?|IV\.?|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|MD|FACS|Hon)\s*$"
MEMBER_OVERRIDES = [
    ("McConnell, A. Mitchell Jr.", "M000355"), ("Allen, Hon.. Richard W.", "A000372"),
    ("Banks, Hon.. James E Hon", "B001311"), ("Barragan, Hon.. Nanette", "B001300"),
    ("Casey, Robert P. Jr.", "C001070"), ("Crapo, Michael D.", "C000880"),
    ("Crenshaw, Hon.. Daniel", "C001120"), ("Delaney, Hon.. April McClain", "D000632"),
    ("Dunn, MD, FACS, Hon.. Neal Patrick", "D000628"),
    ("Fallon, Hon.. Patrick", "F000246"), ("Franklin, Hon.. C. Scott", "F000472"),
    ("Garcia, Hon.. Michael", "G000061"), ("Green, Hon.. Mark Dr", "G000590"),
    ("Hill, Hon.. James French", "H001082"), ("Jacobs, Hon.. Christopher L.", "J000020"),
    ("Keating, Hon.. William R.", "K000375"), ("Kennedy, John", "K000393"),
    ("McCormick, Hon.. Richard Dean Dr", "M001224"), ("McGuire, Hon.. John", "M001225"),
    ("Moore, Hon.. Felix Barry", "M001212"), ("Reed, John F.", "R000122"),
    ("Webster, Hon.. Daniel", "W000806"),
]

# --- fixed values: signals and screening -----------------------------------------------
SIGNAL_LIFETIME_DAYS = {
    "trade_follow": 7, "anomaly_alert": 21, "sentiment_divergence": 14,
    "insider_cluster": 10,
}
ALERTS_PER_HOUR = 10
ANOMALY_EXCLUDED_FEATURES = [
    "price_change_5d", "price_change_21d", "volatility_21d", "volume_ratio_5d", "rsi_14",
]
META_FEATURES = [
    "trade_predictor_proba", "return_predictor_score", "anomaly_score",
    "timing_suspicion_score", "avg_sentiment_7d",
]
FEATURE_METADATA_COLUMNS = [
    "trade_id", "ticker", "transaction_date", "disclosure_date", "transaction_type",
    "filer_type", "amount_range_low", "amount_range_high", "member_bioguide_id",
    "trade_chamber", "party", "member_chamber", "first_elected", "base_price",
    "base_date", "price_future", "future_date", "actual_return", "profitable",
    "is_purchase", "directional_return", "sample_weight", "asset_name", "asset_type",
]

# --- fixed values: graph ----------------------------------------------------------------
EDGE_TYPES = [
    ("Member", "TRADED", "Company"),
    ("Member", "SITS_ON", "Committee"),
    ("Member", "SPONSORED", "Bill"),
    ("Member", "COSPONSORED", "Bill"),
    ("Bill", "REFERRED_TO", "Committee"),
    ("LobbyingFirm", "LOBBIED_FOR", "Company"),
    ("LobbyingFirm", "LOBBIED", "Member"),
    ("Lobbyist", "EMPLOYED_BY", "LobbyingFirm"),
    ("Lobbyist", "FORMERLY_AT", "Member"),
    ("Company", "DONATED_TO", "Member"),
    ("Committee", "HEARING_ON", "Bill"),
]

# Small default word list of the pluggable media scorer (this library's own).
SENTIMENT_WORDS = {
    "gain": 1, "growth": 1, "profit": 1, "strong": 1, "benefit": 1, "success": 1,
    "improve": 1, "positive": 1, "win": 1, "support": 1,
    "loss": -1, "decline": -1, "risk": -1, "weak": -1, "fraud": -1, "failure": -1,
    "worthless": -1, "negative": -1, "penalty": -1, "oppose": -1,
}
