"""Fixed values of the domain: rule tables, lists, code maps and wordings.

Everything below is data. Results must equal these values exactly, so they are written
out plainly. A rule table is an ordered list of (result, keywords); the first rule with
a keyword contained in the lower-cased text wins.
"""

# --- fixed values: stage keyword rules -------------------------------------------------
STAGE_RULES_TRAIN = [
    (1, ["pre-seed", "pre seed", "angel", "friends"]),
    (2, ["seed"]),
    (3, ["pre-series a", "pre series a", "bridge"]),
    (4, ["series a"]),
    (5, ["series b"]),
    (6, ["series c"]),
    (7, ["series d", "series e", "series f"]),
    (8, ["private equity", "pe"]),
    (9, ["ipo", "public"]),
    (2, ["debt", "loan"]),
]
STAGE_RULES_SERVE = [
    (1, ["pre-seed", "angel"]),
    (2, ["seed"]),
    (3, ["pre-series", "bridge"]),
    (4, ["series a"]),
    (5, ["series b"]),
    (6, ["series c"]),
    (7, ["series d", "series e"]),
    (8, ["private equity"]),
    (9, ["ipo"]),
]
STAGE_DEFAULT = 2

# --- fixed values: industry keyword rules ----------------------------------------------
INDUSTRY_RULES_TRAIN = [
    ("EdTech", ["edtech", "education", "learning", "training"]),
    ("FinTech", ["fintech", "finance", "financial", "banking", "payment", "lending"]),
    ("HealthTech", ["health", "medical", "pharma", "biotech", "wellness"]),
    ("E-Commerce", ["ecommerce", "e-commerce", "retail", "trading", "commerce"]),
    ("Tech/SaaS", ["saas", "software", "technology", "tech", "internet", "consumer internet"]),
    ("FoodTech", ["food", "foodtech", "restaurant", "delivery", "foodstuff"]),
    ("Logistics", ["logistic", "transport", "supply chain", "storage"]),
    ("RealEstate", ["real estate", "proptech", "renting", "construction"]),
    ("AgriTech", ["agriculture", "agri", "allied activities"]),
    ("Media", ["media", "entertainment", "content", "news"]),
    ("Manufacturing", ["manufacturing", "machinery", "metals", "chemicals"]),
    ("Services", ["business services", "consulting", "community", "personal", "social"]),
    ("Travel", ["travel", "tourism", "hospitality"]),
]
INDUSTRY_DEFAULT_TRAIN = "Other"
INDUSTRY_RULES_SERVE = [
    ("EdTech", ["edtech", "education", "learning"]),
    ("FinTech", ["fintech", "finance", "financial", "payment", "banking"]),
    ("HealthTech", ["health", "medical", "pharma", "biotech", "wellness"]),
    ("E-Commerce", ["ecommerce", "e-commerce", "retail", "commerce", "trading"]),
    ("Tech/SaaS", ["saas", "software", "technology", "tech", "internet"]),
    ("FoodTech", ["food", "restaurant", "delivery"]),
    ("Logistics", ["logistic", "transport", "supply"]),
    ("RealEstate", ["real estate", "proptech", "construction"]),
    ("AgriTech", ["agri", "agriculture"]),
    ("Media", ["media", "entertainment", "content"]),
    ("Manufacturing", ["manufacturing", "machinery"]),
]
INDUSTRY_DEFAULT_SERVE = "Services"

# --- fixed values: lists ---------------------------------------------------------------
MAJOR_CITIES = ["Bangalore", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Pune"]
TECH_INDUSTRIES = ["EdTech", "FinTech", "HealthTech", "Tech/SaaS", "E-Commerce"]
CITY_FIXES = {
    "Bengaluru": "Bangalore",
    "New Delhi": "Delhi",
    "Gurugram": "Gurgaon",
    "Ncr": "Delhi",
    "Delhi Ncr": "Delhi",
}
STATUS_CODES = {"operating": 0, "closed": 1, "acquired": 2, "ipo": 2}

# --- fixed values: funding bands (upper edges of bands 1 to 4) --------------------------
FUNDING_BAND_EDGES = [100_000, 500_000, 2_000_000, 10_000_000]

# --- fixed values: display labels ------------------------------------------------------
STAGE_LABELS = {
    1: "Pre-seed/Angel", 2: "Seed/Early", 3: "Bridge/Pre-A", 4: "Series A", 5: "Series B",
    6: "Series C", 7: "Late Stage", 8: "Private Equity", 9: "IPO",
}

# --- fixed values: frozen codes of the scoring service ----------------------------------
SERVICE_CITY_CODES = {
    "Ahmedabad": 0, "Bangalore": 1, "Chennai": 2, "Delhi": 3, "Gurgaon": 4, "Hyderabad": 5,
    "Indore": 6, "Jaipur": 7, "Kochi": 8, "Kolkata": 9, "Mumbai": 10, "Noida": 11, "Other": 12,
    "Patna": 13, "Unknown": 14, "Visakhapatnam": 15,
}
SERVICE_INDUSTRY_CODES = {
    "AgriTech": 0, "E-Commerce": 1, "EdTech": 2, "FinTech": 3, "FoodTech": 4, "HealthTech": 5,
    "Logistics": 6, "Manufacturing": 7, "Media": 8, "Other": 9, "RealEstate": 10, "Services": 11,
    "Tech/SaaS": 12, "Travel": 13,
}

# --- fixed values: frozen codes of the dashboard -----------------------------------------
DASHBOARD_CITY_CODES = {
    "Bangalore": 6, "Mumbai": 61, "New Delhi": 66, "Gurgaon": 33, "Hyderabad": 37, "Chennai": 18,
    "Pune": 73, "Noida": 67, "Delhi": 23, "Ahmedabad": 2, "Kolkata": 50, "Jaipur": 42, "Kochi": 49,
    "Chandigarh": 17, "Indore": 40, "Bhopal": 13, "Surat": 80, "Nagpur": 63, "Lucknow": 52,
    "Goa": 30, "Other": 0,
}
DASHBOARD_INDUSTRY_CODES = {
    "E-Commerce": 3, "Tech/SaaS": 12, "EdTech": 2, "FinTech": 4, "HealthTech": 6, "FoodTech": 5,
    "Logistics": 8, "RealEstate": 10, "AgriTech": 0, "Media": 9, "Manufacturing": 7,
    "Services": 11, "Travel": 13, "Other": 1,
}
DASHBOARD_STAGE_CODES = {
    "Pre-seed / Angel": 1, "Seed": 2, "Bridge / Pre-Series A": 3, "Series A": 4, "Series B": 5,
    "Series C": 6, "Late Stage (D/E/F)": 7, "Private Equity": 8, "IPO": 9,
}

# --- fixed values: rule classifier -------------------------------------------------------
RULE_THRESHOLD = 500_000
RULE_CONFIDENCE = 0.72

# --- fixed values: wordings of the reason text; {x} is filled from the record -------------
SAFE_PREFIX = "This startup shows "
SAFE_JOIN = ", and "
FAILED_PREFIX = "Warning signals detected: "
FAILED_JOIN = ", "
REASON_SUFFIX = "."
REASON_FALLBACK = "combination of market and operational risk factors"
REASON_LIMIT = 3
SAFE_REASONS = {
    "strong": "strong funding of {symbol}{amount}M",
    "solid": "solid funding of {symbol}{amount}M",
    "early": "early-stage funding in place",
    "many_rounds": "{rounds} funding rounds showing investor confidence",
    "some_rounds": "{rounds} funding rounds indicating traction",
    "city": "strong startup ecosystem in {city}",
    "tech": "high-growth {industry} sector",
    "late": "late-stage funding indicating maturity",
}
FAILED_REASONS = {
    "none": "very limited funding runway",
    "little": "insufficient capital ({symbol}{amount}M)",
    "rounds": "limited investor backing",
    "debt": "debt/bridge financing signals financial stress",
}
FAILED_REASONS_BY_STYLE = {
    "service": {
        "city": "limited startup ecosystem support in {city}",
        "industry": "challenging market conditions for {industry}",
    },
    "dashboard": {
        "city": "limited startup ecosystem in {city}",
        "industry": "challenging market for {industry} sector",
    },
}
LATE_STAGE_WORDS = {"service": ["series b", "series c", "series d", "private equity"], "dashboard": []}
STRESS_STAGE_WORDS = {"service": ["debt", "bridge", "unknown"], "dashboard": ["debt", "bridge"]}

# --- fixed values: advice, four per outcome, first matching condition wins -----------------
SAFE_ADVICE = {
    "service": [
        "Consider raising a Seed or Series A round to strengthen runway. Focus on achieving product-market fit before scaling.",
        "Good foundation! Focus on unit economics and customer retention. Prepare for Series A with clear growth metrics.",
        "Strong funding base. Expand to Tier-2 cities and diversify revenue streams to reduce risk.",
        "Excellent position! Consider strategic partnerships and international expansion. Profitability roadmap should be prioritized.",
    ],
    "dashboard": [
        "Consider raising a Seed or Series A round to strengthen runway. Focus on product-market fit before scaling.",
        "Good foundation! Focus on unit economics and retention. Prepare for Series A with clear growth metrics.",
        "Strong funding base. Expand to Tier-2 cities and diversify revenue streams.",
        "Excellent position! Consider strategic partnerships and international expansion.",
    ],
}
FAILED_ADVICE = {
    "service": [
        "Urgently seek bridge funding or angel investment. Reduce burn rate immediately and focus on a single core product.",
        "Strengthen your pitch deck and approach angel investors or accelerators like Y Combinator India or Sequoia Surge.",
        "Consider relocating operations to Bangalore or Mumbai for better access to investors and talent.",
        "Re-evaluate business model and pivot if needed. Focus on reducing CAC and improving LTV. Seek mentorship from experienced founders.",
    ],
    "dashboard": [
        "Urgently seek bridge funding or angel investment. Reduce burn rate and focus on a single core product.",
        "Strengthen your pitch and approach angel investors or accelerators like Y Combinator India or Sequoia Surge.",
        "Consider relocating to Bangalore or Mumbai for better access to investors and talent.",
        "Re-evaluate business model. Focus on reducing CAC and improving LTV. Seek mentorship from experienced founders.",
    ],
}
