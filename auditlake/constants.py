"""Enumerations, ranks, weights, thresholds, word lists and patterns that results depend on."""

LEVELS = ("watch", "low", "medium", "high")
STATUSES = ("new", "effective", "deadline", "ongoing", "unconfirmed")
BREAKDOWN = ("regulatory_force", "business_exposure", "urgency", "consequence", "evidence")
LEVEL_FLOORS = ((8, "high"), (5, "medium"), (2, "low"))
THRESHOLDS = (1, 4, 7)
POLICY_AREAS = (
    "onboarding_kyc", "listing_product_compliance", "pricing_promotions", "fees_commissions", "fulfillment_logistics", "returns_refunds_aftersales",
    "payments_settlement_tax", "content_ads_affiliate", "data_privacy_security", "account_health_enforcement", "api_feature_deprecation", "other",
)
CHANGE_TYPES = ("new_rule", "rule_change", "enforcement_change", "fee_change", "feature_change", "deadline", "clarification")
ACCESS_RESULTS = ("public_checked", "login_required", "blocked", "checked_authenticated", "not_checked", "not_applicable")
SOURCE_TYPES = ("official_updates", "current_policy", "dashboard", "discovery_lead")
SOURCE_RESULTS = ("no_relevant_update", "candidate_found", "verified_event", "login_required", "blocked", "not_applicable")
POSITIVE_RESULTS = ("no_relevant_update", "candidate_found", "verified_event")
SOURCE_TIERS = {
    "official_lead": 20, "platform_owned": 20, "government_affiliated": 18, "industry_association": 17, "carrier_or_port": 16,
    "trade_media": 14, "seller_forum": 8, "social": 5, "other": 3,
}

MATERIAL_FIELDS = ("jurisdiction", "authority", "published_date", "effective_date", "deadline", "published_at", "effective_at", "deadline_at", "source_timezone", "source_url")
POLICY_FIELDS = ("platform", "seller_market", "program", "policy_area", "change_type", "seller_scope", "previous_state", "new_state", "enforcement_consequence")
MATCH_WEIGHTS = {"title": 0.30, "authority": 0.12, "jurisdiction": 0.10, "products_or_channels": 0.12, "source_url": 0.14, "regulatory_identifiers": 0.12, "platform_scope": 0.10}
IDENTIFIER_CEILING = 0.79
MATCH_THRESHOLD, REVIEW_THRESHOLD = 0.82, 0.65
MATCHING = "one_to_one_weighted_v2"

UNKNOWN_SCOPES = ("", "unknown", "global", "not stated", "n/a", "none")
SCOPE_ALIASES = {
    "us": "united states", "usa": "united states", "u s": "united states", "united states of america": "united states", "eu": "european union",
    "e u": "european union", "prc": "china", "cn": "china", "uk": "united kingdom", "u k": "united kingdom",
}
CATALOG_ALIASES = {
    "us": "united states", "usa": "united states", "美国": "united states", "eu": "european union", "欧盟": "european union", "cn": "china",
    "中国": "china", "中华人民共和国": "china", "uk": "united kingdom", "英国": "united kingdom",
}
TRACKING_KEYS = ("from", "source", "ref", "ref_", "spm", "scm")

OBLIGATIONS = (
    "allowed", "cancelled", "exempt", "exemption", "may not", "must", "prohibit", "prohibited", "required", "requirement", "resumed", "suspended",
    "不得", "允许", "应当", "必须", "恢复", "暂停", "禁止", "要求", "豁免",
)
#: All begin with a digit, which the first part looks for before it tries the forms.
FACTS = (
    r"(?=[\d一二三四五六七八九十百千万])(?:\d{4}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?"
    r"|\b\d{6,10}\b"
    r"|\d+(?:[.,]\d+)?\s*(?:%|％|percent|percentage points?|个百分点|欧元|美元|元|days?|天|日|个月|months?|years?|年)"
    r"|[一二三四五六七八九十百千万]+(?:欧元|美元|元|天|日|个月|年))"
)
IDENTIFIERS = (
    r"\b(?:celex|docket|document|notice|regulation|directive|decision|rule)\s*(?:no\.?|number|id|:)?\s*(?=[a-z0-9./()_-]*\d)[a-z0-9][a-z0-9./()_-]{2,}\b"
    r"|(?:公告|令|通知)\s*(?:第)?[0-9]{2,4}(?:\s*年|[-/])?[0-9]*\s*号?"
)

LEAD_WEIGHTS = (0.55, 0.30, 0.15)
CLUSTER_THRESHOLD, MINIMUM_PRIORITY = 0.62, 45
AUTO_TITLE, AUTO_URL_TITLE, REVIEW_TITLE = 0.44, 0.65, 0.30
RECENCY = ((24, 25), (72, 21), (168, 16), (336, 10), (720, 5))
HEALTH_STATES = ("ok", "no_relevant_update", "partial", "blocked", "login_required", "timeout", "rate_limited", "schema_drift", "not_configured", "not_checked")
SEVERE_STATES = ("blocked", "login_required", "timeout", "rate_limited", "schema_drift")
INCOMPLETE_STATES = ("partial", "not_checked", "not_configured")
FIX_HINTS = {
    "ok": "No access fix required; continue substantive source review.",
    "no_relevant_update": "No access fix required; retain the checked URL and snapshot evidence.",
    "partial": "Complete route verification, candidate review, or the required public-page snapshot.",
    "blocked": "Retry through the in-app browser and record the observed access boundary.",
    "login_required": "Use an existing authorized read-only browser session; do not bypass authentication.",
    "timeout": "Retry with a bounded timeout or use the in-app browser; do not treat this as no update.",
    "rate_limited": "Retry later with bounded rate limiting; do not reuse the failed result as coverage.",
    "schema_drift": "Inspect the source response and update the parser or registered route before reuse.",
    "not_configured": "Add and verify an official route or preserve the declared coverage gap.",
    "not_checked": "Open the planned route and create a receipt before claiming coverage.",
}
DASHBOARD_HINT = "Check this dashboard through an existing authorized read-only browser session."
GATES = {"minimum_positive_events": 20, "precision": 0.9, "recall": 0.9, "primary_source_rate": 0.95, "date_accuracy": 0.98, "deduplication_accuracy": 0.9, "unsupported_sources": 0}
SIGNATURE_FIELDS = ("id", "source_url", "published_at", "published_date", "effective_at", "effective_date", "deadline_at", "deadline", "summary")
XML_LIMIT = 5 * 1024 * 1024

# Fixed values of plans: regions, subject, authorities and routes that a scope without its own has, and the wording of drills.
DEFAULT_REGIONS = ("China", "United States", "European Union")
DEFAULT_SUBJECT = "trade customs sanctions tariffs product compliance import ban equipment authorization covered list national security new models"
AUTHORITIES = {
    "china": ("Ministry of Commerce", "General Administration of Customs", "State Taxation Administration", "SAMR"),
    "united states": ("Federal Register", "BIS", "OFAC", "USTR", "CBP", "FCC Covered List"),
    "european union": ("European Commission", "EUR-Lex", "Access2Markets"),
}
AUTHORITY_REGIONS = {"cn": "china", "usa": "united states", "us": "united states", "eu": "european union"}
MARITIME_AUTHORITIES = (
    "UK Maritime Trade Operations", "International Maritime Organization", "Joint Maritime Information Center", "Maritime Security Centre Indian Ocean",
    "U.S. Maritime Administration",
)
MARITIME_URLS = (
    "https://www.ukmto.org/recent-incidents", "https://www.ukmto.org/ukmto-products",
    "https://www.imo.org/en/mediacentre/hottopics/pages/middle-east-strait-of-hormuz.aspx", "https://www.maritime.dot.gov/msci",
)
MARITIME_QUERIES = (
    "Strait of Hormuz UKMTO vessel attack incident closure reopening safe navigation shipping",
    "Bab el-Mandeb Red Sea UKMTO vessel attack blockade rerouting shipping",
    "Suez Canal authority closure grounding congestion transit advisory",
    "Panama Canal authority restrictions draft congestion transit advisory",
    "South China Sea Taiwan Strait Black Sea maritime incident port closure shipping advisory",
    "Maersk CMA CGM Hapag-Lloyd MSC service suspension surcharge rerouting maritime security",
)
DRILL_QUERIES = ("official current consolidated text", "amendment corrigendum implementation guidance", "effective date deadline enforcement")
DRILL_QUESTIONS = (
    "What is the current operative text, and has it been amended, corrected, superseded, or withdrawn?",
    "What are the exact publication, effective, transition, expiry, and deadline timestamps and timezones?",
    "Which jurisdictions, products, HS codes, seller markets, programs, and business models are actually in scope?",
    "What filing, document, labeling, listing, fulfillment, payment, or account action is required?",
    "What enforcement consequence applies, and what official implementation guidance exists?",
    "What material facts changed since the earliest stored sighting?",
)
DRILL_POLICY_QUESTION = "Does the platform-owned current policy or account notice confirm the same market and program scope?"

# Fixed values of platform files: kinds, access and roles of routes, and the fields that each file has.
ROUTE_ROLES = {"official_updates": "discovery", "current_policy": "current_rule", "dashboard": "account_specific"}
ROUTE_ACCESS = ("public", "authenticated", "mixed")
PLATFORM_LISTS = ("aliases", "seller_markets", "programs", "dashboard_checks", "applicability_dimensions", "policy_areas", "notes")
