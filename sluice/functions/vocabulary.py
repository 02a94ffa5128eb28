"""Word lists and weights that results depend on."""

from __future__ import annotations

# They must equal the ones the results are defined by.

#: (category, strong terms, broad terms), in rule order.
CATEGORY_RULES = [
    (
        "Audit",
        (
            "external audit services", "statutory audit services", "financial audit services",
            "internal audit services", "project audit services", "forensic audit services",
            "audit of financial statements", "appointment of external auditor", "independent audit firm",
            "qualified audit firms", "assurance services", "agreed upon procedures", "agreed-upon procedures",
        ),
        (
            "external audit", "statutory audit", "financial audit", "internal audit", "project audit",
            "forensic audit", "auditor", "auditing", "financial statements", "fund accountability statement",
        ),
    ),
    (
        "Accounting",
        (
            "accounting services", "bookkeeping services", "financial reporting services",
            "preparation of financial statements", "outsourced accounting", "accounting support services",
        ),
        (
            "accounting", "bookkeeping", "financial reporting", "general ledger", "account reconciliation", "ifrs",
            "ipsas",
        ),
    ),
    (
        "Tax",
        (
            "tax advisory services", "tax consultancy services", "tax compliance services",
            "transfer pricing services",
        ),
        (
            "tax advisory", "tax compliance", "taxation", "value added tax", "withholding tax",
            "corporate income tax", "transfer pricing",
        ),
    ),
    (
        "Recruitment",
        (
            "recruitment services", "staff recruitment services", "executive search services",
            "recruitment consultancy", "candidate assessment services",
        ),
        (
            "recruitment firm", "executive search", "headhunting", "staff selection", "candidate assessment",
        ),
    ),
    (
        "Consulting",
        (
            "consultancy services to conduct", "consulting services to conduct", "consultancy assignment",
            "technical assistance services", "institutional assessment consultancy",
            "policy development consultancy", "strategy development consultancy", "feasibility study consultancy",
            "baseline study consultancy", "endline evaluation consultancy", "impact assessment consultancy",
        ),
        (
            "consultancy", "consultant", "technical assistance", "institutional assessment", "policy development",
            "strategy development", "feasibility study", "baseline study", "endline evaluation",
            "midterm evaluation", "impact assessment",
        ),
    ),
    (
        "Risk and Governance",
        (
            "risk management consultancy", "enterprise risk management consultancy",
            "corporate governance consultancy", "governance assessment services", "internal control review services",
            "compliance review services", "fraud risk assessment services",
        ),
        (
            "risk management", "corporate governance", "internal controls", "compliance review", "fraud risk",
            "governance framework", "risk assessment",
        ),
    ),
    (
        "Due Diligence",
        (
            "financial due diligence services", "commercial due diligence services", "vendor due diligence services",
            "transaction due diligence services",
        ),
        (
            "due diligence", "business verification", "financial verification", "transaction advisory",
        ),
    ),
    (
        "Training",
        (
            "provision of training services", "capacity building services", "training consultancy services",
            "financial management training services", "accounting training services", "audit training services",
        ),
        (
            "training services", "capacity building", "workshop facilitation", "coaching services",
        ),
    ),
    (
        "Payroll",
        (
            "payroll services", "payroll outsourcing services", "payroll management services",
        ),
        (
            "payroll outsourcing", "salary processing services", "employee benefits administration",
        ),
    ),
    (
        "Environmental and Social Consulting",
        (
            "environmental and social impact assessment services", "environmental audit services",
            "environmental consultancy services", "social impact assessment services", "esia consultancy",
            "environmental management plan consultancy",
        ),
        (
            "environmental and social impact assessment", "environmental audit", "social safeguards", "esia", "esmp",
            "environmental assessment",
        ),
    ),
]

STRONG_PROCUREMENT = (
    "request for proposal", "request for proposals", "request for quotation", "request for quotations",
    "request for expression of interest", "request for expressions of interest", "call for expression of interest",
    "call for expressions of interest", "invitation to bid", "invitation for bids", "invitation to tender",
    "invitation for tender", "tender notice", "procurement notice", "specific procurement notice",
    "general procurement notice", "call for proposals", "terms of reference", "solicitation document",
    "bidding document", "bid document",
)
ABBREVIATIONS = (
    "rfp", "rfq", "eoi", "tor", "itb",
)
SUBMISSION = (
    "submit a proposal", "submit proposals", "submission of proposals", "proposal submission", "bid submission",
    "submit a bid", "submit bids", "bids must be submitted", "proposals must be submitted",
    "applications must be submitted", "invites eligible firms", "invites qualified firms",
    "invites interested firms", "interested firms are invited", "eligible bidders are invited",
    "qualified bidders are invited", "solicits proposals", "invites proposals", "invites quotations",
)
METADATA = (
    "tender number", "tender reference", "procurement reference", "reference number", "bid number", "rfp number",
    "rfq number", "submission deadline", "proposal deadline", "bid deadline", "application deadline", "closing date",
    "closing deadline", "deadline for submission", "date of submission", "bid opening", "technical proposal",
    "financial proposal", "eligibility criteria", "evaluation criteria",
)
FIRM = (
    "qualified firm", "qualified firms", "eligible firm", "eligible firms", "interested firm", "interested firms",
    "consulting firm", "consultancy firm", "audit firm", "service provider", "service providers", "qualified bidder",
    "qualified bidders", "eligible bidder", "eligible bidders", "interested bidder", "interested bidders",
    "company or firm", "companies or firms",
)
EMPLOYMENT = (
    "full time employee", "employment contract", "monthly salary", "job applicant", "individual applicant",
    "submit your cv", "send your cv", "upload your cv", "curriculum vitae only", "employee benefits",
    "reporting to the manager", "job description", "career opportunity", "vacant position", "vacancy announcement",
    "apply for this job",
)
GENERIC_PAGE = (
    "about us", "our services", "consulting services worldwide", "consulting industry", "our team",
    "leadership team", "contact us", "privacy policy", "cookie policy", "terms and conditions", "careers",
    "latest jobs", "job listings", "blog", "news article", "training catalogue", "course catalogue",
    "upcoming courses", "membership",
)
GENERIC_TITLES = (
    "about us", "services", "our services", "consulting services", "consulting industry", "responsibilities",
    "job description", "careers", "recruitment", "contact us", "home", "global", "europe", "north america", "africa",
    "rwanda",
)
DOCUMENT_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
)
DOCUMENT_HINTS = (
    "tender", "rfp", "rfq", "eoi", "tor", "expression of interest", "request for proposal", "request for quotation",
    "invitation to bid", "procurement", "bid document",
)
BLOCKED_DOMAINS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com",
    "reddit.com", "pinterest.com", "wikipedia.org", "dictionary.cambridge.org", "cambridge.org", "procore.com",
    "odoo.com", "lusha.com", "glassdoor.com", "indeed.com", "careers.org", "rwandayp.com", "techbehemoths.com",
)
LOW_VALUE_DOMAINS = (
    "dictionary", "directory", "yellowpages", "company-list", "business-list", "training-course", "marketing", "seo",
    "learning-center", "learning-centre", "blogspot", "wordpress",
)
LOW_VALUE_TEXTS = (
    "what is an invitation to bid", "definition of", "meaning of", "top companies", "best companies",
    "company directory", "business directory", "sales leads", "training venue", "training courses in",
    "accounting firms by country", "learning center", "learning centre",
)
SOURCE_OPPORTUNITY = (
    "tender", "tenders", "procurement", "request for proposal", "request for proposals", "rfp",
    "expression of interest", "eoi", "invitation to bid", "terms of reference", "consultancy", "consultant",
    "vacancy", "vacancies", "careers", "jobs", "opportunities", "call for proposals", "call for applications",
    "supplier", "vendor", "prequalification", "grant",
)
HIGH_VALUE_PATHS = (
    "/tender", "/procurement", "/opportun", "/career", "/vacanc", "/jobs", "/consult", "/rfp", "/eoi", "/bid",
    "/supplier",
)
TRUSTED_ORGANISATIONS = (
    "government", "ministry", "authority", "commission", "agency", "district", "university", "institute",
    "foundation", "association", "federation", "bank", "insurance", "united nations", "undp", "unicef", "unfpa",
    "unhcr", "iom", "world bank", "embassy", "ngo", "organisation", "organization", "limited", "ltd", "plc",
)
AGGREGATORS = (
    "tender portal", "tender notices", "global tenders", "jobs portal", "job portal", "all jobs", "career portal",
    "developmentaid", "tendersinfo", "tendersontime", "biddingsource", "tender impulse",
)
CRAWL_DOCUMENT_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
PAGE_LINK_TERMS = (
    "tender", "tenders", "procurement", "bid", "bids", "bidding", "opportunity", "opportunities", "consultancy",
    "consultancies", "consultant", "consulting", "proposal", "proposals", "expression of interest",
    "expressions of interest", "request for proposal", "request for proposals", "rfp", "eoi", "grant", "grants",
    "call for applications", "call for proposals", "announcement", "announcements", "notice", "notices", "supplier",
    "suppliers", "vendor", "vendors", "prequalification",
)
PAGE_OPPORTUNITY = (
    "request for proposal", "request for proposals", "request for quotation", "request for quotations",
    "request for expressions of interest", "request for expression of interest", "expression of interest",
    "expressions of interest", "invitation to bid", "invitation for bids", "invitation to tender", "tender notice",
    "procurement notice", "terms of reference", "consultancy services", "consulting services", "call for proposals",
    "call for applications", "call for consultants", "framework agreement", "submission deadline",
    "application deadline", "closing date", "applications are invited", "bids are invited", "eligible bidders",
    "interested consultants", "interested firms", "interested companies", "supplier registration",
    "prequalification",
)
EXCLUDED_LINKS = (
    "login", "sign in", "sign-in", "register account", "privacy", "cookie", "terms and conditions", "facebook",
    "twitter", "linkedin", "instagram", "youtube", "whatsapp", "mailto:", "tel:", "javascript:", "career", "careers",
    "vacancy", "vacancies", "job", "jobs",
)
INVALID_ORGANISATION_PHRASES = (
    "testimonials", "help about us", "contact us", "job in rwanda", "request for proposal title",
    "job advertisement", "news testimonials", "home jobs", "latest jobs", "submit a job", "career advice",
    "privacy policy", "terms and conditions", "all rights reserved",
)
ORGANISATION_LABELS = (
    "company", "employer", "organisation", "organization", "hiring organisation", "hiring organization", "client",
)
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid",
)
DISCOVERY_QUERIES = (
    '"external audit services" Rwanda', '"external audit" Rwanda tender', '"audit firm" Rwanda request for proposal',
    '"qualified audit firms" Rwanda', '"statutory audit services" Rwanda', '"internal audit services" Rwanda',
    '"project audit" Rwanda request for proposal', '"financial audit services" Rwanda',
    '"accounting firm" Rwanda tender', '"accounting services" Rwanda request for proposal',
    '"bookkeeping services" Rwanda', '"financial reporting services" Rwanda', '"IFRS consultancy" Rwanda',
    '"IPSAS consultancy" Rwanda', '"tax advisory services" Rwanda tender',
    '"tax consultancy" Rwanda request for proposal', '"tax compliance services" Rwanda',
    '"recruitment firm" Rwanda tender', '"recruitment services" Rwanda request for proposal',
    '"human resources consultancy" Rwanda', '"payroll services" Rwanda tender',
    '"consulting firm" Rwanda expression of interest', '"consultancy firm" Rwanda request for proposal',
    '"professional services firm" Rwanda tender', '"financial management services" Rwanda tender',
    '"risk management consultancy" Rwanda', '"governance consultancy" Rwanda', '"due diligence" Rwanda consultancy',
    '"capacity building" Rwanda consultancy', '"institutional assessment" Rwanda consultancy',
    '"request for proposal" Rwanda consulting firm', '"expression of interest" Rwanda professional services',
    '"request for quotation" Rwanda consultancy', '"terms of reference" Rwanda consulting firm',
    '"qualified firms" Rwanda proposals', '"framework agreement" Rwanda consultancy',
    '"prequalification of service providers" Rwanda', "site:.rw tender consultancy",
    "site:.rw procurement opportunities", 'site:.rw "request for proposal"', 'site:.rw "expression of interest"',
    'site:.rw "terms of reference" consultancy', 'site:.rw "qualified firms" proposals', 'site:.rw "audit services"',
    'site:.rw "accounting services"', 'site:.rw "recruitment services"', "site:.org.rw request for proposal",
    "site:.org.rw tender consultancy", "site:.org.rw external audit", "site:.co.rw tender services",
    "site:.co.rw procurement opportunities", "site:.gov.rw tender consultancy", "site:.gov.rw request for proposal",
)
SEARCH_QUERIES = (
    'Rwanda "request for proposal"', 'Rwanda "expression of interest"', 'Rwanda "invitation to bid"',
    'Rwanda "terms of reference" consultancy', "Rwanda procurement opportunities", "Rwanda tender notices",
    "Rwanda consultancy opportunities", "Rwanda audit tender", "Rwanda accounting consultancy",
    "Rwanda tax consultancy tender", "Rwanda recruitment consultancy", "Rwanda human resources consultancy",
    "Rwanda training consultancy", "Rwanda research consultancy", "Rwanda monitoring evaluation consultancy",
    "Rwanda environmental social impact assessment tender", "Rwanda NGO procurement", "Rwanda university tenders",
    "Rwanda private companies careers", "Rwanda organisations vacancies careers",
)

#: signal -> points, found as a substring.
SOURCE_SIGNALS = {
    "tender": 20,
    "procurement": 25,
    "request for proposal": 25,
    "request for quotation": 20,
    "expression of interest": 25,
    "terms of reference": 20,
    "consultancy": 15,
    "consulting firm": 20,
    "audit services": 25,
    "accounting services": 25,
    "qualified firms": 15,
    "bid": 10,
    "supplier": 10,
    "opportunities": 10,
    "login required": -20,
    "page not found": -50,
    "access denied": -40,
    "individual consultant only": -10,
}

#: (organisation_name, base_url, monitor_url, source_type)
SEED_SOURCES = [
    ("Rwanda Development Board", "https://rdb.rw", "https://rdb.rw", "Government Institution"),
    ("Rwanda Revenue Authority", "https://www.rra.gov.rw", "https://www.rra.gov.rw", "Government Institution"),
    ("Rwanda Public Procurement Authority", "https://www.rppa.gov.rw", "https://www.rppa.gov.rw", "Procurement Authority"),
    ("University of Rwanda", "https://ur.ac.rw", "https://ur.ac.rw", "University"),
    ("Rwanda Utilities Regulatory Authority", "https://www.rura.rw", "https://www.rura.rw", "Government Institution"),
    ("Rwanda Social Security Board", "https://www.rssb.rw", "https://www.rssb.rw", "Public Institution"),
    ("National Bank of Rwanda", "https://www.bnr.rw", "https://www.bnr.rw", "Public Institution"),
    ("Rwanda Governance Board", "https://www.rgb.rw", "https://www.rgb.rw", "Government Institution"),
    ("Rwanda Environment Management Authority", "https://www.rema.gov.rw", "https://www.rema.gov.rw", "Government Institution"),
    ("Job in Rwanda", "https://www.jobinrwanda.com", "https://www.jobinrwanda.com", "Job Portal"),
]

#: First rule whose term is in the text names the source type.
SOURCE_TYPE_RULES = [
    ("Government Institution", (".gov.rw", "government", "ministry", "authority", "commission", "district", "public institution")),
    ("University", (".ac.rw", "university", "college", "higher education")),
    ("Development Partner", ("united nations", "undp", "unicef", "unfpa", "unhcr", "world bank", "embassy", "development partner")),
    ("NGO", ("ngo", "non-governmental", "humanitarian", "foundation", "charity")),
    ("Procurement Portal", ("procurement portal", "tender portal", "e-procurement")),
    ("Job Portal", ("job portal", "jobs in rwanda", "career portal")),
    ("Private Company", ("company", "limited", "ltd", "plc", "bank", "insurance", "corporation")),
]
DISCOVERY_TYPE_RULES = [
    ("Procurement", ("tender", "procurement", "request for proposal", "expression of interest", "request for quotation")),
    ("Careers", ("career", "vacancy", "jobs", "employment")),
    ("Opportunity Platform", ("opportunities", "consultancy", "consultancies")),
]
PREFERRED_TYPES = ("Government Institution", "Development Partner", "NGO", "University")
GENERIC_ORGANISATIONS = (
    "home", "tender", "tenders", "procurement", "careers", "jobs", "vacancies", "opportunities", "request for proposal",
    "expression of interest",
)
GENERIC_SITE_LABELS = ("google", "bing", "brave", "facebook", "linkedin", "youtube", "twitter", "x")
IGNORED_DOMAINS = (
    "google.com", "bing.com", "search.brave.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com",
    "tiktok.com",
)
IGNORED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".mp3", ".zip")
STRONG_LINK_TERMS = ("request for proposal", "expression of interest", "terms of reference", "procurement", "tender", "consultancy")
RELEVANT_URL_ENDINGS = ("/procurement", "/tenders", "/careers", "/jobs", "/opportunities")
UNSET_ORGANISATIONS = ("not specified", "unknown", "n/a", "none")
SENTENCE_SIGNALS = (
    " is a ", " invites ", " seeks ", " looking for ", " responsible for ", " working in ", " committed to ", " provides ",
    " wishes to ", " hereby ",
)
TITLE_SEPARATORS = (" | ", " - ", " – ", " — ", " :: ")
OPPORTUNITY_STATUSES = ("New", "Seen", "Interested", "Applied", "Rejected", "Expired")
ACTIVE_STATUSES = ("New", "Seen", "Interested")
LEAD_STATUSES = ("Under Review", "Pursuing", "Submitted", "On Hold", "Awarded", "Lost", "Cancelled")
LEAD_PRIORITIES = ("Low", "Medium", "High", "Urgent")
#: Lead status -> status of the opportunity.
LEAD_TO_STATUS = {
    "Submitted": "Applied", "Awarded": "Interested", "Pursuing": "Interested", "Under Review": "Interested",
    "On Hold": "Interested", "Lost": "Rejected", "Cancelled": "Rejected",
}
PROPOSAL_STATUSES = (
    "Not Started", "Initial Review", "Go", "No-Go", "Proposal Preparation", "Internal Review", "Submitted", "Clarification",
    "Negotiation", "Awarded", "Lost", "Contract Signed",
)
PROPOSAL_RESULTS = ("Pending", "Awarded", "Lost", "Cancelled")
#: Fixed patterns, tried in order; the group is the date.
CRAWL_DEADLINES = (
    r"\b(?:submission|application|bid|proposal)?\s*deadline\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\b(?:submission|application|bid|proposal)?\s*deadline\s*:?\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})",
    r"\b(?:submission|application|bid|proposal)?\s*deadline\s*:?\s*(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{4})",
    r"\bclosing date\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bclosing date\s*:?\s*(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{4})",
    r"\bapplications? close(?:s|d)?\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bapplications? close(?:s|d)?\s*:?\s*(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{4})",
)
PORTAL_DEADLINES = (
    r"\bdeadline\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bdeadline\s*:?\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})",
    r"\bdeadline\s*:?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
    r"\bclosing date\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bclosing date\s*:?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
    r"\bsubmission deadline\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bsubmission deadline\s*:?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
    r"\bapplications? close(?:s|d)?\s*:?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"\bapplications? close(?:s|d)?\s*:?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
)
#: Spark patterns of dates with a month's name, tried in order.
NAMED_DATE_PATTERNS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")
SUPPORTED_JSON_TYPES = ("jobposting", "article", "creativework", "newsarticle", "webpage")
CARD_CLASSES = ("job", "tender", "consultancy", "listing", "views-row", "card", "item", "result")
EXCLUDED_LISTING_PATHS = ("/job", "/jobs", "/job-seeker", "/job-alert")
