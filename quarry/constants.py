"""Closed vocabularies and rank orders. They must be exactly these for right results."""

PRIORITY_RANK = {"HIGH": 4, "MEDIUM": 3, "LOW": 2, "ARCHIVED": 1}

#: Signals by dominance, the strongest first.
SIGNALS = (
    "denied", "withdrawn", "recommended_denial", "tabled", "continued", "staff_concern", "additional_information", "amended", "appeal", "neighborhood_concern", "public_opposition",
)
SIGNAL_WEIGHT = {
    "denied": 60, "recommended_denial": 50, "appeal": 35, "withdrawn": 35, "staff_concern": 30, "neighborhood_concern": 30, "public_opposition": 25, "continued": 20, "tabled": 20,
    "additional_information": 15, "amended": 15,
}
#: Pairs of signals that add to a score when both are present.
SIGNAL_BONUS = (("recommended_denial", "denied", 20), ("denied", "continued", 10), ("recommended_denial", "continued", 10))

SOURCE_RANK = {
    "government_record": 1, "official_website": 2, "official_business": 3, "business_directory": 4, "professional_profile": 5, "public_web": 6, "search_result": 7, "public_record": 8,
}
#: Mailboxes of a role in the identity stage, and in the contact stage.
GENERIC_MAILBOXES = ("info", "contact", "hello", "office", "admin", "sales", "support", "leasing", "development", "planning", "projects", "inquiries", "inquiry")
ROLE_MAILBOXES = ("info", "contact", "hello", "support", "admin", "office", "sales", "marketing", "noreply", "no-reply", "webmaster")
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "test.com", "localhost")
FREE_DOMAINS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "aol.com", "proton.me", "protonmail.com")
MAP_HOSTS = ("google.com", "goo.gl", "g.page", "maps.google.com", "maps.apple.com", "apple.com", "bing.com", "maps.live.com", "live.com", "openstreetmap.org", "waze.com", "mapquest.com")
DIRECTORY_HOSTS = ("opencorporates.com", "bbb.org", "dnb.com", "manta.com", "bizapedia.com", "yellowpages.com", "yelp.com", "corporationwiki.com")
PROFILE_HOST = "linkedin.com"
CONTACT_PATHS = ("/contact", "/about", "/team", "/leadership", "/people")
COMPANY_WORDS = (
    "llc", "inc", "corp", "ltd", "company", "enterprises", "holdings", "group", "partners", "associates", "developments", "construction", "builders", "properties", "realty", "investments", "ventures",
    "capital", "management", "services", "solutions", "consulting", "design", "architecture", "engineering",
)
RECORD_WORDS = ("business entity", "llc", "corporation", "registered", "filing")
#: Role phrases and the role each stands for.
ROLES = {
    "owner": "Owner", "sole proprietor": "Owner", "principal": "Principal", "president": "President", "chief executive officer": "CEO", "ceo": "CEO", "managing member": "Managing Member",
    "managing partner": "Managing Partner", "managing director": "Managing Director", "executive director": "Executive Director", "partner": "Partner", "co-founder": "Co-Founder", "founder": "Founder",
    "registered agent": "Registered Agent", "responsible person": "Responsible Person", "developer": "Developer", "project manager": "Project Manager", "authorized representative": "Representative",
    "representative": "Representative", "agent of record": "Representative", "agent": "Agent", "attorney of record": "Attorney", "attorney": "Attorney", "general contractor": "Contractor",
    "contractor": "Contractor", "architect": "Architect", "engineer": "Engineer",
}
ACTIONABLE_TYPES = (
    "zone map amendment", "rezone", "rezoning", "concept plan", "project plan", "site plan", "conditional use", "conditional use permit", "variance", "development agreement", "subdivision",
    "special exception", "ordinance text amendment",
)
ACTIONABLE_WORDS = ("rezone", "zone map", "concept", "project plan", "site plan", "variance", "subdivision", "development", "conditional use", "special exception")
PENDING = ("scheduled", "pending", "under_review")
STALLED = ("denied", "withdrawn", "recommended_denial", "tabled", "continued")
CONTACTED = ("CONTACTED", "REPLIED", "ENGAGED")
#: Order in which a lead's sources are asked; a later one reads what the earlier ones found.
SOURCE_ORDER = ("web", "website", "directories", "project", "linkedin", "contact", "public_records")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "youtube.com", "tiktok.com")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
URL = r"https?://[^\s<>\")\]]+"
APPLICATION_NUMBER = r"PL[A-Z]{2,6}[0-9]{8}"
