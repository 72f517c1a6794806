"""Fixed lookup lists.

Fixed values: the results of the lexical and network features depend on these
exact strings. The ranked list of popular names is not here; it is a parameter
(see ``sources.dims``).
"""

SUSPICIOUS_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "click", "pw", "cc", "biz", "su",
    "work", "party", "racing", "date", "faith", "science", "men", "accountant",
    "loan", "trade", "stream", "download", "gdn", "icu", "monster", "cyou", "bond",
    "hair", "beauty", "makeup", "info", "live", "online", "site", "club", "space",
    "buzz", "life", "run",
]

PHISHING_KEYWORDS = [
    "login", "signin", "sign-in", "signup", "logon", "account", "accounts",
    "myaccount", "verify", "verification", "validate", "validation", "confirm",
    "confirmation", "authenticate", "authentication", "credential", "credentials",
    "password", "passwd", "reset", "recover", "recovery", "secure", "security",
    "safe", "alert", "warning", "notification", "suspended", "locked", "blocked",
    "unusual", "activity", "urgent", "important", "action-required", "bank",
    "banking", "payment", "pay", "checkout", "billing", "invoice", "refund",
    "reimburse", "claim", "wallet", "balance", "transfer", "shipping", "tracking",
    "delivery", "parcel", "package", "webscr", "ebayisapi", "appleid", "icloud",
    "support", "helpdesk", "help", "service", "services", "customer", "update",
    "updates", "upgrade",
]

TOP_BRANDS = [
    "google", "gmail", "youtube", "microsoft", "outlook", "office", "azure", "xbox",
    "apple", "icloud", "appleid", "facebook", "instagram", "whatsapp", "meta",
    "twitter", "x", "linkedin", "amazon", "aws", "netflix", "adobe", "zoom", "github",
    "gitlab", "slack", "discord", "telegram", "dropbox", "paypal", "chase",
    "wellsfargo", "bankofamerica", "citibank", "barclays", "hsbc", "lloyds",
    "santander", "visa", "mastercard", "amex", "coinbase", "binance", "metamask",
    "robinhood", "kraken", "ebay", "walmart", "target", "aliexpress", "alibaba",
    "dhl", "fedex", "usps", "ups", "steam", "roblox", "epicgames", "playstation",
    "spotify", "hulu", "disneyplus",
]

TWO_PART_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.au", "net.au",
    "org.au", "co.nz", "co.za", "com.br", "com.mx", "com.ar", "co.in", "net.in",
    "org.in", "co.jp", "ne.jp", "or.jp", "com.cn", "net.cn", "org.cn", "com.hk",
    "com.sg", "com.tr", "com.ng", "com.gh", "com.eg", "co.ke", "com.sa", "com.ua",
    "com.pl", "com.ru",
]

COMMON_REGISTRARS = [
    "godaddy", "namecheap", "google", "cloudflare", "tucows", "network solutions",
    "name.com", "gandi", "hover", "porkbun", "dynadot", "enom", "ionos", "1&1",
    "ovh", "hostgator", "bluehost", "squarespace", "wix", "amazon", "markmonitor",
    "csc corporate", "register.com", "domain.com", "namesilo", "netim", "epik",
    "key-systems", "wild west domains",
]

PRIVACY_KEYWORDS = [
    "redacted", "privacy", "whoisguard", "private", "protected", "withheld",
    "data protected", "domains by proxy", "perfect privacy", "contact privacy",
    "identity protection", "gdpr", "not disclosed", "statutory masking", "proxy",
    "anonymize",
]
