"""Word lists and weights of the text rules."""

# Substrings of rising and falling tone.
BULL = ("surge", "rally", "gain", "profit", "beat", "record", "strong", "growth", "upgrade", "buy", "soar", "rise", "bull", "positive", "outperform", "boom", "breakout")
BEAR = ("fall", "drop", "miss", "loss", "decline", "sell", "crash", "weak", "downgrade", "cut", "bear", "negative", "underperform", "concern", "risk", "plunge", "slump", "recession")

# Substrings that name a ledger entry's kind; income is looked for first.
INCOME = ("salary", "income", "bonus", "dividend", "interest", "refund", "payout", "profit", "freelance", "stipend", "commission", "rent received", "sale", "cashback", "reimburse")
EXPENSE = ("rent", "food", "grocer", "bill", "emi", "loan", "tax", "fee", "fuel", "petrol", "shopping", "subscription", "insurance", "travel", "medical", "expense", "utilit", "electric", "recharge")

# Terms of the flags that a question raises.
FLAGS = {
    "tariff": ("tariff", "tariffs", "import duty", "duties"),
    "trade_war": ("trade war", "trade tensions", "sanction", "sanctions"),
    "rates": ("rates", "yield", "treasury", "bond yields"),
    "inflation": ("inflation", "cpi", "ppi"),
    "fed": ("fed", "fomc", "central bank"),
    "opec": ("opec", "production cut", "output cut"),
    "inventory_draw": ("inventory draw", "stock draw", "drawdown in inventories"),
    "inventory_build": ("inventory build", "stock build", "build in inventories"),
    "earnings": ("earnings", "results", "quarterly"),
    "guidance": ("guidance", "outlook"),
    "growth": ("growth", "revenue", "margin", "demand"),
    "ai": ("ai",),
    "safe_haven": ("safe haven", "risk-off", "geopolitical"),
    "geopolitical": ("war", "conflict", "geopolitical", "middle east"),
    "recession": ("recession",),
    "usd_strength": ("strong dollar", "usd strength", "dollar strength"),
    "demand_hit": ("demand hit", "weaker demand", "slowdown"),
    "etf": ("etf",),
    "regulation": ("regulation", "regulatory", "sec"),
    "adoption": ("adoption", "adopt", "institutional inflow"),
    "risk_on": ("risk-on",),
    "risk_off": ("risk-off",),
}

# What a flag adds to an asset's expected return, in percent.
BIAS = {
    "equity": {"tariff": -0.18, "rates": -0.12, "inflation": -0.08, "earnings": 0.22, "guidance": 0.18, "growth": 0.12, "ai": 0.16, "recession": -0.2, "geopolitical": -0.09},
    "gold": {"tariff": 0.16, "rates": -0.12, "inflation": 0.2, "fed": -0.1, "safe_haven": 0.22, "geopolitical": 0.18, "usd_strength": -0.14, "recession": 0.14},
    "oil": {"tariff": -0.32, "trade_war": -0.28, "inflation": -0.04, "opec": 0.26, "inventory_draw": 0.24, "inventory_build": -0.24, "sanction": 0.16, "geopolitical": 0.18, "recession": -0.26, "demand_hit": -0.3, "usd_strength": -0.1},
    "crypto": {"rates": -0.16, "inflation": 0.08, "etf": 0.24, "regulation": -0.22, "adoption": 0.2, "risk_on": 0.16, "risk_off": -0.18},
    "index": {"tariff": -0.18, "rates": -0.14, "inflation": -0.1, "earnings": 0.12, "recession": -0.22, "geopolitical": -0.12, "risk_on": 0.14, "risk_off": -0.16},
}

# Terms of a horizon, its days and its name; terms of an asset; both by first match.
HORIZONS = (
    (("today", "intraday", "right now", "by close"), 1, "today"),
    (("tomorrow", "next session"), 2, "next 1-2 sessions"),
    (("this week", "next week", "weekly"), 5, "1 trading week"),
    (("this month", "next month", "30 days"), 20, "1 trading month"),
)
ASSET_TERMS = (
    ("gold", ("gold", "xau", "gld")),
    ("oil", ("oil", "crude", "brent", "wti")),
    ("crypto", ("btc", "bitcoin", "eth", "ethereum", "crypto")),
    ("index", ("spy", "qqq", "index", "nasdaq", "s&p", "dow")),
)

# Goals of a question, macro terms, company names, and weights of news outlets.
GOALS = (
    ("investment", ("invest", "buy", "long term", "hold", "accumulate")),
    ("trade", ("trade", "swing", "day trade", "scalp", "short term", "flip")),
    ("exit", ("sell", "exit", "unload", "dump", "liquidate")),
)
MACRO = ("tariff", "fed", "inflation", "opec", "sanction", "rates", "yield", "crude", "oil", "gold")
NAMES = {"apple": "AAPL", "nvidia": "NVDA", "microsoft": "MSFT", "tesla": "TSLA", "amazon": "AMZN", "google": "GOOGL", "alphabet": "GOOGL", "meta": "META", "netflix": "NFLX", "amd": "AMD", "intel": "INTC"}
QUALITY = (("reuters", 1.2), ("bloomberg", 1.2), ("wall street journal", 1.16), ("financial times", 1.16), ("cnbc", 1.08), ("marketwatch", 1.04), ("newsapi", 0.98), ("synthetic research feed", 0.82))

#: Fixture lexicon for the invented prose of the test tables: token to weight.
FIXTURE = {"ble": 2, "ing": 2, "er": 1, "en": 1, "ed": 1, "es": 1, "th": -1, "nd": -1, "ti": -1, "st": -1, "thre": -2, "ea": -2}

# Words of sentiment and their weights; a word in two lists counts in both.
STRONG_BUY_WORDS = (
    "breakthrough exceptional outstanding record surge soar skyrocket explode dominate leadership momentum accelerate efficient strategic competitive_advantage market_leader innovation best-in-class"
).split()
BUY_WORDS = (
    "beat gain growth bullish buy upgrade rally strong profit upside outperform opportunity potential upbeat thrive prosper success positive excellent improvement advance higher exceed efficient sustainable confidence conviction catalyst strength attract expansion robust"
).split()
HOLD_WORDS = "balanced mixed uncertain stability maintain steady neutral moderate cautious debate diverge".split()
SELL_WORDS = (
    "miss loss drop bearish sell downgrade decline weak risk lawsuit downside underperform challenge headwind concern uncertainty volatility pressure contraction slowdown weakness deteriorate failure negative poor bad slump turmoil shortage deficit distress"
).split()
STRONG_SELL_WORDS = "collapse crash plunge bankruptcy liquidation fraud scandal crisis recession depression catastrophic disaster devastating terrible awful horrible toxic poison deadly threatened".split()
SENTIMENT = ((2, STRONG_BUY_WORDS), (1, BUY_WORDS), (-1, SELL_WORDS), (-2, STRONG_SELL_WORDS))
#: Signs taken off both ends of a token.
SIGNS = ".,!?;:\"'()[]{}$#@~"
