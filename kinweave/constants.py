"""Fixed values that results depend on: word lists, maps and patterns."""

# Legal forms and stop words that a core name drops.
LEGAL_FORMS = (
    "inc", "incorporated", "llc", "llp", "pllc", "lp", "ltd", "limited", "pvt", "private", "privet", "praivet", "prayvet",
    "corp", "corporation", "co", "cos", "company", "plc", "pte", "opc", "gmbh", "ag", "sa", "sas", "sasu", "sarl", "eurl",
    "sci", "snc", "scs", "scop", "selarl", "sprl", "bv", "nv", "srl", "spa",
    "the", "and", "of", "et", "de", "du", "des", "la", "le", "les", "l", "d",
)

# Short forms of address words.
ADDRESS_FORMS = {
    "street": "st", "str": "st", "strt": "st", "avenue": "ave", "av": "ave", "avn": "ave", "road": "rd", "drive": "dr",
    "drv": "dr", "lane": "ln", "court": "ct", "crt": "ct", "place": "pl", "boulevard": "blvd", "boul": "blvd",
    "bd": "blvd", "blv": "blvd", "highway": "hwy", "parkway": "pkwy", "pky": "pkwy", "circle": "cir", "terrace": "ter",
    "terr": "ter", "trail": "trl", "square": "sq", "suite": "ste", "apartment": "apt", "appt": "apt", "building": "bldg",
    "floor": "fl", "flr": "fl", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne",
    "northwest": "nw", "southeast": "se", "southwest": "sw", "mount": "mt", "fort": "ft", "route": "rte",
    "expressway": "expy", "freeway": "fwy", "junction": "jct", "heights": "hts", "center": "ctr", "centre": "ctr",
    "point": "pt", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6",
    "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10", "number": "no", "nr": "near", "opposite": "opp",
    "sector": "sec", "sect": "sec", "district": "dist", "r": "rue", "chemin": "ch", "allee": "all", "impasse": "imp",
    "faubourg": "fbg", "saint": "st", "sainte": "ste", "residence": "res", "batiment": "bat",
}

# Address tokens that stand for nothing.
PLACEHOLDERS = ("null", "none", "nan", "na", "nil", "unknown", "undefined", "notavailable")

# Letters without a decomposition, and punctuation of many forms.
SPECIAL_LETTERS = {
    "œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ĳ": "ij",
    "’": "'", "‘": "'", "´": "'", "`": "'", "–": "-", "—": "-", "“": '"', "”": '"', "«": '"', "»": '"', "।": " ", "॥": " ",
}

# Latin forms of Indic vowels by their Unicode names.
INDIC_VOWELS = {"a": "a", "aa": "a", "i": "i", "ii": "i", "u": "u", "uu": "u", "e": "e", "ee": "e", "ai": "ai", "o": "o", "oo": "o", "au": "au"}

# Patterns.
WWW = r"\bwww\."
TOP_LEVEL = r"\.(?:com|net|org|in|co|biz|info|io|us|fr|uk|online|site|store|shop)\b"
DOMAIN = r"\.(?:com|net|org|in|co|biz|info|io|us|fr)\b|^[@#][a-z0-9]|www\."
APOSTROPHES = r"['’`´]"
ORDINAL = r"\b(\d+)(?:st|nd|rd|th)\b"
TRADE = r"\b(?:ta|dba|aka|fka|trading as|doing business as)\b"
LEET_FROM, LEET_TO = "013457", "oleast"
SKELETON_SWAPS = (("ph", "f"), ("ck", "k"), ("q", "k"), ("w", "v"), ("z", "s"), ("sh", "s"))

# Classes of legal forms, in the order of their bits.
LEGAL_CLASSES = {
    "llc": r"\bllc\b", "inc": r"\binc\b|\bincorporated\b", "corp": r"\bcorp\b|\bcorporation\b", "ltd": r"\bltd\b|\blimited\b", "pvt": r"\bpvt\b|\bprivate\b", "llp": r"\bllp\b",
    "co": r"\bco\b|\bcompany\b", "fr": r"\bsarl\b|\bsas\b|\bsa\b|\beurl\b|\bsci\b|\bsnc\b", "soc": r"\btrust\b|\bfoundation\b|\bsociety\b", "lp": r"\blp\b|\bpartners?\b", "pc": r"\bpc\b|\bpllc\b|\bpa\b",
}
