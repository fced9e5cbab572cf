"""Word lists and tables that the event-graph semantics are defined by."""

# fixed values
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
ERAS = ("bc", "bce", "ad", "ce")
DATE_WORDS = (
    *MONTHS, *ERAS, "c", "circa", "ca", "early", "late", "mid", "spring", "summer", "autumn", "fall", "winter", "season", "from", "to", "and", "or",
    "between", "since", "until", "till", "in", "on", "of", "the", "around", "about", "approximately", "year", "years", "decade", "century",
    "centuries", "s", "st", "nd", "rd", "th", "annually", "born", "died",
)
TITLE_WORDS = ("duke", "duchess", "prince", "princess", "earl", "count", "countess", "baron", "baroness", "lord", "lady", "king", "queen", "emperor", "empress", "marquis", "viscount", "sir", "jr", "sr")
PLACEHOLDERS = (
    "unknown", "unspecified", "unnamed", "unidentified", "n/a", "na", "none", "null", "nil", "someone", "somebody", "something", "anyone", "anything",
    "various", "others", "other", "it", "he", "she", "they", "them", "him", "her", "his", "its", "their", "we", "us", "you", "this", "that", "these",
    "those", "people", "person", "individual", "entity", "thing",
)
INVENTED = ("implied", "inferred", "assumed", "presumably", "unspecified", "unknown", "unnamed")
STEM_SUFFIXES = ("ations", "ation", "ings", "ing", "ers", "er", "ed", "es", "s")
RELEVANCE_STOP = (
    "what", "which", "where", "when", "who", "whom", "whose", "how", "why", "the", "a", "an", "of", "is", "was", "are", "were", "in", "on", "at", "to",
    "for", "by", "with", "from", "and", "or", "that", "this", "does", "did", "do", "thing", "person", "entity",
)
ANAPHORA = (
    "the film", "the movie", "the album", "the song", "the record", "the single", "the complex", "the venue", "the facility", "the company", "the band",
    "the team", "the station", "the university", "the institute", "the book", "the novel", "the play", "the series", "the show", "this film",
    "this movie", "this album", "this song", "this company", "the organization", "the organisation", "the group", "the territory", "the state",
    "the municipality",
)
KIN_NOUNS = {
    "son": "child", "sons": "child", "daughter": "child", "daughters": "child", "child": "child", "children": "child", "stepson": "child",
    "stepdaughter": "child", "father": "parent", "mother": "parent", "parent": "parent", "parents": "parent", "stepfather": "parent",
    "stepmother": "parent", "wife": "spouse", "husband": "spouse", "spouse": "spouse", "widow": "spouse", "widower": "spouse", "consort": "spouse",
    "brother": "sibling", "brothers": "sibling", "sister": "sibling", "sisters": "sibling", "sibling": "sibling", "siblings": "sibling",
    "half-brother": "sibling", "half-sister": "sibling",
}
PLURAL_KIN = ("sons", "daughters", "children", "parents", "brothers", "sisters", "siblings")
KIN_LEMMAS = {
    "spouse": ("marry", "wed", "spouse", "husband", "wife", "be_married", "married", "marriage", "married_to"),
    "sibling": ("sibling", "brother", "sister", "be_sibling_of"),
    "parent": ("parent", "father", "mother", "beget", "father_of", "mother_of", "parent_of"),
    "child": ("be_child_of", "child", "child_of", "son", "daughter", "son_of", "daughter_of", "born_to"),
}
COPULAS = ("be", "is", "was", "be a", "be an")
BIRTHS = ("born", "bear", "be born")
LOCATES = ("locate", "headquarter", "headquarters", "be located", "situate")
DESCRIPTORS = (
    "actor", "actress", "musician", "guitarist", "singer", "songwriter", "author", "writer", "novelist", "poet", "painter", "director", "producer",
    "composer", "journalist", "politician", "businessman", "businesswoman", "entrepreneur", "footballer", "player", "coach", "rapper", "comedian",
    "architect", "scientist", "physicist", "chemist", "engineer",
)
ADMIN_NOUNS = ("municipality", "government", "city", "state", "province", "county", "district", "borough", "town")
HONORIFICS = ("sir", "dame", "dr", "mr", "mrs", "ms", "lord", "lady", "king", "queen", "rev", "reverend", "professor", "prof")
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh", "ag", "sa", "nv", "bv", "fc", "afc", "cf", "sc")
ABBREVIATIONS = ("inc", "corp", "co", "ltd", "jr", "sr", "st", "dr", "bros", "no", "mr", "mrs", "ms", "u.s", "d.c")
FRAMES = {
    "own.01": {":ARG0": "owner", ":ARG1": "possession"},
    "locate.01": {":ARG1": "thing located", ":ARG2": "location"},
    "marry.01": {":ARG0": "spouse", ":ARG1": "other spouse"},
    "parent.01": {":ARG0": "parent", ":ARG1": "child"},
    "sibling.01": {":ARG0": "person", ":ARG1": "sibling"},
    "bear.02": {":ARG0": "parent giving birth", ":ARG1": "person born"},
    "employ.01": {":ARG0": "employer", ":ARG1": "employee", ":ARG2": "position"},
    "member.01": {":ARG0": "member", ":ARG1": "group"},
    "found.01": {":ARG0": "founder", ":ARG1": "organisation founded"},
    "distribute.01": {":ARG0": "distributor", ":ARG1": "thing distributed", ":ARG2": "recipient"},
    "manufacture.01": {":ARG0": "manufacturer", ":ARG1": "product"},
    "partner.01": {":ARG0": "partner", ":ARG1": "other partner"},
    "alias.01": {":ARG0": "entity", ":ARG1": "alternative name of the same entity"},
    "affiliate.01": {":ARG0": "possessor / parent organisation", ":ARG1": "associated entity"},
}
INTERNAL_FRAMES, IDENTITY_FRAMES = ("alias.01", "affiliate.01"), ("alias.01",)
FRAME_VERBS = {
    "locate.01": ("locate", "be located", "situate", "be situated", "lie", "sit", "stand", "headquarter", "headquarters", "be headquartered", "take place"),
    "own.01": ("own", "possess", "acquire", "buy", "purchase"),
    "marry.01": ("marry", "wed", "be married"),
    "parent.01": ("parent", "father", "mother", "beget"),
    "sibling.01": ("sibling", "brother", "sister"),
    "bear.02": ("bear", "born", "be born", "give birth"),
    "employ.01": ("employ", "hire", "work for", "work at"),
    "member.01": ("member", "be member", "be a member", "join", "belong", "belong to", "play for"),
    "found.01": ("found", "co-found", "cofound", "establish", "co-establish", "set up"),
    "distribute.01": ("distribute", "release", "market", "publish"),
    "manufacture.01": ("manufacture", "make", "build"),
    "partner.01": ("partner", "collaborate", "team up"),
    "alias.01": ("alias",),
    "affiliate.01": ("affiliate",),
}
RELATIONS = ("cause", "result", "before", "after", "condition", "contrast")
ALIAS_CONNECTORS = ("of", "for", "and", "the", "de", "du", "des", "für", "&")

# fixed values: names that stand for a role
ROLE_ALIASES = {
    ":ARG0": (
        "actor", "agent", "subject", "creator", "create", "author", "producer", "produce", "director", "direct", "founder", "found", "funder", "fund",
        "employer", "speaker", "caller", "writer", "write", "inventor", "invent", "parent", "performer", "artist", "musician", "singer", "player",
        "member", "leader", "originator", "distributor", "publisher", "manufacturer", "maker", "owner", "proprietor", "operator", "builder", "supplier",
        "seller", "buyer", "parent_company", "holding_company", "founded_by", "distributed_by", "manufactured_by", "owned_by", "headquartered_by",
        "partner_a",
    ),
    ":ARG1": (
        "patient", "theme", "object", "entity", "creation", "product", "work", "novel", "play", "target", "problem", "callee", "recipient", "topic",
        "child", "sibling", "spouse", "partner", "partner_b", "wife", "husband", "album", "song", "book", "movie", "film", "organization", "group",
        "band", "company", "university", "institution", "subsidiary", "division", "facility", "property", "building", "aircraft", "vehicle",
        "distributee", "manufacturee", "release",
    ),
    ":ARG2": (
        "example", "description", "instrument", "attribute", "capital", "name", "beneficiary", "role", "title", "status", "genre", "headquarters",
        "headquarter", "hq", "manufacturer_of", "distributor_of",
    ),
    ":location": (
        "place", "region", "city", "venue", "site", "where", "country", "state", "birthplace", "birth_place", "headquartered_in", "located_in",
        "based_in", "residence", "territory", "municipality", "province",
    ),
    ":time": ("date", "year", "period", "when", "timestamp", "birth_date", "start_date", "end_date", "release_date", "release_year", "founded_year", "founded_date"),
}
CONTEXT_ROLES = (":manner", ":purpose", ":direction", ":location", ":time")
