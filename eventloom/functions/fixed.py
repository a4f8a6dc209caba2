"""Word lists, patterns and limits that results depend on, stated as they must be."""

# limits
DESCRIPTION_MAX = 420
LOCATION_MAX = 160
PRICE_MAX = 90
MAX_RUN_DAYS = 7
SPEAKERS_MAX = 12
HISTORY_RUNS = 90
SAMPLES_MAX = 8
MIN_EVENTS = 100
MIN_OK_SHARE = 0.5
HORIZON_DAYS = 45
CARRY_DAYS = 7
PAGE_ROWS = 250

# The character references that queries of whole pages read; what else begins with an ampersand is text
PAGE_REFERENCES = ("quot", "copy", "middot", "lt", "gt", "amp")

# What the gate asks of a published record
GATE_ID = r"^[0-9a-f]{12}\z"
GATE_TITLE_MIN = 3
GATE_MARKUP = r"(?i)<[a-z/]"
GATE_URL = r"^https?://"
GATE_TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9]\z"
GATE_DESCRIPTION_MAX = 500

# Words of a title that say nothing about which event it is
STOPWORDS = "a an the and or of in on at to for with from by is are be as its it this that into about how why what who when live talk talks lecture lectures event events online in-person evening afternoon morning conversation book launch presents special annual public free new".split()

# Words of a location that say nothing about which place it is
GENERIC_PLACE = "london the of and at room rooms hall building house street road centre center theatre lecture main floor level online uk".split()

# Query parameters that only track visits
TRACKING_PARAM = r"^(?:utm_[a-z]+|aff|ref|referrer|source|fbclid|gclid|dclid|msclkid|mc_[a-z]+|_gl|_ga|campaign|cmp|intcmp|kw|hsa_[a-z]+)$"

# Status markers of titles
STATUS_WORDS = r"sold[\s-]*out|fully[\s-]*booked|cancell?ed|postponed|waiting[\s-]*list(?:\s+only)?|last\s+few(?:\s+tickets)?|few\s+tickets\s+left|new\s+date|rescheduled|extra\s+date|date\s+added|now\s+online|new"
STATUS_MARKERS = (
    rf"^\s*[*\[(]*\s*(?:{STATUS_WORDS})\s*[*\])]*\s*[:\-–—|!]+\s*",
    rf"^\s*[*\[(]+\s*(?:{STATUS_WORDS})\s*[*\])]+\s*",
    rf"\s*[-–—|:]?\s*[*\[(]+\s*(?:{STATUS_WORDS})\s*[*\])]+\s*$",
    rf"\s*[-–—|]\s*(?:{STATUS_WORDS})\s*!?\s*$",
    rf"\*+\s*(?:{STATUS_WORDS})\s*\*+",
)
CANCELLED = r"(?:^|[*\[(\s:|–—-])(?:cancell?ed|postponed)(?:$|[*\])\s:!|–—-])"
FORMAT_PREFIX = r"^\s*(in[\s-]?person(?:\s+only)?|online(?:\s+only)?|hybrid|virtual|live[\s-]?stream(?:ed)?)\s*(?::|\||–|—|-)\s+"
FORMAT_SUFFIX = r"\s*(?:[\[(]\s*(online(?:\s+(?:only|event))?|in[\s-]?person|hybrid|virtual|live[\s-]?stream)\s*[\])]|[-–—|]\s*(online(?:\s+only)?|in[\s-]?person|hybrid))\s*$"
ONLINE_IN_TITLE = r"\[online\]|\(online\)|\bonline:\s|:\s*online\b|\s[-–—]\s*online\b|\bwebinar\b|\blive\s?stream\b|\bvirtual\s+(?:event|talk|lecture)\b"

# What is no talk, and what is not public
EXHIBITION = r"\bexhibitions?\b|(?<!\b(?:of|golf|main|race|crash)\s)\bcourses?\b(?!\s+of\b)"
BUT_A_TALK = r"\b(?:talks?|lectures?|launch|tours?|conversations?|discussions?|panels?|debates?|seminars?|symposium|q\s?&\s?a|readings?|in\s+focus)\b"
MEMBERS_TITLE = r"\b(?:members|fellows|friends)(?:\s+of\s+(?:the\s+)?[\w&]+)?['’]?\s*(?:\(only\)|only\b)|\bfellows['’]\s+(?:tour|evening|meeting|event|drinks)\b"
MEMBERS_LEAD = r"\b(?:for|open to)\s+(?:members|fellows)\s+only\b|\b(?:members|fellows)[\s-]only\s+(?:event|lecture|tour|meeting)\b|\bin person and members only\b|\bthis (?:event|tour|lecture) is (?:for|open to) (?:members|fellows)\b"

# prices
DONATION = r"\b(?:pay what you (?:can|wish|want|feel|decide)|pwyc|suggested donation|donations? (?:welcome|encouraged|optional|appreciated)|by donation|free,? donations)\b"
PAID_PRICE = r"[£$€]\s*[1-9]\d*(?:\.\d{2})?|[£$€]\s*0\.(?:[1-9]\d|0[1-9])|\b[1-9]\d*(?:\.\d{2})?\s*(?:gbp|pounds?)\b|\btickets? from\b|\bconcessions?\b"
MEMBERS_ONLY_FREE = r"\bfree\s+(?:for|to)\s+(?:members|fellows|friends|students|staff|subscribers|patrons)\b"
FREE_PRICE = r"^\s*(?:free\b|£\s*0(?:\.00)?\b|0(?:\.00)?\s*(?:gbp)?\s*(?:$|[-–—]))"
FREE_PROSE = (
    r"\bfree\s+(?:to\s+(?:attend|join|all|the\s+public)|entry|admission|event|talk|lecture|public\s+(?:event|lecture|talk)|of\s+charge|and\s+open\s+to\s+(?:all|the\s+public)|for\s+(?:all|everyone|the\s+public)|tickets?|registration|places?|webinar|online\s+(?:event|talk|lecture)|but\s+(?:booking|registration|ticketed))\b",
    r"\b(?:entry|admission|tickets?|attendance|registration|this\s+(?:event|talk|lecture|webinar|session|seminar)\s+is|it'?s|events?\s+(?:is|are))\s*(?:is\s+|are\s+)?(?::|-|–)?\s*(?:completely\s+|totally\s+|entirely\s+)?free\b",
    r"\ball\s+(?:welcome|are\s+welcome)[^.]{0,40}\bfree\b|\bfree\b[^.]{0,20}\ball\s+welcome\b",
    r"^free\b",
)
PAID_PROSE = r"\bconcession(?:ary)?\s+(?:tickets?|rates?|prices?)\b|\b(?:buy|purchase)\s+(?:a|your|the)\s+(?:\w+\s+)?tickets?\b|\btickets?\s*(?:cost|are|:)?\s*£\s*[1-9]|£\s*[1-9]\d*(?:\.\d{2})?\s*(?:per\s+(?:person|ticket)|\(|standard|full|adult|concession|members?|non-members?|students?|general|\/|online|in[\s-]person)|\bstandard tickets?\b|\bticket prices?\b|\bprice:\s*£|\btickets?\s+(?:are\s+)?(?:priced|from)\s+£"

# attendance
ONLINE_WORDS = r"\b(?:online|on-line|virtual(?:ly)?|zoom|microsoft\s+teams|teams|webinar|live[\s-]?stream(?:ed|ing)?|streamed|youtube|vimeo|crowdcast|remote(?:ly)?|digital)\b|\bhow\s*to\s*\+"
FILLER_WORDS = r"\b(?:this|the|a|an|event|events|session|sessions|will|be|is|are|take|takes|taking|place|held|hosted|only|via|on|in|at|by|from|and|or|public|lecture|lectures|talk|talks|seminar|seminars|meeting|platform|format|delivered|join|us|live|details|link|links|sent|to|attendees|registered|after|registration|booking|you|your|access|watch|available|tba|tbc)\b"
HYBRID_LOCATION = r"\b(?:and|&|\+|or|plus)\s+(?:online|livestream|live\s*stream|zoom|virtual)|(?:online|livestream|virtual)\s+(?:and|&|\+|or)\s+|\b(?:in[\s-]person|hybrid)\b"
HYBRID_PROSE = r"\b(?:hybrid|in[\s-]person\s+(?:and|&|or|\+)\s+(?:online|virtual|via)|(?:online|virtual)\s+(?:and|&|or|\+)\s+in[\s-]person|in\s+person\s+or\s+(?:online|via\s+(?:the\s+)?livestream))\b"
ONLINE_PROSE = (
    r"\bonline[\s-]only\b",
    r"\b(?:this|the)\s+(?:is\s+an?\s+)?(?:online|virtual)\s+(?:event|talk|lecture|session|webinar|seminar|course|panel|discussion)\b",
    r"\bwebinar\b",
    r"\b(?:takes?\s+place|held|hosted|delivered|streamed)\s+(?:entirely\s+|exclusively\s+)?(?:online|on\s+zoom|via\s+zoom|virtually)\b",
    r"\b(?:via|on|using)\s+(?:zoom|microsoft\s+teams|crowdcast)\b",
    r"\bonline\s+(?:event|lecture|talk|seminar|session|public\s+event|panel|discussion|book\s+launch|conversation)\b",
    r"\bjoin\s+(?:us\s+)?online\b",
)

# places
NON_LONDON_PLACES = (
    "aberdeen", "bath", "belfast", "birmingham", "bournemouth", "bradford", "brighton", "bristol", "cambridge",
    "canterbury", "cardiff", "carlisle", "chelmsford", "cheltenham", "chester", "colchester", "cornwall", "coventry",
    "derby", "devon", "dublin", "dundee", "durham", "edinburgh", "exeter", "glasgow", "gloucester", "grassmarket",
    "guildford", "harrogate", "hull", "inverness", "ipswich", "lancaster", "leeds", "leicester", "lincoln",
    "liverpool", "manchester", "milton keynes", "newcastle", "northampton", "norwich", "nottingham", "oxford",
    "plymouth", "portsmouth", "preston", "salisbury", "sheffield", "southampton", "st andrews", "stirling",
    "sunderland", "swansea", "swindon", "taunton", "tyntesfield", "warwick", "winchester", "wolverhampton",
    "worcester", "york", "cumbria", "yorkshire", "lake district", "slapton", "peterborough", "southend", "southend-on-sea",
    "luton", "st albans", "maidstone", "tunbridge wells", "hastings", "eastbourne", "worthing", "chichester", "poole",
    "weymouth", "truro", "falmouth", "tiverton", "kendal", "grange-over-sands", "king's lynn", "whitehaven",
    "scarborough", "blackpool", "bolton", "stockport", "salford", "wigan", "warrington", "shrewsbury", "hereford",
    "stratford-upon-avon", "newport", "wrexham", "aberystwyth", "bangor", "londonderry", "derry", "fermanagh", "perth",
    "galway", "cork", "limerick", "torquay", "yeovil", "basingstoke", "woking", "bedford", "kettering", "loughborough",
    "stoke-on-trent", "leamington", "margate", "dover", "folkestone", "ramsgate", "whitstable", "great yarmouth",
    "lowestoft", "bury st edmunds", "ely", "henley-on-thames", "windsor", "sevenoaks", "tonbridge", "crawley", "horsham",
    "lewes", "harwich", "clacton", "keswick", "ambleside", "buxton", "matlock", "ludlow", "malvern",
    "paris", "new york", "berlin", "amsterdam", "brussels", "washington", "boston", "sydney", "toronto", "hong kong",
    "singapore", "tokyo", "dubai", "abu dhabi", "delhi", "mumbai", "beijing", "los angeles", "san francisco",
)
STREETISH_AFTER = r"(?:['’]s\b|street|st\b|road|rd\b|square|sq\b|place|pl\b|house|circus|way|terrace|gardens?|gate|lane|row|rooms?|hall|court|crescent|mews|walk|yard|wharf|buildings?|avenue|ave\b|park|close|drive|hill|heath|bridge|palace|inn|theatre|college|school)"
LONDON = r"\blondon\b|\b(?:westminster|camden|islington|southwark|lambeth|hackney|kensington|chelsea|bloomsbury|holborn|soho|covent garden|mayfair|piccadilly|strand|south bank|southbank|barbican|greenwich|stratford|shoreditch|clerkenwell|marylebone|fitzrovia|highgate|hampstead|kew|richmond|wimbledon|white city|whitechapel|aldgate|city of london|canary wharf|king'?s cross|euston|paddington|battersea|brixton|notting hill)\b"
LONDON_POSTCODE_AREAS = ("E", "EC", "N", "NW", "SE", "SW", "W", "WC", "BR", "CR", "DA", "EN", "HA", "IG", "KT", "RM", "SM", "TW", "UB", "WD")
POSTCODE = r"\b([A-Z]{1,2})\d[A-Z\d]?\s*\d[ABD-HJLNP-UW-Z]{2}\b"

# Month names and the numbers they stand for
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTH_NAME = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"

# Forms of a date. Groups are year, month and day as each form orders them
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})(?!\d)"
DATE_DAYS_OF_MONTH = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s*[–—-]\s*\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH_NAME}(?:,?\s+(\d{{4}}))?"
DATE_DAY_MONTH = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[\s-]+{MONTH_NAME}(?:,?[\s-]+(\d{{4}}))?"
DATE_MONTH_DAY = rf"\b{MONTH_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
DATE_SLASHED = r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})\b"

# Digits that are a date, not a time
DATE_DIGITS = (r"\b\d{4}-\d{2}-\d{2}(?:T(?=\d))?", r"\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b")

# Forms of a time (a word, an hour with am or pm, a 24-hour time, an hour that opens a range ending in
# am or pm), what comes before one that isn't the start, and what joins a time to the end of its range
TIME_WORD = r"\b(noon|midday|midnight)\b"
TIME_MERIDIEM = r"(?<![£$€\d.,:])\b(1[0-2]|0?[1-9])(?:[:.]([0-5]\d))?\s*([ap])\.?\s?m\b\.?"
TIME_24_HOUR = r"(?<![£$€\d.,:])\b([01]\d|2[0-3]|\d)[:.]([0-5]\d)(?::[0-5]\d)?\b(?![.:,]?\d)(?!\s*(?:%|per\s*cent|hours?|hrs?|mins?|minutes?|km|miles?|million|bn|[mk]\b))"
TIME_OPENS_RANGE = r"(?<![£$€\d.,:])\b(1[0-2]|0?[1-9])(?=\s*(?:-|–|—|to|until)\s*(?:1[0-2]|0?[1-9])(?:[:.][0-5]\d)?\s*[ap]\.?\s?m\b)"
DOORS_BEFORE = r"\b(doors?)\b[^0-9]{0,14}"
RANGE_END = r"\s*(?:-|–|—|to|until|till)\s*(?:(1[0-2]|0?[1-9])(?:[:.][0-5]\d)?\s*([ap])\.?\s?m\b|\b(noon|midday)\b)"

# Honorifics before names, particles within them, letters after them, and words that no name has
HONORIFIC = r"^(?:(?:Prof(?:essor)?|Dr|Sir|Dame|Lord|Lady|Baroness|Baron|Rev(?:erend)?|Rt\.? Hon\.?|The Hon\.?|Mr|Mrs|Ms|Mx|Emeritus|Associate|Assistant)\.?\s+)+"
HONORIFIC_OF_KEY = r"^(?:(?:professor|prof|dr|sir|dame|lord|lady|baroness|baron|rev(?:erend)?|rt\.? hon|the hon|mr|mrs|ms|mx|miss)\.?\s+)+"
PROSE_TITLES = "Professor Prof Dr Sir Dame Lord Lady Baroness Baron Rev Reverend".split()
PROSE_SECOND_TITLES = "Sir Dame Dr Professor".split()
PROSE_NEXT_PERSON = "Professor Prof Dr Sir Dame".split()
PROSE_LETTERS = "FSA FRS FBA FRSE FLS FRAS OBE MBE CBE KBE DBE PhD MP".split()
PROSE_PARTICLES = "van von de der da di du la le al el bin ibn".split()
NAME_PARTICLES = "van von de der den da di du la le bin al el ibn y".split()
POST_NOMINALS = r"(?:,?\s+(?:[A-Z]{2,6}|F[A-Z][A-Za-z]{1,7}|Ph\.?D|D\.?Phil|M\.?Sc|B\.?Sc|Hon))+\s*$"
NAME_WORD = r"^[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’.-])*$"
NOT_FIRST_WORD = r"^(?:(?i:of|in|for|and|the)|[A-Z][a-z]{3,}ing)$"
NOT_IN_NAME = r"[\d:!?()\"“”@/]"
NOT_NAME_WORDS = r"\b(?:the|of|and|for|on|in|at|to|a|an|live|online|london|society|college|university|institute|school|centre|center|department|lecture|lectures|talk|event|events|festival|book|launch|q&a|tickets?|guests?|friends|others|more|panel|special|conversation|evening|night|screening|seminar|series|week|day|professor|lecturer|reader|fellow|director|chair|president|history|science|studies|research|technology|information|art|arts|music|theatre|gallery|museum|club|group|network|trust|foundation|award|prize|opening|launch|exhibition|workshop|conference|symposium|forum|summit|debate|discussion|introduction|annual|memorial|limited|ltd|plc|inc|llp|company|consulting|consultancy|sponsor|partners?|agency|council|ministry|office|scientist|engineer|manager|officer|lead|head|senior|principal|geologist|analyst|consultant|advis[eo]r|specialist|researcher|candidate|coordinator|executive|chief|deputy|editor|keynotes?|speakers?|chairs?|hosts?|panellists?|moderators?)\b"

# Phrases of titles that name people, and limits of a name and of the text before a separator
AGENT_PHRASE = r",?\s*\b(?:moderated|chaired|hosted|introduced|interviewed|presented)\s+by\s+"
CONVERSATION = r"^(.+?)\s+in conversation(?:\s+with\s+(.+))?$"
PEOPLE_PHRASES = (r"\b(?:an? (?:evening|afternoon|morning|night|audience) with|in conversation with|hosted by|chaired by|with)\s+(.+)$", r"\bspeakers?:\s*(.+)$")
NAME_SEPARATORS = r"\s*(?:,|;|/|\band\b|&|\+)\s*"
NAME_LENGTH, NAME_WORDS, LEAD_LENGTH = (4, 60), (2, 5), (4, 80)
COVERED_SHARE = 0.8
PROSE_LENGTH = 400

# What walls say in the first 6,000 characters of a response, and of an error that tells of one
WALL_TEXT = (
    ("Cloudflare bot protection", r"Just a moment\.\.\.|cf-chl|challenge-platform|Attention Required! \| Cloudflare"),
    ("SiteGround captcha", r"sgcaptcha"),
    ("Vercel security checkpoint", r"Vercel Security Checkpoint"),
    ("Imperva/Incapsula", r"_Incapsula_Resource|Incapsula incident"),
)
WALL_DENIED = ("access blocked (WAF)", r"Access (?:Blocked|Denied)|Request blocked")
INTERSTITIAL = r"<title>\s*(?:Just a moment|Attention Required|Robot Challenge Screen)|sgcaptcha|Vercel Security Checkpoint"
WALL_LEAD, INTERSTITIAL_MOST = 6000, 40_000

# Prices of one venue's pages
VENUE_LEVY = (r"\*[^*]*levy[^*]*\*", r"\(\+\s*£\s?\d+(?:\.\d{2})?\s*venue levy\)")
BOT_WALL = r"blocked by|bot protection|bot check|captcha|challenge"
