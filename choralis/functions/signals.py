"""Content signals: what spam, sales, praise and machine-written posts leave in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from choralis.functions.exact import round3, spark_pattern

# The patterns of the signals, in the order of the signal struct. \b is an ASCII word boundary.
URGENCY = (
    r"\b(hurry|immediately|urgent(ly)?|act now|asap|limited time|last chance|today only|don'?t miss( out)?"
    r"|before it sells out|sells out|only \d+ (minutes?|hours?|spots?|left)( left)?|kindly|locked|suspended|verify your"
    r"|claim (your|now))\b"
)
LINK = r"(https?://\S+|www\.\S+|\b[a-z0-9-]+\.(com|net|io|co|xyz|me|ly|gg|app|link|site|shop|org)(/\S*)?)"
SHORTENER = (
    r"\b(bit\.ly|tinyurl\.com|goo\.gl|ow\.ly|is\.gd|buff\.ly|cutt\.ly|rb\.gy|shorturl\.at|tiny\.cc|rebrand\.ly|t\.ly|s\.id)\b"
)
MESSAGING = (
    r"(\b(t\.me|wa\.me)/\S+|\b(contact|message|text|reach|dm|chat)\b[^.\n]{0,30}\b(telegram|whatsapp)\b"
    r"|\b(telegram|whatsapp)\s*(:|@|at\b|\+?\d)|\bsend (a|me a) (direct message|dm)\b|\bdm (me|them|him|her)\b"
    r"|\bcontact (the )?support\b)"
)
CRYPTO = (
    r"(\$[A-Z]{2,6}\b|\b(airdrop|wallet|seed phrase|metamask|trust wallet|giveaway|giving away|connect your wallet"
    r"|double rewards|presale|token launch|whitelist|mint)\b)"
)
MENTION = r"(?<![\w@])@\w{2,}"
THREAD_HOOK = (
    r"(🧵|👇|[\[(]1/\d{1,2}[\])]|\b1/\d{1,2}\s*$|so you don'?t have to|unpopular opinion|here'?s how|a thread\b|bookmark this)"
)
MONEY = (
    r"(\b(made|earned|making|profited|withdrew)\s+\$\s?\d[\d,.]*\s?k?\b"
    r"|\$\s?\d[\d,.]*\s?k?\s+(in|within)\s+(just\s+)?\d+\s+(hours?|days?|weeks?)"
    r"|\b(guaranteed (returns?|profits?)|trading signals?|signal group|account manager|forex|binary options"
    r"|helped me (recover|get (it|my \w+) back)|recover(ed)? (my|your|all my|lost|stolen) (funds|crypto|money|account|btc|bitcoin)"
    r"|thanks to @\w+,? i (made|earned|recovered|got))\b)"
)
JOB = (
    r"(#interested\b|\b(work from home|work-from-home|earn \$\s?\d[\d,]*\s?(/|per|a|an)\s?(day|week|hour)"
    r"|comment (your )?(email|\"?interested\"?)|no experience (needed|required)|urgent(ly)? hiring|daily pay(ment)?"
    r"|part[- ]time job)\b)"
)
ADULT = (
    r"(🔞|\b(check (out )?my (bio|profile)|link in (my )?bio|lonely tonight|horny|nudes|onlyfans|hot pics|private pics"
    r"|dm me for fun|hook ?up)\b)"
)
# The adult lures that only point to a bio.
BIO_POINTERS = [
    "check my bio", "check out my bio", "check my profile", "check out my profile", "link in bio", "link in my bio",
]
FOLLOW = (
    r"(#(f4f|followback|follow4follow)\b|\b(follow for follow|follow 4 follow|i follow back|follow back"
    r"|gain \d+\+? followers|buy (real )?followers|free followers)\b)"
)
PRAISE = (
    r"\b(great|amazing|awesome|insightful|valuable|well said|so true|spot on|thanks for sharing|love this|brilliant"
    r"|powerful|inspiring|helpful|informative)\b"
)
# Words that praise of any post is made of.
GENERIC_WORDS = (
    "great insights insight insightful thanks thank sharing share post valuable value content amazing awesome love this "
    "that well said true spot totally agree absolutely important everyone understand inspiring powerful helpful "
    "informative perspective point points really such very much nice good brilliant excellent fantastic wonderful keep "
    "going work congrats congratulations indeed interesting article read always truly message words wise needed hear "
    "today make makes sense couldn't more with what your have been here there these those think"
).split()
MILESTONE = (
    r"(\b((happy|excited|thrilled|pleased|proud|delighted|honou?red|grateful) to (share|announce)"
    r"|starting a new (position|role|job|chapter)|new (position|role|job) (as|at)|i'?ve (just )?(joined|accepted)"
    r"|(joined|joining) [^.\n]{0,40}\bas (an? )?|work anniversary|celebrating \d+ years?|got promoted|promoted to"
    r"|(earned|obtained|completed|received|achieved|passed|cleared) (my |the |a |an )?[^.\n]{0,50}"
    r"(certification|certificate|certified|exam|degree|course)|congratulations|congrats|graduated|new beginnings)\b"
    r"|#(certification|certified|newjob|newrole|newposition|careergrowth|workanniversary|promotion|graduation)\b)"
)
PROMOTION = (
    r"(\b((book|schedule) (a|your) (free )?(call|demo|meeting|session)|sign up|register (now|here|today)"
    r"|enrol+(ment)? (now|today|open)|enrol+ (in|for)|link in (the )?(first )?comments?|limited (seats|spots|slots)"
    r"|use (the )?code|buy now|shop now|order now|pre-?order|get (yours|your copy|it now)"
    r"|free (webinar|trial|guide|e-?book|masterclass|workshop|template|checklist|audit)"
    r"|join (my|our) (newsletter|course|cohort|community|program|bootcamp|webinar)"
    r"|check out (my|our) (new )?(course|product|tool|app|service|book)"
    r"|(dm|message) me (\"\w+\"|to (get|learn|join)|for (details|the link))|comment \"\w+\" (below )?(and|&) i'?ll"
    r"|vote for (us|our)|your vote|(we'?re|we are) (launching|live)|launch(ed|ing) (our|my)"
    r"|(our|my) (startup|company|product|platform|app|team) (is|goes|will|just)|come (visit|see|meet) us"
    r"|visit (us|our booth)|our booth|startup pitch|pitch (day|parade|competition)|now available|available now|waitlist"
    r"|early access|request a demo|free consultation)\b|\b\d{1,2}% off\b)"
)
AI_STYLE = (
    r"(\b(delve|game[- ]changer|in today'?s (fast[- ]paced|digital|ever[- ]evolving|competitive)|ever[- ]evolving"
    r"|unlock(ing)? (the|your)|let'?s dive in|here'?s the thing|navigat(e|ing) the (complexities|landscape)|seamless(ly)?"
    r"|tapestry|elevate your|harness(ing)? the power|embark|in conclusion|key takeaways?|it'?s not just about|isn'?t just"
    r"|the real magic|a testament to|plays a (crucial|pivotal) role|crucial|pivotal|transformative|empower(ing)?"
    r"|foster(ing)?|leverag(e|ing)|supercharge|actionable insights?|thought leadership)\b|—|[✅🚀💡👉🔑📌✨🔥⚡🎯])"
)
STEPS = r"(^\s*(\d+[.)]|step \d+)|\bhow to\b|\d+(\.\d+)?\s?(%|ms|gb|mb|x\b))"
HASHTAG = r"(?<![\w#])#[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}']+"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{23F3}]"

#: Signals that list their first six distinct matches.
LISTS = {
    "urgency": URGENCY, "shortened": SHORTENER, "messaging": MESSAGING, "crypto": CRYPTO, "money": MONEY, "job": JOB,
    "adult": ADULT, "follow": FOLLOW, "milestones": MILESTONE, "promotions": PROMOTION, "ai_style": AI_STYLE,
}


#: The characters that a match of a pattern can start with: those of words, in lower case, all behind a word boundary, and others. No match starts with any other.
STARTS = {
    URGENCY: ("abcdhiklostuv", ""), SHORTENER: ("bcgiorst", ""), MESSAGING: ("cdmrstw", ""), CRYPTO: ("acdgmpstw", "$"),
    MONEY: ("abefghmprstw", "$"), JOB: ("cdenpuw", "#"), ADULT: ("cdhlnop", "🔞"), FOLLOW: ("bfgi", "#"), PRAISE: ("abghilpstvw", ""),
    THREAD_HOOK: ("", r"🧵👇\[(1suhab"), MILESTONE: ("acdeghijnoprstw", "#"), PROMOTION: ("0-9abcdefgjlmnoprsuvwy", ""), AI_STYLE: ("acdefghiklnpstu", r"\x{2014}-\x{1F6FF}"),  # a range is quicker than its signs
}


def _start(word: str, other: str) -> str:
    found = ([f"(?=[{word}])(?<!\\w)"] if word else []) + ([f"(?=[{other}])"] if other else [])
    return f"(?:{'|'.join(found)})" if found else ""


def _any_case(pattern: str, flags: str = "i") -> Column:
    """The pattern in any case. Where no match can start, one look at a character tells, before any alternative is tried."""
    return F.lit(f"(?{flags})" + _start(*STARTS.get(pattern, ("", ""))) + spark_pattern(pattern))


def first_matches(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, _any_case(pattern), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, 6)


def _any_list() -> Column:
    """A pattern that a text matches if and only if one of LISTS does, for most texts match none."""
    words, others = zip(*[STARTS[p] for p in LISTS.values()], strict=True)
    each = "|".join(_start(*STARTS[p]) + spark_pattern(p) for p in LISTS.values())
    return F.lit(f"(?i){_start(''.join(words), ''.join(others))}(?:{each})")


def content_words(text: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD[:-1] + "{4,}"), F.lit(0)))


def overlap(text: Column, parent: Column) -> Column:
    share = lambda own: F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, content_words(parent))) / F.size(own))
    return F.get(F.transform(F.array(content_words(text)), share), F.lit(0))  # a lambda's argument is taken once


def generic_praise(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"@\w+", " ")), F.lit(WORD), F.lit(0))
    own = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(GENERIC_WORDS))
    return F.regexp_like(text, _any_case(PRAISE)) & (F.size(words) <= 25) & (F.size(own) <= 1)


def link_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + spark_pattern(LINK).replace("[a-z0-9-]+", "[a-z0-9-]++")))  # never gives letters back in vain


def uppercase_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{IsUppercase}]+", ""))
    return F.when(letters < 20, 0.0).otherwise(round3(upper / F.nullif(letters, F.lit(0))))


def text_signals(texts: Column, parent: Column) -> Column:
    """A struct of 21 signals of an account's texts; parent null: there is nothing to stay on topic with."""
    everything = F.array_join(texts, "\n")
    words = F.regexp_count(everything, F.lit(WORD))
    emojis = F.regexp_count(everything, F.lit(EMOJI))
    none, found = F.array().cast("array<string>"), F.regexp_like(everything, _any_list())
    off = F.array_max(F.transform(texts, lambda t: overlap(t, parent)))
    fields = {
        "emojis": emojis,
        "emoji_density": round3(emojis / F.greatest(F.lit(1), words)),
        "links": link_count(everything),
        "mentions": F.regexp_count(everything, F.lit(MENTION)),
        "uppercase_ratio": uppercase_ratio(everything),
        "thread_hook": F.regexp_like(everything, _any_case(THREAD_HOOK, "im")),
        "parent_overlap": F.when(parent.isNotNull(), round3(F.coalesce(off, F.lit(0.0)))),
        "generic_praise": (F.size(texts) > 0) & F.forall(texts, generic_praise),
        "hashtags": F.regexp_count(everything, F.lit(HASHTAG)),
        "substantive": (words >= 60) & (F.regexp_count(everything, _any_case(STEPS, "im")) >= 2),
        **{name: F.when(~found, none).otherwise(first_matches(everything, p)) for name, p in LISTS.items()},
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])
