"""Scalar functions over text: screens, tokens, topics, hashes, labels and form hints, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vectors import let

Text = Column | str

# Fixed values.
DENY = (
    r"how to (kill|murder|poison|assault|rape|kidnap|traffick)",
    r"how to (make|build) a (bomb|explosive|weapon)",
    r"how to (destroy|tamper|fabricate) evidence",
    r"how to (bribe|threaten) (a )?(judge|witness|official|cop|police)",
    r"how to (forge|counterfeit) (documents?|signature|id)",
    r"how to (escape|get away) after (killing|murder|crime)",
    r"contract killing",
    r"hire (a )?hitman",
)
DARK = ("how to kill", "how to murder someone", "how to poison", "how to make a bomb", "how to destroy evidence", "how to bribe a judge", "how to forge documents", "how to escape after killing", "how to sexually assault", "child abuse", "how to traffick", "contract killing")
STOP = ("what", "how", "when", "where", "why", "the", "and", "for", "with", "from")
CRIME = ("theft", "murder", "assault", "rape", "fraud", "cheating", "robbery", "kidnapping", "accident", "domestic", "violence", "harassment", "cybercrime", "defamation", "bail", "arrest", "fir", "property", "land", "salary", "divorce", "dowry", "stalking")
CRIME_OLD = ("theft", "murder", "assault", "rape", "fraud", "cheating", "robbery", "dacoity", "kidnapping", "accident", "domestic", "violence", "harassment", "cybercrime", "defamation", "bail", "arrest", "fir", "complaint", "property", "land", "salary", "consumer", "divorce", "dowry", "cruelty", "pocso", "rti", "employer", "landlord", "tenant", "workplace", "stalking")
ALIASES = {
    "stolen": "theft", "steal": "theft", "stole": "theft", "stealing": "theft", "murdered": "murder", "killed": "murder", "killing": "murder",
    "assaulted": "assault", "raped": "rape", "cheated": "cheating", "robbed": "robbery", "kidnapped": "kidnapping", "harassed": "harassment", "stalked": "stalking", "defamed": "defamation",
}
TERMS = ("murder", "theft", "assault", "rape", "kidnapping", "fraud", "cheating", "forgery", "robbery", "dacoity", "abetment", "conspiracy", "bail", "arrest", "warrant", "fir", "complaint", "evidence", "witness", "confession", "punishment", "imprisonment", "fine", "death", "life", "property", "document", "court", "magistrate", "police", "investigation", "trial", "appeal", "hurt", "grievous", "wrongful", "criminal", "offence", "penalty", "dowry", "cruelty", "defamation", "obscene", "nuisance")
CATEGORIES = (
    ("Offences Against Person", ("murder", "hurt", "assault", "rape", "kidnap")),
    ("Offences Against Property", ("theft", "robbery", "dacoity", "property", "fraud", "cheat")),
    ("Arrest and Bail", ("bail", "arrest", "warrant", "remand", "custody")),
    ("Evidence and Proof", ("evidence", "witness", "proof", "confession")),
    ("Investigation and Complaints", ("fir", "complaint", "investigation", "inquiry")),
    ("Trial Procedure", ("trial", "court", "magistrate", "session")),
    ("Punishment", ("punishment", "sentence", "fine", "imprisonment")),
)
ACTIONS = (("/auth/login", "user_login"), ("/auth/logout", "user_logout"), ("/auth/register", "user_register"), ("/legal", "legal_query"), ("/complaints", "complaint"), ("/knowledge", "knowledge_search"), ("/awareness", "news"))
NOT_AUDITED = ("/api/docs", "/api/redoc", "/api/openapi.json")
CITATIONS = (r"(?i)BNS\s+(?:Section\s+)?(\d+[A-Z]?)", r"(?i)BNSS\s+(?:Section\s+)?(\d+[A-Z]?)", r"(?i)IPC\s+(?:Section\s+)?(\d+[A-Z]?)", r"(?i)Section\s+(\d+[A-Z]?)\s+(?:of\s+)?(?:BNS|BNSS|IPC|BSA)")
PLACES = ("at", "near", "in", "inside", "outside", "from", "location:", "place:")


def _c(t: Text) -> Column:
    return F.col(t) if isinstance(t, str) else t


def tokens(t: Text) -> Column:
    """Words between white space."""
    return F.filter(F.split(_c(t), r"\s+"), lambda w: w != "")


def normalise(t: Text) -> Column:
    """Lower case, look-alike digits and signs as letters, all else but letters as single spaces."""
    plain = F.translate(F.lower(_c(t)), "01345@$", "oieasas")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z\s]", " "), r"\s+", " "))


def harm_match(t: Text) -> Column:
    """The first harm pattern that the normalised text matches, as matched; else NULL."""
    def first(n: Column) -> Column:
        match = F.coalesce(*[F.nullif(F.regexp_extract(n, p, 0), F.lit("")) for p in DENY])
        return F.when(n.rlike("|".join(f"(?:{p})" for p in DENY)), match)

    return let(normalise(t), first)


def dark_match(t: Text) -> Column:
    """The first phrase of the older list that the lower-cased text contains; else NULL."""
    return F.coalesce(*[F.when(F.contains(F.lower(_c(t)), F.lit(p)), F.lit(p)) for p in DARK])


def strip(w: Column, marks: str) -> Column:
    return F.btrim(w, F.lit(marks))


def query_words(t: Text, most: int = 6, stop: tuple[str, ...] = STOP) -> Column:
    """Search words: longer than 3 as typed, no stop words, without marks at the ends, lower case, the first `most`."""
    kept = F.filter(tokens(t), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*stop) if stop else F.length(w) > 3)
    return F.slice(F.transform(kept, lambda w: F.lower(strip(w, ".,?!;:"))), 1, most)


def crime_terms(t: Text, old: bool = False) -> Column:
    """The distinct crime words of a text, other forms as the word itself (not in the older list)."""
    words = F.transform(tokens(t), lambda w: strip(F.lower(w), ".,?!"))
    if not old:
        alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(alias, w), w))
    return F.array_intersect(words, F.array(*map(F.lit, CRIME_OLD if old else CRIME)))


def topic_changed(now: Column, before: Column, turns: Column, old: bool = False) -> Column:
    """now, before: crime words of this turn and of the last three user turns; turns: length of the history."""
    apart = ~F.arrays_overlap(now, before)
    rule = F.when((F.size(now) == 0) & (F.size(before) == 0), False)
    rule = rule.when(~apart, False).otherwise(F.size(now) > 0) if old else rule.otherwise(apart)
    return F.when(turns < (1 if old else 2), True).otherwise(rule)


def fenced_json(t: Text) -> Column:
    """The first part between ``` that starts, after an optional `json`, with { or [; else the text, trimmed."""
    text = F.trim(_c(t))
    parts = F.transform(F.split(text, "```"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"^json\s*", ""))
    found = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit("{")) | F.startswith(p, F.lit("["))), F.lit(0))
    return F.when(F.contains(text, F.lit("```")), F.coalesce(found, text)).otherwise(text)


def clean_response(t: Text) -> Column:
    """Unwrap {"filtered_text": ...}, keep one warning mark at most, trim; NULL is empty."""
    inner = F.get_json_object(_c(t), "$.filtered_text")
    text = F.when(F.startswith(F.trim(_c(t)), F.lit("{")), F.coalesce(inner, _c(t))).otherwise(_c(t))
    parts = F.split(text, "⚠️")
    return F.coalesce(F.trim(F.when(F.size(parts) > 2, F.concat_ws("⚠️", F.slice(parts, 1, 2))).otherwise(text)), F.lit(""))


def confidence(similarity: Text) -> Column:
    return F.round(0.55 + 0.4 * F.least(_c(similarity), F.lit(1.0)), 3)


def embed(t: Text, dim: int = 768) -> Column:
    """Hashing embedder: MD5 of each lower-case word, modulo dim, counted; unit length (no word: zeros).

    The 128-bit remainder is taken from four 32-bit pieces by Horner's rule, which stays within 64 bits.
    """
    def bucket(h: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(4):
            piece = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
            out = (out * ((1 << 32) % dim) + piece) % dim
        return out.cast("int")

    def dense(at: Column) -> Column:
        """at: the words' buckets in order. Runs of equal ones are counted, and zeros put between them."""
        last = F.filter(F.transform(at, lambda b, k: F.struct(b.alias("b"), (k + 1).alias("end"), F.coalesce(F.get(at, k + 1) != b, F.lit(True)).alias("last"))), lambda r: r["last"])
        runs = lambda r: F.transform(r, lambda e, k: F.struct(e["b"].alias("b"), (e["end"] - F.coalesce(F.get(r, k - 1)["end"], F.lit(0))).cast("double").alias("n")))
        return let(let(last, runs), lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, e: s + e["n"] * e["n"])), lambda scale: filled(c, scale)))

    def filled(c: Column, scale: Column) -> Column:
        gap = lambda e, k: F.array_repeat(F.lit(0.0).cast("float"), e["b"] - F.coalesce(F.get(c, k - 1)["b"], F.lit(-1)) - 1)
        parts = F.transform(c, lambda e, k: F.concat(gap(e, k), F.array((e["n"] / scale).cast("float"))))
        return F.concat(F.flatten(parts), F.array_repeat(F.lit(0.0).cast("float"), dim - 1 - F.get(c, F.size(c) - 1)["b"]))

    at = F.array_sort(F.transform(tokens(F.lower(_c(t))), lambda w: let(F.md5(w.cast("binary")), bucket)))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return let(at, lambda a: F.when(F.size(a) > 0, dense(a)).when(a.isNotNull(), zero))


def embed_input(title: Text, text: Text) -> Column:
    return F.concat(_c(title), F.lit(". "), F.substring(_c(text), 1, 2000))


def hmac_sha256(key: str, message: Text) -> Column:
    """Hexadecimal HMAC-SHA256 under a constant key."""
    import hashlib

    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in k).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(_c(message), "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def ip_hash(ip: Text, key: str) -> Column:
    """The first 40 digits of the keyed hash; NULL for NULL or empty."""
    return F.when(_c(ip) != "", F.substring(hmac_sha256(key, ip), 1, 40))


def action_of(path: Text) -> Column:
    out = F.lit("api_request")
    for key, action in reversed(ACTIONS):
        out = F.when(F.contains(_c(path), F.lit(key)), action).otherwise(out)
    return out


def is_audited(path: Text) -> Column:
    p = _c(path)
    excluded = F.lit(False)
    for x in NOT_AUDITED:
        excluded = excluded | F.startswith(p, F.lit(x))
    return F.startswith(p, F.lit("/api/")) & ~excluded


def timestamp_or(t: Text, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(_c(t), "Z$", "+00:00")), default)


def keywords(t: Text) -> Column:
    """The terms of the list that the text contains."""
    low = F.lower(_c(t))
    return F.filter(F.array(*map(F.lit, TERMS)), lambda w: F.contains(low, w))


def category(title: Text) -> Column:
    """The first rule one of whose words the title contains; else General."""
    low, out = F.lower(_c(title)), F.lit("General")
    for name, words in reversed(CATEGORIES):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def citations(t: Text) -> Column:
    """The first three distinct citations of sections, pattern by pattern."""
    found = F.concat(*[F.transform(F.regexp_extract_all(_c(t), F.lit(p), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, r"\s+", " "))) for p in CITATIONS])
    return F.array_join(F.slice(F.array_distinct(found), 1, 3), ", ")


def place_hint(t: Text) -> Column:
    """Up to 38 characters behind the first place word, to the first mark, if they are 4 to 59 characters."""
    low, hints = F.lower(_c(t)), []
    for w in PLACES:
        at = F.locate(f" {w} ", low)
        words = F.trim(F.split(F.substring(_c(t), at + F.lit(len(w) + 2), F.lit(38)), "[,.!?]")[0])
        hints.append(F.when((at > 0) & (F.length(words) > 3) & (F.length(words) < 60), words))
    return F.coalesce(*hints, F.lit(""))


def fir_type(t: Text) -> Column:
    return F.when(F.contains(F.lower(_c(t)), F.lit("non-cognizable")), "Non-Cognizable").otherwise("Cognizable")


def is_email(t: Text) -> Column:
    return _c(t).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_phone(t: Text) -> Column:
    return _c(t).rlike(r"^[6-9][0-9]{9}$")


def haversine_km(lat1: Text, lon1: Text, lat2: Text, lon2: Text) -> Column:
    """Great-circle distance on a sphere of 6371 km, one decimal."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return F.round(6371 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def page_count(n: Text, size: int = 20) -> Column:
    return F.ceil(_c(n) / size)


def section_order(number: Text) -> list[Column]:
    """Natural order of section numbers: leading number, then the text."""
    return [F.coalesce(F.regexp_extract(_c(number), r"^(\d+)", 1).try_cast("int"), F.lit(0)), _c(number)]
