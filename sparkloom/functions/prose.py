"""Expressions over prose, identifiers, dates and numbers as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that term vectors, similarity, hints and recall leave out.
VECTOR_STOP = ("the", "a", "an", "is", "it", "in", "of", "to", "and", "or", "for", "on", "at", "be", "as", "by", "fn", "pub", "let", "use", "mut", "self")
SIMILARITY_STOP = (
    "the", "and", "for", "are", "was", "were", "been", "this", "that", "with", "from", "not", "but", "then", "than", "into",
    "its", "it's", "use", "uses", "using", "when", "which", "what", "how", "all", "any", "can", "cannot", "does", "don't",
    "only", "one", "two", "more", "most", "also", "must", "should", "would", "will", "just", "same", "each", "every", "other",
    "there", "their", "they", "them", "our", "you", "your", "has", "have", "had", "after", "before", "about", "over", "under",
    "per", "via",
)
HINT_STOP = ("the", "and", "for", "with", "that", "this", "from", "into", "when", "code", "function", "write", "writing", "add", "adding", "new", "make")
RECALL_STOP = ("the", "and", "for", "with", "when", "that", "this", "how", "why", "does", "not", "are", "was", "but", "from", "into", "our", "use", "using")
# Other spellings of a limit's origin, of a kind of evidence and of a status.
PROVENANCE = {
    "physical": "physics", "information": "physics", "information-bound": "physics", "physics-bound": "physics",
    "hardware-capability": "hardware", "device": "hardware", "silicon": "hardware", "gpu": "hardware",
    "os": "platform", "os-policy": "platform", "platform-policy": "platform", "policy": "platform", "driver": "platform", "spec": "platform", "format": "platform",
    "default": "library-default", "config": "library-default", "configuration": "library-default", "library-config": "library-default",
    "version": "library-version", "library": "library-version",
    "design": "our-design", "api": "our-design", "our-api": "our-design", "our-code": "our-design", "ownership": "our-design",
    "implementations": "implementation", "existing-implementation": "implementation", "existing-implementations": "implementation", "research-code": "implementation",
    "consensus": "authority", "expert": "authority", "experts": "authority", "research-says": "authority",
    "cost": "budget", "frame-budget": "budget",
}
EVIDENCE = {
    "measured-on-device": "measured", "measured-on-target": "measured", "measurement": "measured", "measure": "measured", "test": "measured", "tested": "measured", "benchmark": "measured",
    "doc": "vendor-doc", "docs": "vendor-doc", "vendor": "vendor-doc", "vendor-docs": "vendor-doc", "documentation": "vendor-doc", "spec": "vendor-doc", "release": "vendor-doc", "release-notes": "vendor-doc",
    "research": "paper", "article": "paper", "study": "paper",
    "existing-implementation": "implementation", "implementations": "implementation", "code": "implementation",
    "consensus": "authority", "expert": "authority", "experts": "authority",
    "inference": "inferred", "reasoned": "inferred", "reasoning": "inferred", "estimate": "inferred",
}
STATUS = {"held": "holds", "hold": "holds", "confirmed": "holds", "move": "moved", "broken": "moved", "fell": "moved", "retire": "retired"}
# Breaks between clauses, phrases of a duration in minutes, minutes of a unit.
CLAUSE_BREAKS = (" — ", " - ", "; ", ": ", ". ")
PHRASES = (("half a day", 240), ("half an hour", 30), ("an hour", 60), ("a day", 480))
UNITS = (("m|min|mins|minute|minutes", 1), ("h|hr|hrs|hour|hours", 60), ("day|days", 480))


def similarity_tokens(text: Column) -> Column:
    """Words and identifiers of three characters or more, with their dots and colons, without the common ones."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_:.]*"), 0), lambda t: (F.length(t) >= 3) & ~t.isin(*SIMILARITY_STOP))


def hint_tokens(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) >= 4) & ~t.isin(*HINT_STOP))))


def opening_clause(text: Column, limit: int) -> Column:
    """Cut at the first break between 30 and limit, else at the last space before limit; limits are in characters."""
    s = F.trim(text)
    places = [F.when(F.locate(b, s).between(31, limit + 1), F.locate(b, s) - 1) for b in CLAUSE_BREAKS]
    head = F.substring(s, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.coalesce(F.least(*places), F.when((F.locate(" ", F.reverse(head)) > 0) & (space > 30), space), F.lit(limit))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, F.lit(1), cut), F.lit(" …")))


def first_clause(text: Column, limit: int) -> Column:
    """The first sentence if it ends within limit, the whole if short, else whole words."""
    s = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    end, head = F.locate(". ", s), F.substring(s, 1, limit)
    space = F.locate(" ", F.reverse(head))
    words = F.when(space > 0, F.rtrim(F.substring(head, F.lit(1), F.length(head) - space))).otherwise(head)
    return F.when(end.between(1, limit), F.concat(F.substring(s, F.lit(1), end), F.lit(" …"))).when(F.length(s) <= limit, s).otherwise(F.concat(words, F.lit(" …")))


def without_fences(text: Column) -> Column:
    """The lines outside of ``` fences; a fence that isn't closed runs to the end."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(state, line):
        fence = F.ltrim(line).startswith("```")
        kept = F.when(fence | state["inside"], state["kept"]).otherwise(F.concat(state["kept"], F.array(line)))
        return F.struct((state["inside"] != fence).alias("inside"), kept.alias("kept"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


def entry_key(text: Column) -> Column:
    """The first 40 characters, lower-cased, with single spaces."""
    return F.substring(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, 40)


def is_placeholder(key: Column) -> Column:
    k = F.trim(key)
    return (k == "") | k.startswith("...") | (k.startswith("<") & k.endswith(">"))


def identifiers(text: Column) -> Column:
    """snake_case and CamelCase words, lower-cased, without outer underscores."""
    snake = lambda w: (F.length(w) >= 5) & F.contains(F.regexp_replace(w, "^_+|_+$", ""), F.lit("_")) & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)
    camel = lambda w: (F.length(w) >= 6) & w.rlike(r"\p{Ll}\p{Lu}")
    found = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: snake(w) | camel(w))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.lower(F.regexp_replace(w, "^_+|_+$", "")))))


def code_references(text: Column) -> Column:
    """Words that look like code: CamelCase with two capitals, or snake_case, of four characters or more."""
    words = F.split(text, r"[^A-Za-z0-9_]+")
    camel = lambda w: w.rlike("^[A-Z]") & w.rlike("[A-Z].*[A-Z]") & w.rlike("[a-z]")
    snake = lambda w: F.contains(w, F.lit("_")) & ~w.rlike("[A-Z]")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike("^[A-Za-z_]") & (camel(w) | snake(w)))))


def slug(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "_ ", "--")


def alias(text: Column, table: dict[str, str]) -> Column:
    """The slug, under its usual name if it is another spelling."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[slug(text)], slug(text))


def valid_date(text: Column) -> Column:
    d = F.trim(text)
    month = F.try_to_timestamp(F.concat(d, F.lit("-01")), F.lit("yyyy-MM-dd")).isNotNull()
    full = F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(d.rlike("^[0-9]{4}$"), True).when(d.rlike("^[0-9]{4}-[0-9]{2}$"), month).when(d.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), full).otherwise(False)


def minutes(text: Column) -> Column:
    """Minutes that a phrase names, null if it names none; the first number that has a unit counts."""
    t = F.lower(text)
    out = F.when(F.lit(False), F.lit(0))
    for phrase, n in PHRASES:
        out = out.when(F.contains(t, F.lit(phrase)), n)
    units = "|".join(u for u, _ in UNITS)
    found = rf"(?<![0-9.])([0-9]+(?:\.[0-9]+)?)[ -]*({units})(?![a-z])"
    number, unit = F.regexp_extract(t, found, 1), F.regexp_extract(t, found, 2)
    times = F.coalesce(*[F.when(unit.rlike(f"^({u})$"), F.lit(n)) for u, n in UNITS])
    return out.when(number != "", F.round(number.cast("double") * times).cast("int"))


def since_seconds(text: Column, now: Column, session: Column) -> Column:
    """The time that a `since` means: empty or session, a timestamp, or so many minutes, hours, days before now; else null."""
    s = F.trim(text)
    n, unit = F.regexp_extract(s, "^([0-9]+)[mhd]$", 1), F.regexp_extract(s, "^[0-9]+([mhd])$", 1)
    back = n.cast("long") * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return F.when((s == "") | (F.lower(s) == "session"), session).when(n != "", now - back).when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.unix_seconds(F.try_to_timestamp(s)))


def share(num: Column, den: Column) -> Column:
    """A rate with its numbers, as 12% (3/25)."""
    rate = F.format_string("%.0f", F.bround(F.lit(100.0) * num / F.when(den == 0, None).otherwise(den), 0))
    return F.when(den == 0, "n/a").otherwise(F.concat(rate, F.lit("% ("), num.cast("string"), F.lit("/"), den.cast("string"), F.lit(")")))


def fixed(x: Column, places: int) -> Column:
    """A double from 1 to 2^53 as text with so many places, at most two, as C prints it.

    The exact binary value counts and exact halves go to the even digit; format_string takes the shortest decimal and halves up.
    """
    whole, one = F.floor(x), 1 << 52
    part = ((x - whole) * F.lit(float(one))).cast("long") * 10**places  # exact: what is behind the point in 52 bits
    down = F.shiftright(part, 52)
    rest = part - F.shiftleft(down, 52)
    digits = whole * 10**places + down
    digits = digits + F.when((rest > one // 2) | ((rest == one // 2) & (digits % 2 == 1)), 1).otherwise(0)
    if not places:
        return digits.cast("string")
    return F.concat(F.floor(digits / 10**places).cast("string"), F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0"))


def amount(n: Column, billions: bool = True) -> Column:
    """A number for people: 1.25B, 3.4M, 12k; without billions 1250.0M."""
    f = n.cast("double")
    small = F.when(f >= 1e6, F.concat(fixed(f / 1e6, 1), F.lit("M"))).when(f >= 1e3, F.concat(fixed(f / 1e3, 0), F.lit("k"))).otherwise(n.cast("string"))
    return F.when(f >= 1e9, F.concat(fixed(f / 1e9, 2), F.lit("B"))).otherwise(small) if billions else small


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4))


def common_segments(a: Column, b: Column, sep: str = "::") -> Column:
    """How many leading segments two module paths share."""
    pairs = F.arrays_zip(F.split(a, sep).alias("x"), F.split(b, sep).alias("y"))
    state = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct((s["on"] & p["x"].eqNullSafe(p["y"])).alias("on"), (s["n"] + F.when(s["on"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"))
    return F.aggregate(pairs, state, step)["n"]
