"""Text expressions: tokenisers, shortening, signatures, redaction, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, least_bytes: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of letters, digits and underscores, of so many bytes at least."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= least_bytes) & ~t.isin(*stop) if stop else F.octet_length(t) >= least_bytes)


def ellipsize(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def normalise(text: Column, most: int = 80) -> Column:
    """Digits out, white space to single spaces, shortened: what repeats of a message have in common."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]+", ""), r"\s+", " ")), 1, most)


def scrub(text: Column) -> Column:
    """Masks keys by their prefix, bearer tokens and assignments of secrets."""
    text = F.regexp_replace(text, r"\b(ghp|gho|ghs|sk|pk|xoxb)[_-][A-Za-z0-9]{16,}", "$1_[REDACTED]")
    return F.regexp_replace(text, r"(?i)\b(token|password|secret|api_key)(\s*[=:]\s*)\"[^\"]*\"", '$1$2"[REDACTED]"')


def path_key(url: Column) -> Column:
    """The path of an address, lower-cased, without query; segments that are parameters become *."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_replace(path, r"/(\{[^/]*\}|:[^/]+|[0-9]+)", "/*")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


# Prefixes of published kinds of credentials.
SECRET_PREFIXES = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "sk_live_", "sk_test_", "rk_live_",
    "xoxb-", "xoxp-", "xoxa-", "xoxs-", "AKIA", "ASIA", "AIza", "hf_", "glpat-",
)


def redact(text: Column, most_bytes: int = 8192, reserve: int = 48) -> Column:
    """Masks key blocks and credentials, keeps their prefix. Doing it twice changes nothing.

    Longer texts are cut before a whole character and end with a note that says how many bytes are gone; the reserve has room for it.
    """
    out = F.regexp_replace(text, r"(?s)-----BEGIN.*?-----END[^\n]*", "[REDACTED key block]")
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_-])(" + "|".join(SECRET_PREFIXES) + r")[A-Za-z0-9_-]{12,}", "$1[REDACTED]")
    raw, kept = F.encode(out, "UTF-8"), most_bytes - reserve
    goes_on = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")  # noqa: E731  the byte behind the first n is inside a character
    size = F.when(~goes_on(kept), kept).when(~goes_on(kept - 1), kept - 1).when(~goes_on(kept - 2), kept - 2).otherwise(kept - 3)
    cut = F.concat(F.substr(raw, F.lit(1), size).cast("string"), F.lit("...["), (F.octet_length(out) - size).cast("string"), F.lit(" bytes truncated]"))
    return F.when(text.startswith('{"_redacted":'), text).when(F.octet_length(out) > most_bytes, cut).otherwise(out)


def dedent(text: Column) -> Column:
    """Without the indent that all lines with content share."""
    lines = F.split(text, "\n")
    least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, least + 1, F.length(x)))), "\n")


def line_time(line: Column) -> Column:
    """Seconds since 1970 of a line's timestamp field; null if it has none or it isn't a time."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_extract(line, r'"timestamp":"([0-9T:-]{19})', 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def text_of(json: Column, field: str) -> Column:
    """A field that is a text, or a list of parts whose texts are joined; anything else is empty."""
    raw = F.get_json_object(json, f"$.{field}")
    parts = F.from_json(F.when(raw.startswith("["), raw), "array<struct<text:string>>")
    joined = F.array_join(F.array_compact(parts["text"]), "\n")
    return F.when(raw.startswith("["), F.coalesce(joined, F.lit(""))).when(raw.startswith("{"), "").otherwise(F.coalesce(raw, F.lit("")))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hexadecimal digits; in two halves, as 64-bit products don't wrap."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h, at):
        lo = h["lo"].bitwiseXOR(F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("long"))
        low = lo * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(lo, 8)  # the prime is 2**40 + 0x1B3
        mask = F.lit(0xFFFFFFFF)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    h = F.aggregate(places, start, step)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
