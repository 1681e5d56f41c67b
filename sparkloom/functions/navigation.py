"""Shell reads as navigation calls: greps and line reads that can be answered exactly are rewritten, all others are refused.

Words may be quoted; what the shell would expand or redirect, and flags that aren't known, refuse the whole
command. Flags stand before the pattern; a flag behind it refuses, too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A command that asks to be left alone.
LEAVE = "NAV_RAW=1"
# Folders that a search leaves out in any case, and long flags that change nothing or what a short one does.
SKIPPED = ("target", "node_modules", ".git", "dist", "build", "venv", ".venv", "__pycache__")
LONG = {"ignore-case": "i", "word-regexp": "w", "fixed-strings": "F", "extended-regexp": "E", "files-with-matches": "l", "count": "c"}
IDLE = ("line-number", "recursive", "dereference-recursive", "no-messages", "with-filename", "no-filename", "color", "colour", "color=auto", "color=never", "binary-files=without-match")

_WORD = r"""(?:[^\s'"\\|&;<>()`$]|'[^'\n]*'|"(?:[^"\\`$\n]|\\["\\$`])*"|\\[^\n])+"""
_QUIET = r"2>/dev/null"
#: A whole command: words and operators. || is refused by having no place here.
_LINE = rf"(?:{_QUIET}|{_WORD}|[ \t]+|\|(?!\|)|&&|;)*"
_SEGMENT = rf"((?:{_QUIET}|{_WORD}|[ \t]+|\|)+)(&&|;)?"
_EXCLUDED = "|".join(x.replace(".", r"\.") for x in SKIPPED)
_FLAG = rf"""-[nrRHhIsiwFEGlc]+|-[nrRHhIsiwFEGlc]*[ABC][ ]?[0-9]+|--(?:{"|".join([*IDLE, *LONG])})|--include=(?:{_WORD})|--exclude-dir=(?:\{{(?:(?:{_EXCLUDED}),?)+\}}|{_EXCLUDED})|--(?:after-|before-)?context=[0-9]+"""
_TAIL = r"head|head[ ]+(?:-n[ ]*)?-?[1-9][0-9]*|wc[ ]+-l"
_GREP = rf"^(e?grep)((?:[ \t]+(?:{_FLAG}))*)(?:[ \t]+--)?[ \t]+(?!-)({_WORD})((?:[ \t]+(?!-|{_QUIET}){_WORD})+)([ \t]+{_QUIET})?((?:[ \t]*\|[ \t]*(?:{_TAIL}))*)[ \t]*$"
_SED = rf"^sed[ \t]+-n[ \t]+(?:-e[ \t]+)?(['\"]?)((?:[1-9][0-9]*(?:,(?:[1-9][0-9]*|\$))?p;?)+)\1[ \t]+(?!-)({_WORD})(?:[ \t]+{_QUIET})?[ \t]*$"


def _number(flags: Column, letters: str, long: str) -> Column:
    """The last count that a flag gives, of the short ones or the long one."""
    found = F.regexp_extract_all(flags, F.lit(rf"(?:-[A-Za-z]*[{letters}][ ]?|--(?:{long}context)=)([0-9]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("int"), F.lit(0))


def _search(text: Column) -> Column:
    """The call that answers a grep."""
    part = lambda i: F.regexp_extract(text, _GREP, i)
    flags, tail = part(2), part(6)
    short = F.array_join(F.regexp_extract_all(flags, F.lit(r"(?:^|[ \t])-([A-Za-z]+)"), F.lit(1)), "")
    has = lambda letter: F.contains(short, F.lit(letter)) | flags.rlike(rf"--(?:{'|'.join(n for n, x in LONG.items() if x == letter)})(?:[ \t]|$)")
    last = F.regexp_extract(short, "^.*([EG])", 1)
    fixed, extended = has("F"), F.when(last == "E", True).when(last == "G", False).otherwise((part(1) == "egrep") | flags.contains("--extended-regexp"))
    before, after = F.greatest(_number(flags, "BC", "before-|"), F.lit(0)), _number(flags, "AC", "after-|")
    heads = F.transform(F.regexp_extract_all(tail, F.lit(r"head(?:[ ]+(?:-n[ ]*)?-?([1-9][0-9]*))?"), F.lit(1)), lambda n: F.when(n == "", 10).otherwise(n.cast("int")))
    globs = F.regexp_extract_all(flags, F.lit(rf"--include=({_WORD})"), F.lit(1))
    option = lambda cond, value: F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise("")
    numbered = lambda name, n: F.concat(F.lit(f" -{name} "), n.cast("string"))
    same = (before == after) & (before > 0)
    count = has("c") | tail.rlike("wc[ ]+-l")
    return F.concat(
        F.lit("nav search"), option(~extended & ~fixed, " --basic"), option(fixed, " -F"), option(has("i"), " -i"), option(has("w"), " -w"),
        option(same, numbered("C", before)), option(~same & (before > 0), numbered("B", before)), option(~same & (after > 0), numbered("A", after)),
        option(count, " -c"), option(~count & has("l"), " -l"),
        option(F.size(globs) > 0, F.concat(F.lit(" --glob "), F.array_join(globs, ","))),
        option(F.size(heads) > 0, F.concat(F.lit(" --head "), F.array_min(heads).cast("string"))),
        F.lit(" -- "), part(3), F.lit(" "), F.trim(part(4)), option(part(5) != "", f" {_QUIET}"),
    )


def _read(text: Column) -> Column:
    """The call that answers a read of lines."""
    ranges = F.transform(F.regexp_extract_all(F.regexp_extract(text, _SED, 2), F.lit(r"([0-9]+(?:,(?:[0-9]+|\$))?)p"), F.lit(1)), lambda r: F.when(F.contains(r, F.lit(",")), F.replace(F.replace(r, F.lit(",$"), F.lit("-")), F.lit(","), F.lit("-"))).otherwise(F.concat(r, F.lit("-"), r)))
    return F.concat(F.lit("nav lines "), F.array_join(ranges, ","), F.lit(" -- "), F.regexp_extract(text, _SED, 3))


def rewritten(command: Column) -> Column:
    """command, kinds (search or read, one for each call) of a shell command, or null if it is to run as it is.

    Segments apart by ; and && are looked at one by one: changes of folder, echoes and assignments stay; a && behind a
    read refuses, as a read's exit status isn't a grep's. A read of lines backwards refuses.
    """
    line = F.trim(command)
    pairs = F.zip_with(F.regexp_extract_all(line, F.lit(_SEGMENT), F.lit(1)), F.regexp_extract_all(line, F.lit(_SEGMENT), F.lit(2)), lambda a, b: F.struct(F.trim(a).alias("text"), b.alias("sep")))

    def one(p: Column) -> Column:
        text = p["text"]
        kept = text.rlike(rf"^(?:cd|echo|printf|true)(?=[ \t]|$)(?:(?!\|)[\s\S])*$") | text.rlike(rf"^[A-Za-z_]\w*=(?:{_WORD})?$")
        backwards = F.exists(F.regexp_extract_all(F.regexp_extract(text, _SED, 2), F.lit(r"([0-9]+,[0-9]+)p"), F.lit(1)), lambda r: F.split(r, ",")[1].cast("long") < F.split(r, ",")[0].cast("long"))
        kind = F.when(kept, "kept").when((p["sep"] == "&&"), F.lit(None)).when(text.rlike(_GREP), "search").when(text.rlike(_SED) & ~backwards, "read")
        call = F.when(kind == "kept", text).when(kind == "search", _search(text)).when(kind == "read", _read(text))
        return F.struct(kind.alias("kind"), F.concat(call, F.when(p["sep"] == ";", "; ").when(p["sep"] == "&&", " && ").otherwise("")).alias("call"))

    calls = F.transform(pairs, one)
    kinds = F.filter(F.transform(calls, lambda c: c["kind"]), lambda k: k != "kept")
    fine = line.rlike(rf"^{_LINE}$") & ~F.contains(line, F.lit(LEAVE)) & ~line.rlike(r"(?:^|[;&])[ \t]*(?:;|&&)") & ~F.exists(calls, lambda c: c["kind"].isNull()) & (F.size(kinds) > 0)
    return F.when(fine, F.struct(F.trim(F.array_join(F.transform(calls, lambda c: c["call"]), "")).alias("command"), kinds.alias("kinds")))
