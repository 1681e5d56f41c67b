"""Search in program text over a stored index of trigrams.

Texts lie in blocks of some dozens, sorted by block; the index has which trigrams each block holds, in
lower case. A pattern is read for trigrams that every match must have; blocks without them are not read,
the lines of the others are matched. Patterns that need no trigram read everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.work import files_mark, published

#: Texts of a block; folders of the stored texts, each with a share of the blocks; blocks that a plan names one by one.
BLOCK_TEXTS, PARTS, MOST_NAMED = 64, 64, 1_000

# patterns


def extended(basic: str) -> str:
    """A basic regular expression as an extended one: the signs ( ) { } | + ? are operators behind a backslash, and plain without."""
    swap = lambda m: m[0] if m[0][0] == "[" else m[1] if m[1] else "\\\\" if m[0] == "\\" else f"\\{m[2]}" if m[2] else m[0]
    return re.sub(r"\[\^?\]?[^\]]*\]?|\\([(){}|+?])|([(){}|+?])|\\.|\\$", swap, basic)


def glob_pattern(globs: str) -> str:
    """Globs, several apart by commas, as one regular expression: * and ? stay within a folder, ** doesn't, {a,b} is either.

    A glob with a slash fits the end of a path, one without its last name. A backslash reads as a slash.
    """
    depth, globs_ = 0, [[]]
    for sign in re.findall(r"\*\*|.", globs.replace("\\", "/")):
        depth = max(0, depth + (sign == "{") - (sign == "}"))
        if sign == "," and not depth:
            globs_.append([])
        else:
            globs_[-1].append(sign)
    return "|".join(f"(?:^|/){_glob(g)}$" for g in ("".join(x).strip() for x in globs_) if g)


def _glob(glob: str) -> str:
    signs = {"**": ".*" if "/" in glob else "[^/]*", "*": "[^/]*", "?": "[^/]"}
    depth, out = 0, ""
    for sign in re.findall(r"\*\*|.", glob):
        if sign == "{":
            depth, part = depth + 1, "(?:"
        elif sign == "}" and depth:
            depth, part = depth - 1, ")"
        else:
            part = "|" if sign == "," and depth else signs.get(sign) or re.escape(sign)
        out += part
    return out + ")" * depth


@dataclass(frozen=True)
class Search:
    """What to look for: kind is extended, basic or fixed; output is lines, count or files."""

    pattern: str
    kind: str = "extended"
    word: bool = False
    ignore_case: bool = False
    glob: str | None = None
    context: int = 0
    output: str = "lines"

    def regex(self) -> str:
        """The pattern for one line, for Java."""
        if not self.pattern:
            raise ValueError("an empty pattern")
        p = {"fixed": re.escape, "basic": extended, "extended": lambda x: x.replace("\\|", "|")}[self.kind](self.pattern)
        p = f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])" if self.word else p
        return f"(?i){p}" if self.ignore_case else p


# what a pattern needs: None (nothing), a trigram, or ("and" | "or", needs)


def grams(text: str) -> list[str]:
    """The trigrams of a run of characters, in lower case; none across characters beyond ASCII."""
    return [g.lower() for g in (text[i : i + 3] for i in range(len(text) - 2)) if g.isascii()]


def _all(needs: list) -> tuple | str | None:
    needs = [n for n in needs if n is not None]
    return ("and", needs) if len(needs) > 1 else needs[0] if needs else None


def _parsed(items) -> tuple | str | None:
    needs, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is K.LITERAL:
            run += chr(value)
            continue
        if op is K.AT:  # takes no character
            continue
        needs += grams(run)
        run = ""
        if op is K.SUBPATTERN:
            needs.append(_parsed(value[-1]))
        elif op is K.BRANCH:
            each = [_parsed(x) for x in value[1]]
            needs.append(None if None in each else ("or", each))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            needs.append(_parsed(value[2]))
        elif op is K.ATOMIC_GROUP:
            needs.append(_parsed(value))
    return _all(needs)


def needed(regex: str) -> tuple | str | None:
    """The trigrams that every match of a pattern has; nothing if the pattern can't be read here."""
    try:
        return _parsed(_parser.parse(regex))
    except (re.error, OverflowError):
        return None


def _names(need) -> Iterator[str]:
    if isinstance(need, str):
        yield need
    elif need:
        for n in need[1]:
            yield from _names(n)


def _held(need, found: Column) -> Column:
    """Whether a set of trigrams has what is needed."""
    if isinstance(need, str):
        return F.array_contains(found, need)
    out = _held(need[1][0], found)
    for n in need[1][1:]:
        out = out & _held(n, found) if need[0] == "and" else out | _held(n, found)
    return out


# the index


@dataclass
class TextIndex:
    texts: DataFrame  # part, block, path, text
    grams: DataFrame  # gram, block


_TEXTS = "block bigint, path string, text string, part bigint"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _block_grams(batches):
    """The distinct trigrams of each run of rows of one block; trigrams with bytes beyond ASCII are left out."""
    schema = pa.schema([("gram", pa.string()), ("block", pa.int64())])
    for batch in batches:
        blocks, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        start = 0
        for i in range(1, len(blocks) + 1):
            if i < len(blocks) and blocks[i] == blocks[start]:
                continue
            b = _LOWER[np.frombuffer(b"\xff\xff".join(texts[start:i]), np.uint8)]  # no trigram spans two texts
            if len(b) >= 3:
                code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
                code = np.unique(code[(code & 0x808080) == 0])
                names = [bytes((c >> 16, c >> 8 & 255, c & 255)).decode() for c in code.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([blocks[start]] * len(names), pa.int64())], schema=schema)
            start = i


def build(docs: DataFrame, path: str, text: str, name: str) -> TextIndex:
    """The index of a table's texts, stored once for the files it is read from. A null path or text is empty.

    Texts are shuffled once, into blocks by a hash of their path; the index is as large as the blocks have different trigrams.
    """
    spark = docs.sparkSession

    def make(base: str) -> None:
        blocks = max(1, -(-docs.count() // BLOCK_TEXTS))
        rows = docs.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("path", "text"), F.lit(blocks))).withColumn("part", F.col("block") % PARTS)
        rows.repartitionByRange("part", "block").sortWithinPartitions("part", "block", "path").write.partitionBy("part").parquet(f"{base}/texts")
        stored = spark.read.schema(_TEXTS).parquet(f"{base}/texts").select("block", "text").mapInArrow(_block_grams, "gram string, block bigint").distinct()
        stored.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{base}/grams")

    base = published(spark, f"grams-{name}-{files_mark(spark, docs)[:32]}", make)
    return TextIndex(spark.read.schema(_TEXTS).parquet(f"{base}/texts"), spark.read.schema("gram string, block bigint").parquet(f"{base}/grams"))


def candidates(index: TextIndex, regex: str) -> DataFrame | None:
    """The blocks that may hold a match; None if all may."""
    need = needed(regex)
    if need is None:
        return None
    wanted = sorted(set(_names(need)))
    found = index.grams.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_set("gram").alias("found"))  # of the pattern's own trigrams
    return found.where(_held(need, F.col("found"))).select("block")


def search(index: TextIndex, s: Search) -> DataFrame:
    """lines: path, line (from 1), hit, text of matching lines and those around them. count: path, hits. files: path.

    Null and empty texts have one empty line. Rows with equal paths are files of their own; count and files give a row each.
    """
    regex, texts = s.regex(), index.texts
    blocks = candidates(index, regex)
    if blocks is not None:
        named = [r[0] for r in blocks.limit(MOST_NAMED + 1).collect()]
        if len(named) <= MOST_NAMED:  # folders without these blocks aren't listed
            texts = texts.where(F.col("part").isin(sorted({b % PARTS for b in named})) & F.col("block").isin(named))
        else:
            texts = texts.join(blocks, "block", "left_semi")
    if s.glob:
        texts = texts.where(F.col("path").rlike(glob_pattern(s.glob)))
    rows = texts.select("path", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("hit", F.transform("lines", lambda x: x.rlike(regex))).where(F.exists("hit", lambda x: x))
    if s.output == "files":
        return rows.select("path")
    if s.output == "count":
        return rows.select("path", F.size(F.filter("hit", lambda x: x)).cast("long").alias("hits"))
    near = F.col("hit")
    if s.context:
        reach = F.lit(s.context)
        near = F.transform("hit", lambda x, i: F.exists(F.slice("hit", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, reach) + reach + 1), lambda y: y))
    shown = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.get("hit", i).alias("hit"), x.alias("text"), F.get(near, i).alias("near"))), lambda r: r["near"])
    return rows.select("path", F.explode(shown).alias("r")).select("path", "r.line", "r.hit", "r.text")
