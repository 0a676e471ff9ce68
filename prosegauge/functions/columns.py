"""Column builders: patterns of Python's dialect compiled for the JVM, Unicode trim, clamps, counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Python's str methods and patterns see it, as the inside of a character class.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same set for the JVM, which asks a range after the other: the common ones as single characters, which it looks up at once,
#: and the others only beyond Latin-1.
JAVA_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORDS, LITE_WORDS = r"[A-Za-z0-9']+", r"[A-Za-z']+"
#: Sentence ends of the counting splitter, and of the one that keeps punctuation.
DROP_SPLIT, KEEP_SPLIT = rf"[.!?]+(?:[{SPACE}]+|\z)", rf"(?<=[.!?])[{SPACE}]+"
JAVA_DROP, JAVA_KEEP = rf"[.!?]+(?:{JAVA_SPACE}+|\z)", rf"(?<=[.!?]){JAVA_SPACE}+"
_W = r"[\p{L}\p{N}_]"


def _classes(p: str, space: str, word: str, digit: str) -> str:
    """Replace the shorthand classes, inside and outside of brackets."""
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\w", r"\d", r"\S"):
            body = {"s": space, "w": word, "d": digit}.get(two[1], space)
            out.append(body if inside else f"[^{body}]" if two[1] == "S" else f"[{body}]")
            i += 2
            continue
        if p[i] == "\\":
            out.append(two)
            i += 2
            continue
        if p[i] == "[" and not inside:
            inside = True
        elif p[i] == "]" and inside and p[i - 1] not in "[^":
            inside = False
        out.append(p[i])
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "iud") -> str:
    """A Python pattern for java.util.regex: Unicode classes, word edges by lookaround, newline as the only line end."""
    p = re.sub(r"^\(\?i\)", "", pattern)
    flags = flags if p == pattern else "iud"
    p = p.replace(fixed.OPENER, r"(?:^|(?<=[.!?]\s))\s*")
    either = "(?:(?<=@W)(?!@W)|(?<!@W)(?=@W))"
    p = re.sub(r"(^|.)\\b", lambda m: m[1] + (either if m[1] and m[1] in "+}?*" else "(?!@W)" if m[1] and (m[1].isalnum() or m[1] in ")]") else "(?<!@W)"), p, flags=re.S)
    p = _classes(p, SPACE, r"\p{L}\p{N}_", r"\p{Nd}")
    return f"(?{flags}m)" + p.replace("@W", _W)


def re2(pattern: str, flags: str = "i") -> str:
    """The same pattern for RE2, which has no lookaround: openers consume their prefix (see opener_text)."""
    p = re.sub(r"^\(\?i\)", "", pattern)
    flags = flags if p == pattern else "i"
    p = p.replace(fixed.OPENER, r"(?:^|\n|[.!?]\s)\s*")
    return f"(?{flags}m)" + _classes(p, SPACE, r"\p{L}\p{N}_", r"\p{Nd}")


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def more_words(text: Column, least: int) -> Column:
    """Whether the text has more than that many runs without white space; no more of it is read than that takes."""
    other = JAVA_SPACE.replace("[", "[^", 1)
    return F.coalesce(text.rlike(rf"\A{JAVA_SPACE}*+(?:{other}++{JAVA_SPACE}++){{{least}}}{other}"), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often use names it: Spark puts Columns into each other and may
    then work out each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clamp01(x: Column) -> Column:
    """NaN is 0.5, null stays null, anything else is bound to 0..1."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def e4(x: Column) -> Column:
    """Ten thousand times x, rounded half up: an integer that engines agree on."""
    return F.floor(x * 10000 + 0.5).cast("long")


def mean_e4(x: Column) -> Column:
    """e4 of a mean of readings: a tie that double arithmetic has moved by less than a millionth counts as a tie."""
    return F.floor(F.round(x * 10000, 6) + 0.5).cast("long")


def round4(x: Column) -> Column:
    return e4(x) / F.lit(10000.0)


def sentences_keep(text: Column) -> Column:
    """Sentences with their punctuation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(trimmed(F.coalesce(text, F.lit(""))), JAVA_KEEP, -1), trimmed), lambda s: s != "")


def sentences_drop(text: Column) -> Column:
    """Sentences without their final punctuation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), JAVA_DROP, -1), trimmed), lambda s: s != "")


def sentence_sizes(text: Column, words: str) -> Column:
    """Matches of words in each piece of the counting splitter that is not blank."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), JAVA_DROP, -1), lambda s: ~is_blank(s))
    return F.transform(pieces, lambda s: F.regexp_count(s, F.lit(words)))


def moments(counts: Column) -> Column:
    """struct(n, s1, s2): size, sum and sum of squares of an array of counts, in one pass."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s1"] + x).alias("s1"), (a["s2"] + x.cast("long") * x).alias("s2"))
    return F.aggregate(counts, zero, step)


def variation(m: Column) -> Column:
    """Population standard deviation over mean, from integer moments; null where the sum is 0."""
    return F.when(m["s1"] > 0, F.sqrt((m["n"] * m["s2"] - m["s1"] * m["s1"]).cast("double")) / m["s1"])


def prefix_tree(words: list[str]) -> str:
    """A pattern of exactly these words that shares their beginnings, so that a matcher tries few branches at each place."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + "?" * ("" in node)

    return pattern(tree)


def word_list(words: list[str]) -> str:
    """Whole lite tokens of a list, in any ASCII case."""
    return rf"(?i)(?<![A-Za-z']){prefix_tree(words)}(?![A-Za-z'])"
