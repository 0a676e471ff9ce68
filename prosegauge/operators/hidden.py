"""Hidden and look-alike characters: counts, removal, and a generator of inputs for the tests of both."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import count_of
from .arrow import by_row

_CARRIERS = rf"[{fixed.INVISIBLE}]|[\x{{E0000}}-\x{{E007F}}]"
_JOINER, _ASIDE = "\u200d", "\ufdd0"  # the second is a noncharacter, which no text may interchange
# Characters that a joiner may stand between.
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{FE00}-\x{FE0F}\x{2122}\x{A9}\x{AE}\x{203C}\x{2049}"


def hidden_count(text: Column) -> Column:
    """Invisible carriers and look-alike letters; joiners and control characters do not count."""
    t = F.coalesce(text, F.lit(""))
    alike = F.length(t) - F.length(F.translate(t, fixed.LOOKALIKES, ""))
    return count_of(t, _CARRIERS) + alike


def composed(t: str | None) -> str | None:
    return t if t is None or t.isascii() else unicodedata.normalize("NFC", t)


def scrubbed(text: Column) -> Column:
    """Native part: carriers, joiners without emoji on both sides, controls but tab and line ends, look-alikes to ASCII.

    A joiner between two emoji is set aside as a noncharacter first, since lookbehind cannot see a supplementary one."""
    t = F.regexp_replace(text, _CARRIERS, "")
    t = F.regexp_replace(t, rf"([{_EMOJI}]){_JOINER}(?=[{_EMOJI}])", "$1")
    t = F.translate(F.regexp_replace(t, _JOINER, ""), "", _JOINER)
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return F.translate(t, fixed.LOOKALIKES, fixed.ASCII_LETTERS)


def scrub(text: Column) -> Column:
    """scrubbed, then composed (NFC); ASCII is its own composed form, but only a filter keeps it from the Arrow hop."""
    return by_row(composed, "string")(scrubbed(text))


def with_lookalikes(text: Column, rate: float) -> Column:
    """Test inputs: every round(1/rate)-th eligible letter becomes its look-alike; rate 0 or less changes nothing."""
    if rate <= 0:
        return text
    every, table = max(1, round(1 / rate)), dict(zip(fixed.ASCII_LETTERS, fixed.LOOKALIKES, strict=True))

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        n, out = 0, []
        for c in t:
            n += c in table
            out.append(table[c] if c in table and n % every == 0 else c)
        return "".join(out)

    return by_row(one, "string")(text)
