"""Inputs that set the operators off: invented prose holds next to none of what they look for, so every document gets a
passage of our own wording in front, by its id; one seed is empty and leaves a control group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEEDS = [
    "",
    "Moreover, we delve into a robust landscape. It's not a tool, it's a promise; a vital one; truly. Fast. Simple. Bold. Done here.",
    "Interestingly, studies show the plan works, ensuring steady growth. Great question! I hope this helps — let me know if it could potentially fail.",
    "In today's digital world this serves as a game-changer. Whether you're a cook or a poet, experts agree. As an AI language model I cannot say more.",
    "# Launch 🚀\nTL;DR it is not only fast but also cheap. Thus - as said - they may eventually unlock it, marking a shift.",
    'Smith (2020) found 42% [12] of 1,024 cases (Lee & Park, 2019, p. 4). See https://example.org/a?b=1 and "a quoted line" for $5.50 over 3 years. ⟦HZ0007⟧ stays.',
    "Furthermore, numerous teams utilize various tools. Additionally, they enhance significant results. Overall, careful work is essential. However, therefore, we wait.",
    "Hid​den m⁠arks and lооk-alikes: реас. Plain words follow here; one more.",
    "I went out. It rained, of course, and nobody at the stop had thought of an umbrella, so we all stood there dripping and laughing. Fine.",
    "Certainly! Let me walk you through it. Here's a breakdown: from ancient myths to the modern age. In conclusion, only time will tell.",
]


def seeded(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) with the seed of doc_id modulo the number of seeds before the text."""
    prefix = F.element_at(F.array(*map(F.lit, SEEDS)), (F.pmod("doc_id", F.lit(len(SEEDS))) + 1).cast("int"))
    text = F.when(prefix == "", F.col("text")).otherwise(F.concat(prefix, F.lit(" "), "text"))
    return docs.select("doc_id", text.alias("text"), "lang", "source")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEEDED = f"""seeded AS (
  SELECT doc_id, CASE WHEN prefix = '' THEN text ELSE prefix || ' ' || text END AS text, lang, source
  FROM documents JOIN (VALUES {", ".join(f"({k}, {quoted(s)})" for k, s in enumerate(SEEDS))}) seed(k, prefix) ON doc_id % {len(SEEDS)} = k)"""
