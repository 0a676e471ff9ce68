"""Secret scans with DataFrame functions only.

Three lexical kinds (assign, access, hex) are matched as they stand. A fourth, markov, adds tokens that read like random
strings: two character Markov models, one of random strings and one of ordinary identifiers, are counted from labelled
samples, and a token's mean log-likelihood ratio decides.

Positions without a scripting language: the pieces between matches and the matches themselves alternate, so running
sums of their lengths give each match's offset. Texts are worked on once per distinct text, found by SHA-256, and
joined back to all rows.

Defined results: null and empty texts have no spans; repeated rows each get their row; spans are in code points, end
exclusive; spans of different lexical kinds may overlap, a markov span never overlaps a lexical one, and of spans that begin
together the kind listed first stands first; a very long text is read in linear time, with its matches and the pieces between them
as one array, which is exploded into rows before anything is added up; empty tables give empty tables; extra columns
pass, but for one named secret_spans, in any case, which the result replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drawn, fresh, without

# Fixed patterns: kind, matcher, least code points of the whole match, least of group 2.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 12),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
]
#: What a token for the Markov models is: so many of these characters, a digit and a letter among them.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Texts that can hold any span at all. The last asks for a digit behind the first character of a run, and only there, so that a
#: long run of letters is read once.
HINTS = [r"(?i)password|passwd|secret|token|api_?key", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{16})[A-Za-z+/_=-]*+[0-9]"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bounds of the labelled samples: texts drawn for ordinary words (of at most so many code points), random strings made.
DRAWN_TEXTS, LONGEST_DRAWN, RANDOM_STRINGS = 300, 20_000, 1500
#: Pseudo-counts of a character's own frequency in its transitions.
BACK_OFF = 5.0
#: Least mean log-likelihood ratio of a pair of characters, in nats.
LEAST_RATIO = 0.6


def bigram_counts(tokens: DataFrame, name: str) -> DataFrame:
    """Rows (pair, count) of neighbouring characters in column token."""
    pairs = tokens.where(F.length("token") > 1).select(F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"), "token")
    return pairs.groupBy(F.substring("token", F.col("i"), F.lit(2)).alias("pair")).agg(F.count("*").alias(name))


def markov_ratios(texts: DataFrame) -> DataFrame:
    """Rows (pair, ratio) for all pairs of the alphabet: log of transition probability in random strings over that in words."""
    spark = texts.sparkSession
    ordinary = (
        drawn(texts.select("doc_id", "text"), DRAWN_TEXTS)
        .where(F.length("text") <= LONGEST_DRAWN)
        .select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("token"))
        .where(~F.col("token").rlike(rf"^(?=.*[0-9])(?=.*[A-Za-z]){TOKEN}$|^[0-9a-f]{{16,}}$"))
    )
    n = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    random = n.select(F.explode(F.array(F.col("h"), F.base64(F.unhex("h")), F.upper(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "")))).alias("token"))
    chars = spark.range(1).select(F.explode(F.array(*map(F.lit, ALPHABET))).alias("a"))
    every = chars.select("a", F.explode(F.array(*map(F.lit, ALPHABET))).alias("b")).select(F.concat("a", "b").alias("pair"))
    both = every.join(bigram_counts(random, "n_random"), "pair", "left").join(bigram_counts(ordinary, "n_ordinary"), "pair", "left").fillna(0)
    first, second = Window.partitionBy(F.substring("pair", 1, 1)), Window.partitionBy(F.substring("pair", 2, 1))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of the alphabet's pairs, a fixed number

    def chance(c: str):
        """Of the second character after the first, backed off to its frequency anywhere, and that to an even one."""
        alone = (F.sum(c).over(second) + F.lit(0.5)) / (F.sum(c).over(whole) + F.lit(0.5 * len(ALPHABET)))
        return (F.col(c) + BACK_OFF * alone) / (F.sum(c).over(first) + BACK_OFF)

    return both.select("pair", F.log(chance("n_random") / chance("n_ordinary")).alias("ratio"))


def located(texts: DataFrame, pattern: str) -> DataFrame:
    """Rows (text_key, start, end, found) of all matches, leftmost and without overlap."""
    pieces = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    rows = texts.select("text_key", F.posexplode(F.arrays_zip(pieces.alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))).alias("i", "m"))
    along = Window.partitionBy("text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("m.found"), F.lit(0))
    start = F.coalesce(F.sum(F.col("m.gap") + size).over(along), F.lit(0)) + F.col("m.gap")
    return rows.select("text_key", start.alias("start"), (start + size).alias("end"), F.col("m.found").alias("found")).where("found is not null")


def spans_of(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows (text_key, kind, rank, start, end) over distinct texts; sample: texts from which ordinary words are learnt."""
    lexical = None
    for rank, (kind, pattern, whole, inner) in enumerate(KINDS):
        hits = located(texts.where(F.col("text").rlike(HINTS[rank])), pattern).where(F.length("found") >= whole)
        if inner:
            hits = hits.where(F.length(F.regexp_extract("found", pattern, 2)) >= inner)
        hits = hits.select("text_key", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "start", "end")
        lexical = hits if lexical is None else lexical.unionByName(hits)
    token = located(texts.where(F.col("text").rlike(HINTS[3])), TOKEN).where(F.col("found").rlike("[0-9]") & F.col("found").rlike("[A-Za-z]"))
    # tokens that no lexical span touches: the furthest end among spans that begin before the token's end
    both = lexical.select("text_key", F.col("start").alias("at"), F.lit(1).alias("order"), "start", "end", F.lit(None).cast("string").alias("found"))
    both = both.unionByName(token.select("text_key", F.col("end").alias("at"), F.lit(0).alias("order"), "start", "end", "found"))
    before = Window.partitionBy("text_key").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    furthest = F.max(F.when(F.col("order") == 1, F.col("end"))).over(before)
    free = both.withColumn("furthest", furthest).where("order = 0 and coalesce(furthest, -1) <= start")
    pairs = free.select("text_key", "start", "end", F.explode(F.sequence(F.lit(1), F.length("found") - 1)).alias("i"), "found")
    pairs = pairs.select("text_key", "start", "end", F.substring("found", F.col("i"), F.lit(2)).alias("pair"))
    # the model has one row for each pair of the alphabet, whatever the corpus
    scored = pairs.join(F.broadcast(markov_ratios(sample)), "pair").groupBy("text_key", "start", "end").agg(F.avg("ratio").alias("ratio"))
    added = scored.where(F.col("ratio") >= LEAST_RATIO).select("text_key", F.lit("markov").alias("kind"), F.lit(len(KINDS)).alias("rank"), "start", "end")
    return lexical.unionByName(added)


def scan(docs: DataFrame) -> DataFrame:
    """docs with spans, an array of (start, rank, end, kind) in order of start and kind."""
    docs = without(docs, ["secret_spans"])
    key = fresh(docs, "secret_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    any_hint = F.lit(False)
    for hint in HINTS:
        any_hint = any_hint | F.col("text").rlike(hint)
    texts = keyed.where(any_hint).groupBy(F.col(key).alias("text_key")).agg(F.min("text").alias("text"))
    spans = spans_of(texts, docs.select("doc_id", "text"))
    found = spans.groupBy(F.col("text_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("secret_spans"))
    # the spans stand by for a join between two plain shuffles, so that a text of very many rows, also an empty one, can be split
    return keyed.join(checkpointed(found), key, "left").drop(key)
