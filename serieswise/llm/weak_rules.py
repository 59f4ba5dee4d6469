"""Document quality by weak supervision: rules vote keep, junk or abstain, EM weighs them.

Every rule votes on counts that a document's text gives. Expectation-maximisation over the
table of vote patterns estimates how often each rule votes each way on good documents and on
each kind of junk; the posterior probability of being good replaces all-must-pass filtering.
(With one class for all junk the largest kind takes it, and the rules that tell another kind
count as noise.)
Everything is built-in SQL functions. The EM runs on one row that holds the vote patterns, at
most 3 ** 10 of them however many documents there are.

Null and empty texts have no words: every count is 0 and the base rule fails. Ties do not
occur (a posterior of exactly 0.5 keeps). Repeated rows are judged alike, each on its own. An
empty table gives an empty result. Columns of the input that carry the name of a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise.llm.common import sheltered, stage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STEPS = 30
#: Pseudo-votes per rule and vote value, so that no probability is 0.
PRIOR = 0.5
#: More junk pseudo-votes for the rules of a kind of junk.
OWN = 2.0
#: Probability that a pattern without a junk vote is junk, or one with a junk vote good, at the start.
START = 0.02

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_marked", "n_capitals", "n_marks", "n_stops", "n_distinct"]

#: (name, junk if, keep if) on the measures; otherwise the rule abstains.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_share", "20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("marked_words", "10 * n_marked > n_words", "50 * n_marked <= n_words"),
    ("word_length", "2 * word_chars < 5 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "n_repeat_words = 0"),
    ("lines", "2 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    ("capitals", "5 * n_capitals > word_chars", "20 * n_capitals <= word_chars"),
    ("marks", "10 * n_marks > n_words", "50 * n_marks <= n_words"),
    ("variety", "7 * n_distinct < n_words", "3 * n_distinct >= n_words"),
    ("stops", "n_words >= 50 and 200 * n_stops < n_words", "60 * n_stops >= n_words"),
]

#: Junk comes in kinds, which seldom occur together: (name, places of the rules that tell it).
KINDS = [("symbols", (0, 1, 2)), ("repetition", (4, 5, 8, 9)), ("shouting", (6, 7))]


def _count(text: Column, chars: str) -> Column:
    """Occurrences of the characters; replace() is far cheaper than translate() where they are rare."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def _let(value: Column, body) -> Column:
    """Bind a value once; a plain reference in a lambda would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, by sorting (hash, position)."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

    places = F.array_sort(F.transform(_let(pairs, repeated), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step)["n"].cast("long")


def with_measures(docs: DataFrame) -> DataFrame:
    """The documents with the counts of their whole texts."""
    return sheltered(docs, ("text",), (*MEASURES, *EXTRA, "base_failed"), _measured)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.columns
    split = docs.select(
        *own,
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        _count(text, SYMBOLS).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>](?![^\x20\x09-\x0D])")).cast("long").alias("n_marked"),
        _count(text, "!").alias("n_marks"),
        _count(text, ".?").alias("n_stops"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}{2,}", ""))).cast("long").alias("n_capitals"),
    )
    n = F.size("_words")
    counted = split.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_marked",
        "n_capitals",
        "n_marks",
        "n_stops",
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ).alias("_hashes"),
    )
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    measured = counted.select(
        *own, *MEASURES[:4], F.when(again, _covered(F.col("_hashes"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"), *EXTRA
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def votes() -> Column:
    """One vote a rule: -1 junk, 1 keep, 0 abstain."""
    return F.array(*[F.expr(f"CASE WHEN {junk} THEN -1 WHEN {keep} THEN 1 ELSE 0 END") for _, junk, keep in RULES])


def _lookup(rows: list[list[float]]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in r) + ")" for r in rows) + ")"


def _start() -> str:
    """Class probabilities of a pattern before the first step: the kinds of its junk votes share most of it."""
    hit = [f"exists(array({', '.join(map(str, rules))}), j -> votes[j] = -1)" for _, rules in KINDS]
    found = " + ".join(f"int({h})" for h in hit)
    return (
        f"array(if({found} = 0, {1 - START}D, {START}D), "
        + ", ".join(f"if({found} = 0, {START / len(KINDS)}D, {1 - START}D * int({h}) / greatest({found}, 1))" for h in hit) + ")"
    )


def estimate(patterns: DataFrame) -> DataFrame:
    """Class probabilities of each vote pattern (votes, n): good first, then the kinds of junk."""
    k, r = len(KINDS) + 1, len(RULES)
    extra = _lookup([[0.0] * r] + [[OWN if j in rules else 0.0 for j in range(r)] for _, rules in KINDS])
    mass = "aggregate(s, 0D, (a, p) -> a + p.n * p.q[c])"
    hits = "aggregate(s, 0D, (a, p) -> a + if(p.votes[j] = v, p.n * p.q[c], 0D))"
    own = f"{extra}[c][j]"
    theta = (
        f"transform(sequence(0, {r - 1}), j -> transform(array(-1, 0, 1), v -> "
        f"ln(({hits} + {PRIOR}D + if(v = -1, {own}, 0D)) / ({mass} + {3 * PRIOR}D + {own}))))"
    )
    classes = f"transform(sequence(0, {k - 1}), c -> named_struct('t', {theta}, 'o', ln({mass} + {PRIOR}D)))"
    log = f"transform(m, x -> x.o + aggregate(sequence(0, {r - 1}), 0D, (a, j) -> a + x.t[j][p.votes[j] + 1]))"
    soft = f"get(transform(array({log}), g -> transform(g, x -> 1D / aggregate(g, 0D, (a, y) -> a + exp(y - x)))), 0)"
    one = f"transform(s, p -> named_struct('votes', p.votes, 'n', p.n, 'q', {soft}))"
    step = f"get(transform(array({classes}), m -> {one}), 0)"
    state = patterns.agg(
        F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"), F.expr(_start()).alias("q")))).alias("s0")
    )
    return (
        state.select(F.explode(F.expr(f"aggregate(sequence(1, {STEPS}), s0, (s, i) -> {step})")).alias("p"))
        .select(F.col("p.votes").alias("_pattern"), F.col("p.q").alias("_q"))
    )


def quality_rules(measured: DataFrame) -> DataFrame:
    """Measured documents with `posterior` (probability of being good) and `kept`.

    The measures are written once to the shared folder: the EM and the result read them from
    there. The joined table has a row per vote pattern, a bound that no input passes.
    """
    return sheltered(measured, (*MEASURES, *EXTRA, "base_failed"), ("posterior", "kept"), _judged)


def _judged(measured: DataFrame) -> DataFrame:
    staged = stage(measured.withColumn("_votes", votes()), "quality-rules")
    patterns = staged.groupBy(F.col("_votes").alias("votes")).agg(F.count("*").alias("n"))
    judged = staged.join(F.broadcast(estimate(patterns)), F.col("_votes") == F.col("_pattern"), "left")
    good = F.col("_q")[0]
    return judged.select(*measured.columns, good.alias("posterior"), (~F.col("base_failed") & (good >= 0.5)).alias("kept"))
