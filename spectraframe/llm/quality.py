"""Quality by weak supervision, in DataFrame functions only.

Rules look at one document and vote good (1), bad (-1) or abstain (0): each has a range of values that speaks for neither,
and texts it has nothing to say about. How often each combination of votes occurs is all that estimation needs:
3 ** rules rows at most, whatever the corpus. Expectation-maximisation on those estimates how often each rule votes bad on
good and on bad documents (votes independent given the truth, abstaining uninformative) and the share of good ones; no
estimate is bounded. A document's posterior probability of being good decides, instead of all rules having to pass.

The rules on words that need a script or language vote only there: function words count against a text only if its
language is named (column `lang`) and is one of the four whose words are listed, and word lengths only in Latin script.

Defined cases: null text is empty; a text without words fails the base; an empty table keeps the starting rates;
rows that share a doc_id are rows of their own; a null or unknown language is none; other columns are carried along by
`filter_quality`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, UPPER, written

#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it on for was be with as at by this are from".split(),
    "de": "der die und in den das ist von zu mit des im ein eine nicht auf für sich dem als".split(),
    "fr": "de la le les et du est dans pour qui que au par sur un une en il des ce".split(),
    "es": "de la que el en los las y un una por con se le del su para es al lo".split(),
}
SYMBOLS = "#*$%&|<>"
#: Letters outside the Latin script.
FOREIGN = r"[\p{L}&&[^\p{IsLatin}]]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words are in a window of `window` words that the text has twice or more."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k"))))

        def places(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["k"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(_let(placed, places), start, lambda a, k: F.struct((a["n"] + F.least(F.lit(window), k - a["last"])).alias("n"), k.alias("last")), lambda a: a["n"])

    def in_text(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))
        return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(words, in_text))


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, lang_col: str | None = "lang") -> DataFrame:
    """docs' columns `keep` (default all) in a struct `doc`, and the base's and the rules' numbers. A language column that docs
    don't have names no language."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.lower(F.col(lang_col).cast("string")) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)]).alias("doc"), lang.alias("lang"), text.alias("text"), F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    lists = {lang: F.array(*map(F.lit, words)) for lang, words in FUNCTION_WORDS.items()}
    function = F.greatest(*[F.size(F.array_intersect("words", known)) for known in lists.values()])
    for lang, known in lists.items():
        function = F.when(F.col("lang") == lang, F.size(F.array_intersect("words", known))).otherwise(function)
    rows = rows.select("doc", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _count(F.col("text"), SYMBOLS).alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.size("lines").alias("n_lines"),
                       _count(F.col("text"), UPPER).alias("n_upper"), _count(F.col("text"), "!").alias("n_exclaim"), F.size(F.array_distinct("words")).alias("n_distinct"), function.alias("n_function"),
                       F.col("lang").isin(*FUNCTION_WORDS).alias("listed"), F.regexp_count("text", F.lit(FOREIGN)).alias("n_foreign"), F.size(F.filter("lines", lambda x: x.rlike(f'[.!?"…。！？।؟][{SPACE_CLASS}]*$'))).alias("n_ended"))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rules() -> dict[str, Column]:
    """Each rule's vote: bad, good, else abstain; the first that applies."""
    n, chars, lines = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    some, long = n >= 10, n >= 30
    latin = 10 * F.col("n_foreign") <= chars
    return {
        "symbols": vote(F.col("n_symbols") > 0.05 * chars, some & (F.col("n_symbols") <= 0.01 * chars)),
        "capitals": vote(some & (F.col("n_upper") > 0.3 * chars), long & (F.col("n_upper") <= 0.1 * chars)),
        "exclamations": vote(F.col("n_exclaim") > 0.02 * chars, long & (F.col("n_exclaim") <= 0.002 * chars)),
        "duplicate_lines": vote(F.col("n_dup_lines") > 0.3 * lines, (lines >= 4) & (F.col("n_dup_lines") == 0)),
        "variety": vote(long & (F.col("n_distinct") < 0.4 * n), long & (F.col("n_distinct") >= 0.6 * n)),
        "function_words": vote(F.coalesce("listed", F.lit(False)) & latin & (n >= 50) & (F.col("n_function") < 3), long & (F.col("n_function") >= 6)),
        "sentence_ends": vote((lines >= 2) & (F.col("n_ended") < 0.5 * lines), some & (F.col("n_ended") == lines)),
        "word_length": vote(some & latin & ((chars > 8 * n) | (chars < 3 * n)), long & latin & (chars <= 6.5 * n) & (chars >= 4 * n)),
    }


#: How often a rule that votes votes bad on good and on bad documents, and the share of good ones, before any data. The rates
#: stand beside the data as START_WEIGHT documents of each kind, so no estimate becomes 0 or 1.
START, START_GOOD = (0.05, 0.5), 0.7
START_WEIGHT = 4

Rates = list[tuple[float, float]]


def _odds(votes: np.ndarray, good: float, rates: np.ndarray) -> np.ndarray:
    """The log-odds of good of each row of votes."""
    return np.log(good / (1 - good)) + (votes < 0) @ np.log(rates[:, 0] / rates[:, 1]) + (votes > 0) @ np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, steps: int = 500) -> tuple[float, Rates]:
    """The share of good documents, and each rule's rate of bad votes on good and on bad ones, from the counts of vote
    patterns."""
    votes = np.array([v for v, _ in patterns], int).reshape(-1, n_rules)
    n = np.array([k for _, k in patterns], float)
    good, rates = START_GOOD, np.array([START] * n_rules)
    for _ in range(steps if n.sum() else 0):
        p = n / (1 + np.exp(-np.clip(_odds(votes, good, rates), -700, 700)))
        kinds = np.stack([p, n - p])
        bad = kinds @ (votes < 0) + START_WEIGHT * np.array(START)[:, None]
        now = (bad / (kinds @ (votes != 0) + START_WEIGHT)).T
        moved = np.abs(now - rates).max()
        rates, good = now, (p.sum() + 1) / (n.sum() + 2)
        if moved < 1e-10:
            break
    return float(good), [(float(g), float(b)) for g, b in rates]


def posterior(votes: tuple[int, ...], good: float, rates: Rates) -> float:
    return float(1 / (1 + np.exp(-np.clip(_odds(np.array([votes]), good, np.array(rates)), -700, 700)))[0])


def judged(rows: DataFrame) -> DataFrame:
    """Rows of `features`, with `quality` (the posterior probability) and `kept`. They are written once with their votes and
    what they carry, and read twice: the counts of votes, then the verdicts. Nothing is shuffled but those counts."""
    votes = rules()
    rows = written(rows.withColumns({f"vote_{name}": vote for name, vote in votes.items()}))
    names = [f"vote_{name}" for name in votes]
    found = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** rules rows at most
    good, rates = estimate(sorted((tuple(r[:-1]), r[-1]) for r in found), len(names))
    total = F.lit(float(np.log(good / (1 - good))))
    for name, (g, b) in zip(names, rates, strict=True):
        total = total + F.when(F.col(name) < 0, float(np.log(g / b))).when(F.col(name) > 0, float(np.log((1 - g) / (1 - b)))).otherwise(0.0)
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-total)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that the rules keep. Each row is written once with its votes, so its verdict needs no join."""
    return judged(features(docs, text_col, lang_col=lang_col)).where("kept").select("doc.*")
