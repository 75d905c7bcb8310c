"""Quality rules as weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). Nothing says which rules are right: expectation
maximisation over the votes of all documents estimates each rule's accuracy and the share of good documents, and the
posterior probability of being good decides, instead of "every rule must pass".

The work on texts is one Arrow stage. EM needs only the number of documents per combination of votes, of which there
are at most 3 ** len(RULES) however many documents there are; those counts are what the driver gets.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import ASCII_SPACE, in_arrow, stored

SYMBOLS = "#*$%&|<>"
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_end_lines long, "
    "n_alpha_words long, n_top_word long, n_upper long"
)
NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def text_features(text: str | None) -> tuple[int, ...]:
    """The columns of FEATURES for one text; null counts as no words.

    n_lines are lines with a word, n_end_lines those that end a sentence, n_alpha_words words with a letter,
    n_top_word the count of the most frequent word, n_upper the capital ASCII letters.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    seen: set[str] = set()
    lines = dups = ends = 0
    for line in text.split("\n"):
        if bare := line.strip(ASCII_SPACE):
            lines += 1
            ends += bare[-1] in ".!?:;\"'”»…"
            dups += line in seen
            seen.add(line)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            end = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    top = Counter(words).most_common(1)[0][1] if n else 0
    alpha = sum(w.isalpha() or any(b > 64 for b in w) for w in words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, sum(text.count(c) for c in SYMBOLS), dups, repeats, lines, ends, alpha, top, upper


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES, one row per row of ``docs``."""

    def of(batch: pa.RecordBatch) -> dict:
        rows = [text_features(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id")} | {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(NAMES)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), of, f"doc_id {kind}, {FEATURES}")


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are SQL conditions over FEATURES; where neither holds the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words between 60 and 100000", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2.5 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "20 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("marked_words", "50 * n_symbols < n_words", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 2 and 20 * n_dup_lines <= n_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("letters", "10 * n_alpha_words >= 9 * n_words", "10 * n_alpha_words < 7 * n_words"),
    Rule("sentences", "2 * n_end_lines >= n_lines", "n_lines >= 4 and 10 * n_end_lines < n_lines"),
    Rule("one_word", "n_words >= 50 and 100 * n_top_word <= 12 * n_words", "n_words >= 50 and 100 * n_top_word > 20 * n_words"),
    Rule("capitals", "20 * n_upper <= 3 * word_chars", "10 * n_upper > 3 * word_chars"),
)


def vote(rule: Rule) -> Column:
    return F.when(F.expr(f"n_words = 0 or ({rule.bad})"), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass(frozen=True)
class VoteModel:
    """prior: log odds of a good document; for[i] and against[i]: log odds that a vote of rule i adds."""

    prior: float
    for_good: tuple[float, ...]
    for_bad: tuple[float, ...]

    def log_odds(self, votes: list[int]) -> float:
        return self.prior + sum(g if v > 0 else b if v < 0 else 0.0 for v, g, b in zip(votes, self.for_good, self.for_bad, strict=True))


def fit_votes(patterns: list[tuple[list[int], int]], n_rules: int, rounds: int = 50) -> VoteModel:
    """EM for two classes and rules that are independent given the class; abstentions say nothing.

    Posteriors start from the share of good votes. A rule's rates are smoothed by one vote each way, and a vote never
    counts against its own direction, which keeps the classes from changing places. No documents give a model in which
    every document is as likely good as bad.
    """
    posterior = [(1 + sum(v > 0 for v in votes)) / (2 + sum(v != 0 for v in votes)) for votes, _ in patterns]
    model = VoteModel(0.0, (0.0,) * n_rules, (0.0,) * n_rules)
    for _ in range(rounds if patterns else 0):
        good = sum(p * n for p, (_, n) in zip(posterior, patterns, strict=True))
        bad = sum(n for _, n in patterns) - good
        up, down = [], []
        for i in range(n_rules):
            count = {(c, v): 1.0 for c in "gb" for v in (1, -1)}
            for p, (votes, n) in zip(posterior, patterns, strict=True):
                if votes[i]:
                    count["g", votes[i]] += p * n
                    count["b", votes[i]] += (1 - p) * n
            rate_g = count["g", 1] / (count["g", 1] + count["g", -1])
            rate_b = count["b", 1] / (count["b", 1] + count["b", -1])
            up.append(max(0.0, math.log(rate_g / rate_b)))
            down.append(min(0.0, math.log((1 - rate_g) / (1 - rate_b))))
        model = VoteModel(math.log((good + 1) / (bad + 1)), tuple(up), tuple(down))
        posterior = [1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes))))) for votes, _ in patterns]
    return model


def fit(feats: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """Counts of vote combinations over all rows (at most 3 ** rules of them reach the driver), then EM there."""
    votes = feats.select(F.array(*[vote(r) for r in rules]).alias("votes")).groupBy("votes").count()
    return fit_votes(sorted((list(r["votes"]), r["count"]) for r in votes.collect()), len(rules))


def log_odds(model: VoteModel, rules: tuple[Rule, ...] = RULES) -> Column:
    terms = [F.when(v > 0, F.lit(g)).when(v < 0, F.lit(b)).otherwise(F.lit(0.0)) for v, g, b in zip(map(vote, rules), model.for_good, model.for_bad, strict=True)]
    return sum(terms, F.lit(model.prior))


def verdict(model: VoteModel, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> dict[str, Column]:
    """base_failed, quality (the posterior) and kept as columns over FEATURES."""
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    quality = 1 / (1 + F.exp(-log_odds(model, rules)))
    return {"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= least)}


def quality_scores(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, FEATURES, base_failed, quality, kept.

    A null or empty text has no words: it fails the base and is not kept. Repeated rows are judged alike and count as
    often as they stand in the table. Null ids stay; other columns are ignored; an empty table gives no rows.
    """
    feats = stored(features(docs), "quality-features")
    return feats.withColumns(verdict(fit(feats, rules), rules, least))


def good_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_scores` keeps, with all their columns.

    Null, empty and blank texts have no words and go; repeated rows stay or go together; null ids are no reason to go.

    The model is fitted on all rows first; rows are then judged where they stand, so texts are neither shuffled nor
    written twice.
    """
    model = fit(stored(features(docs), "quality-features"), rules)

    def judged(batches):
        for batch in batches:
            rows = [text_features(t) for t in batch.column("text").to_pylist()]
            added = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *NAMES])

    names = docs.columns
    inside = docs.toDF(*[f"c{i}" if c != "text" else "text" for i, c in enumerate(names)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema), FEATURES])
    kept = inside.mapInArrow(judged, schema).filter(verdict(model, rules, least)["kept"])
    return kept.select(*inside.columns).toDF(*names)
