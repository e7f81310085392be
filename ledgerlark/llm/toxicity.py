"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the classes of a clause's tokens: insult, threat, target, negation and reported speech. Their
product is built once and run over every clause that holds a term. Insult terms and their weights are learned from labelled
rows; a clause scores its weighted terms, less where negated or reported, more where a person is addressed. A logistic
regression over the clause scores of a document gives its probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, whole

# Closed word classes of the grammar in the four languages of the corpus.
TARGET = set("you your yours he she they them him her dich dir du ihr euch sie tu toi te vous ils elles lui usted ustedes tú ti ellos ellas".split())
THREAT = set("kill hurt destroy beat stab shoot burn murder töten umbringen verletzen schlagen tuer frapper détruire brûler matar herir destruir golpear".split())
NEGATION = set("not no never neither nor isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca ningún jamás".split())
REPORT = set("said says wrote writes called calls quoted claimed reported sagte schrieb nannte behauptete dit écrit appelé affirmé dijo escribió llamó afirmó".split())

INSULT, HURT, WHO, NOT, SAID, OTHER = range(6)
SCOPE = 3  # tokens that a negation reaches
NEGATED, REPORTED, ADDRESSED, THREATENED = 0.25, 0.5, 0.25, 1.0

MAX_LABELLED = 20_000  # labelled rows that a model is fitted on, at most; drawn by a digest of the id
MAX_TERMS = 400
STEMS = (4, 5, 6, 7, 8)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[^.!?;:\n]+")
FEATURES = ["best", "total", "clauses", "threats"]


def _machines() -> list[tuple[object, list, object]]:
    """(start, states, step) of each transducer; step(state, class) gives the next state."""
    insult = (0, [0, 1], lambda s, c: 1 if c == INSULT else s)
    threat = (0, [0, 1], lambda s, c: 1 if c == HURT else s)
    target = (0, [0, 1], lambda s, c: 1 if c == WHO else s)
    negation = (0, list(range(SCOPE + 1)), lambda s, c: SCOPE if c == NOT else max(0, s - 1))
    report = (0, [0, 1], lambda s, c: 1 if c == SAID else s)
    return [insult, threat, target, negation, report]


def compose() -> tuple[tuple, dict, dict]:
    """Start state, transitions (state, class) -> (state, factor of a weighted token), and final factors by state.

    The product of the transducers; the factor of an insult or threat token depends on the negation and report states.
    """
    machines = _machines()
    steps, final = {}, {}
    for state in product(*[m[1] for m in machines]):
        for c in range(6):
            after = tuple(m[2](s, c) for m, s in zip(machines, state, strict=True))
            factor = (NEGATED if state[3] > 0 else 1.0) * (REPORTED if state[4] else 1.0)
            steps[state, c] = (after, factor if c in (INSULT, HURT) else 0.0)
        final[state] = 1.0 + (ADDRESSED if state[2] and (state[0] or state[1]) else 0.0)
    return tuple(m[0] for m in machines), steps, final


START, STEPS, FINAL = compose()


@dataclass
class Model:
    """Learned terms (whole words, or stems ending in ``*``) with weights, and the regression over clause features."""

    terms: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    intercept: float = -6.0

    def weight(self, word: str) -> float:
        found = self.terms.get(word)
        if found is not None:
            return found
        return max((self.terms.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n), default=0.0)


def _automaton(model: Model):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term in {*(t.rstrip("*") for t in model.terms), *THREAT}:
        machine.add_word(term, len(term))
    machine.make_automaton()
    return machine


def score_clause(words: list[str], model: Model) -> tuple[float, float]:
    """Weight of the insults and of the threats that the product of the transducers finds in a clause."""
    state, insult, threat = START, 0.0, 0.0
    for word in words:
        weight = model.weight(word)
        c = INSULT if weight > 0 else HURT if word in THREAT else WHO if word in TARGET else NOT if word in NEGATION else SAID if word in REPORT else OTHER
        state, factor = STEPS[state, c]
        if c == INSULT:
            insult += weight * factor
        elif c == HURT:
            threat += THREATENED * factor
    # a threat needs a target
    return insult * FINAL[state], threat * FINAL[state] if state[2] else 0.0


def features(text: str, model: Model, machine) -> list[float]:
    """Best and total clause weight, number of matched clauses, weight of threats. Clauses without a term are not parsed."""
    low = text.lower()
    starts = []
    for end, length in machine.iter(low):
        at = end - length + 1
        if at == 0 or not low[at - 1].isalpha():
            starts.append(at)
    if not starts:
        return [0.0] * len(FEATURES)
    starts.sort()
    best = total = threats = 0.0
    clauses, i = 0, 0
    for clause in _CLAUSE.finditer(low):
        if i == len(starts):
            break
        if starts[i] >= clause.end():
            continue
        while i < len(starts) and starts[i] < clause.end():
            i += 1
        insult, threat = score_clause(_TOKEN.findall(clause.group()), model)
        best, total, threats = max(best, insult), total + insult, threats + threat
        clauses += insult + threat > 0
    return [best, math.log1p(total), math.log1p(clauses), math.log1p(threats)]


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label that have a word or stem, counted per batch."""
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(_TOKEN.findall((text or "").lower()))
            seen[int(toxic)].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        terms = set(seen[0]) | set(seen[1])
        yield pd.DataFrame([(t, seen[1][t], seen[0][t]) for t in terms], columns=["term", "bad", "good"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents outside the held-out fold, by a digest of the id."""
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = ids.filter(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most ``most`` rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_terms: int = MAX_TERMS) -> Model:
    """Learns terms by log-odds of document counts, then a logistic regression over the clause features of the same rows.

    Without labelled rows of both classes the model has no terms and scores every text near 0.
    """
    rows = training_rows(docs, labels, most).persist()
    try:
        size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        bad, good = size.get(1, 0), size.get(0, 0)
        if not bad or not good:
            return Model()
        counts = rows.mapInPandas(_term_counts, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        counts = counts.persist()
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        # of as many terms as there are, about one in ten such tables has one that gets so far from even odds by chance
        n, rate = F.col("bad") + F.col("good"), bad / (bad + good)
        part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
        chance = math.log(10 * max(1, counts.count()))
        strong = counts.withColumn("odds", odds).filter((F.col("odds") > 2) & (part(F.col("bad"), rate) + part(F.col("good"), 1 - rate) > chance))
        found = strong.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(most_terms).collect()
        counts.unpersist()
        model = Model({r["term"]: float(r["odds"]) for r in found})

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = _automaton(model)
            for batch in batches:
                out = pd.DataFrame([features(t, model, machine) for t in batch["text"]], columns=FEATURES)
                yield out.assign(toxic=batch["toxic"].to_numpy())

        table = rows.mapInPandas(measured, ", ".join(f"{c} double" for c in FEATURES) + ", toxic int").groupBy(*FEATURES, "toxic").count().toPandas()
    finally:
        rows.unpersist()
    model.coefficients, model.intercept = _regress(table[FEATURES].to_numpy(), table["toxic"].to_numpy(), table["count"].to_numpy())
    return model


def _regress(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps; at most ``MAX_LABELLED`` rows of four numbers."""
    order = np.lexsort((*x.T, y))
    x, y, n = np.column_stack([x, np.ones(len(x))])[order], y[order], n[order]
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta[:-1]], float(beta[-1])


def scorer(model: Model):
    """A column function: text to probability. Null and empty texts get the score of a text without terms."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        machine = _automaton(model)
        x = np.array([features(t, model, machine) for t in texts.fillna("")]).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(model.coefficients) + model.intercept, -30, 30))))

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with its score: doc_id, held_out, score, predicted. Null ids count as not held out; rows are independent."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(whole()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    got = free_name(docs, "_score")
    return docs.withColumn(got, scorer(model)(whole())).filter(F.col(got) < 0.5).drop(got)
