"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults (learned from labels), threats, targets, negations, reporting
verbs.  Four small transducers read the symbols of a clause one after the other, each
rewriting what the one before wrote: negation turns the insults and threats in its reach into
negated ones, reported speech marks what is quoted, a target makes them directed, and the last
one weighs them.  They are composed into one table, so a clause is read once.  A document's
score comes from its worst clause and from all clauses together, calibrated on the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, slices, stage

# fixed values: closed word classes in the four languages of the corpus
THREATS = "kill hurt destroy beat strangle töte töten umbringen schlage verprügeln tuer tuerai frapper détruire matar mataré golpear destruir".split()
TARGETS = "you your yours yourself he she they them du dich dein deine ihr euch sie tu toi ton vous votre ils elles tú usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not never neither nor without nicht kein keine keinen nie niemals ohne pas jamais aucun sans nunca jamás ningún sin tampoco".split()
REPORTS = "said says saying wrote claimed called quoted sagte sagt schrieb behauptete nannte dit disait écrit affirmait appelle dijo dice escribió afirmó llamó".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "IHTNRW"
WEIGHTS = {"I": 1.0, "J": 1.5, "H": 0.5, "K": 2.0, "i": 0.3, "j": 0.4, "h": 0.0, "k": 0.2, "r": 0.3, "s": 0.2}
REACH = 3  # words after a negation that it covers
PREFIXES = (3, 4, 5, 6, 7, 8)
MIN_ODDS = 3.5
MIN_ERRORS = 3.0
STRONG = 0.8  # of the greatest log odds found
EXPLAINS = 2  # texts that a weaker entry must explain alone

Rules = dict[tuple[str, str], tuple[str, str]]


def negation() -> Rules:
    """State: how many words the last negation still covers."""
    rules: Rules = {}
    for left in range(REACH + 1):
        after = str(max(0, left - 1))
        for symbol in "IHTRW":
            rules[str(left), symbol] = (after, symbol.lower() if left and symbol in "IH" else symbol)
        rules[str(left), "N"] = (str(REACH), "N")
    return rules


def reported() -> Rules:
    """State: whether a reporting verb came before in the clause."""
    rules: Rules = {}
    for symbol in "IHihTNW":
        rules["plain", symbol] = ("plain", symbol)
        rules["told", symbol] = ("told", {"I": "r", "i": "r", "H": "s", "h": "s"}.get(symbol, symbol))
    for state in ("plain", "told"):
        rules[state, "R"] = ("told", "R")
    return rules


def directed() -> Rules:
    """State: whether the clause has named a target."""
    rules: Rules = {}
    for symbol in "IHihrsNRW":
        rules["none", symbol] = ("none", symbol)
        rules["named", symbol] = ("named", {"I": "J", "i": "j", "H": "K", "h": "k"}.get(symbol, symbol))
    for state in ("none", "named"):
        rules[state, "T"] = ("named", "T")
    return rules


def compose(first: Rules, second: Rules) -> Rules:
    """The transducer that feeds what ``first`` writes to ``second``."""
    out: Rules = {}
    for (a, symbol), (a_next, middle) in first.items():
        for b in {state for state, _ in second}:
            if (b, middle) in second:
                b_next, written = second[b, middle]
                out[f"{a}/{b}", symbol] = (f"{a_next}/{b_next}", written)
    return out


START = "0/plain/none"


def grammar() -> dict[tuple[str, str], tuple[str, float]]:
    """All transducers as one, the last of which weighs each symbol."""
    whole = compose(compose(negation(), reported()), directed())
    return {key: (state, WEIGHTS.get(symbol, 0.0)) for key, (state, symbol) in whole.items()}


@dataclass
class Model:
    """Learned insults with their weights (log odds), and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    worst: float = 0.0
    total: float = 0.0


class Reader:
    """Scores clauses of whole texts."""

    def __init__(self, model: Model):
        import regex

        self.model = model
        self.rules = grammar()
        self.classes = {w: THREAT for w in THREATS} | {w: TARGET for w in TARGETS}
        self.classes |= {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
        letter = r"[^\W\d_]"
        alone = [*map(regex.escape, [*model.words, *THREATS])]
        starts = [regex.escape(p) + letter + "*" for p in model.prefixes]
        self.any = regex.compile(rf"(?<!{letter})(?:{'|'.join([*alone, *starts])})(?!{letter})").search
        self.tokens = regex.compile(rf"{letter}+(?:['’]{letter}+)*|[.!?;:\n]").findall

    def insult(self, word: str) -> float:
        found = self.model.words.get(word, 0.0)
        for size in PREFIXES:
            found = max(found, self.model.prefixes.get(word[:size], 0.0))
        return found

    def clauses(self, text: str) -> tuple[float, float]:
        """(weight of the heaviest clause, weight of all clauses) of a text."""
        low = text.lower()
        if not self.any(low):
            return 0.0, 0.0
        worst = total = here = 0.0
        state = START
        for token in self.tokens(low):
            if token in ".!?;:\n":
                worst, total, here, state = max(worst, here), total + here, 0.0, START
                continue
            weight = self.insult(token)
            symbol = INSULT if weight else self.classes.get(token, NEGATION if token.endswith(("n't", "n’t")) else OTHER)
            state, factor = self.rules[state, symbol]
            here += factor * (weight or 1.0)
        return max(worst, here), total + here


def _measured(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(*keep, worst, total) of every row's ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in slices(batches, "text"):
            worst, total = zip(*[reader.clauses(t or "") for t in batch.column(0).to_pylist()])
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(worst), pa.array(total)], names=[*keep, "worst", "total"])

    passed = ", ".join(f"{k} {field_type(rows, k)}" for k in keep)
    return rows.select("text", *keep).mapInArrow(run, f"{passed}, worst double, total double")


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` documents per label, those with the least hashes of their id."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = stage(known, "toxicity-labels")
    hashed = known.withColumn("hash", F.xxhash64("doc_id"))
    # a first cut by hash, at about twice the wanted share, keeps the ranking below small
    few = None
    for r in known.groupBy("label").count().toLocalIterator():
        share = min(1.0, (2.0 * rows + 100) / r["count"])
        part = hashed.where((F.col("label") == r["label"]) & (F.col("hash") <= min(2**63 - 1, int(share * 2**64) - 2**63)))
        few = part if few is None else few.unionByName(part)
    if few is None:
        return known
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash", "doc_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= rows).drop("rank", "hash")


def _features(text: str) -> Column:
    """A text's distinct words, ended by a space, and the starts of its longer words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0)))
    forms = F.transform(
        words,
        lambda w: F.concat(
            F.array(F.concat(w, F.lit(" "))),
            F.filter(F.array(*[F.substring(w, 1, n) for n in PREFIXES]), lambda p: F.length(p) < F.length(w)),
        ),
    )
    return F.array_distinct(F.flatten(forms))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = 3000,
    max_entries: int = 500,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """A model from at most ``rows`` labelled documents of each label.

    Entries are words, and starts of words, that toxic texts hold far more often than others:
    log odds of at least ``MIN_ODDS``, more than ``MIN_ERRORS`` standard errors from 0, in at least three
    texts and one in a hundred toxic ones.  Of nested entries the one that says most stays; weak
    ones, which may only keep company with insults, must explain texts that no other entry does.  NULL labels teach
    nothing, an id with several labels counts as toxic, and without both labels there is no
    entry: every score is then the share of toxic labels.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = stage(_sample(known, rows), "toxicity-sample")
    shares = {r["label"]: r["count"] for r in known.where("label is not null").groupBy("label").count().toLocalIterator()}
    base = shares.get(1, 0) / max(1, sum(shares.values()))
    prior = math.log(min(max(base, 1e-4), 1 - 1e-4) / (1 - min(max(base, 1e-4), 1 - 1e-4)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # at most 2 * rows ids, so the sample is shipped to the scan
    taught = stage(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("label").alias("label")), "toxicity-texts")
    sizes = {r["label"]: r["count"] for r in taught.groupBy("label").count().toLocalIterator()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(bias=prior)
    counts = taught.select("label", F.explode(_features("text")).alias("entry")).groupBy("entry").agg(
        F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")
    )
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("zeros") + 0.5) / (n0 + 1.0))
    error = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    strong = (
        counts.where(F.col("ones") >= max(3, math.ceil(n1 / 100)))
        .withColumn("odds", odds)
        .where((F.col("odds") >= MIN_ODDS) & (F.col("odds") > MIN_ERRORS * error))
        .orderBy(F.desc(F.col("ones") * F.col("odds")), F.desc(F.length("entry")), "entry")
        .limit(4 * max_entries)
    )
    strong = stage(strong, "toxicity-entries")
    # at most 4 * max_entries entries, each with the toxic texts of the sample that hold it
    held = (
        taught.where("label = 1")
        .select(F.xxhash64("text").alias("id"), F.explode(_features("text")).alias("entry"))
        .join(F.broadcast(strong), "entry")
        .groupBy("entry", "odds", "ones", "zeros")
        .agg(F.collect_set("id").alias("ids"))
    )
    entries = sorted(held.collect(), key=lambda r: (-r["ones"] * r["odds"], -len(r["entry"]), r["entry"]))
    model = Model(bias=prior)
    _choose(model, entries, EXPLAINS, max_entries)
    if model.words or model.prefixes:
        measured = _measured(taught, model, ["label"]).toPandas()  # at most 2 * rows rows of three numbers
        _calibrate(model, measured["worst"].to_numpy(), measured["total"].to_numpy(), measured["label"].to_numpy(), base)
    return model


def _choose(model: Model, entries: list, least: int, most: int) -> None:
    """Fill the lexicon: strong entries, then those that explain ``least`` texts which no entry so far does.

    Of the weaker ones, a start of words must not occur in any text that is not toxic.
    """
    limit = STRONG * max((r["odds"] for r in entries), default=0.0)
    explained: set[int] = set()
    for row in [r for r in entries if r["odds"] >= limit] + [r for r in entries if r["odds"] < limit]:
        entry, ids = row["entry"], set(row["ids"])
        word = entry.rstrip(" ")
        weak = row["odds"] < limit and (len(ids - explained) < least or entry == word and row["zeros"])
        if weak or len(model.words) + len(model.prefixes) >= most:
            continue
        nested = any(word.startswith(p) for p in model.prefixes)
        around = entry == word and any(o.startswith(word) for o in [*model.words, *model.prefixes])
        if not nested and not around:
            (model.prefixes if entry == word else model.words)[word] = min(row["odds"], 8.0)
            explained |= ids


def _calibrate(model: Model, worst: np.ndarray, total: np.ndarray, label: np.ndarray, base: float) -> None:
    """Ridge logistic regression by Newton steps, each label weighted by its share in all labels."""
    x = np.column_stack([np.ones(len(worst)), worst, np.log1p(total)])
    base = min(max(base, 1e-4), 1 - 1e-4)
    weight = np.where(label == 1, base / max(1, (label == 1).sum()), (1 - base) / max(1, (label == 0).sum())) * len(label)
    ridge = np.diag([1e-3, 0.1, 0.1])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    model.bias, model.worst, model.total = map(float, beta)


def score(
    docs: DataFrame,
    model: Model,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, *keep, worst, total, score, predicted) of every whole text.

    NULL and empty texts hold no clause and get the score of one without a match.  Repeated
    rows and NULL ids are rows like others; columns outside ``keep`` are not read.
    """
    keep = keep or {}
    chosen = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in keep.items()])
    z = F.lit(model.bias) + F.lit(model.worst) * F.col("worst") + F.lit(model.total) * F.log1p("total")
    measured = _measured(chosen, model, ["doc_id", *keep]).withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
    return measured.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
