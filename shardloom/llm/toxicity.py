"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (a seed list, and words and beginnings of words learned from labelled texts), how near
its hits stand to second-person words, capitals, punctuation, and obfuscation (words with digits or signs inside, and
lexicon hits that show only once these are undone). The trees see labelled texts through lexicons that were learned
without them, so that a hit means the same for learned and for new texts; new texts get the lexicon of the whole sample.
The calibration is a rising function fitted to scores of trees that did not see the rows.

Features come from the whole text alone. Null and empty texts have the same features and get a score like any other;
without usable labels every score is the smoothed share of ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.batches import map_batches
from shardloom.llm.boosting import Isotonic, Trees, log_odds, sigmoid
from shardloom.llm.labelled import collect_features, labelled_texts, score_texts
from shardloom.session import materialize

THRESHOLD = 0.5
# Terms of the learned lexicon at most, texts a term must occur in, and its least log odds.
LEXICON_TERMS = 5_000
LEAST_TEXTS = 3
LEAST_ODDS = 2.5
FOLDS = 3
# Words between a hit and a second-person word that count as near.
NEAR = 5

# Common insults as a start of the lexicon.
SEEDS = frozenset((
    "idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting",
    "clown", "dumb", "ugly", "fool", "hate", "filthy", "vermin", "dumm", "trottel", "abschaum", "imbécile", "stupide", "ordure",
    "estúpido", "imbécil", "basura",
))
# Second-person words.
SECOND_PERSON = frozenset((
    "you", "your", "yours", "you're", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton",
    "vous", "votre", "tú", "ti", "usted", "vosotros",
))
# Signs that stand for letters.
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:!?\"'()[]{}<>"
_INNER = re.compile(r"[^\W\d_]+[\d@$!*#._-]+[^\W\d_]|[\d@$!*#]+[^\W\d_]+[\d@$!*#]")

NAMES = (
    "log_words", "seeds", "seed_share", "hits", "hit_share", "odds_share", "most_odds", "distinct_hits", "begun", "begun_share",
    "near_you", "you_share", "hidden", "hidden_hits", "capital_share", "capital_words", "capital_hits", "shouts", "questions",
    "runs", "stars",
)


def terms_of(word: str) -> list[str]:
    """The word and its first four and five letters, as lexicon keys."""
    return [f"={word}"] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]


class Lexicon:
    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.known: dict[str, tuple[float, bool]] = {}

    def look(self, word: str) -> tuple[float, bool]:
        """Largest log odds of the word's keys, and whether only its beginning is known."""
        found = self.known.get(word)
        if found is None:
            whole, *begun = (self.odds.get(t, 0.0) for t in terms_of(word))
            found = max(whole, *begun, 0.0), not whole and any(begun)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found
        return found

    def __getstate__(self) -> dict:
        return {"odds": self.odds, "known": {}}

    def text_features(self, raw: bytes) -> list[float]:
        text = raw.decode("utf-8", "replace")
        words = text.split()
        count = max(1, len(words))
        lower = text.lower().split()
        seeds = hidden = hidden_hits = 0
        odds: list[float] = []
        places: list[int] = []
        begun = 0
        kinds = set()
        you: list[int] = []
        look, known = self.look, self.known.get
        for k, word in enumerate(lower):
            weight, start = known(word) or look(word)
            if not weight and not word.isalpha():
                bare = word.strip(_EDGE)
                if bare != word:
                    weight, start = known(bare) or look(bare)
                if not bare.isalpha() and _INNER.search(bare):
                    hidden += 1
                    plain = "".join(filter(str.isalpha, bare.translate(_PLAIN)))
                    if plain in SEEDS or look(plain)[0]:
                        hidden_hits += 1
                word = bare
            if word in SEEDS:
                seeds += 1
                weight = max(weight, LEAST_ODDS)
            if weight:
                odds.append(weight)
                places.append(k)
                begun += start
                kinds.add(word)
            if word in SECOND_PERSON:
                you.append(k)
        near = 0
        if you and places:
            at = np.searchsorted(you, places)
            spots = np.array(you)
            ahead, back = spots[np.minimum(at, len(you) - 1)], spots[np.maximum(at - 1, 0)]
            near = int((np.minimum(abs(ahead - places), abs(back - places)) <= NEAR).sum())
        upper = [w.isupper() for w in words]
        capital_hits = sum(upper[k] for k in places) if len(upper) == len(lower) else 0
        size = max(1, len(text))
        return [
            np.log1p(len(words)), seeds, seeds / count, len(odds), len(odds) / count, sum(odds) / count, max(odds, default=0.0),
            len(kinds), begun, begun / count, near, len(you) / count, hidden / count, hidden_hits,
            _capitals(raw) / size, sum(upper) / count, capital_hits,
            text.count("!") / count, text.count("?") / count, (text.count("!!") + text.count("??")) / count, text.count("*") / count,
        ]

    def features(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.text_features(t) for t in texts], float).reshape(-1, len(NAMES))


_CAPITALS = bytes(range(65, 91))


def _capitals(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, _CAPITALS))


def learn_lexicons(sample: DataFrame, folds: int = FOLDS) -> tuple[Lexicon, list[Lexicon]]:
    """Words and beginnings that toxic texts hold far more often: of the whole sample, and without each fold (h mod folds).

    Counts combine in Spark; only the best terms come back.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, tuple[Counter, Counter]] = {f: (Counter(), Counter()) for f in range(folds)}
            for raw, y, h in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("y").to_pylist(), batch.column("h").to_pylist()):
                words = {w.strip(_EDGE) for w in (raw or b"").decode("utf-8", "replace").lower().split()}
                terms = {t for w in words if w for t in terms_of(w)} | {""}  # the empty term counts the texts
                counts[h % folds][1].update(terms)
                if y:
                    counts[h % folds][0].update(terms)
            for fold, (ones, every) in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * len(every), pa.int32()), pa.array(list(every), pa.string()),
                     pa.array([ones[t] for t in every], pa.int64()), pa.array(list(every.values()), pa.int64())],
                    ["fold", "term", "ones", "every"])

    def parts(name: str) -> list:
        return [F.sum(F.when(F.col("fold") == f, F.col(name)).otherwise(0)).alias(f"{name}{f}") for f in range(folds)]

    counts = map_batches(sample, step, "fold int, term string, ones bigint, every bigint").groupBy("term").agg(
        F.sum("ones").alias("ones"), F.sum("every").alias("every"), *parts("ones"), *parts("every")).where(F.col("ones") >= LEAST_TEXTS)
    counts = materialize(counts, "terms")
    total = counts.where("term = ''").first()
    if total is None:
        return Lexicon({}), [Lexicon({})] * folds

    def lexicon(left_out: int | None) -> Lexicon:
        def count(name: str) -> Column:
            return F.col(name) if left_out is None else F.col(name) - F.col(f"{name}{left_out}")

        def number(name: str) -> int:
            return total[name] if left_out is None else total[name] - total[f"{name}{left_out}"]

        ones, every, texts, bad = count("ones"), count("every"), number("every"), number("ones")
        odds = F.log((ones + 0.5) / (bad + 1.0)) - F.log((every - ones + 0.5) / (texts - bad + 1.0))
        best = counts.where("term <> ''").where(ones >= LEAST_TEXTS).select("term", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
        return Lexicon({r["term"]: r["odds"] for r in best.orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS).collect()})

    return lexicon(None), [lexicon(f) for f in range(folds)]


class ToxicityModel:
    """Lexicon, trees and calibration; called with texts it gives their scores."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def fit(self, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> ToxicityModel:
        self.share = float(sigmoid(np.array(log_odds(y))))
        self.trees = None
        if 0 < y.sum() < len(y):
            self.trees = Trees().fit(x, y)
            raw = np.empty(len(y))
            for side in (part, ~part):
                learned = y[~side]
                raw[side] = Trees().fit(x[~side], learned).raw(x[side]) if 0 < learned.sum() < len(learned) else log_odds(y)
            self.level = Isotonic().fit(raw, y)
        return self

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return self.level(self.trees.raw(self.lexicon.features(texts)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> ToxicityModel:
    sample = labelled_texts(docs, labels, label, **options)
    lexicon, others = learn_lexicons(sample)
    x, y, h = collect_features(sample, [o.features for o in others])
    return ToxicityModel(lexicon).fit(x, y, (h // FOLDS) % 2 == 0)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    return score_texts(docs, model, text, name)


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; columns as before."""
    name = "_" + "_".join(docs.columns)  # a name that no column has
    return score(docs, model, text, name).where(f"`{name}` < {threshold}").drop(name)
