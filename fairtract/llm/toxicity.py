"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier.

Voters are word lists, phrases and patterns written here, and words and word
beginnings that a bounded sample of labelled documents shows to go with toxic
ones, dealt over several voters. A voter fires on a document or abstains.

The label model is generative: a document is toxic or not, and a voter fires
with a probability that depends on this and on one other voter, its parent in the
tree of strongest correlations (by mutual information within the classes). Its
parameters come from expectation maximisation over the vote patterns of *all*
training documents, counted by Spark; documents with a label keep it.
Patterns stay distributed, the driver sees sums per pair of voters.

The posteriors of a bounded sample of training documents (``fit_rows``) are the soft
labels of a logistic regression on counts of the found words, votes and densities,
which scores every whole text. Scores use the text only.

Held-out documents (every fifth by checksum of doc_id) teach nothing. A null or
empty text gets the score of a text without any hit, a null doc_id is never labelled,
repeated rows are scored each, without labels the lists alone vote. Empty tables give
no rows. Texts are read in chunks of a million characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.llm.storage import stage

# Words that commonly serve as abuse, by kind and language.
LISTS = {
    "insults": "idiot idiots moron morons imbecile dimwit halfwit dunce fool loser losers clown clowns jerk dumbass",
    "slights": "stupid dumb worthless pathetic disgusting useless brainless ignorant ridiculous hopeless repulsive",
    "contempt": "scum trash garbage vermin filth parasite parasites pest subhuman maggot maggots swine",
    "profanity": "fuck fucking fucker shit shitty bullshit asshole bitch bastard crap damn cunt dickhead",
    "violence": "kill murder strangle stab lynch exterminate hang burn shoot beat",
    "german": "idiot trottel dummkopf arschloch abschaum versager wichser schlampe dreckig widerlich erbärmlich",
    "french": "idiot imbécile crétin connard salope ordure minable débile abruti merde dégueulasse",
    "spanish": "idiota imbécil estúpido estúpida basura escoria pendejo cabrón mierda asqueroso patético",
}
PHRASES = ["shut up", "go to hell", "drop dead", "kill yourself", "hate you", "piece of shit", "get lost", "nobody likes you", "halt die fresse", "ta gueule", "cállate"]
COURTESY = "please thanks thank sorry welcome appreciate kindly bitte danke merci gracias"
ADDRESS = frozenset("you your youre ur u du ihr tu vous toi tú usted".split())

WORD = re.compile(r"\w+")
#: Voters among which found words and found word beginnings are dealt.
WORD_VOTERS, STEM_VOTERS = 8, 3
STEMS = range(4, 9)
CHUNK = 1_000_000
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SPACE = re.compile(r"\s")

VOTERS = [
    *LISTS, "phrases", "addressed", "courtesy", "shouting", "exclaiming",
    *[f"words {i}" for i in range(WORD_VOTERS)], *[f"stems {i}" for i in range(STEM_VOTERS)],
    "several words", "many words", "dense words", "no word",
]
#: Voters that speak for clean documents; only the start of the estimation without labels uses this.
CLEAN = {"courtesy", "no word"}


def is_held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _chunks(text: str) -> Iterator[str]:
    """Pieces of a text of about ``CHUNK`` characters, cut at white space."""
    start = 0
    while len(text) - start > CHUNK:
        space = _SPACE.search(text, start + CHUNK)
        stop = space.start() if space else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


@dataclass
class Reader:
    """Reads a text into features and votes. ``words`` and ``stems`` are the found entries, strongest first."""

    words: list[str]
    stems: list[str]
    place: dict[str, int] = field(init=False)
    stem_place: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.words)}
        self.stem_place = {s: i for i, s in enumerate(self.stems)}
        self.lengths = sorted({len(s) for s in self.stems})
        self.kind = {}
        for name, listed in [*LISTS.items(), ("courtesy", COURTESY)]:
            for w in listed.split():
                self.kind.setdefault(w, []).append(name)
        self.voter = {name: i for i, name in enumerate(VOTERS)}
        self.size = len(self.words) + len(self.stems) + len(VOTERS) + 4

    def read(self, text: str | None) -> tuple[int, np.ndarray]:
        """Votes as bits, and features: counts of entries, votes, and overall counts and densities."""
        counts: Counter[str] = Counter()
        text = text or ""
        fired: set[str] = set()
        for chunk in _chunks(text):
            low = chunk.lower()
            found = WORD.findall(low)
            counts.update(found)
            if any(p in low for p in PHRASES):
                fired.add("phrases")
            if "addressed" not in fired and not ADDRESS.isdisjoint(found) and self._addressed(found):
                fired.add("addressed")
        x = np.zeros(self.size, np.float32)
        n_words = counts.total()
        listed, hits, kinds, stem_hits = 0, 0, 0, 0
        n_own, n_stems = len(self.words), len(self.stems)
        stem_counts = np.zeros(n_stems, np.int64)
        for w, n in counts.items():
            for name in self.kind.get(w, ()):
                fired.add(name)
                listed += n if name != "courtesy" else 0
            i = self.place.get(w)
            if i is not None:
                x[i] = math.log1p(n)
                hits += n
                kinds += 1
                fired.add(f"words {i % WORD_VOTERS}")
            for k in self.lengths:
                j = self.stem_place.get(w[:k]) if len(w) >= k else None
                if j is not None:
                    stem_counts[j] += 1
        x[n_own : n_own + n_stems] = np.log1p(stem_counts)
        for j in np.flatnonzero(stem_counts >= 2).tolist():
            fired.add(f"stems {j % STEM_VOTERS}")
        stem_hits = int(stem_counts.max(initial=0))
        if kinds >= 2:
            fired.add("several words")
        if kinds >= 4:
            fired.add("many words")
        if hits >= 2 and 100 * hits >= n_words:
            fired.add("dense words")
        if not hits and not listed:
            fired.add("no word")
        raw = text.encode()
        upper, lower = (len(raw) - len(raw.translate(None, c)) for c in (_UPPER, _LOWER))
        if upper > 20 and upper > lower:
            fired.add("shouting")
        if 50 * text.count("!!") > n_words:
            fired.add("exclaiming")
        votes = sum(1 << self.voter[name] for name in fired)
        for name in fired:
            x[n_own + n_stems + self.voter[name]] = 1
        x[-4:] = math.log1p(hits), math.log1p(listed), min(hits / max(n_words, 10), 0.1) * 20, min(stem_hits / max(n_words, 10), 0.1) * 20
        return votes, x

    def _addressed(self, words: list[str]) -> bool:
        """Whether abuse follows a second person within three words."""
        abuse = lambda w: w in self.place or any(k != "courtesy" for k in self.kind.get(w, ()))
        return any(w in ADDRESS and any(map(abuse, words[i + 1 : i + 4])) for i, w in enumerate(words))


def _entry_rows(counts: Counter) -> pd.DataFrame:
    rows = [(*key, n) for key, n in counts.items()]
    return pd.DataFrame(rows, columns=["whole", "entry", "toxic", "n"])


def find_entries(labelled: DataFrame, words: int, stems: int, least: float = 15.0) -> Reader:
    """Words and beginnings of words of ``labelled(text, toxic)`` that go with toxic documents.

    Documents are counted, not occurrences; a beginning counts where two words or more of a document have it. Entries have a log likelihood ratio of
    ``least`` or more and are at least eight times as frequent among toxic documents.
    """
    totals = labelled.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not totals.t or not totals.c:
        return Reader([], [])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[bool, str, int]] = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                own = {w for chunk in _chunks(text or "") for w in WORD.findall(chunk.lower())}
                counts.update((True, w, toxic) for w in own)
                begun = Counter(w[:k] for k in STEMS for w in own if len(w) >= k)
                counts.update((False, s, toxic) for s, n in begun.items() if n > 1)
                if len(counts) > 1_000_000:
                    yield _entry_rows(counts)
                    counts.clear()
        yield _entry_rows(counts)

    t, c = (F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    counted = labelled.mapInPandas(count, "whole boolean, entry string, toxic int, n long")
    counted = counted.groupBy("whole", "entry").agg(t.alias("t"), c.alias("c")).where("t >= 3")
    rate = (F.col("t") + F.col("c")) / float(totals.t + totals.c)

    def part(k: Column, n: int) -> Column:
        """Twice the log likelihood that counts of a class gain over the common rate."""
        inside = F.when(k > 0, k * F.log(k / n / rate)).otherwise(0.0)
        outside = F.when(k < n, (n - k) * F.log((1 - k / n) / (1 - rate))).otherwise(0.0)
        return 2 * (inside + outside)

    ratio = ((F.col("t") + 0.5) / (totals.t + 1)) / ((F.col("c") + 0.5) / (totals.c + 1))
    strong = counted.withColumn("gain", part(F.col("t"), totals.t) + part(F.col("c"), totals.c)).where(F.col("gain") >= least).where(ratio >= 8)

    def top(whole: bool, n: int) -> list[str]:
        rows = strong.where(F.col("whole") == whole).orderBy(F.desc("gain"), "entry").limit(n).collect()
        return [r.entry for r in rows]

    strong = stage(strong, "entries")
    return Reader(top(True, words), top(False, stems))


class LabelModel:
    """P(toxic), and P(a voter fires | class, whether its parent fires)."""

    def __init__(self, m: int):
        self.m = m
        self.prior = 0.1
        toxic = np.array([0.05 if name in CLEAN else 0.4 for name in VOTERS[:m]])
        clean = np.array([0.4 if name in CLEAN else 0.02 for name in VOTERS[:m]])
        #: Chances of firing by class, parent's state and voter; without labels the lists are trusted at first.
        self.fires = np.stack([np.stack([clean, clean]), np.stack([toxic, toxic])])
        self.parent = np.full(m, -1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes (bits) are toxic."""
        v = (votes[:, None] >> np.arange(self.m)) & 1
        parents = np.where(self.parent >= 0, v[:, self.parent], 0)
        logs = []
        for y in (0, 1):
            p = self.fires[y][parents, np.arange(self.m)]
            logs.append(np.where(v == 1, np.log(p), np.log1p(-p)).sum(axis=1))
        odds = math.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def learn_tree(self, sums: np.ndarray) -> None:
        """The spanning tree of greatest mutual information within classes; weak ties are no correlation."""
        total = sums[:, -1, -1]
        gain = np.zeros((self.m, self.m))
        for y in (0, 1):
            n = total[y]
            if n <= 0:
                continue
            both = sums[y, :-1, :-1]
            one = np.diag(both)
            for a in (0, 1):
                for b in (0, 1):
                    pa_, pb = (one if a else n - one), (one if b else n - one)
                    joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else n - one[:, None] - one[None, :] + both
                    joint = np.maximum(joint, 0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        part = joint * np.log(joint * n / (pa_[:, None] * pb[None, :]))
                    gain += np.nan_to_num(part, nan=0.0, posinf=0.0, neginf=0.0)
        self.parent[:] = -1
        inside, outside = {0}, set(range(1, self.m))
        while outside:
            best, i, j = max((gain[i, j], i, j) for i in inside for j in outside)
            # Twice the gain is chi-square distributed if the two are independent.
            self.parent[j] = i if 2 * best > 10.8 else -1
            inside.add(j)
            outside.remove(j)

    def learn(self, sums: np.ndarray) -> None:
        """Parameters from expected counts of pairs of voters that fire, smoothed by one document."""
        total = sums[:, -1, -1]
        self.prior = float(np.clip((total[1] + 1) / (total.sum() + 2), 1e-4, 1 - 1e-4))
        for y in (0, 1):
            one = np.diag(sums[y])[:-1]
            base = np.clip((one + 0.1) / (total[y] + 1), 1e-4, 1 - 1e-4)
            for j, p in enumerate(self.parent):
                if p < 0:
                    self.fires[y, :, j] = base[j]
                    continue
                with_p = sums[y, p, j]
                self.fires[y, 1, j] = (with_p + base[j]) / (one[p] + 1)
                self.fires[y, 0, j] = (one[j] - with_p + base[j]) / (total[y] - one[p] + 1)
        self.fires = np.clip(self.fires, 1e-4, 1 - 1e-4)


def _pair_sums(patterns: DataFrame, model: LabelModel | None) -> np.ndarray:
    """Expected counts by class of pairs of voters that fire; the last row and column count documents.

    Without a model only labelled documents count.
    """
    m = len(VOTERS)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, m + 1, m + 1))
        for batch in batches:
            votes, n = batch["votes"].to_numpy(np.int64), batch["n"].to_numpy(float)
            label = batch["label"].to_numpy(int)
            weight = np.where(label < 0, 0.0, label)
            free = label < 0
            if model is None:
                n = np.where(free, 0.0, n)
            elif free.any():
                weight[free] = model.posterior(votes[free])
            v = np.ones((len(votes), m + 1))
            v[:, :m] = (votes[:, None] >> np.arange(m)) & 1
            for y, w in enumerate((1 - weight, weight)):
                sums[y] += (v * (w * n)[:, None]).T @ v
        yield pd.DataFrame({"cell": np.arange(sums.size), "part": sums.ravel()})

    out = np.zeros(2 * (m + 1) ** 2)
    for row in patterns.mapInPandas(expect, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect():
        out[row.cell] = row.part
    return out.reshape(2, m + 1, m + 1)


def fit_label_model(patterns: DataFrame, rounds: int = 8) -> LabelModel:
    """Expectation maximisation over ``patterns(votes, label (-1: unknown), n)``."""
    model = LabelModel(len(VOTERS))
    known = _pair_sums(patterns, None)
    if known[:, -1, -1].min() >= 10:
        model.learn(known)
    for i in range(rounds):
        sums = _pair_sums(patterns, model)
        if i == 1:
            model.learn_tree(sums)
        model.learn(sums)
    return model


@dataclass
class Classifier:
    reader: Reader
    label_model: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        odds = float(self.reader.read(text)[1] @ self.weights) + self.bias
        return 1 / (1 + math.exp(-min(max(odds, -60), 60)))


def _labels(labels: DataFrame) -> DataFrame:
    """One label per training document; of several the greatest."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _share(key: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))


def fit(
    docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, fit_rows: int = 20_000, words: int = 400, stems: int = 60
) -> Classifier:
    """Learn from training documents.

    Bounded samples, by a hash of doc_id: ``label_rows`` labelled documents give the entries of the found
    voters (``words``, ``stems``), ``fit_rows`` documents the linear classifier. The label model covers all.
    """
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~is_held_out(F.col("doc_id")))
    known = stage(_labels(labels), "labels")
    chosen = stage(known.where(_share(F.col("doc_id"), label_rows / max(known.count(), 1))).limit(2 * label_rows), "chosen")
    reader = find_entries(train.join(chosen, "doc_id").select("text", "toxic"), words, stems)

    share = fit_rows / max(train.select("doc_id").count(), 1)
    sampled = train.select("doc_id", "text", _share(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), share).alias("sampled"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("votes", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, xs = [], []
            for text, wanted in zip(batch.column("text"), batch.column("sampled").to_pylist()):
                v, x = reader.read(text.as_py())
                votes.append(v)
                xs.append(x if wanted else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(votes, pa.int64()), pa.array(xs, pa.list_(pa.float32()))], ["doc_id", "votes", "x"]
            )

    voted = stage(sampled.mapInArrow(vote, schema), "votes")
    labelled = voted.select("doc_id", "votes").join(known, "doc_id", "left")
    patterns = labelled.groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))
    model = fit_label_model(stage(patterns, "patterns"))
    return Classifier(reader, model, *_regress(voted.where("x is not null").select("votes", "x").limit(2 * fit_rows), model, reader.size))


def _regress(sample: DataFrame, model: LabelModel, size: int) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: each document counts for both classes by its posterior."""

    @F.pandas_udf("double")
    def posterior(votes: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(votes.to_numpy(np.int64)))

    judged = stage(sample.select("x", posterior("votes").alias("p")), "posteriors")
    if judged.isEmpty():
        return np.zeros(size), math.log(model.prior / (1 - model.prior))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    rows = judged.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), sides.alias("side")).select("features", "side.*").where("weight > 1e-6")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, standardization=False, maxIter=60, family="binomial").fit(rows)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` with a classifier fitted on the documents that are not held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
