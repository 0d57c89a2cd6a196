"""Abusive, hateful and sexual language by weak supervision.

A text is cut into segments; words are folded, un-obfuscated and tagged by the lexicon; voters (patterns over the
tagged words) fire or not. A generative label model learns from the counts of vote patterns over the whole corpus how
accurate each voter is, and how voters go together beyond the class. Its posterior labels a bounded
sample of segments, on which a linear classifier over hashed words is trained. A document's score is that of its
worst segment by the classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from ..session import durable, spread_out
from . import lexicon
from .textnorm import fold

SENTENCE = re.compile(r"(?<=[.!?…;])\s+|[\r\n]+|\s[-–|]\s|, (?=i |you |we |the only|a plant|typical |never |send |get )")
SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$#*][.\-_*]){2,}[a-z0-9@$#*](?![a-z0-9])|(?<![a-z0-9])(?:[a-z0-9@$] ){3,}[a-z0-9@$](?![a-z0-9])")
#: What any match of SPACED holds; few texts do.
MAYBE_SPACED = re.compile(r"[.\-_*][a-z0-9@$#*][.\-_*]| [a-z0-9@$] [a-z0-9@$] ")
WORD = re.compile(r"[a-z0-9@$#*_!|+\-]*[a-z0-9@$#*][a-z0-9@$#*_!|+\-]*")
NUMBER = re.compile(r"(?<![a-z0-9$@])\d[\d.,:/]*(?![a-z0-9$@])")
UNIT = re.compile(r"\b[a-z]{2}-\d{3}[a-z]\b|\bsensor_\d+\b")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
RUN = re.compile(r"(.)\1{2,}")
JUNK = re.compile(r"[^a-z]+")


#: Different segments that a task keeps what it found of.
REMEMBERED = 300_000


class Tagger:
    """Maps words, however disguised, to the tags of the lexicon."""

    def __init__(self) -> None:
        self.tag: dict[str, str] = {}
        for tag, words in lexicon.SPELLED.items():
            for w in words:
                self.tag.setdefault(w, tag)
        self.slips: dict[str, str] = {}
        self.swaps: dict[str, str] = {}
        for w in self.tag:
            if len(w) >= 4:
                for i in range(len(w)):
                    self.slips.setdefault(w[:i] + w[i + 1 :], w)
                for i in range(len(w) - 1):
                    self.swaps.setdefault(w[:i] + w[i + 1] + w[i] + w[i + 2 :], w)
        self.ordinary = set(lexicon.ORDINARY)
        self.phrases = [(re.compile(rf"\b{k}\b"), v) for k, v in lexicon.PHRASES.items()]
        self.cache: dict[str, tuple[str, bool]] = {}

    def word(self, raw: str) -> tuple[str, bool]:
        """The tag, or the plain word, and whether it stood disguised."""
        got = self.cache.get(raw)
        if got is None:
            got = self._word(raw)
            if len(self.cache) < 400_000:
                self.cache[raw] = got
        return got

    def _word(self, raw: str) -> tuple[str, bool]:
        if raw.isdigit():
            return "0", False
        if raw in self.tag:
            return self.tag[raw], False
        if raw in self.ordinary or (raw.replace("-", "").isalnum() and sum(map(str.isdigit, raw)) > 2):
            return raw.replace("-", " "), False
        body = raw.strip("-_!|+")
        plain = JUNK.sub("", body.translate(LEET))
        marked = plain != body
        for v in (plain, RUN.sub(r"\1", plain), RUN.sub(r"\1\1", plain), JUNK.sub("", body.replace("1", "l").translate(LEET))):
            if v in self.tag:
                return self.tag[v], True
        long_run = RUN.search(plain) is not None
        bare = JUNK.sub("", body.translate(LEET)) if not long_run else RUN.sub(r"\1", plain)
        hidden = re.search(r"[#*_@$]|[a-z]-+[a-z]", body) is not None
        least = 3 if hidden else 4
        if len(bare) >= least and bare not in self.ordinary:
            if w := self.swaps.get(bare):
                return self.tag[w], marked or long_run
            if (w := self.slips.get(bare)) and (hidden or len(w) >= 5):
                return self.tag[w], marked or long_run
        return (JUNK.sub(" ", RUN.sub(r"\1", raw)).strip() or "0"), False

    def tagged(self, text: str) -> str:
        """The segment's words in order, listed ones as tags; HID at the end where one stood disguised."""
        words, hidden = [], False
        for raw in WORD.findall(text.replace("'", " ").replace("’", " ")):
            w, h = self.word(raw)
            hidden |= h
            words.append(w)
        out = " ".join(words)
        for pattern, tag in self.phrases:
            out = pattern.sub(tag, out)
        return f"{out} HID" if hidden else out


def segments(text: str, longest: int = 18, step: int = 9) -> list[str]:
    """The folded text's sentences, numbers and tags as one; longer ones in windows of `longest` words, each `step`
    words on; what spans no more than `longest` - `step` + 1 words lies whole in one."""
    out = []
    text = fold(text)
    if MAYBE_SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)
    for s in SENTENCE.split(text):
        if not s or s.isspace():
            continue
        if "-" in s or "_" in s:
            s = UNIT.sub("sensor", s)
        words = NUMBER.sub("0", s).split()
        if len(words) <= longest:
            out.append(" ".join(words))
        else:
            out += [" ".join(words[i : i + longest]) for i in range(0, max(len(words) - longest + step, 1), step)]
    return out


class Voters:
    def __init__(self) -> None:
        self.names = list(lexicon.VOTERS)
        self.patterns = [re.compile(p) for p in lexicon.VOTERS.values()]
        self.harmless = np.array([n.startswith("not_") for n in self.names])
        self.prior = np.array([lexicon.PRIOR[n] for n in self.names])
        self.asked = [[(1 << j, p.search) for j, p in enumerate(self.patterns) if self.harmless[j] == h] for h in (False, True)]

    def pattern(self, tagged: str) -> int:
        """Bit j is set where voter j fires; harmless voters are asked only where another accuses."""
        bits = 0
        for asked in self.asked:
            for bit, search in asked:
                if search(tagged):
                    bits |= bit
            if not bits:
                break
        return bits


def bits_of(patterns: np.ndarray, voters: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(voters)[None, :]) & 1


@dataclass
class LabelModel:
    """Each voter's accuracy (how often the class it speaks for is the right one where it fires) and its weight after
    correlations: a voter whose votes go with others' beyond the class counts for less."""

    accuracy: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    harmless: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a segment is abusive; 0 where no accusing voter fires. Silent voters say nothing."""
        odds = np.log(self.accuracy / (1 - self.accuracy)) * self.weight * np.where(self.harmless, -1, 1)
        p = 1 / (1 + np.exp(-np.clip(votes @ odds, -40, 40)))
        return np.where(votes[:, ~self.harmless].any(1), p, 0.0)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, prior: np.ndarray, harmless: np.ndarray, rounds: int = 40, trust: tuple[float, float] = (0.5, 8.0)) -> LabelModel:
    """Expectation maximisation on the counts of vote patterns.

    `prior` is what is believed of each voter's accuracy beforehand; it weighs as `trust` times the segments on which
    the voter fires (for accusing and for harmless voters; the latter speak of few of the segments that they know). Accuracies are learnt from how voters agree where several fire; correlations between voters of
    one side are those of their residuals given the class, over segments with an accusing vote.
    """
    voters = len(harmless)
    votes = bits_of(patterns, voters).astype(float)
    accused = votes[:, ~harmless].any(1)
    votes, n = votes[accused], counts[accused].astype(float)
    fired = votes * n[:, None]
    model = LabelModel(prior.astype(float), np.ones(voters), np.eye(voters), harmless)
    same = (harmless[:, None] == harmless[None, :]) & ~np.eye(voters, dtype=bool)
    trusted = np.where(harmless, trust[1], trust[0])
    for _ in range(rounds):
        p = model.posterior(votes)
        right = np.where(harmless[None, :], (1 - p)[:, None], p[:, None])
        total = fired.sum(0)
        accuracy = ((fired * right).sum(0) + trusted * total * prior + prior) / ((1 + trusted) * total + 1)
        mean = [(fired * q[:, None]).sum(0) / max((n * q).sum(), 1e-9) for q in (1 - p, p)]
        rest = sum((d := (votes - m) * np.sqrt(n * q)[:, None]).T @ d for m, q in zip(mean, (1 - p, p), strict=True))
        sd = np.sqrt(np.maximum(np.diag(rest), 1e-9))
        correlation = rest / np.outer(sd, sd)
        weight = 1 / (1 + (np.clip(correlation, 0, 1) * same).sum(1))
        model = LabelModel(np.clip(accuracy, 0.05, 0.995), weight, correlation, harmless)
    return model


def features(tagged: str, bits: int = 18) -> np.ndarray:
    """Hashed words, pairs, pairs over a gap and triples of a tagged segment, each once."""
    w = ["^", *tagged.split(), "$"]
    names = [*w[1:-1], *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)), *(f"{a} _ {b}" for a, b in zip(w, w[2:], strict=False))]
    names += [f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:], strict=False)]
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((xxh32_intdigest(x) & mask for x in names), np.int64, len(names)))


def train_linear(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = 18, epochs: int = 12, least_steps: int = 1500, rate: float = 0.15, decay: float = 2e-5, bias: float = -2.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by mini-batches with per-weight rates (AdaGrad).

    The bias isn't learnt: a segment of which no word was seen in training is to come out harmless.
    """
    sizes = np.array([len(r) for r in rows])
    # weights of the features that occur, numbered anew
    names, flat_all = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    ends = np.cumsum(sizes)
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    rng = np.random.default_rng(seed)
    # a small corpus takes more passes, so that the weights get as far as on a large one
    for _ in range(max(epochs, -(-least_steps * 256 // max(len(rows), 1)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            n = sizes[batch]
            owner = np.repeat(np.arange(len(batch)), n)
            flat = flat_all[np.repeat(ends[batch] - np.cumsum(n), n) + np.arange(n.sum())]
            z = np.bincount(owner, w[flat], len(batch)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weights[batch]
            seen, inside = np.unique(flat, return_inverse=True)
            step = np.bincount(inside, error[owner], len(seen)) + decay * len(batch) * w[seen]
            g2[seen] += step**2
            w[seen] -= rate * step / np.sqrt(g2[seen])
    full = np.zeros(1 << bits)
    full[names] = w
    return full, bias


def abuse_scores(documents: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("source",), train_segments: int = 60_000, oversample: int = 50, bits: int = 18) -> DataFrame:
    """(doc_id, <keep>, score): a score from 0 to 1 per document row; 0.5 and above is abusive.

    Votes are counted and documents scored whole and over all rows. `train_segments` bounds the labelled sample that
    the classifier is trained on: up to half from segments on which an accusing voter fires, the rest from all others,
    each picked by a hash of its document, place and words. The pass that counts votes draws the sample too: its rates
    follow from the letters of the corpus, at `oversample` times the others' rate for accused segments, and what is
    drawn beyond the bound is left out by the same hash. Null, empty and blank texts score 0. Repeated rows are scored
    each. An empty table gives no rows. Without any accused segment in the corpus all scores are 0.
    """
    spark = documents.sparkSession
    docs = spread_out(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL"))
    accusing = sum(1 << j for j, h in enumerate(Voters().harmless) if not h)
    size = documents.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    # more letters than a segment of ordinary text has: rather too many are drawn
    rates = [min(1.0, much * train_segments / 2 / max(size / 120, 1)) for much in (1, oversample)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, voters, seen, known = Tagger(), Voters(), {}, {}
        names = ["pattern", "n", "draw", "at"]
        for batch in batches:
            draws, got, votes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, s in enumerate(segments(t)):
                    found = known.get(s)
                    if found is None:
                        tagged = tagger.tagged(s)
                        found = (voters.pattern(tagged), tagged)
                        if len(known) < REMEMBERED:
                            known[s] = found
                    seen[found[0]] = seen.get(found[0], 0) + 1
                    draw = xxh64_intdigest(f"{i} {k} {s}")
                    if draw < rates[bool(found[0] & accusing)] * 2**64:
                        draws.append(draw - 2**63)
                        got.append(features(found[1], bits))
                        votes.append(found[0])
            if draws:
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int64()), pa.nulls(len(draws), pa.int64()), pa.array(draws, pa.int64()), pa.array(got, pa.list_(pa.int32()))], names=names)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64()), pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.list_(pa.int32()))], names=names)

    looked = durable(docs.mapInArrow(look, "pattern long, n long, draw long, at array<int>"))
    # at most 2 ** (number of voters) rows, whatever the corpus
    table = looked.where("n IS NOT NULL").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r.pattern for r in table], np.int64), np.array([r.n for r in table], np.int64)
    accused = (patterns & accusing) != 0
    if not accused.any():
        return documents.select(F.col(key).alias("doc_id"), *[k for k in keep if k in documents.columns], F.lit(0.0).alias("score"))
    voters = Voters()
    model = fit_label_model(patterns, counts, voters.prior, voters.harmless)
    shares = [min(r, train_segments / 2 / max(int(counts[a].sum()), 1)) for r, a in zip(rates, (~accused, accused), strict=True)]
    limits = [F.lit(min(int(x * 2**64) - 2**63, 2**63 - 1)) for x in shares]
    within = F.col("draw") < F.when(F.col("pattern").bitwiseAND(accusing) == 0, limits[0]).otherwise(limits[1])
    sample = looked.where("draw IS NOT NULL").where(within).select("draw", "pattern", "at").dropDuplicates(["draw"]).toArrow().combine_chunks()
    votes = sample["pattern"].to_numpy()
    rows = [np.asarray(x.values, np.int64) for x in sample["at"].combine_chunks()]
    order = np.argsort(sample["draw"].to_numpy())  # the same at any partitioning
    rows, votes = [rows[i] for i in order], votes[order]
    labels = model.posterior(bits_of(votes, len(voters.names)).astype(float))
    weights, bias = train_linear(rows, labels, np.ones(len(rows)), bits)
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

    extra = [f for f in documents.schema.fields if f.name in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        tagger, known = Tagger(), {}

        def weigh(s: str) -> float:
            z = known.get(s)
            if z is None:
                z = float(w[features(tagger.tagged(s), bits)].sum())
                if len(known) < REMEMBERED:
                    known[s] = z
            return z

        for batch in batches:
            out = [max(map(weigh, segments(t)), default=None) if t else None for t in batch.column(0).to_pylist()]
            scores = pa.array([0.0 if z is None else 1 / (1 + np.exp(-np.clip(z + b, -30, 30))) for z in out], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=["doc_id", *(f.name for f in extra), "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    schema = f"doc_id {documents.schema[key].dataType.simpleString()}, {kinds + ', ' if kinds else ''}score double"
    return spread_out(documents.select(F.col(text), F.col(key).alias("doc_id"), *[f.name for f in extra])).mapInArrow(score, schema)
