"""Toxicity by a weighted lexicon that is learned from labels and matched by one automaton.

Texts are folded first: small letters, letters of other scripts that look like Latin ones, and digits or signs that
stand for letters inside a word. An entry is a whole word or the beginning of words; it counts where it
starts a word, unless an exception phrase covers it. The weight found is set against the length of the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import fresh, gram_codes, mixed, word_codes
from termloom.plans.staging import write_stage

# The lexicon is learned from about this many labelled rows, taken by a hash of their id.
FIT_DOCS = 20_000
# The most entries a lexicon may have.
LEXICON_SIZE = 5_000
THRESHOLD = 0.3
# An entry is this many times likelier in toxic texts, at least, and found in so many, or this share, of them.
MIN_ODDS, MIN_DOCS, MIN_SHARE = 8.0, 3.0, 0.005
STEMS = (4, 5, 6)
ANCHORS = 4
HOLD_OUT = 2

# Phrases in which a word that insults elsewhere does not; learned ones are added.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "white trash bag", "class clown award")
# Letters that look like Latin ones, and signs that stand for letters.
_ALIKE = str.maketrans(
    "авекмнорстухіјѕԁһԛԝьαβεικνορτυχγӏ",
    "abekmhopctyxijsdhqwbabeiknoptuxyl",
    "­​‌‍⁠﻿",
)
_STANDS = str.maketrans("0134578@$", "oieastbas")

_SIGNS = re.compile(r"[0134578@$]")
_SIGNED = re.compile(r"\S*[0134578@$]\S*")
_TAIL = re.compile(r"[\W_]*$")
_LETTERS = re.compile(r"[^\W_]+")


def _plain(match: re.Match) -> str:
    """A word with its signs as letters; marks at its end and numbers stay as they are."""
    word = match.group()
    end = _TAIL.search(word).start()
    core = word[:end]
    return core.translate(_STANDS) + word[end:] if any(c.isalpha() for c in core) else word


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        text = text.translate(_ALIKE)
    return _SIGNED.sub(_plain, text) if _SIGNS.search(text) else text


class Scorer:
    """The toxicity of texts by a lexicon: entries ``=word`` and ``^beginning`` with weights."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], factors: list[float]) -> None:
        self.lexicon, self.exceptions, self.factors = lexicon, exceptions, factors
        self._automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def _matcher(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            kinds: dict[str, list] = {}
            for entry, weight in self.lexicon.items():
                kinds.setdefault(entry[1:], [0.0, 0.0, False])["^=".index(entry[0])] = weight
            for phrase in self.exceptions:
                kinds.setdefault(phrase, [0.0, 0.0, False])[2] = True
            made = ahocorasick.Automaton()
            for text, values in kinds.items():
                made.add_word(text, (len(text), *values))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest entry at each start, without those inside an exception."""
        if not self.lexicon:
            return []
        found: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (size, beginning, word, exception) in self._matcher().iter(folded):
            start, end = last + 1 - size, last + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end == len(folded) or not folded[end].isalnum()
            if exception and closed:
                spared.append((start, end))
            weight = max(beginning, word if closed else 0.0)
            if weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        if spared:
            found = {s: (e, w) for s, (e, w) in found.items() if not any(a <= s and e <= b for a, b in spared)}
        return [(s, e, w) for s, (e, w) in sorted(found.items())]

    def measures(self, text: str | None) -> tuple[float, float]:
        """Weight found, and weight a thousand words."""
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        found = Counter((folded[s:e], w) for s, e, w in self.hits(folded))
        # An entry that repeats adds less each time.
        weight = math.fsum(w * (1 + math.log(n)) for (_, w), n in sorted(found.items()))
        return math.log1p(weight), math.log1p(1000.0 * weight / (len(text.split()) + 50)) if weight else 0.0

    def score(self, text: str | None) -> float:
        a, b, c = self.factors
        found = self.measures(text)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, a + b * found[0] + c * found[1]))))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hashes of a text's runs of five words under some hash functions: near copies share most."""
    seeds = np.random.default_rng(11).integers(1, 2**63, ANCHORS, dtype=np.uint64)
    for batch in batches:
        rows = []
        for codes in word_codes(batch.column(1)):
            grams = gram_codes(codes, min(5, max(len(codes), 1)))
            rows.append([int(mixed(grams ^ s).min().view(np.int64)) if len(grams) else 0 for s in seeds])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["row", "anchors"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights of the toxic and of the other texts that hold each word and each beginning of words."""
    for batch in batches:
        sums = (Counter(), Counter())
        for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in range(3))):
            words = {w for w in _LETTERS.findall(fold(text or "")) if 2 < len(w) <= 40}
            entries = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) >= n}
            for entry in entries:
                sums[toxic][entry] += weight
        both = list(set(sums[0]) | set(sums[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.string()), *(pa.array([s[e] for e in both], pa.float64()) for s in (sums[1], sums[0]))],
            ["entry", "toxic", "clean"],
        )


def _odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))


def _chosen(candidates: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """Candidates without those that another one explains, which is as clean and matches wherever they do.

    Of entries with equal sums a word stays before a beginning, and a long beginning before a short one.
    """
    stems = {e[1:]: (t, c) for e, t, c in candidates if e[0] == "^"}
    words = {e[1:]: (t, c) for e, t, c in candidates if e[0] == "="}

    def explained(entry: str, toxic: float, clean: float) -> bool:
        text = entry[1:]
        for n in STEMS:
            other = stems.get(text[:n]) if len(text) >= n and (entry[0] == "=" or n < len(text)) else None
            if other and other[0] > 1.05 * toxic and other[1] <= clean + 0.02 * other[0]:
                return True
        if entry[0] == "^":
            # A beginning that one longer entry accounts for.
            longer = [v for s, v in (*stems.items(), *words.items()) if s.startswith(text) and (s != text or s in words and v is words.get(s))]
            return any(v[0] >= toxic / 1.05 for v in longer)
        return False

    return [c for c in candidates if not explained(*c)]


def _phrases(scorer: Scorer):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of words around each hit, with the weights of the toxic and of the other texts that hold them."""
        for batch in batches:
            sums = (Counter(), Counter())
            for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in range(3))):
                folded = fold(text or "")
                pairs = set()
                for start, end, _ in scorer.hits(folded):
                    while end < len(folded) and folded[end].isalnum():
                        end += 1
                    before, after = re.search(r"[^\W_]+ $", folded[max(0, start - 40) : start]), re.match(r" [^\W_]+", folded[end : end + 40])
                    pairs.update([before.group() + folded[start:end]] if before else [])
                    pairs.update([folded[start:end] + after.group()] if after else [])
                for pair in pairs:
                    sums[toxic][pair] += weight
            both = list(set(sums[0]) | set(sums[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), *(pa.array([s[e] for e in both], pa.float64()) for s in (sums[1], sums[0]))],
                ["entry", "toxic", "clean"],
            )

    return phrases


def _measure(scorer: Scorer):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.measures(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)), batch.column(1), batch.column(2)], ["a", "b", "toxic", "weight"]
            )

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Factors of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    factors = np.zeros(x.shape[1])
    keep = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ factors, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ factors)
        factors += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return factors.tolist()


def in_hold_out(doc_id: Column) -> Column:
    """Whether a row is held out from learning; rows without id are not, as no label names them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HOLD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Scorer:
    """Learn lexicon, exceptions and scale from labelled texts that are not held out.

    About ``fit_docs`` labelled ids are taken by a hash; conflicting labels of an id count as toxic, and of repeated ids
    the smallest text is read. A text counts with one over the number of its near copies, so that a
    passage that was copied often is no evidence of its own. Without labels of both kinds the lexicon is empty.
    """
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_hold_out(F.col("doc_id")))
    labels = write_stage(labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels")
    share = min(1.0, fit_docs / max(labels.count(), 1))
    labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # fit_docs rows, two numbers each
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = write_stage(sample.withColumnRenamed("doc_id", "row"), "sample")
    near = sample.select(F.col("row").cast("long"), "text").mapInArrow(_anchors, "row long, anchors array<long>")
    near = near.select("row", F.posexplode("anchors").alias("place", "anchor"))
    copies = near.groupBy("place", "anchor").agg(F.count("*").alias("n"))
    weights = near.join(copies, ["place", "anchor"]).groupBy("row").agg((1 / F.max("n")).alias("weight"))
    sample = write_stage(sample.join(weights, "row").select("text", "toxic", "weight"), "sample")
    total = {r.toxic: r.weight for r in sample.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    n_toxic, n_clean = total.get(1, 0.0), total.get(0, 0.0)
    if not n_toxic or not n_clean:
        prior = (n_toxic + 0.05) / (n_toxic + n_clean + 1)
        return Scorer({}, [], [math.log(prior / (1 - prior)), 0.0, 0.0])
    sums = lambda df: df.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    schema = "entry string, toxic double, clean double"
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    strong = sums(sample.mapInArrow(_entries, schema)).filter((F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * n_toxic)) & (odds >= MIN_ODDS))
    found = strong.orderBy(F.desc("toxic"), "entry").limit(LEXICON_SIZE).collect()
    chosen = _chosen([(r.entry, r.toxic, r.clean) for r in found])
    lexicon = {e: math.log(_odds(t, c, n_toxic, n_clean)) for e, t, c in chosen}
    scorer = Scorer(lexicon, list(exceptions), [0.0, 0.0, 0.0])
    spared = sums(sample.mapInArrow(_phrases(scorer), schema)).filter("clean >= 2 AND toxic < 0.05 * clean")
    spared = [r.entry for r in spared.orderBy(F.desc("clean"), "entry").limit(LEXICON_SIZE).collect()]
    scorer = Scorer(lexicon, [*exceptions, *spared], [0.0, 0.0, 0.0])
    rows = sample.mapInArrow(_measure(scorer), "a double, b double, toxic int, weight double").toArrow()
    x = np.column_stack([rows["a"].to_numpy(), rows["b"].to_numpy()])
    scorer.factors = _logistic(x, rows["toxic"].to_numpy().astype(float), rows["weight"].to_numpy())
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` with the column ``score`` (0 to 1) in place of the text.

    Null and empty texts, and those without a hit, get the score of no weight. Each row is scored by its text
    alone, whatever its length, so equal texts have equal scores.
    """
    (score,) = fresh(docs, "score")
    others = [c for c in docs.columns if c.lower() != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others))
            for start in range(0, max(batch.num_rows, 1), 500):
                some = texts.slice(start, 500)
                values = pa.array([scorer.score(t.as_py()) for t in some], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, 500) for i in range(len(others))), values], [*others, score])

    ordered = docs.select(*others, "text")
    fields = [*ordered.schema.fields[:-1]]
    schema = type(ordered.schema)(fields).add(score, "double")
    return ordered.mapInArrow(scored, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a lexicon learned from the rows that are not held out."""
    scorer = fit(docs, labels, fit_docs)
    found = score_toxicity(docs.select("doc_id", "text"), scorer)
    return found.select(
        "doc_id", in_hold_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
