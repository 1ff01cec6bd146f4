"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The
likelihood of a word is the sum over all ways to cut it into pieces of the product of
their probabilities, by a forward pass; a text's is the product over its words.  The
probabilities are fitted by expectation-maximisation on the words of a bounded sample
of labelled documents (about ``TRAIN_DOCS`` a language, by hash, whole texts); the
expected counts are gathered from the executors, a row a piece and language at most.

Words are runs of letters, lower-cased, of any length: sums that would grow too small
for a number are scaled up every ``SCALED`` letters and their logarithms kept.  A letter
that no piece covers has one probability in all languages.

* A null text, or one without a letter, is ``und`` with score 0, and so is everything
  when nothing was learned.  Ties go to the first language by name.  Null languages and
  null ids are not learned from.  Rows that repeat get equal predictions.
* An empty table gives an empty result.  The result is a column expression; no name of
  the input is touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import checked_broadcast, written

#: Vocabulary file, if the session does not name another by ``VOCABULARY_SETTING``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
VOCABULARY_SETTING = "spark.veilframe.vocabulary"
TRAIN_DOCS = 600
TRAIN_SEED = 6
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = 1e-8
NONE = "und"

START = "▁"  # marks the begin of a word in the vocabulary
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters between two scalings: even unknown ones are far from the smallest number.
SCALED = 16
#: Pieces used less often than this, on average and in every language, are dropped from
#: the model; single letters stay.
LEAST_USES = 2.0
#: Words whose likelihoods a worker keeps, and texts it looks at together.
CACHE = 400_000
TEXTS = 500


def words_of(text: str | None) -> Counter[str]:
    """The words of a text with their numbers."""
    return Counter(LETTERS.findall((text or "").lower()))


def read_pieces(path: str = VOCABULARY) -> list[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return sorted({p for p in usable if LETTERS.fullmatch(p.lstrip(START) or "a")})


@dataclass(frozen=True)
class Model:
    """Probability of each piece in each of the languages."""

    languages: tuple[str, ...]
    pieces: dict[str, tuple[float, ...]]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def places(self) -> dict[str, int]:
        """Line of each piece in ``table``."""
        return {piece: i for i, piece in enumerate(self.pieces)}

    @cached_property
    def table(self) -> np.ndarray:
        """A line for each piece, one for a letter without a piece, and one of zeros."""
        known = np.array(list(self.pieces.values())).reshape(-1, len(self.languages))
        unknown = np.full((1, len(self.languages)), UNKNOWN)
        return np.concatenate([known, unknown, np.zeros_like(unknown)])


# --- one word --------------------------------------------------------------------------


def expected_counts(word: str, probability: dict[str, float], longest: int) -> dict[str, float]:
    """How often each piece is used, on average over the segmentations of the word."""
    word = START + word
    n = len(word)
    arcs = [
        [(j, p) for j in range(i + 1, min(n, i + longest) + 1)
         if (p := probability.get(word[i:j], UNKNOWN if j == i + 1 else 0.0))]
        for i in range(n)
    ]
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, some in enumerate(arcs):
        for j, p in some:
            into[j].append((i, p))
    # Sums over what leads to each place and away from it, and the logarithm of their scale.
    ahead, ahead_scale = _scaled_sums(range(n + 1), arcs, 0, longest)
    back, back_scale = _scaled_sums(range(n, -1, -1), into, n, longest)
    total = math.log(ahead[n]) + ahead_scale[n]
    out: dict[str, float] = defaultdict(float)
    for i, some in enumerate(arcs):
        for j, p in some:
            out[word[i:j]] += ahead[i] * p * back[j] * math.exp(ahead_scale[i] + back_scale[j] - total)
    return out


def _scaled_sums(order: range, arcs: list, first: int, longest: int) -> tuple[list[float], list[float]]:
    """Sums of products over the paths from ``first`` along ``arcs``, visited in order."""
    n = len(order)
    sums, scales, scale = [0.0] * n, [0.0] * n, 0.0
    sums[first] = 1.0
    for visited, i in enumerate(order):
        if visited and visited % SCALED == 0:
            unit = sums[i]
            scale += math.log(unit)
            for k in order[visited : visited + longest + 1]:
                sums[k] /= unit
        scales[i] = scale
        if i < len(arcs):
            for j, p in arcs[i]:
                sums[j] += sums[i] * p
    return sums, scales


def log_likelihoods(words: list[str], model: Model) -> np.ndarray:
    """Of each word in each language: words of one length go forward together."""
    out = np.empty((len(words), len(model.languages)))
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        by_size[len(word) + 1].append(i)
    get, unknown = model.places.get, len(model.places)
    for n, members in by_size.items():
        marked = [START + words[i] for i in members]
        ahead = np.zeros((n + 1, len(members), len(model.languages)))
        ahead[0] = 1.0
        scale = np.zeros(ahead.shape[1:])
        for i in range(n):
            if i and i % SCALED == 0:
                unit = ahead[i].copy()
                scale += np.log(unit)
                ahead[i : i + model.longest + 1] /= unit
            for j in range(i + 1, min(n, i + model.longest) + 1):
                cut = map(itemgetter(slice(i, j)), marked)
                none = unknown if j == i + 1 else unknown + 1
                line = np.fromiter(map(get, cut, repeat(none)), np.intp, len(members))
                if j == i + 1:
                    ahead[j] += ahead[i] * model.table[line]
                elif len(hits := np.flatnonzero(line <= unknown)):
                    ahead[j, hits] += ahead[i, hits] * model.table[line[hits]]
        out[members] = np.log(ahead[n]) + scale
    return out


# --- fitting ------------------------------------------------------------------------------


def training_words(labelled: DataFrame, most_docs: int = TRAIN_DOCS) -> DataFrame:
    """lang, word, n of a sample by hash of ``labelled`` (doc_id, lang, text)."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    place = F.pmod(F.xxhash64(F.lit(TRAIN_SEED), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = labelled.join(checked_broadcast(sizes), "lang").where(place * F.col("docs") < most_docs)
    some = some.select("doc_id", "lang", "text").distinct()  # rows that repeat count once

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter[str]] = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"]):
                seen[lang].update(words_of(text))
            rows = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    each = some.select("lang", "text").mapInPandas(counted, "lang string, word string, n long")
    return written(each.groupBy("lang", "word").agg(F.sum("n").alias("n")), "training-words")


def fit(
    labelled: DataFrame, vocabulary: str | None = None, most_docs: int = TRAIN_DOCS, rounds: int = ROUNDS
) -> Model:
    """``labelled`` has doc_id, lang and text; rows without a language are left out.  The
    vocabulary file is read by the driver alone."""
    labelled = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL")
    words = training_words(labelled, most_docs)
    spark = labelled.sparkSession
    pieces = read_pieces(vocabulary or spark.conf.get(VOCABULARY_SETTING, VOCABULARY))
    longest = max(map(len, pieces), default=1)
    tables: dict[str, dict[str, float]] = {}
    flat = {p: 1.0 / len(pieces) for p in pieces}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((tables, flat))

        def expected(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known, first = shared.value
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                    for piece, x in expected_counts(word, known.get(lang, first), longest).items():
                        sums[lang, piece] += n * x
            rows = [(lang, piece, x) for (lang, piece), x in sums.items() if piece in first]
            yield pd.DataFrame(rows, columns=["lang", "piece", "n"])

        each = words.mapInPandas(expected, "lang string, piece string, n double")
        sums = each.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        tables = normalised(sums)
    languages = tuple(sorted(tables))
    used = {p for t in tables.values() for p in t}
    return Model(languages, {p: tuple(tables[lang][p] for lang in languages) for p in sorted(used)})


def normalised(sums: list) -> dict[str, dict[str, float]]:
    """Probabilities per language over the pieces that any language uses."""
    used = sorted({r.piece for r in sums if r.n >= LEAST_USES or len(r.piece) == 1})
    counts: dict[str, dict[str, float]] = defaultdict(dict)
    for r in sums:
        counts[r.lang][r.piece] = r.n
    kept = set(used)
    out = {}
    for lang in sorted(counts):
        whole = math.fsum(n for p, n in counts[lang].items() if p in kept) + SMOOTHING * len(used)
        out[lang] = {p: (counts[lang].get(p, 0.0) + SMOOTHING) / whole for p in used}
    return out


# --- prediction ----------------------------------------------------------------------------


class Words:
    """Likelihoods of words met lately; when too many are kept, all are dropped."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.places: dict[str, int] = {}
        self.lines = np.empty((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        """Make sure of these."""
        if len(self.places) > CACHE:
            self.places, self.lines = {}, self.lines[:0]
        new = [w for w in words if w not in self.places]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.lines = np.concatenate([self.lines, log_likelihoods(new, self.model)])


def predict(texts: Iterable[str | None], words: Words) -> list[tuple[str, float]]:
    languages = words.model.languages
    seen = [words_of(t) for t in texts]
    if not languages:
        return [(NONE, 0.0)] * len(seen)
    words.learn(set().union(*seen))
    out = []
    for own in seen:
        if not own:
            out.append((NONE, 0.0))
            continue
        lines = np.fromiter(map(words.places.__getitem__, own), np.intp, len(own))
        totals = np.fromiter(own.values(), np.float64, len(own)) @ words.lines[lines]
        best = int(totals.argmax())
        out.append((languages[best], 1.0 / float(np.exp(totals - totals[best]).sum())))
    return out


def predicted(text: Column, model: Model) -> Column:
    """Struct of lang and score (share of the best language, all equally likely)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for texts in batches:
            parts = (texts[i : i + TEXTS] for i in range(0, len(texts), TEXTS))
            rows = [row for part in parts for row in predict(part, words)]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return judge(text)
