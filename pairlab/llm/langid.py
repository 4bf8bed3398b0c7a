"""Language identification by segmentation-marginalised unigram models over a fixed vocabulary.

Each language has a probability for every piece of a public SentencePiece vocabulary. A word (a
run of letters, lowered, with the word mark before it) has as its probability the sum over all its
segmentations into pieces, by a forward pass; a text's is the product over its words, and the
likeliest language is the prediction. The score is the language's posterior, under equal priors, for
a word of the text's geometric mean probability: a text of many words doesn't drive it to 0 or 1, and
text that no language explains better than the others scores low at any length.

The piece probabilities are fitted by expectation maximisation, with forward and backward passes, on
a bounded sample of labelled rows: at most ``docs_per_lang`` whole texts (those with the smallest
hashes of id and text) of each language. The model's memory grows with the languages, so at most
``max_langs`` are learned, those with the most different labelled rows; labels beyond are never predicted. Runs of
over LONGEST letters, as scripts without spaces have them, are cut into such stretches for fitting;
scoring takes every run whole.

Defined cases: a null text, or one with no letter, is ``und`` with score 0, and so is every text if
no row is labelled; null labels are not learned from; a null id is never learned from; a repeated row
is learned from once; ties go to the language first in code point order; repeated rows get equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pairlab.llm.common import in_worker, text_slices
from pairlab.llm.tokens import Numbered, vocabulary_path

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"
#: Probability of a single character that is no piece, and the share of unseen pieces' counts.
_CHARACTER, _UNSEEN = 1e-7, 0.01
#: Letters of a stretch that is fitted as a whole.
LONGEST = 40
#: Distinct words, and their letters, whose scores a worker keeps; a bound of memory.
KEPT_WORDS, KEPT_CHARS = 200_000, 8_000_000


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary: number of each piece that consists of letters after the word mark, if it has one."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=vocabulary_path(name))
        found = [p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).removeprefix(_MARK).isalpha() or p == _MARK]
        self.number = {p: i for i, p in enumerate(found)}
        self.longest = max(map(len, found))
        self.absent, self.other = len(found), len(found) + 1  # rows of no piece and of a lone character

    def lattice(self, batch: list[str]):
        """For words of one length, with the mark: (from, to, piece numbers) of all spans, by end."""
        n, get = len(batch[0]), self.number.get
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                missing = self.other if j - i == 1 else self.absent
                yield i, j, np.fromiter((get(w[i:j], missing) for w in batch), np.int32, len(batch))


def by_length(items: list[str]) -> dict[int, list[str]]:
    out = defaultdict(list)
    for w in items:
        out[len(w)].append(w)
    return out


def log_scores(pieces: Pieces, probs: np.ndarray, items: list[str]) -> dict[str, np.ndarray]:
    """log probability of each word under each language (a column of probs), all segmentations summed."""
    out = {}
    for n, group in by_length([_MARK + w for w in items]).items():
        for at in range(0, len(group), 20_000):
            batch = group[at : at + 20_000]
            shape = (len(batch), probs.shape[1])
            alpha, scale = {0: np.ones(shape)}, np.zeros(shape)
            for i, j, ids in pieces.lattice(batch):
                if j not in alpha:
                    alpha[j] = np.zeros(shape)
                    alpha.pop(j - pieces.longest - 1, None)
                    if j > 1 and (low := alpha[j - 1] < 1e-120).any():  # keeps long words from vanishing
                        factor = np.where(low, 1e120, 1.0)
                        scale -= np.log(factor)
                        for k in alpha:
                            alpha[k] = np.minimum(alpha[k] * factor, 1e150)
                alpha[j] += alpha[i] * probs[ids]
            logs = np.log(np.maximum(alpha[n], 1e-300)) + scale
            out.update(zip((w[1:] for w in batch), logs))
    return out


def fit(pieces: Pieces, counts: dict[str, int], rounds: int) -> np.ndarray:
    """Piece probabilities from word counts: substring counts first, then expectation maximisation."""
    size = len(pieces.number) + 2
    stretches: Counter = Counter()
    for w, n in counts.items():
        marked = _MARK + w
        for at in range(0, len(marked), LONGEST + 1):
            stretches[marked[at : at + LONGEST + 1]] += n
    groups = by_length(list(stretches))
    weight = {n: np.array([stretches[w] for w in g], float) for n, g in groups.items()}
    spans = {n: list(pieces.lattice(g)) for n, g in groups.items()}

    def normalised(found: np.ndarray) -> np.ndarray:
        found = found[:-2] + _UNSEEN
        return np.append(found / found.sum(), [0.0, _CHARACTER])

    first = np.zeros(size)
    for n, own in spans.items():
        for _, _, ids in own:
            first += np.bincount(ids, weight[n], size)
    probs = normalised(first)
    for _ in range(rounds):
        found = np.zeros(size)
        for n, own in spans.items():
            shape = len(groups[n])
            alpha = [np.ones(shape)] + [np.zeros(shape) for _ in range(n)]
            beta = [np.zeros(shape) for _ in range(n)] + [np.ones(shape)]
            for i, j, ids in own:
                alpha[j] += alpha[i] * probs[ids]
            for i, j, ids in reversed(own):
                beta[i] += beta[j] * probs[ids]
            share = weight[n] / np.maximum(alpha[n], 1e-300)
            for i, j, ids in own:
                found += np.bincount(ids, alpha[i] * probs[ids] * beta[j] * share, size)
        probs = normalised(found)
    return probs


def held_out(id_col: Column) -> Column:
    """Whether the checksum of the id as text leaves 0 modulo 5; a null id counts as held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model", docs_per_lang: int = 400, max_langs: int = 200, rounds: int = 3
) -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and the matrix (piece, language) of probabilities."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")
    )
    # At most max_langs rows. Different rows count: the bound below is one on their hashes.
    most = labelled.groupBy("lang").agg(F.count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not most:
        return [], np.zeros((0, 0))
    # A hash bound draws about half as many again as are wanted, so what is ranked doesn't grow with the table.
    bounds = F.create_map(*[F.lit(x) for r in most for x in (r.lang, min(1.0, (1.5 * docs_per_lang + 60) / r.n))])
    drawn = labelled.filter(((F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)) <= bounds[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("h")
    sample = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= docs_per_lang)

    def learn(pdf):
        import pandas as pd

        counts = Counter(w for t in pdf["text"] for w in words(t))
        probs = fit(Pieces(vocabulary), counts, rounds)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "probs": [probs.tolist()]})

    # At most max_langs rows of the vocabulary's size, each from docs_per_lang texts at most.
    rows = sorted(sample.select("lang", "text").groupBy("lang").applyInPandas(learn, "lang string, probs array<double>").collect())
    return [r.lang for r in rows], np.array([r.probs for r in rows]).T


class Scorer:
    """Scores texts in a worker; keeps the scores of words that it has met."""

    def __init__(self, langs: list[str], probs: np.ndarray, vocabulary: str):
        self.langs, self.probs, self.pieces = langs, probs, Pieces(vocabulary)
        self._reset()

    def _reset(self):
        self.known = Numbered()
        self.chars = 0
        self.rows = np.zeros((1 << 14, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        keys, counts = [], []
        for t in texts:
            own = words(t) if t else []
            if own and not any(c.isalpha() for w in own for c in w):
                own = []
            keys += own
            counts.append(len(own))
        if not keys or not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.known) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self._reset()
        index = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        if new := self.known.take_new():
            while len(self.known) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.chars += sum(map(len, new))
            for w, s in log_scores(self.pieces, self.probs, new).items():
                self.rows[self.known[w]] = s
        counts = np.array(counts)
        filled = np.flatnonzero(counts)
        totals = np.add.reduceat(self.rows[index], (np.cumsum(counts) - counts)[filled], axis=0)
        best = totals.argmax(axis=1)
        mean = totals / counts[filled, None]
        posterior = 1.0 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
        langs, out = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for i, b, p in zip(filled.tolist(), best.tolist(), posterior.tolist()):
            langs[i], out[i] = self.langs[b], p
        return langs, out


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model", docs_per_lang: int = 400, max_langs: int = 200, rounds: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every row with held_out, lang_pred and score; ``keep`` names input columns to carry as kept_<name>."""
    langs, probs = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, vocabulary=vocabulary, docs_per_lang=docs_per_lang, max_langs=max_langs, rounds=rounds)
    # At most max_langs times the vocabulary's pieces: its size doesn't depend on the corpus.
    model = docs.sparkSession.sparkContext.broadcast((langs, probs))
    key = hash((tuple(langs), probs.tobytes(), vocabulary))

    carried = [c for c in keep if c != text_col]

    def run(batches):
        scorer = in_worker(("language scorer", key), lambda: Scorer(*model.value, vocabulary))
        for b in text_slices(batches, 0):
            lang, score = scorer.predict(b.column(0).to_pylist())
            columns = dict(zip(b.schema.names, b.columns))
            columns |= {f"kept_{text_col}": columns.pop("text"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    source = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        *[F.col(c).alias(f"kept_{c}") for c in carried],
    )
    out = StructType([*source.schema.fields[1:], *([StructField(f"kept_{text_col}", StringType())] if text_col in keep else []), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = out.fieldNames()
    return source.mapInArrow(run, out)
