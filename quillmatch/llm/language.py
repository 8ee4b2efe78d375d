"""Language ID by error-correcting output codes.

Method: each language has a codeword. For every bit a binary classifier over hashed byte trigrams (log odds of the trigram among the languages whose
bit is set against the others, smoothed, languages weighing alike) gives a margin; the margins are decoded to the codeword of the least loss, where
the loss of a bit is logistic and weighs by how well its classifier tells the two sides apart.

A text is flagged as ambiguous if its best codeword has a posterior under ``CERTAIN``, or if it lies too near the next one: on the bits in which the two
differ, its mean margin is placed between those that texts of either language have as a rule (0: the next, 1: the best), and a place under ``PURE`` says that over a third of
the text is the other language's. The posterior alone rarely tells, as it grows with a text's length whatever the mixture.

Learning counts trigrams of all training rows: a table of languages by ``BUCKETS`` numbers, summed map-side, is all that reaches
the driver; more than ``MOST_LANGUAGES`` languages are an error.

Cases: null texts and texts without a letter are ``und`` with score 0 and no flag; so is everything when no row can be learned from. With one
language its codeword has no bits and the score is 1. A null key is neither held out nor learned from, a null lang isn't learned from. Very long
texts are read whole. Repeated rows stay; empty tables give empty results; columns with the names of results are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.rows import blocks, map_blocks
from quillmatch.llm.words import utf8
from quillmatch.operators.skew import fresh

BUCKETS, MOST_LANGUAGES, CERTAIN, PURE, STEP = 1 << 14, 1_000, 0.6, 2 / 3, 1 << 20
#: Letters and bytes beyond ASCII stand for themselves, all else for a space.
PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram that begins at each byte, offsets of the texts): bucket 0 where it runs over the text's end or holds no letter."""
    data, offsets = utf8(column)
    n = len(data)
    plain = np.full(n + 2, 32, np.uint32)
    plain[:n] = PLAIN[data]
    code = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    blank = code == 0x202020
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(18)
    bucket = np.maximum(code.astype(np.int32), 1)
    bucket[blank] = 0
    for k in (1, 2):
        at = offsets[1:] - k
        bucket[at[at >= offsets[:-1]]] = 0
    return bucket, offsets


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: all ways to part the languages while these are few, else random words far from each other."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        return np.array([c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]).T.astype(float)
    bits, random, best, widest = int(np.ceil(10 * np.log2(n))), np.random.RandomState(0), None, -1
    for _ in range(50):
        words = random.choice((-1.0, 1.0), (n, bits))
        split = np.abs(words.sum(0)) < n
        apart = (bits - words @ words.T) / 2 + np.eye(n) * bits
        if split.all() and apart.min() > widest:
            best, widest = words, apart.min()
    return best


class Model:
    """Weights of each bit's classifier, codewords and the weights of bits in the loss."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.words = codewords(len(languages))
        counts = counts.copy()
        if len(languages):
            counts[:, 0] = 0
        share = (counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * counts.shape[1])
        weights, trust = [], []
        for word in self.words.T:
            on, off = share[word > 0].mean(0), share[word < 0].mean(0)
            w = np.log(on / off)
            w[0] = 0
            weights.append(w.astype(np.float32))
            trust.append(((on - off) * w).sum())  # how far the two sides' expected margins are apart
        self.weights = np.array(weights, np.float32).reshape(len(weights), BUCKETS)
        self.usual = share @ self.weights.T  # (languages, bits): the mean margin of a trigram in texts of a language
        self.trust = np.array(trust) / max(1e-9, sum(trust)) * len(trust) if trust else np.zeros(0)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, bits): summed log odds over the root of their number, and these roots."""
        bucket, offsets = trigrams(column)
        out, root = np.zeros((len(column), len(self.weights))), np.ones(len(column))
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some):
            return out, root
        root[some] = np.sqrt(np.maximum(1, np.add.reduceat((bucket > 0).astype(np.int32), offsets[some])))
        for b, w in enumerate(self.weights):
            out[some, b] = np.add.reduceat(w[bucket], offsets[some]) / root[some]
        return out, root

    def decode(self, margins: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its posterior, the text's place between the next codeword and it)."""
        loss = np.stack([(self.trust * np.logaddexp(0, -word * margins)).sum(1) for word in self.words], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best, row = p.argmax(1), np.arange(len(p))
        score = p[row, best]
        if len(self.words) < 2:
            return best, score, np.ones(len(p))
        others = loss.copy()
        others[row, best] = np.inf
        second = others.argmin(1)
        sign = self.trust * (self.words[best] - self.words[second])  # 0 where the codewords agree
        text, one, two = ((sign * m).sum(1) for m in (margins / root[:, None], self.usual[best], self.usual[second]))
        return best, score, (text - two) / np.maximum(1e-9, one - two)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows that aren't held out."""
    rows = df.where((F.crc32(F.col(f"`{key}`").cast("string")) % 5 != 0) & F.col(f"`{lang}`").isNotNull())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, STEP):
                bucket, offsets = trigrams(block.column(0))
                langs = block.column(1).dictionary_encode()
                names = langs.dictionary.to_pylist()
                of = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.diff(offsets))
                got = np.bincount(of * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, got):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    # In arrays by language, so that few rows reach the driver.
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MOST_LANGUAGES + 1).collect()
    if len(summed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    summed.sort(key=lambda r: r.lang)
    counts = np.zeros((len(summed), BUCKETS))
    for row, r in zip(counts, summed):
        at, n = np.array(r.c, np.int64).T
        row[at] = n
    return Model([r.lang for r in summed], counts)


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Adds the predicted language, its score and the flag of ambiguous texts under ``names``."""

    def make():
        def run(block):
            names, scores, flags = [], [], []
            for part in blocks(block, STEP):
                column = part.column(part.schema.get_field_index(text))
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_pylist()
                if not model.languages:
                    letters = [False] * len(letters)
                    best, score, place = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters))
                else:
                    best, score, place = model.decode(*model.margins(column))
                for ok, b, s, p in zip(letters, best.tolist(), score.tolist(), place.tolist()):
                    names.append(model.languages[b] if ok else "und")
                    scores.append(s if ok else 0.0)
                    flags.append(ok and (s < CERTAIN or p < PURE))
            return [names, scores, flags]

        return run

    return map_blocks(df, make, "`{}` string, `{}` double, `{}` boolean".format(*names))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    predicted = predict(docs.select("doc_id", "text"), learn(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: not ``und``, and a score of ``CERTAIN`` at least, with all their columns, whatever their names. Texts that mix
    languages stay. Learned from the docs themselves."""
    names = tuple(fresh(docs.columns, "lang_pred", "score", "ambiguous"))
    known = predict(docs, learn(docs), "text", names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= CERTAIN))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])
