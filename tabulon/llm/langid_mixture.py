"""Language identification as inference of a mixture of languages.

Each language is a smoothed distribution over hashed letter trigrams; text that none of them explains has a uniform
one. A document's trigrams come from a mixture of these; expectation-maximisation estimates its proportions, first of
all of them, then of the sets that a penalised likelihood prefers: one joins the set only if it raises the log
likelihood by more than `penalty` times the logarithm of the number of trigrams. The prediction is the language with
the largest proportion, its score that proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import release, ship

BUCKETS = 1 << 15
UNDETERMINED = "und"

#: Bytes that end a word count as one space; letters of all scripts beyond ASCII stay as their UTF-8 bytes.
_FOLD = np.full(256, 32, dtype=np.uint8)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _c
_FOLD[128:] = np.arange(128, 256, dtype=np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, in which each run of ASCII non-letters is one space."""
    folded = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    b = folded[keep].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their counts."""
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    release()
    for lang, counts in totals.items():
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["lang", "bucket", "n"])


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Languages in alphabetical order, the probabilities of their trigrams, mixed with a uniform floor, and those of the unknown."""

    def __init__(self, counts: dict[str, np.ndarray], floor: float = 0.02):
        self.langs = sorted(counts)
        share = [(1 - floor) * counts[x] / max(counts[x].sum(), 1) + floor / BUCKETS for x in self.langs]
        self.p = np.array([*share, np.full(BUCKETS, 1 / BUCKETS)], dtype=np.float64).T.copy()

    def proportions(self, found: np.ndarray, counts: np.ndarray, penalty: float = 1.0) -> np.ndarray:
        """The document's share of each language, and of the unknown at the end; shares outside the chosen set are 0.

        The set begins with the likeliest single language; the others, and the unknown, are tried in order of their
        shares in a mixture of all. One whose bound says that it can't raise the likelihood enough needs no trial.
        """
        p, logs, n = self.p[found], np.log(self.p[found]), counts.sum()
        single = counts @ logs
        chosen = [int(np.argmax(single[:-1]))]
        weights, likelihood, least = np.ones(1), single[chosen[0]], penalty * np.log(n + 1)
        order = np.argsort(-self._em(p, counts, n), kind="stable")
        for k in (int(k) for k in order if k != chosen[0]):
            # no mixture is likelier than the largest of its members at each trigram
            if counts @ logs[:, [*chosen, k]].max(axis=1) - likelihood <= least:
                continue
            some = p[:, [*chosen, k]]
            tried = self._em(some, counts, n)
            with_k = counts @ np.log(some @ tried)
            if with_k - likelihood > least:
                chosen.append(k)
                weights, likelihood = tried, with_k
        out = np.zeros(p.shape[1])
        out[chosen] = weights
        return out

    @staticmethod
    def _em(p, counts, n, near=1e-3, steps=200):
        """The shares of `p`'s columns, from equal ones until no share moves by `near` (or for so many steps)."""
        shares = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(steps):
            joint = p * shares
            new = (counts / joint.sum(axis=1)) @ joint / n
            if np.abs(new - shares).max() < near:
                return new
            shares = new
        return shares


def train(docs: DataFrame, per_lang: int = 1500, max_langs: int = 200) -> Model:
    """Learn from text and lang of the labelled documents that are not held out.

    Of each language about `per_lang` documents are used, or all if it has fewer: those whose hashes (of doc_id and
    text) are below a share of their range, a bound that the corpus doesn't move and that needs no task to see a
    whole language. More than `max_langs` languages are an error: the model, which the driver gathers and broadcasts,
    has 256 KB for each, 52 MB at most.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = labelled.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("rows")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    per = spark.createDataFrame([tuple(r) for r in counts], "of string, rows long")
    range_of = 1 << 20
    few = F.pmod(F.xxhash64("doc_id", "text"), F.lit(range_of)) * F.col("rows") < per_lang * range_of
    chosen = labelled.join(F.broadcast(per), F.col("lang") == F.col("of")).filter(few).select("lang", "text")
    counts = chosen.mapInArrow(_count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language, of BUCKETS pairs at most
    listed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for r in listed.toLocalIterator():
        by_lang[r.lang] = np.zeros(BUCKETS, dtype=np.float64)
        by_lang[r.lang][r.buckets] = r.n
    return Model(by_lang)


def _told(model: Model, text: str | None) -> tuple[np.ndarray, float] | None:
    """A text's shares and its number of trigrams; None for one without a letter, or without a model."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return None
    found, counts = counted(text)
    return (model.proportions(found, counts), counts.sum()) if len(found) else None


def _predict(model):
    """Predictions for (doc_id, held_out, text) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = [*m.langs, UNDETERMINED]
        for batch in batches:
            langs, scores, mixtures = [], [], []
            for text in batch.column(2):
                shares, _ = _told(m, text.as_py()) or (None, 0)
                top = None if shares is None else int(np.argmax(shares[:-1]))
                langs.append(UNDETERMINED if top is None else names[top])
                scores.append(0.0 if top is None else float(min(1.0, shares[top])))
                mixtures.append([] if top is None else [(names[k], float(shares[k])) for k in np.flatnonzero(shares)])
            arrays = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "mixture"])
        release()

    return run


def identify(docs: DataFrame, labelled: DataFrame | None = None, per_lang: int = 1500) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score, mixture (language to proportion, `und` for what no language explains).

    The prediction sees the whole text only. `und` with score 0 stands for a null text, one without a letter,
    and all documents where nothing labelled can be learned from. Ties go to the language first in the
    alphabet. Repeated rows are predicted each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs if labelled is None else labelled, per_lang))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string,double>")


def in_known_language(docs: DataFrame, least: float = 0.5, few: int = 40, per_lang: int = 1500) -> DataFrame:
    """The documents of `docs`, all columns, with a letter, of whose text the known languages explain `least` at least.

    The rest, the mixture's unknown part, is likelier under no language: other languages, scripts and junk. Texts of
    less than `few` trigrams (some seven words) are too short to be rejected. Null and empty texts leave.
    Where nothing labelled can be learned from, all texts with a letter stay. Repeated rows stay or leave together; an
    empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))

    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for batch in batches:
            keep = []
            for text in batch:
                text = text.as_py()
                told = _told(m, text)
                keep.append(any(map(str.isalpha, text or "")) if told is None and not m.langs else bool(told and (told[1] < few or 1 - told[0][-1] >= least)))
            yield pa.array(keep, pa.bool_())
        release()

    known.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # only texts go to Python; the other columns wait
    return docs.filter(F.arrow_udf(known, "boolean")(F.col("text")))
