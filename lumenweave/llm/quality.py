"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is trained on documents labelled as good; its counts meet in Spark by shard and stay there as sorted files of
the shared folder. Each document block's n-grams are dealt by shard and joined with the counts of that shard, so neither
the driver nor a broadcast ever holds the model. A document goes if its perplexity lies beyond a quantile of all trusted
texts of its language that the model has not learnt from, long ones too.

Tokens are runs of letters, of digits and of other characters. Words are folded to lower case; words rare in trusted
text stand for their shape. A token equal to the one before it is a token of its own, and another after several such
in a row.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .blocks import _BYTES, LOWER, Words, blocks, mix, powers
from .ngrams import DEALT, Deal, File, dealt_counts, put, shard_of, sorted_keys
from .shared import fresh, prepare, text_column, unused, width, written

ORDER = 3
#: Trusted documents to learn from, at most, unless asked otherwise; one in five of them is held out for the thresholds.
MOST_TRUSTED = 4000
#: Share of trusted documents not learnt from within the threshold, and what the threshold is stretched by.
QUANTILE, STRETCH = 0.99, 1.15
#: Trusted documents not learnt from that a language needs for a threshold of its own.
ENOUGH = 40
RARE = 2
#: Steps of a doubling of perplexity that thresholds are rounded up to.
GRAIN = 4096
#: Repetitions in a row after which further ones are a token of their own, which hardly any trusted text holds.
CHANT = 5

U = np.uint64
_SHAPES = {"lower": U(11), "title": U(12), "upper": U(13), "digits": U(14), "marks": U(15), "again": U(16), "chant": U(20)}
_START, _END, _LINE = U(17), U(18), U(19)
#: Classes of bytes: 0 white space, 1 letters and non-ASCII, 2 digits, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


class Tokens:
    """Tokens of a block: hash, shape, owner; each text begins with ORDER - 1 starts and ends in an end."""

    def __init__(self, texts: list[bytes]):
        w = _Runs(texts)
        size = w.end - w.start
        ups = np.concatenate(([0], np.cumsum(_UPPER[w.plain])))
        ups = ups[w.end] - ups[w.start]
        kind = _CLASS[w.plain[w.start]] if len(w.start) else np.empty(0, np.uint8)
        first_up = _UPPER[w.plain[w.start]] if len(w.start) else np.empty(0, np.int64)
        shape = np.select([kind == 2, kind == 3, (ups > 1) & (2 * ups > size), first_up > 0], [_SHAPES["digits"], _SHAPES["marks"], _SHAPES["upper"], _SHAPES["title"]], _SHAPES["lower"]).astype(U)
        hash_ = np.where(shape == _SHAPES["upper"], w.hash ^ U(1), w.hash)
        again = np.zeros(len(hash_), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
        at = np.arange(len(again))
        chant = at - np.maximum.accumulate(np.where(again, 0, at)) >= CHANT
        for own, name in ((again, "again"), (chant, "chant")):
            hash_, shape = np.where(own, _SHAPES[name], hash_), np.where(own, _SHAPES[name], shape)
        docs, pad = len(texts), ORDER  # starts, and one end
        n = len(hash_) + docs * pad
        place = np.arange(len(hash_)) + w.owner * pad + ORDER - 1
        self.hash, self.shape = np.full(n, _START), np.full(n, _START)
        self.hash[place], self.shape[place] = hash_, shape
        last = w.first[1:] + np.arange(docs) * pad + ORDER - 1
        self.hash[last] = self.shape[last] = _END
        self.owner = np.repeat(np.arange(docs), w.count + pad)
        self.count = w.count + 1
        self.real = np.flatnonzero(self.hash != _START)


class _Runs(Words):
    """Runs of one class of characters."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.plain = np.frombuffer(self.raw, np.uint8)
        self.buf = LOWER[self.plain]
        kind = _CLASS[self.plain]
        edge = np.flatnonzero(np.diff(kind, prepend=0) != 0)
        stop = np.append(edge[1:], len(kind))
        word = kind[edge] > 0
        self.start, self.end = edge[word], stop[word]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        up, down = powers(len(self.buf))
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum(_BYTES[self.buf] * up, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])


class Known:
    """The words that trusted text holds often enough: sorted files by shard in the shared folder."""

    def __init__(self, about: dict):
        self.uri, self.shards, self.there, self.open = about["uri"], about["shards"], set(about["files"]), {}

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(words), bool), shard_of(words, self.shards)
        for s in np.unique(shard).tolist():
            if s in self.there:
                if s not in self.open:
                    self.open[s] = File(f"{self.uri}/known-{s}")
                rows = np.flatnonzero(shard == s)
                out[rows] = self.open[s].find(0, words[rows])[1]
        return out


def _fold(t: Tokens, known) -> np.ndarray:
    """Each token that is known, and the shape of each other one."""
    words, at = np.unique(t.hash, return_inverse=True)
    return np.where(known(words)[at], t.hash, t.shape)


def _word_batches(shards: int, batches):
    for b in batches:
        texts = [x.encode() for x in b.column("text").to_pylist()]
        for first, last in blocks(texts):
            t = Tokens(texts[first:last])
            h, n = np.unique(t.hash[t.real], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards)), pa.array(h.view(np.int64)), pa.array(n)], names=["shard", "h", "n"])


def _store_known(uri: str, batches):
    """Stores the words of a partition, which is one shard."""
    parts = [(b.column(0), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        shard = parts[0][0][0].as_py()
        put(f"{uri}/known-{shard}", sorted_keys(np.unique(np.concatenate([x for _, x in parts]).view(U)), True))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])


def _known(about: dict) -> Known:
    if about["uri"] not in _kept:
        _kept[about["uri"]] = Known(about)
    return _kept[about["uri"]]


def _gram_batches(deal: Deal, about: dict, batches):
    def sequences():
        for b in batches:
            texts = [x.encode() for x in b.column("text").to_pylist()]
            for first, last in blocks(texts):
                t = Tokens(texts[first:last])
                yield _fold(t, _known(about)), t.real

    yield from dealt_counts(deal, ORDER, sequences())


_kept: dict = {}


def perplexities(model: ngrams.Model, known, texts: list[bytes]) -> np.ndarray:
    out = []
    for first, last in blocks(texts, ngrams.SCORED):
        t = Tokens(texts[first:last])
        total = np.bincount(t.owner[t.real], model.log10(_fold(t, known), t.real)[0], last - first)
        out.append(10 ** (-total / t.count))
    return np.concatenate([*out, np.empty(0)])


def _score_batches(about: dict, known: dict, own: str, batches):
    if about["uri"] not in _kept:
        _kept.clear()
        _kept[about["uri"]] = ngrams.Model(about)
    model, words = _kept[about["uri"]], _known(known)
    for b in batches:
        got = perplexities(model, words, [(x or "").encode() for x in b.column(own).to_pylist()])
        names = [n for n in b.schema.names if n != own or own == "text"]
        yield pa.RecordBatch.from_arrays([pa.array(got) if n == "perplexity" else b.column(n) for n in names], names=names)


def _language(docs: DataFrame):
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").alias("own_id")).where("own_id is not null").distinct()


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRUSTED) -> tuple[dict, dict, DataFrame]:
    """What describes the model, and its known words; and the ids (own_id) that it is learnt from.

    Trusted documents are those labelled quality 1; of more than `most`, those of the smallest hash of doc_id are taken,
    whole, whatever their length; of them four in five are learnt from. Without trusted documents nothing is known.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = width(spark)
    chosen = _trusted(labels).orderBy(F.xxhash64("own_id"), "own_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_column(docs).alias("text")).join(F.broadcast(chosen), "own_id")
    sample = written(own.where(F.pmod(F.xxhash64("own_id", F.lit(1)), F.lit(5)) != 0), "trusted")
    learn, uri = sample.select("text"), fresh(spark, "known")
    counts = learn.mapInArrow(partial(_word_batches, n), "shard int, h long, n long").groupBy("shard", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE)
    files = counts.select("shard", "h").repartitionById(n, "shard").mapInArrow(partial(_store_known, uri), "shard int").collect()
    known = {"uri": uri, "shards": n, "files": sorted(r.shard for r in files)}
    # a bounded sample has no word that is too much for a shard
    deal = Deal(n, n, [], [], [])
    about = ngrams.stored(learn.mapInArrow(partial(_gram_batches, deal, known), DEALT), deal, ORDER)
    return about, known, sample.select("own_id").distinct()


def thresholds(scored: DataFrame, labels: DataFrame, learnt: DataFrame) -> dict:
    """Perplexity limits by language (None: of all) from all scored trusted documents (doc_id, lang, perplexity) that the model has not learnt from.

    Perplexities are rounded up by less than 1/5000, so that a quantile holds a bounded number of values; without
    trusted documents there is no limit.
    """
    rows = scored.select(F.col("doc_id").cast("long").alias("own_id"), _language(scored).alias("lang"), "perplexity")
    held = rows.join(_trusted(labels), "own_id").join(F.broadcast(learnt), "own_id", "left_anti")
    top = F.percentile(F.ceil(F.log2("perplexity") * GRAIN) / GRAIN, QUANTILE)
    found = held.rollup("lang").agg(F.count("*").alias("n"), top.alias("top"), F.grouping("lang").alias("every")).where(f"every = 1 or n >= {ENOUGH}").collect()
    limits = {None if r.every else r.lang: 2**r.top * STRETCH for r in found if r.top is not None}
    return {None: float("inf")} | limits


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, most: int = MOST_TRUSTED) -> DataFrame:
    """docs, or the given columns of it, with perplexity and accepted added (columns of those names are replaced), by a model trained on labels' good documents.

    most: trusted documents to learn from, at most. One row for each row. Null and empty texts hold only the end, and are
    accepted or not by its perplexity like any other. A null language is one of its own, like the empty string; a language
    with fewer than ENOUGH trusted documents outside the sample has the threshold of all languages. The threshold is the
    quantile of those documents' perplexities times STRETCH, so that clean documents a little beyond it stay. An empty
    table gives an empty table.
    """
    about, known, learnt = train(docs, labels, most)
    rows = (docs.select(*columns) if columns else docs).drop("perplexity", "accepted").withColumn("perplexity", F.lit(0.0))
    own = "text" if dict(rows.dtypes).get("text") == "string" else unused("own_text", docs.columns)
    asked = docs.withColumn("perplexity", F.lit(0.0)).withColumn(own, text_column(docs) if own != "text" else F.col("text"))
    asked = asked.select(*rows.columns, *([own] if own != "text" else []))
    scored = written(asked.mapInArrow(partial(_score_batches, about, known, own), rows.schema), "scored")
    limits = thresholds(scored, labels, learnt)
    every = F.lit(limits.pop(None))
    own_limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), _language(scored)) if limits else F.lit(None).cast("double")
    return scored.withColumn("accepted", F.col("perplexity") <= F.coalesce(own_limit, every))


def op9_quality(spark, sf_dir):
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), ["doc_id", "lang"]).select("doc_id", "lang", "perplexity", "accepted")
