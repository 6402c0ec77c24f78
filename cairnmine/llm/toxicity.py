"""Toxicity by compression distance.

Two zstandard dictionaries are compared. The ordinary one is trained by zstandard's own trainer on ordinary text. The toxic
one is trained on toxic text: the segments (words) of it that its text explains and ordinary text does not, the most typical
last; the ordinary dictionary's content stands before them, so what is ordinary lies equally near in both and only toxic
segments make a difference. A document is cut into windows of about ``WINDOW`` bytes (at spaces), and once more with windows
shifted by half; each window is compressed with either dictionary, behind a run of ``PAD`` zeros, so that no window is stored
uncompressed and every byte saved shows. The difference of the two lengths says how many bytes the toxic dictionary saved. How
many windows reach each of a range of thresholds, and which part of all windows, go through a calibrated logistic curve to a
score from 0 to 1.

Training. A segment counts once for each different word before it in the sample, so that copies of one text count once. With a
contexts in toxic text against e expected from ordinary text (at equal length), it is toxic if a >= ``LEAST_CONTEXTS``, the
likelihood ratio 2 (a ln(a / e) - a + e) is at least ``EVIDENCE`` (a chance of about one in 100,000) and a > ``RATIO`` e. The
curve is fitted by cross-fitting: every fold of the sample is measured with toxic segments of the other folds, then the final
ones are found in all of it.

Sample: of the labelled rows allowed for training, at most ``MOST_TOXIC`` toxic and ``MOST_ORDINARY`` ordinary documents,
those with the smallest hashes of the text (equal texts count once). Only rows are left out: chosen texts train and calibrate
whole, as they are scored. They stay in a written table; words are counted, the ordinary dictionary is trained (one task, on the
sample's ordinary texts) and windows are measured by executors, so the driver holds the dictionaries and one row of features
for each chosen text.

Defined cases: null, empty or wordless texts have no window and get the curve's value at no evidence; without toxic or
without ordinary training rows every score is 0; labels that are null train nothing; a document with several labels is
toxic if one of them says so; repeated rows each get a row. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, smallest_hashes

WINDOW, PAD, ORDINARY_BYTES, TOXIC_BYTES, TRAINING_WINDOW = 64, bytes(64), 128 << 10, 8 << 10, 512
MOST_TOXIC, MOST_ORDINARY, FOLDS, WORDS_A_BATCH = 1500, 3500, 5, 1 << 16
RATIO, EVIDENCE, LEAST_CONTEXTS, SEGMENT = 10.0, 20.0, 4, (3, 32)
THRESHOLD = 0.7
_SPACES = bytes(i if chr(i).isalnum() and i < 128 or i >= 128 else 32 for i in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, and one space for whatever isn't a letter or digit."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACES).split())


def windows(data: bytes, size: int = WINDOW, shifts: tuple[int, ...] = (0, 1)) -> Iterator[bytes]:
    """The whole text in windows that end at spaces, twice: from its start, and from half a window on."""
    for at in (k * size // 2 for k in shifts):
        while at < len(data):
            to = data.find(b" ", at + size)
            to = min(len(data) if to < 0 else to + 1, at + 4 * size)
            yield data[max(0, at - 1) : to]
            at = to


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, fold, word, before) for each word of the sample; the first word of a text has an empty one before it."""
    for b in batches:
        for toxic, fold, data in zip(b.column("toxic").to_pylist(), b.column("fold").to_pylist(), b.column("plain")):
            words = data.as_py().split()
            before = [b"", *words[:-1]]
            for i in range(0, len(words), WORDS_A_BATCH):
                w = pa.array(words[i : i + WORDS_A_BATCH], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(w), pa.int32()), pa.array([fold] * len(w), pa.int32()), w, pa.array(before[i : i + WORDS_A_BATCH], pa.binary())], ["toxic", "fold", "word", "before"])


def count_words(sample: DataFrame) -> DataFrame:
    """For each word how many different words precede it, by label y: c{y}_{j} without fold j, and c{y}_{FOLDS} in all folds."""
    pairs = sample.mapInArrow(_mentions, "toxic int, fold int, word binary, before binary")
    pairs = pairs.groupBy("word", "toxic", F.xxhash64("before").alias("before")).agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    inside = [~((F.col("low") == j) & (F.col("high") == j)) for j in range(FOLDS)] + [F.lit(True)]  # a context of fold j alone is unknown without it
    counts = [F.count_if((F.col("toxic") == y) & inside[j]).alias(f"c{y}_{j}") for y in range(2) for j in range(FOLDS + 1)]
    return pairs.groupBy("word").agg(*counts)


def toxic_segments(words: DataFrame, sizes: dict[tuple[int, int], int]) -> list[bytes]:
    """The content of the toxic dictionary without each fold, and of all folds; ``sizes``: bytes of text by label and part.

    What passes the tests, and reaches the driver, are words that tell the labels apart in a bounded sample.
    """
    gain = []
    for part in range(FOLDS + 1):
        a = F.col(f"c1_{part}").cast("double")
        e = (F.col(f"c0_{part}") + 0.5) * (max(1, sizes[1, part]) / max(1, sizes[0, part]))
        known = (a >= LEAST_CONTEXTS) & (a > RATIO * e) & (2 * (a * F.ln(a / e) - a + e) >= EVIDENCE)
        gain.append(F.when(known, (a - e) * (F.length("word") + 1)).otherwise(0.0))
    rows = words.where(F.length("word").between(*SEGMENT)).select("word", F.array(*gain).alias("gain")).where(F.array_max("gain") > 0).collect()
    out = []
    for part in range(FOLDS + 1):
        chosen, n = [], 0
        for gained, word in sorted((-r["gain"][part], bytes(r["word"])) for r in rows if r["gain"][part] > 0):
            if (n := n + len(word) + 1) > TOXIC_BYTES:
                break
            chosen.append(word)
        out.append(b" " + b" ".join(reversed(chosen)) + b" " if chosen else b"")
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ordinary dictionary's content; of too little text, the text itself."""
    texts = sorted(data.as_py() for b in batches for data in b.column("plain"))
    pieces = [w for t in texts for w in windows(t, TRAINING_WINDOW, (0,))]
    size = min(ORDINARY_BYTES, sum(map(len, pieces)) // 8)
    try:
        data = zs.train_dictionary(size, pieces).as_bytes()
    except zs.ZstdError:
        data = b" ".join(texts)[-ORDINARY_BYTES:]
    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes  # segments that follow the ordinary content
    weights: tuple[float, ...] | None = None  # of the curve: the constant, then one for each feature

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        """For the ordinary and the toxic dictionary; the first is as long as the second, so that offsets cost the same."""
        out = []
        for data in (self.ordinary + b" " * len(self.toxic), self.ordinary + self.toxic):
            own = zs.ZstdCompressionDict(data or b" " * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
            # tables large enough for every position of the dictionary
            params = zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=18, search_log=6, min_match=5, target_length=64, strategy=zs.STRATEGY_LAZY, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            out.append(zs.ZstdCompressor(dict_data=own, compression_params=params))
        return out[0], out[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ np.array(w[1:]), -30, 30)))


def features(text: bytes, compressors: tuple[zs.ZstdCompressor, zs.ZstdCompressor]) -> list[float]:
    """Windows that saved 1 ... 7 bytes, or more; all windows; parts of them that saved at least 2, 4 or 6 bytes. Square roots."""
    a, b = (c.compress for c in compressors)
    d = np.array([len(a(w)) - len(b(w)) for w in (PAD + x for x in windows(text))] or [0])
    counts = np.bincount(np.clip(d, 0, 8), minlength=9)[1:]
    return [*np.sqrt(counts).tolist(), float(np.sqrt(len(d))), *[float(np.sqrt((d >= k).mean())) for k in (2, 4, 6)]]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _features_by(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [m.compressors() for m in shared.value]
        for b in batches:
            x = [features(t.as_py(), own[k]) for t, k in zip(b.column("plain"), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("h", "toxic", "fold")], pa.array(x, pa.list_(pa.float64()))], ["h", "toxic", "fold", "x"])

    return run


def train(sample: DataFrame, scratch: Scratch) -> Model | None:
    """A model from rows (h, toxic, fold, plain), whose texts are read where they are."""
    seen = sample.groupBy("toxic", "fold").agg(F.sum(F.length("plain")).alias("size")).collect()
    if {r["toxic"] for r in seen} != {0, 1}:
        return None
    sizes = {(y, j): sum(r["size"] for r in seen if r["toxic"] == y and r["fold"] != j) for y in range(2) for j in range(FOLDS + 1)}
    ordinary = bytes(sample.where("toxic = 0").select("plain").coalesce(1).mapInArrow(_train, "data binary").collect()[0]["data"])
    words = scratch.write(count_words(sample), "words")
    *folds, toxic = toxic_segments(words, sizes)
    folds = [Model(ordinary, x) for x in folds]
    rows = sample.mapInArrow(_features_by(sample.sparkSession.sparkContext.broadcast(folds)), "h long, toxic int, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r["fold"], -r["toxic"], r["h"]))
    weights = _fit(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    return Model(ordinary, toxic, weights)


def _plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in ("h", "toxic", "fold")], pa.array([plain(b.column("text")[i].as_py())], pa.binary())], ["h", "toxic", "fold", "plain"])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """A model from the labelled rows whose crc32(id as text) mod 3 is not 1."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null").withColumn("h", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    narrow = rows.select("doc_id", "h").join(marks, "doc_id")  # texts are hashed where they are read, not shuffled
    narrow = scratch.write(narrow.groupBy("h").agg(F.max_by("doc_id", F.struct("toxic", "doc_id")).alias("doc_id"), F.max("toxic").alias("toxic")), "narrow")  # equal texts once
    pick = lambda y, n: smallest_hashes(narrow.where(F.col("toxic") == y), n)
    folds = (F.row_number().over(W.partitionBy("toxic").orderBy("h")) % FOLDS).alias("fold")
    chosen = scratch.write(pick(1, MOST_TOXIC).unionByName(pick(0, MOST_ORDINARY)).select("*", folds), "chosen")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "toxic", "fold", "text")  # whole; at most the sample's rows
    sample = scratch.write(texts.mapInArrow(_plain_rows, "h long, toxic int, fold int, plain binary"), "sample")
    if sample.count() > chosen.count():  # repeated rows
        sample = scratch.write(sample.dropDuplicates(["h"]), "sample")
    return train(sample, scratch)


def _scores(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own = model.compressors() if model else None
        for b in batches:
            if model and b.num_rows:
                x = np.array([features(plain(t.as_py()), own) for t in b.column(b.schema.get_field_index(text_col))])
                score = model.score(x)
            else:
                score = np.zeros(b.num_rows)
            yield b, score

    return run


def score(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scores = _scores(shared, "text")

    def run(batches):
        for b, s in scores(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(is_held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows (all columns) whose score is below the threshold."""
    scores = _scores(docs.sparkSession.sparkContext.broadcast(model), text_col)

    def run(batches):
        for b, s in scores(batches):
            yield b.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
