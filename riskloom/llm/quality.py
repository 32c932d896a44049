"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus, and base rules.

Both multinomials are over hashed byte n-grams of two lengths, ``BUCKETS`` buckets each: the raw one counts every text,
the target one the trusted texts (labels.quality = 1) among at most ``SAMPLE_ROWS`` labelled rows, those whose ids come
first by a fixed hash. A document's score is its mean log ratio over all its n-grams; it is kept if that is at least a
threshold that is fixed from the same labelled sample (see :func:`_threshold`) before any document is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices, unit_hash, written

NGRAM_BYTES = (2, 4)
BUCKETS = 1 << 14
SAMPLE_ROWS = 20_000
SMOOTHING = 0.5
#: Bytes of a text that are hashed at a time.
PIECE_BYTES = 1 << 20
#: Share of trusted sample texts that the threshold may turn away.
TRUSTED_LOSS = 0.002
#: What the cut may lose of the best separation to be more lenient.
LENIENCE = 0.03
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def _buckets(data: bytes) -> np.ndarray:
    """Bucket of each n-gram, lengths one after the other; lengths have buckets of their own."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = []
    for k, n in enumerate(NGRAM_BYTES):
        if len(raw) >= n:
            code = np.zeros(len(raw) - n + 1, dtype=np.uint32)
            for i in range(n):
                code = code * np.uint32(0x01000193) + raw[i : len(raw) - n + 1 + i]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(((code ^ (code >> np.uint32(12))) % np.uint32(BUCKETS)).astype(np.int64) + k * BUCKETS)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, by pieces of bounded size. A piece reaches into the next one as far as the n-grams that
    begin in it; what a short end repeats of the last piece is cut off."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= PIECE_BYTES:
        yield _buckets(data)
        return
    for k, n in enumerate(NGRAM_BYTES):
        for at in range(0, len(data) - n + 1, PIECE_BYTES):
            found = _buckets(data[at : at + PIECE_BYTES + n - 1])
            yield found[(found >= k * BUCKETS) & (found < (k + 1) * BUCKETS)]


def _counts(texts: list[str | None]) -> np.ndarray:
    total = np.zeros(BUCKETS * len(NGRAM_BYTES), dtype=np.int64)
    held: list[np.ndarray] = []
    for text in texts:
        for found in _pieces(text):
            held.append(found)
            if sum(map(len, held)) >= PIECE_BYTES:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held = []
    return total + np.bincount(np.concatenate(held), minlength=len(total)) if held else total


@dataclass(frozen=True)
class QualityModel:
    """ratio: log(target / raw) by bucket; threshold: the least mean ratio that is kept."""

    ratio: np.ndarray
    threshold: float

    def score(self, text: str | None) -> float:
        """Mean log ratio; 0.0 for a text without n-grams."""
        total, n = 0.0, 0
        for found in _pieces(text):
            total, n = total + float(self.ratio[found].sum()), n + len(found)
        return total / n if n else 0.0


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(sample_id, good, text) of the rows of at most ``sample_rows`` labelled ids, those first by a fixed hash. Ids are compared
    as text, whatever their type."""
    key = F.col("doc_id").cast("string")
    known = labels.where(key.isNotNull() & F.col("quality").isNotNull()).groupBy(key.alias("sample_id")).agg((F.max("quality") == 1).alias("good"))
    known = written(docs.sparkSession, known.orderBy(unit_hash("quality", F.col("sample_id")), "sample_id").limit(sample_rows), "quality-sample")
    rows = docs.select(key.alias("own_id"), "text").join(F.broadcast(known), F.col("own_id") == F.col("sample_id")).select("sample_id", "good", "text")
    return written(docs.sparkSession, rows, "quality-texts")


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The most lenient cut that parts the sample within ``LENIENCE`` as well as the best does (share of rejects turned away
    less share of trusted turned away) among those that lose at most ``TRUSTED_LOSS`` of the trusted, moved halfway to
    the next reject below. Below every score if the sample has only one class."""
    if not good.any() or good.all():
        return -np.inf
    trusted, rejects = np.sort(scores[good]), np.sort(scores[~good])
    cuts = np.unique(np.concatenate((trusted[: int(TRUSTED_LOSS * len(trusted)) + 1], rejects[rejects <= trusted[int(TRUSTED_LOSS * len(trusted))]])))
    gain = np.searchsorted(rejects, cuts, "left") / len(rejects) - np.searchsorted(trusted, cuts, "left") / len(trusted)
    cut = float(cuts[np.flatnonzero(gain >= gain.max() - LENIENCE)[0]])
    below = rejects[rejects < cut]
    return (cut + float(below[-1])) / 2 if len(below) else cut


def _summed(texts: DataFrame) -> np.ndarray:
    """N-gram counts of a column of texts. Only vectors of fixed length, one for each task, leave the tasks."""

    def count(batches):
        total = np.zeros(BUCKETS * len(NGRAM_BYTES), dtype=np.int64)
        for batch in slices(batches):
            total += _counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS * len(NGRAM_BYTES), dtype=np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of the two smoothed multinomials, by bucket; 0 without target texts."""
    ratio = np.zeros(len(raw))
    for k in range(len(NGRAM_BYTES)):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        if target[own].sum():
            ratio[own] = np.log((target[own] + SMOOTHING) / (target[own].sum() + SMOOTHING * BUCKETS)) - np.log((raw[own] + SMOOTHING) / (raw[own].sum() + SMOOTHING * BUCKETS))
    return ratio


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Counts over every text of ``docs``; the target and the threshold from the labelled sample, whose texts alone are scored
    here. The driver collects two vectors and one score for each sampled id, its least one."""
    sample = _sample(docs, labels, sample_rows)
    model = QualityModel(log_ratio(_summed(sample.where("good").select("text")), _summed(docs.select("text"))), -np.inf)

    def score(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["sample_id", "good", "score"])

    scored = sample.mapInArrow(score, "sample_id string, good boolean, score double").groupBy("sample_id", "good").agg(F.min("score")).collect()
    return QualityModel(model.ratio, _threshold(np.array([s for *_, s in scored]), np.array([g for _, g, _ in scored], dtype=bool)))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows of ``window`` words that are found twice or more, the first of them included. Windows are
    compared by a 64-bit hash of their words' hashes."""
    if len(words) <= window:
        return 0
    codes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    code = np.zeros(len(words) - window + 1, dtype=np.uint64)
    for i in range(window):
        code = code * np.uint64(0x9E3779B97F4A7C15) + each[i : len(words) - window + 1 + i]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines, seen = 0, set()
    for line in data.split(b"\n"):
        if line.strip(BLANKS):
            lines += line in seen
            seen.add(line)
    return len(words), len(text) - sum(data.count(c) for c in BLANKS), sum(data.count(c) for c in SYMBOLS), lines, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row of ``docs``: doc_id, the five rule counts, base_failed, kept, score.

    Null and empty texts have no words and fail the base rules. A text of under 2 bytes scores 0. Repeated rows are each
    judged; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [rules(t) for t in texts]
            failed = [base_failed(x[0], x[4]) for x in found]
            scores = [model.score(t) for t in texts]
            kept = [not f and s >= model.threshold for f, s in zip(failed, scores, strict=True)]
            columns = [batch.column(0), *[pa.array([x[k] for x in found], pa.int64()) for k in range(5)], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_failed", "kept", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, score double")


def filter_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs``, all columns, without those that :func:`judge` rejects."""
    at = docs.schema.names.index("text")

    def run(batches):
        for batch in slices(batches):
            keep = []
            for text in batch.column(at).to_pylist():
                found = rules(text)
                keep.append(not base_failed(found[0], found[4]) and model.score(text) >= model.threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
