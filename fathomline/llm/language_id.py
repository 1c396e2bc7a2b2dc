"""Language identification with bit-sliced Bloom filters over byte n-grams.

Slot ``i`` of the filter holds one bit a language; ANDing the slots of an n-gram's hashes gives all
languages whose filter has it. For every text the hits of each language are counted, corrected for
the language's false-positive rate, and the largest count decides.

Training takes a bounded sample of labelled rows a language (about ``sample_docs``, by hash of text and
position, so copies of one text are drawn one by one) of the ``most_languages`` most frequent languages,
and keeps the ``grams`` most frequent n-grams of each order; counting them is a Spark aggregation. Prediction is one
narrow map that works in windows of bytes, whatever the lengths of texts, and ships one array whose
size the parameters fix.

``und``: null texts, texts without any letter, and all texts if nothing was learned; their score is 0.
A text none of whose n-grams is known gets the most frequent training language and score 0. Ties go
to the most frequent training language, then to the name that sorts first. Repeated rows each get their row; empty tables give empty
results; other columns are not read in prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, kept_rows, output
from .unit_encoder import _bytes_of

BATCH_BYTES, WINDOW_BYTES = 2_000_000, 500_000
ORDERS = (3, 5)
#: Bounds of training: labelled rows a language, n-grams kept a language and order, bits of a filter's slot number, and languages.
SAMPLE_DOCS, GRAMS, SLOT_BITS, MOST_LANGUAGES = 2000, 20_000, 20, 1000
HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: str
    slots: np.ndarray  # (2**slot_bits, words) of uint8 or uint64
    false_positive: np.ndarray


def grams_of(raw: np.ndarray, order: int) -> np.ndarray:
    """Each n-gram of folded bytes as one number, tagged with its order."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(n, order, np.uint64)
    for k in range(order):
        value <<= np.uint64(8)
        value |= raw[k : k + n]
    return value


def _blank(order: int) -> int:
    return int(grams_of(np.full(order, 32, np.uint8), order)[0])


def _windows(raw: np.ndarray, offsets: np.ndarray, order: int):
    """(n-grams, document of each) over the bytes in windows; n-grams that leave their document or are blank are left out."""
    for at in range(0, max(len(raw) - order + 1, 0), WINDOW_BYTES):
        grams = grams_of(raw[at : at + WINDOW_BYTES + order - 1], order)
        place = at + np.arange(len(grams))
        doc = np.searchsorted(offsets, place, side="right") - 1
        keep = (place + order <= offsets[doc + 1]) & (grams != np.uint64(_blank(order)))
        yield grams[keep], doc[keep]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS, slot_bits: int = SLOT_BITS, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learns from rows with a text and a language."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    languages = sorted(found)
    if not languages:
        return LanguageModel([], UNKNOWN, np.zeros((1, 1), np.uint8), np.zeros(0))
    below = [(name, int(min(1.0, sample_docs / n) * (1 << 30))) for name, n in found.items()]
    chance = docs.sparkSession.createDataFrame(below, "of string, below long")
    drawn = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30))
    sample = rows.withColumn("drawn", drawn).join(F.broadcast(chance), F.col("lang") == F.col("of")).where("drawn < below").select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def counted(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            lang = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            raw, offsets = _bytes_of(batch.column("text"))
            raw = _FOLD[raw]
            for order in ORDERS:
                held: dict[str, list[np.ndarray]] = {}
                for gram, doc in _windows(raw, offsets, order):
                    own = lang[doc]
                    for name in set(own):
                        held.setdefault(name, []).append(gram[own == name])
                for name, parts in held.items():
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield output(schema, [[name] * len(gram), gram.astype(np.int64), n])

    table = sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.shiftright("gram", 24).cast("int")  # order 3 leaves its tag above 24 bits
    best = Window.partitionBy("lang", F.when(order == 3, 3).otherwise(5)).orderBy(F.desc("n"), "gram")
    kept = table.withColumn("place", F.row_number().over(best)).where(F.col("place") <= grams).select("lang", "gram").toPandas()
    return build(languages, min(languages, key=lambda x: (-found[x], x)), {k: v["gram"].to_numpy(np.int64).view(np.uint64) for k, v in kept.groupby("lang")}, slot_bits)


def build(languages: list[str], prior: str, grams: dict[str, np.ndarray], slot_bits: int = SLOT_BITS) -> LanguageModel:
    """The bit-sliced filter of the languages' n-grams."""
    words = -(-len(languages) // 64)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((1 << slot_bits, words), kind)
    rates = []
    for i, name in enumerate(languages):
        bit = kind(1 << (i % 64))
        for at in _places(grams.get(name, np.zeros(0, np.uint64)), slot_bits):
            slots[at, i // 64] |= bit
        full = np.count_nonzero(slots[:, i // 64] & bit) / len(slots)
        rates.append(full ** len(HASHES))
    return LanguageModel(languages, prior, slots, np.asarray(rates))


def _places(grams: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    return [((grams * h) >> np.uint64(64 - slot_bits)).astype(np.int64) for h in HASHES]


def hits(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: hits a language (corrected), n-grams in all, whether it has a letter."""
    import regex

    raw, offsets = _bytes_of(texts)
    folded = _FOLD[raw]
    docs, width = len(texts), len(model.languages)
    bits = int(np.log2(len(model.slots)))
    count, total = np.zeros((docs, width)), np.zeros(docs)
    for order in ORDERS:
        for gram, doc in _windows(folded, offsets, order):
            if not len(gram):
                continue
            first, *others = _places(gram, bits)
            mask = model.slots[first]
            for at in others:
                mask = mask & model.slots[at]
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            which = doc[starts]
            total[which] += np.diff(np.append(starts, len(doc)))
            for i in range(width):
                one = (mask[:, i // 64] >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                count[which, i] += np.add.reduceat(one, starts, dtype=np.int64)
    f = model.false_positive
    corrected = np.maximum(0, (count - total[:, None] * f) / (1 - np.minimum(f, 0.999)))
    plain = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
    wide = np.concatenate([[0], np.cumsum(folded >= 128)])
    letter = np.diff(plain[offsets]) > 0
    for i in np.flatnonzero(~letter & (np.diff(wide[offsets]) > 0)):
        letter[i] = regex.search(r"\p{L}", texts[int(i)].as_py()) is not None
    return corrected, total, letter


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, coverage): score is the language's share of all corrected hits, coverage its share of the text's n-grams."""
    schema = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        model = shared.value
        names = np.asarray([*model.languages, UNKNOWN], dtype=object)
        prior = names.tolist().index(model.prior)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = batch.column("text")
            if not model.languages:
                n = batch.num_rows
                yield output(schema, [batch.column("key"), [UNKNOWN] * n, np.zeros(n), np.zeros(n)])
                continue
            count, total, letter = hits(model, texts)
            count[:, prior] += 1e-9 * (count[:, prior] > 0)
            best = count.argmax(axis=1)
            top, every = count[np.arange(len(best)), best], count.sum(axis=1)
            best = np.where(every > 0, best, prior)
            known = letter & (every > 0)
            score = np.where(known, top / np.where(every > 0, every, 1), 0.0)
            coverage = np.where(known, top / np.where(total > 0, total, 1), 0.0)
            yield output(schema, [batch.column("key"), names[np.where(letter, best, len(names) - 1)].tolist(), np.clip(score, 0, 1), np.clip(coverage, 0, 1)])

    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(predicted, "key long, lang_pred string, score double, coverage double").withColumnRenamed("key", id_col)


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(docs[id_col].cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


#: A text of at least so many n-grams is rejected when a smaller share of them is known.
KNOWN_GRAMS, KNOWN_SHARE = 40, 0.2


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents with a letter, but for those of KNOWN_GRAMS n-grams or more of which the best language has under KNOWN_SHARE; with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: pa.Array) -> np.ndarray:
        if not shared.value.languages:
            return np.zeros(len(texts), bool)
        count, total, letter = hits(shared.value, texts)
        return letter & ((total < KNOWN_GRAMS) | (count.max(axis=1) >= KNOWN_SHARE * total))

    return kept_rows(docs, text_col, known, BATCH_BYTES)
