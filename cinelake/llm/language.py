"""Language ID: interpolated Kneser-Ney character models per language, kept in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.common import mix, slices
from cinelake.llm.words import PLAIN, Pretokens, span_hashes

ORDER, DISCOUNT, GROUP = 5, 0.75, 32
_HEAD, _TAIL = 0x110000, 0x110001  # stand before and after every word


def _cut(text: str) -> list[str]:
    return regex.findall(PLAIN, unicodedata.normalize("NFC", text).lower())


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters of a batch: the bytes, each run's start and end in them, and its text."""
    p = Pretokens(texts, _cut, special=False, contractions=False)
    if len(p.starts) == 0:
        return p.data, p.starts, p.ends, p.owner
    first = p.data[p.starts]
    letter = ((first >= 97) & (first <= 122)) | (first >= 128)
    return p.data, p.starts[letter], p.ends[letter], p.owner[letter]


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the runs one after another, their number for each run, and whether the run has a letter."""
    raw = data.tobytes()
    words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    has = np.array([any(c.isalpha() for c in w) for w in words], bool)
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), size, has


def grams_of(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams that end at each place of each word, lengths 1 to ORDER (columns), and the word of each row.

    A word is its characters with a mark at either end; places are all but the leading mark. A gram that would reach
    before the word is padded with the mark.
    """
    full = size + ORDER  # ORDER - 1 marks, the characters, the end
    begin = np.concatenate([[0], np.cumsum(full)])
    flat = np.full(begin[-1], _HEAD, np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    flat[begin[owner] + ORDER - 1 + inner] = codes
    flat[begin[1:] - 1] = _TAIL
    word = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1) + begin[word] + ORDER - 1
    out = np.empty((len(word), ORDER), np.uint64)
    run = np.zeros(len(word), np.uint64)
    for k in range(ORDER):
        run = mix(run + flat[place - k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        out[:, k] = run
    return out, word


def _pads() -> np.ndarray:
    """Hashes of one to ORDER marks of a word's head."""
    out, run = [], np.zeros(1, np.uint64)
    for k in range(ORDER):
        run = mix(run + np.full(1, _HEAD, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        out.append(run)
    return np.concatenate(out)


_PADS = _pads()


class HashArray:
    """A sorted array of hashes with the place where those of each leading bits start, so that a search is a few steps."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, ~np.uint64(0))
        self.index = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash; the number of hashes if it isn't there."""
        at = self.index[(hashes >> self.shift).astype(np.int64)]
        live = np.flatnonzero(self.keys[at] < hashes)
        while len(live):
            at[live] += 1
            live = live[self.keys[at[live]] < hashes[live]]
        at[self.keys[at] != hashes] = len(self.keys) - 1
        return at


class Models:
    """Kneser-Ney models: sorted hashes of grams, with each language's discounted probability and the weight of longer grams.

    For a gram of k characters, ``share`` has max(count - D, 0) / (count of its context) (counts of distinct left neighbours
    below the longest) and, as the context of longer grams, ``rest`` has D * (distinct followers) / count, what it leaves to
    shorter ones. Tables hold ``GROUP`` languages each, so their size follows the grams. A language without a word is left out.
    """

    def __init__(self, words: list[list[str]], names: list[str]):
        self.names = [n for n, own in zip(names, words, strict=True) if own]
        counted = [self._counted(own) for own in words if own]
        letters = [c[0][0] for c in counted]
        self.letters = max(len(np.unique(np.concatenate(letters or [np.zeros(0)]))), 1)
        self.groups = [self._tables(counted[a : a + GROUP]) for a in range(0, len(counted), GROUP)]
        self.temperature, self.limit = 1.0, np.inf

    @staticmethod
    def _counted(own: list[str]) -> list[tuple[np.ndarray, ...]]:
        """For each length: grams, their share, and the contexts (one character shorter) with their rest."""
        size = np.array([len(w) for w in own], np.int64)
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # one row per distinct longest gram; the shorter ones and the contexts follow from it
        g, word = grams_of(codes, size)
        _, at, counts = np.unique(g[:, -1], return_index=True, return_counts=True)
        grams, contexts = g[at], np.zeros_like(g)
        contexts[1:, 1:] = g[:-1, :-1]
        contexts[np.flatnonzero(np.diff(word, prepend=-1)), 1:] = _PADS[:-1]
        contexts, out = contexts[at], []
        for k in range(ORDER):
            if k == ORDER - 1:
                key, at, count = grams[:, k], np.arange(len(counts)), counts.astype(np.float64)
            else:  # in how many ways the gram is continued to the left
                _, at = np.unique(grams[:, k + 1], return_index=True)
                key, first, count = np.unique(grams[at, k], return_index=True, return_counts=True)
                at, count = at[first], count.astype(np.float64)
            context, inverse = np.unique(contexts[at, k], return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(context))
            kinds = np.bincount(inverse, minlength=len(context))
            out.append((key, np.maximum(count - DISCOUNT, 0) / total[inverse], context, DISCOUNT * kinds / total))
        return out

    @staticmethod
    def _tables(counted: list[list[tuple[np.ndarray, ...]]]) -> tuple[np.ndarray, list[tuple[HashArray, np.ndarray, np.ndarray]]]:
        """The rest of the empty context, and for each length the hashes, shares and rests (a last row for all others)."""
        n, tables = len(counted), []
        for k in range(ORDER):
            longer = [c[k + 1] if k + 1 < ORDER else (None, None, c[k][0][:0], c[k][1][:0]) for c in counted]
            keys = np.unique(np.concatenate([c[k][0] for c in counted] + [x[2] for x in longer]))
            share, rest = np.zeros((len(keys) + 1, n), np.float32), np.ones((len(keys) + 1, n), np.float32)
            for lang, (own, x) in enumerate(zip(counted, longer, strict=True)):
                share[np.searchsorted(keys, own[k][0]), lang] = own[k][1]
                rest[np.searchsorted(keys, x[2]), lang] = x[3]
            tables.append((HashArray(keys), share, rest))
        return np.array([c[0][3][0] for c in counted], np.float32), tables

    def word_costs(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits of each word (its end included) under each language's model."""
        grams, word = grams_of(codes, size)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = []
        for empty, tables in self.groups:
            p, rest = np.full((len(word), len(empty)), 1.0 / self.letters, np.float32), empty
            for k, (hashes, share, rests) in enumerate(tables):
                at = hashes.find(grams[:, k])
                p *= rest
                p += share[at]
                before = np.empty_like(at)
                before[1:] = at[:-1]
                before[first] = hashes.find(_PADS[k : k + 1])
                rest = rests[before]
            out.append(np.add.reduceat(-np.log2(p), first, axis=0))
        return np.concatenate(out, axis=1)


class Scorer:
    """Scores texts under models. The costs of words are kept in a table of fixed size, where a word's hash names its
    place; a word that isn't there is scored anew, so what the table holds changes no result."""

    def __init__(self, models: Models, table_bytes: int = 32 << 20):
        self.models = models
        slots = 1 << max(10, (table_bytes // (4 * len(models.names) + 12)).bit_length() - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.costs = np.zeros((slots, len(models.names)), np.float32)
        self.lengths = np.zeros(slots, np.int32)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs and lengths (with the end; 0 without a letter) of words."""
        slot = (keys >> np.uint64(24)).astype(np.int64) & (len(self.keys) - 1)
        cost, length = self.costs[slot], self.lengths[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            _, at, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            new = miss[at]
            codes, size, has = characters(data, starts[new], ends[new])
            fresh = np.where(has[:, None], self.models.word_costs(codes, size), np.float32(0))
            long = np.where(has, size + 1, 0).astype(np.int32)
            cost[miss], length[miss] = fresh[inverse], long[inverse]
            place, pick = np.unique(slot[new], return_index=True)
            self.keys[place], self.costs[place], self.lengths[place] = keys[new[pick]], fresh[pick], long[pick]
        return cost, length

    def predict(self, texts: list[str], block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter, or no language learned), its score, its bits a character, and whether it is rejected."""
        m, n = self.models, len(texts)
        best, score, bits = np.full(n, -1), np.zeros(n), np.full(n, np.nan)
        data, starts, ends, owner = words_of(texts)
        if len(starts) and m.names:
            keys = span_hashes(data, starts, ends)
            sums, total = np.zeros((n, len(m.names))), np.zeros(n, np.int64)
            step = max(1, block // len(m.names))
            for a in range(0, len(keys), step):
                part = slice(a, a + step)
                cost, length = self.words(data, starts[part], ends[part], keys[part])
                own = owner[part]
                head = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[head]] += np.add.reduceat(cost, head, axis=0, dtype=np.float64)
                total[own[head]] += np.add.reduceat(length, head, dtype=np.int64)
            known = np.flatnonzero(total)
            rate = sums[known] / total[known, None]
            best[known], bits[known] = rate.argmin(axis=1), rate.min(axis=1)
            score[known] = 1 / np.exp((rate.min(axis=1, keepdims=True) - rate) / m.temperature).sum(axis=1)
        return best, score, bits, (best < 0) | (bits > m.limit)


def train(texts: list[str], langs: list[str]) -> Models:
    """One model per language from four fifths of its texts; the rest sets the temperature of the score (least squared
    error among fixed steps) and the rejection limit (99.5 % of the right predictions are below it, with a tenth on top).
    A language whose texts have no letter is not learned."""
    names = sorted(set(langs))
    words: list[list[str]] = [[] for _ in names]
    number = {x: i for i, x in enumerate(names)}
    apart: list[int] = []
    seen = dict.fromkeys(names, 0)
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            apart.append(i)
            continue
        data, starts, ends, _ = words_of([text])
        codes, size, has = characters(data, starts, ends)
        flat = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        words[number[lang]] += [flat[b - s : b] for b, s, h in zip(np.cumsum(size).tolist(), size.tolist(), has.tolist(), strict=True) if h]
    models = Models(words, names)
    known = {x: i for i, x in enumerate(models.names)}
    apart = [i for i in apart if langs[i] in known]
    if apart and len(known) > 1:
        truth = np.array([known[langs[i]] for i in apart])
        scorer, errors = Scorer(models), []
        for models.temperature in (0.02, 0.05, 0.1, 0.2, 0.4, 0.8):
            best, score, bits, _ = scorer.predict([texts[i] for i in apart])
            errors.append((float(((score - (best == truth)) ** 2).mean()), models.temperature))
        models.temperature = min(errors)[1]
        right = bits[(best == truth) & np.isfinite(bits)]
        if len(right):
            models.limit = 1.1 * float(np.quantile(right, 0.995))
    return models


def training_rows(docs: DataFrame, per_language: int = 300, longest: int = 50_000, most_rows: int = 20_000, most_chars: int = 32_000_000) -> list:
    """doc_id, lang, text of about ``per_language`` labelled rows of each language, picked by a hash of the id.

    The bounds hold whatever the input's size: ``most_rows`` rows in all are shared evenly among the languages (with more
    languages than that, the most frequent are learned, one row each), a row gives its first ``longest`` characters, or as
    many as ``most_chars`` leave to each row. Rows without a language or text are not picked; of rows that repeat an id and a
    language one text is taken. Three scans: of lang alone, of id and lang, and of the picked rows.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    if not counts:
        return []
    each = max(1, min(per_language, most_rows // len(counts)))
    # hashes below a share that leaves twice what is wanted and some more; the smallest of these are taken
    share = [(r.lang, min(1.0, (2 * each + 60) / r.n)) for r in counts]
    share = docs.sparkSession.createDataFrame(share, "l string, share double")
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "lang"), F.lit(1 << 40))
    picked = own.select("doc_id", "lang", h.alias("h")).join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.col("h") < F.col("share") * (1 << 40))
    picked = picked.select("doc_id", "lang", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each)
    picked = picked.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"))
    first = min(longest, max(1, most_chars // (each * len(counts))))
    rows = own.join(F.broadcast(picked), own["doc_id"].eqNullSafe(F.col("d")) & (own["lang"] == F.col("l")))  # at most most_rows rows
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.substring(F.col("text").cast("string"), 1, first)).alias("text")).collect()
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang))


def identify_languages(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), bits_per_char, rejected.

    The language with the fewest bits a character wins; the first in the alphabet on a tie. Words are runs of letters,
    lower-cased; a text without letters, empty or null is ``und`` with score 0, null bits and rejected. A text whose bits
    exceed the calibrated limit keeps its best language and is marked rejected. Without models every row is ``und``. Repeated rows and null ids are treated
    like others, no other column is read, and an empty table gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(models)  # bound by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*scorer.models.names, "und"], object)
        for batch, texts in slices(batches, "__text", 1 << 19):
            best, score, bits, rejected = scorer.predict(texts.to_pylist())
            cols = [batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "lang_pred", "score", "bits_per_char", "rejected"])

    schema = f"`{id_col}` {kind}, lang_pred string, score double, bits_per_char double, rejected boolean"
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify_languages`` of all documents by models of those with crc32(doc_id as text) mod 4 other than 2: doc_id,
    held_out, lang_pred, score, bits_per_char, rejected. A row with a null id is learned from; an empty table gives no rows,
    and where nothing can be learned every row is ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = training_rows(docs.where(~held_out))
    models = train([r.text for r in rows], [r.lang for r in rows])
    return identify_languages(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
