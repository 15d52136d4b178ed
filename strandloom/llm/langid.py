"""Language identification with spans of mixed-language text.

Words are runs of letters.  A word's script, from code-point ranges, narrows the candidate languages to those
learned with that script; its score for each is the sum of smoothed log-probabilities of its byte 3-grams and
4-grams.  Viterbi with a penalty for each switch labels every word; runs of a label are the spans, and the
label with most letters is the document's language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens

UNKNOWN = "und"
#: Expected number of rows of each language that a fit reads, chosen by the hash of the key.
TRAIN_ROWS = 3_000
BUCKETS = 1 << 16
#: Most languages that a fit learns, those of most rows; the model has a row of BUCKETS for each.
MAX_LANGUAGES = 500
SWITCH_PENALTY = 12.0
#: A script counts for a language if it has at least this share of the language's words.
SCRIPT_SHARE = 0.01
#: First lead byte, in UTF-8, of each script's range.
SCRIPTS = ((0x00, "latin"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD4, "armenian"), (0xD6, "hebrew"), (0xD8, "arabic"), (0xE0, "indic"), (0xE1, "other"), (0xE3, "han"), (0xEA, "hangul"), (0xEE, "other"))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SCRIPT = np.zeros(256, np.int8)
for _k, (_low, _) in enumerate(SCRIPTS):
    _SCRIPT[_low:] = _k
_SCRIPT[:0xC0] = 0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS, log-probabilities
    allowed: np.ndarray  # scripts x languages


@dataclass
class Words:
    """Letter runs of a chunk of rows: byte spans, first word of each row, script and n-gram positions."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    script: np.ndarray
    buckets: np.ndarray  # n-gram buckets, two for each byte of a word
    gram_word: np.ndarray  # first n-gram of each word


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Letter runs and their hashed n-grams; anything but a letter reads as one blank."""
    n = len(data)
    letter = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:n]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    padded = np.full(n + 4, 32, np.uint32)
    padded[2 : n + 2] = np.where(letter, data, 32)
    # The window of a letter at i: i-1 .. i+1 and i-1 .. i+2, so that a blank stands at either end.
    three = padded[1 : n + 1] << 16 | padded[2 : n + 2] << 8 | padded[3 : n + 3]
    four = three << 8 | padded[4 : n + 4]
    inside = np.flatnonzero(letter)
    mixed = np.empty(2 * len(inside), np.uint32)
    mixed[0::2] = three[inside] * np.uint32(0x9E3779B1)
    mixed[1::2] = (four[inside] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)
    buckets = (mixed >> np.uint32(16)).astype(np.int64)
    script = np.maximum.reduceat(_SCRIPT[data], starts) if len(starts) else np.zeros(0, np.int8)
    gram_word = 2 * np.searchsorted(inside, starts)
    return Words(starts, ends, np.searchsorted(starts, offsets), script, buckets, gram_word)


def _lower_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of lower-cased texts, large enough that Viterbi walks many rows in step."""
    return tokens.text_chunks(pc.utf8_lower(pc.fill_null(column, "")), 1 << 20)


def train(df: DataFrame, learnable: Column, rows: int = TRAIN_ROWS) -> Model:
    """Learn from the text and language of rows for which ``learnable`` holds and language is not null.

    At most MAX_LANGUAGES are learned.  Rows are kept with a probability, by the hash of their text, that leaves about ``rows`` for each language;
    their counts, at most BUCKETS for each language, are summed on the executors.
    """
    known = df.where(learnable & F.col("lang").isNotNull())
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r.lang: r.n for r in counted.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows / sizes[k])))])
    draw = (F.xxhash64("text", F.lit(7)) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000.0
    counts = (
        known.where(draw < F.element_at(rate, F.col("lang")))
        .select("lang", "text")
        .mapInArrow(_count_grams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    place = {k: i for i, k in enumerate(languages)}
    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(SCRIPTS), len(languages)))
    at = np.array([place[k] for k in counts.column("lang").to_pylist()], np.int64)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    real = bucket >= 0
    grams[at[real], bucket[real]] = n[real]
    scripts[-1 - bucket[~real], at[~real]] = n[~real]
    smooth = 0.5
    weights = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)
    return Model(languages, weights, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for row, data, offsets in _lower_chunks(batch.column(1)):
            words = split_words(data, offsets)
            grams = np.append(words.gram_word, len(words.buckets))[words.first]
            for k in range(len(offsets) - 1):
                own = totals.setdefault(languages[row + k], np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                np.add.at(own, words.buckets[grams[k] : grams[k + 1]], 1)
                np.add.at(own, BUCKETS + words.script[words.first[k] : words.first[k + 1]].astype(np.int64), 1)
    for language, own in totals.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([language] * len(at), pa.string()),
                "bucket": pa.array(np.where(at < BUCKETS, at, BUCKETS - 1 - at), pa.int32()),
                "n": pa.array(own[at], pa.int64()),
            }
        )


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words x languages; a language that is not learned with the word's script gets a prohibitive score."""
    out = np.zeros((len(words.starts), len(model.languages)), np.float32)
    if len(words.starts):
        for k in range(len(model.languages)):
            out[:, k] = np.add.reduceat(model.weights[k][words.buckets], words.gram_word)
        out -= out.max(1, keepdims=True)
        narrowed = model.allowed[words.script]
        narrowed |= ~narrowed.any(1, keepdims=True)
        out[~narrowed] -= 1e4
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word; rows of words are walked in step, longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], first[:-1][order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # rows with more than t words
    labels = np.zeros(len(scores), np.int16)
    if not longest:
        return labels
    switched, origin = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    best = np.zeros((len(counts), scores.shape[1]), np.float32)
    for t in range(longest):
        at = begin[: active[t]] + t
        now = best[: active[t]]
        if t:
            source = now.argmax(1)
            jump = now[np.arange(len(now)), source] - penalty
            over = now < jump[:, None]
            switched[at], origin[at] = over, source
            now = np.where(over, jump[:, None], now)
            now -= now.max(1, keepdims=True)
        best[: active[t]] = now + scores[at]
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        labels[at] = state[: active[t]]
        if t:
            own = state[: active[t]]
            state[: active[t]] = np.where(switched[at, own], origin[at], own)
    return labels


def _letters(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def identify(
    df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", spans: bool = True
) -> DataFrame:
    """``keep``, lang_pred, score and spans, which are (lang, first_word, words) over the text's letter runs.

    Columns of ``keep`` that are named as one of these are not kept.  A null text or one without a letter is ``und`` with score 0 and no spans; so is any if nothing was learned.
    The score is the predicted language's share of the letters.  The model is the size of its languages.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = tuple(k for k in keep if k not in ("lang_pred", "score", *(["spans"] if spans else [])))
    kept = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
    extra = ", spans array<struct<lang: string, first_word: int, words: int>>" if spans else ""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.text_slices(batch, len(keep)):
                found = _identify_batch(shared.value, part.column(len(keep)), spans)
                columns = [*part.columns[: len(keep)], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
                names = [*keep, "lang_pred", "score"]
                if spans:
                    columns.append(pa.array(found[2], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    read = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("langid_text"))
    return read.mapInArrow(label, f"{kept}lang_pred string, score double{extra}")


def _identify_batch(model: Model, column: pa.Array, spans: bool) -> tuple[list, list, list]:
    names, scores, runs = [], [], []
    kept = len(model.languages)
    for row, data, offsets in _lower_chunks(column):
        words = split_words(data, offsets)
        labels = viterbi(word_scores(model, words), words.first) if kept else np.zeros(len(words.starts), np.int16)
        ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])[offsets]
        sizes = words.ends - words.starts
        for k in range(len(offsets) - 1):
            own = labels[words.first[k] : words.first[k + 1]]
            lettered = ascii_letters[k + 1] > ascii_letters[k] or _letters(column[row + k].as_py())
            if not kept or not lettered or not len(own):
                names.append(UNKNOWN), scores.append(0.0), runs.append([])
                continue
            share = np.bincount(own, sizes[words.first[k] : words.first[k + 1]], kept)
            top = int(share.argmax())
            names.append(model.languages[top]), scores.append(float(share[top] / share.sum()))
            if spans:
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                runs.append(
                    [
                        {"lang": model.languages[own[a]], "first_word": int(a), "words": int(b - a)}
                        for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True)
                    ]
                )
    return names, scores, runs
