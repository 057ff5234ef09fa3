"""Problem 5: the language of texts and of their segments, by string-kernel classification.

The kernel counts character n-grams of words (1 to 4 characters, word ends marked, plus the writing system) that are
present in both texts: a blended spectrum of presence, normalised. Landmarks are drawn from a bounded sample of labelled
texts; one-versus-rest kernel ridge regression is fitted in their Nyström space. As the kernel is an inner product, the
fitted weights fold exactly into one vector per n-gram, and scoring is a matrix product over a batch's words.

Words of a text are scored and cut into segments by a Viterbi pass with a price for each change of language, lower
where a sentence begins. A segment counts as whole sentences if it has enough words of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

from .canon import canonical

LANGUAGES = ("en", "zh", "es", "de", "fr", "pt", "ru")
# Spellings of the languages besides the two-letter code, which may carry a region.
SPELLINGS = {
    "en": ("eng", "english"),
    "zh": ("zho", "chi", "chinese"),
    "es": ("spa", "spanish"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
}
#: Bounds of the labelled sample the classifier is fitted on, and of its landmarks.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 100
RIDGE = 0.1
#: Viterbi prices in units of word scores, and words (or Chinese characters) that make a whole sentence.
CHANGE_INSIDE, CHANGE_AT_SENTENCE = 3.0, 1.5
LEAST_WORDS, LEAST_HAN = 4, 6

NOISE = regex.compile(r"[#@]\S+|\b(?:https?://|www\.|pic\.)\S+", regex.I)
TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:['’]\p{L}+)*|[.!?…。！？\n]+|[\p{N}]+")


def label_language(label: Column) -> Column:
    """The language a label names: its code, or 'other' for another code-like label, or null for none (placeholders)."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " "))), r"[-_ ].*$", "")
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(plain.isin(code, *names), F.lit(code)).otherwise(out)
    return out


@lru_cache(maxsize=200_000)
def _grams(word: str) -> np.ndarray:
    first = ord(word[0])
    system = "H" if first >= 0x2E80 else "C" if 0x400 <= first < 0x530 else "L" if first < 0x250 else "O"
    marked = f"<{word.lower()}>"
    grams = {f"\0{system}"} | {marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)}
    grams -= {"<", ">"}
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams], np.int64)


def tokens(text: str) -> list[tuple[str, bool]]:
    """Words with whether a sentence begins there. Tags, handles and links are left out."""
    out, fresh = [], True
    for token in TOKEN.findall(NOISE.sub(" . ", canonical(text))):
        if token[0].isalpha():
            out.append((token, fresh))
            fresh = False
        elif not token[0].isdigit():
            fresh = True
    return out


@dataclass
class Model:
    """``grams`` (sorted hashes) and their weight vectors, one column a language."""

    grams: np.ndarray
    weights: np.ndarray

    def _weights(self, flat: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1)
        return self.weights[at] * (self.grams[at] == flat)[:, None]

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages): each word's additive share of the kernel score, as one batched product."""
        ids = [_grams(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.add.reduceat(self._weights(np.concatenate(ids)), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)

    def segment(self, words: list[str]) -> np.ndarray:
        """Normalised kernel score of a segment for each language."""
        return self.segments([_grams(w) for w in words], np.array([len(words)]))[0]

    def segments(self, grams: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """(segments, languages): normalised kernel scores; ``grams`` are those of the words of all segments, ``sizes``
        the words of each."""
        counts = np.fromiter(map(len, grams), np.int64, len(grams))
        owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
        keys = np.sort(owner << 32 | np.concatenate(grams))
        keys = keys[np.append(True, keys[1:] != keys[:-1])]  # presence
        starts = np.searchsorted(keys >> 32, np.arange(len(sizes)))
        held = np.diff(np.append(starts, len(keys)))
        return np.add.reduceat(self._weights(keys & 0xFFFFFFFF), starts, axis=0) / np.sqrt(held)[:, None]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression, one language against the rest."""
    bags = [np.unique(np.concatenate([np.empty(0, np.int64), *(_grams(w) for w in {w for w, _ in tokens(t)})])) for t in texts]
    used = [k for k, b in enumerate(bags) if len(b)]
    chosen: list[int] = []
    for code in LANGUAGES:
        chosen += [k for k in used if labels[k] == code][:landmarks]
    if not chosen:
        return Model(np.array([-1]), np.zeros((1, len(LANGUAGES)), np.float32))
    grams = np.unique(np.concatenate([bags[k] for k in chosen]))
    marks = np.zeros((len(chosen), len(grams)), np.float32)
    for row, k in enumerate(chosen):
        marks[row, np.searchsorted(grams, bags[k])] = 1 / np.sqrt(len(bags[k]))
    kernel = np.empty((len(used), len(chosen)))
    for row, k in enumerate(used):
        at = np.minimum(np.searchsorted(grams, bags[k]), len(grams) - 1)
        kernel[row] = marks[:, at[grams[at] == bags[k]]].sum(axis=1) / np.sqrt(len(bags[k]))
    among = (marks @ marks.T).astype(np.float64)
    target = np.array([[1.0 if labels[k] == code else -1.0 for code in LANGUAGES] for k in used])
    # languages weigh alike however many texts they have
    share = Counter(labels[k] for k in used)
    weight = np.array([1 / share[labels[k]] for k in used])[:, None]
    left = kernel.T @ (kernel * weight) + ridge * among + 1e-9 * np.eye(len(chosen))
    dual = np.linalg.solve(left, kernel.T @ (target * weight))
    return Model(grams, (marks.T @ dual).astype(np.float32))


def viterbi(scores: np.ndarray, fresh: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best language of each word of a batch of texts; ``scores`` (words, languages) and ``fresh`` (where a sentence
    begins) of all texts one after the other, ``sizes`` the words of each."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    sizes, own = sizes[order], np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.int8)
    best = scores[starts].copy()
    for t in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # texts that have a word t
        at, now = starts[:n] + t, best[:n]
        top = now.argmax(axis=1)
        moved = now[np.arange(n), top] - np.where(fresh[at], CHANGE_AT_SENTENCE, CHANGE_INSIDE)
        stay = now >= moved[:, None]
        back[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, moved[:, None]) + scores[at]
    path = np.empty(len(scores), np.int64)
    state = best.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def segments(model: Model, texts: list[list[tuple[str, bool]]], scores: np.ndarray) -> list[list[tuple[str, float, int, bool]]]:
    """(language, confidence, weight, whole) of each segment of each text, in order; ``scores`` of all words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[tuple[str, float, int, bool]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    used = np.flatnonzero(sizes)
    words = [w for t in texts for w, _ in t]
    path = viterbi(scores - scores.mean(axis=1, keepdims=True), np.fromiter((f for t in texts for _, f in t), bool, len(words)), sizes[used])
    owner = np.repeat(used, sizes[used])
    begins = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])))
    count = np.diff(np.append(begins, len(words)))
    fit_to = model.segments([_grams(w) for w in words], count)
    odds = np.exp(4 * (fit_to - fit_to.max(axis=1, keepdims=True)))
    lang, rows = path[begins], np.arange(len(begins))
    han = np.add.reduceat(np.fromiter(("\u2e80" <= w[0] for w in words), np.int64, len(words)), begins)
    whole = np.where(lang == LANGUAGES.index("zh"), han >= LEAST_HAN, count - han >= LEAST_WORDS) & (lang == fit_to.argmax(axis=1))
    fields = zip(owner[begins].tolist(), lang.tolist(), (odds[rows, lang] / odds.sum(axis=1)).tolist(), (count - han + han // 2).tolist(), whole.tolist(), strict=True)
    for text, code, confidence, weight, full in fields:
        out[text].append((LANGUAGES[code], confidence, weight, full))
    return out


def sample_labelled(rows: DataFrame, key: str, text: str, label: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most about ``per_language`` labelled texts a language, by hash of the key: bounded, and without any sort."""
    named = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), label.alias("code")).where("code is not null and t is not null")
    counts = {r["code"]: r["count"] for r in named.groupBy("code").count().collect()}
    rate = F.lit(0.0)
    for code, n in counts.items():
        rate = F.when(F.col("code") == code, F.lit(min(1.0, per_language / n))).otherwise(rate)
    picked = named.where(F.expr("pmod(xxhash64(k), 1000000) / 1000000.0") < rate).orderBy(F.expr("xxhash64(k, t)")).limit(2 * per_language * len(LANGUAGES)).collect()
    return [r["t"] for r in picked], [r["code"] for r in picked]


def train(rows: DataFrame, key: str, text: str, label: Column) -> Model:
    """The classifier, fitted on rows whose (now and then wrong) labels name a language."""
    return fit(*sample_labelled(rows, key, text, label))


SEGMENTS = "array<struct<lang: string, confidence: double, weight: int, whole: boolean>>"
FIELDS = ("lang", "confidence", "weight", "whole")


def segmenter(model: Model, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, ...) -> (..., segments), for whole batches at once."""
    cache: dict[str, np.ndarray] = {}
    for pdf in batches:
        for begin in range(0, len(pdf), 2000):
            part = pdf.iloc[begin : begin + 2000]
            texts = [tokens(t) if isinstance(t, str) else [] for t in part["text"]]
            if len(cache) > 300_000:
                cache = {}
            new = list({w for words in texts for w, _ in words} - cache.keys())
            if new:
                cache.update(zip(new, model.words(new), strict=True))
            flat = [cache[w] for words in texts for w, _ in words]
            found = segments(model, texts, np.array(flat) if flat else np.empty((0, len(LANGUAGES))))
            yield part.drop(columns="text").assign(segments=[[dict(zip(FIELDS, s, strict=True)) for s in some] for some in found])


def classified(samples: DataFrame) -> DataFrame:
    """line_no, label (what language names), main, confidence and segments of each sample whose text has words.

    ``main`` is null if only tags, handles or links are left. Null and empty texts drop out; repeated rows stay.
    """
    rows = samples.select("line_no", "text", label_language(F.col("language")).alias("label"), F.col("language").alias("written"))
    model = samples.sparkSession.sparkContext.broadcast(train(rows, "line_no", "text", F.col("label")))  # bounded by the sample
    # a label that names a language we do not know is not a placeholder but names another one
    named = F.when(F.col("label").isNull() & F.regexp_like(F.lower(F.trim("written")), F.lit(r"^(it|nl|pl|sv|da|no|fi|tr|ar|ja|ko|hi|uk|cs|el|he|vi|th|id)([-_].*)?$")), "other").otherwise(F.col("label"))
    rows = rows.where(F.regexp_like("text", F.lit(r"[\p{L}\p{N}]"))).select("line_no", "text", named.alias("label"))
    return spread(rows).mapInPandas(lambda batches: segmenter(model.value, batches), f"line_no long, label string, segments {SEGMENTS}")


def by_language(found: DataFrame) -> DataFrame:
    """line_no, label, main and langs (languages with whole sentences; the main one alone if none has)."""
    weights = ", ".join(f"struct(aggregate(filter(segments, s -> s.lang = '{c}'), 0, (a, s) -> a + s.weight) as weight, '{c}' as lang)" for c in LANGUAGES)
    top = F.expr(f"array_max(filter(array({weights}), x -> x.weight > 0)).lang")
    whole = F.expr("array_distinct(transform(filter(segments, s -> s.whole), s -> s.lang))")
    return found.select("line_no", "label", top.alias("main"), whole.alias("whole")).select(
        "line_no", "label", "main", F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.array_compact(F.array("main"))).alias("langs")
    )


def wrong_or_mixed(samples: DataFrame) -> DataFrame:
    """p5_found: (line_no, lang), a row per language with whole sentences, of samples whose language is missing or a
    placeholder, names another language than the text's main one, or whose text has whole sentences in two."""
    rows = by_language(classified(samples)).where("label is null or label <> main or size(langs) > 1")
    return rows.select("line_no", F.explode("langs").alias("lang")).distinct()


def language_report(samples: DataFrame) -> DataFrame:
    """A row per segment: line_no, position, lang, confidence, words and whether it is whole sentences."""
    return classified(samples).select("line_no", F.posexplode("segments").alias("position", "s")).select(
        "line_no", "position", "s.lang", F.round("s.confidence", 6).alias("confidence"), F.col("s.weight").alias("words"), "s.whole"
    )
