"""Problem 10: abusive, hateful or sexual content, by nearest labelled examples.

Texts are normalised (one form, markup off, spelling tricks undone), cut into sentences and these into windows of words.
A window's neighbours are labelled windows by exact TF-IDF cosine over words and word pairs, found with a block-max
inverted index: a block of examples is only scored if the sum of its terms' maxima can still beat what is known. The
neighbours' distance-weighted votes give the window's score, the highest window the document's, with the nearest
abusive example as evidence.

Labels say which documents are abusive, not where, and some are wrong. So labelled windows are cleaned first: a window of
an abusive document counts as abusive only if its own neighbours in other documents say so, or if nothing else in its
document does, no other document has its like and what is loosely like it is not mostly harmless. The index holds a
bounded sample of labelled documents. Term frequencies are counted over all documents: exactly for every term of the
index, by 2^18 hash buckets (an upper bound) for terms no example has, which enter a window's norm only.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, spread

from .canon import canonical
from .mixing import clean_source

#: Bounds of the labelled sample, in documents.
MOST_ABUSIVE, MOST_OTHER = 1500, 4000
WIDTH, STEP = 8, 4
HAN_WIDTH, HAN_STEP = 12, 6
NEIGHBOURS, FLOOR, SHRINK = 10, 0.35, 0.08
#: Votes that make a window abusive: at first, when whole documents vote, and then, when cleaned windows do.
SURE = (0.8, 0.5)
UNLIKE = 0.45
#: A window is harmless, whatever its few nearest say, if of its LOOSE nearest examples above LOOSE_FLOOR, at least
#: LEAST_LOOSE, a smaller share than LOOSE_SHARE is abusive.
LOOSE, LEAST_LOOSE, LOOSE_FLOOR, LOOSE_SHARE = 40, 8, 0.2, 0.35
BLOCK = 128
COUNT_BUCKETS = 1 << 18

_MARKUP = re.compile(r"<[^<>]{0,200}>|https?://\S+|\b(?:pic|www)\.\S+")
_TAGS = re.compile(r"(?<![\w$@!*])[#@]\w+:?|\(\w+\)")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_ENDS = re.compile(r"[.!?…。！？\n]+(?=\s|$|[^\x00-\x7f])|\n|(?<=[\u2e80-\u9fff]),")
_WORD = re.compile(r"[⺀-鿿豈-﫿]|[^\W⺀-鿿豈-﫿]+(?:[@$*!'’0-9]+[^\W⺀-鿿豈-﫿]+)*[$]?|[@$][^\W\d_]\w*")
_AGAIN = re.compile(r"(.)\1{2,}")
# Characters that stand for letters inside words.
_STAND_INS = str.maketrans("@$0134578!", "asoieastbi")


@lru_cache(maxsize=200_000)
def _word_id(word: str) -> int:
    word = word.lower()
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.translate(_STAND_INS)
        elif word.isdigit():
            word = "0"
    word = _AGAIN.sub(r"\1", word)
    return zlib.crc32(word.encode()) & 0x7FFFFFFF


def sentence_ids(text: str) -> list[list[int]]:
    """Word ids of each sentence of a text after normalisation; a sentence of Chinese has the mark -2 in front."""
    text = canonical(text)
    if "<" in text or "&" in text or "/" in text or "pic." in text:
        text = _MARKUP.sub(" ", html.unescape(text))
    text = _TAGS.sub(" ", text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)
    out = []
    for sentence in _ENDS.split(text):
        words = _WORD.findall(sentence)
        if words:
            han = not sentence.isascii() and 2 * sum("\u2e80" <= w <= "\u9fff\uffff" for w in words) > len(words)
            out.append([-2, *map(_word_id, words)] if han else [*map(_word_id, words)])
    return out


def _worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, source, text) -> (doc_id, source, words): ids with a -1 after each sentence."""
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            ids: list[int] = []
            for sentence in sentence_ids(text) if isinstance(text, str) else ():
                ids += sentence
                ids.append(-1)
            out.append(np.asarray(ids, np.int32))
        yield pdf[["doc_id", "source"]].assign(words=out)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0] .. end[0] - 1, begin[1] .. end[1] - 1 and so on."""
    sizes = end - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * 1_000_003 + right * 29 + 7) & 0x3FFFFFFFFFFF | 1 << 46


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, owner): term ids of each window (words, then pairs; -1 pads), and the document it is from."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    if not sizes.sum():
        return np.empty((0, 2 * HAN_WIDTH - 1), np.int64), np.empty(0, np.int64)
    flat = np.concatenate(docs).astype(np.int64)
    ends = np.flatnonzero(flat == -1)
    begins = np.append(0, ends[:-1] + 1)
    han = flat[begins] == -2
    begins += han
    width, step, n = np.where(han, HAN_WIDTH, WIDTH), np.where(han, HAN_STEP, STEP), ends - begins
    over = np.maximum(n - width, 0)
    count = -(-over // step) + 1
    sentence = np.repeat(np.arange(len(ends)), count)
    start = np.minimum(_ranges(np.zeros_like(count), count) * step[sentence], over[sentence])
    at = np.arange(HAN_WIDTH)
    place = np.minimum((begins[sentence] + start)[:, None] + at, len(flat) - 1)
    table = np.where(at < np.minimum(n, width)[sentence, None], flat[place], -1)
    pairs = _pairs(table[:, :-1], table[:, 1:])
    pairs[table[:, 1:] < 0] = -1
    terms = np.sort(np.concatenate([table, pairs], axis=1), axis=1)
    terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
    return terms, np.repeat(np.arange(len(docs)), sizes)[ends][sentence]


def _bucket(terms: np.ndarray) -> np.ndarray:
    mixed = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(46)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame], vocabulary: np.ndarray) -> Iterator[pd.DataFrame]:
    """Occurrences over a partition of each term of ``vocabulary`` (its place), of each bucket (after the vocabulary)
    and, last, of sentences: a bounded table."""
    known = len(vocabulary)
    total = np.zeros(known + COUNT_BUCKETS + 1, np.int64)
    for pdf in batches:
        docs = [w for w in pdf["words"] if len(w)]
        if not docs:
            continue
        flat = np.concatenate(docs).astype(np.int64)
        pair = _pairs(flat[:-1], flat[1:])[(flat[:-1] >= 0) & (flat[1:] >= 0)]
        terms = np.concatenate([flat[flat >= 0], pair])
        total += np.bincount(known + _bucket(terms), minlength=len(total))
        if known:
            at = np.minimum(np.searchsorted(vocabulary, terms), known - 1)
            total += np.bincount(at[vocabulary[at] == terms], minlength=len(total))
        total[-1] += (flat == -1).sum()
    used = np.flatnonzero(total)
    yield pd.DataFrame({"place": used, "n": total[used]})


class Weights:
    """Inverse frequencies: exact ones of a vocabulary, and those of hash buckets for all other terms."""

    def __init__(self, vocabulary: np.ndarray, known: np.ndarray, buckets: np.ndarray) -> None:
        self.vocabulary, self.known, self.buckets = vocabulary, known.astype(np.float32), buckets.astype(np.float32)

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, unit TF-IDF weights by presence) of windows; padding weighs 0."""
        at = self.look_up(terms)
        weights = np.where(at >= 0, self.known[at] if len(self.known) else 0, self.buckets[_bucket(np.maximum(terms, 0))])
        weights = np.where(terms >= 0, weights, 0)
        return at, weights / np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-9)


class BlockMaxIndex:
    """Exact cosine search over labelled examples: distinct windows with the documents they are from.

    ``owner`` and ``truth`` say for each window which document it is from (an index into ``docs``) and whether it is
    abusive there. Equal windows are one example; it is abusive if it is in at least half of its documents, and votes
    with the logarithm of their number. Examples of one block share their rarest terms, so that block maxima are low for
    everything else. Windows are searched in batches: bounds of all blocks, then exact cosines in the blocks whose bound
    can still matter, each as one sparse product.
    """

    CHUNK, FIRST_BLOCKS = 1024, 6

    def __init__(self, terms: np.ndarray, weights: Weights, truth: np.ndarray, owner: np.ndarray, docs: np.ndarray) -> None:
        self.weights, self.docs = weights, docs
        terms, example = np.unique(terms, axis=0, return_inverse=True)
        example = example.reshape(-1)
        held, first = np.unique(np.stack([example, owner]), axis=1, return_index=True) if len(example) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        count = np.bincount(held[0], minlength=len(terms)).astype(np.int64)
        hits = np.bincount(held[0], weights=truth[first], minlength=len(terms))
        abusive = 2 * hits >= np.maximum(count, 1)
        mixed = (np.arange(len(terms)) * 2654435761) % (1 << 32)
        at, weight = weights.of(terms)
        rarest = np.argsort(-np.where(at >= 0, weight, 0), axis=1, kind="stable")[:, :2]
        rare = np.take_along_axis(at, rarest, axis=1) if len(terms) else np.empty((0, 2), np.int64)
        order = np.lexsort((rare[:, 1], rare[:, 0], ~abusive))  # abusive examples share blocks
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        #: Examples have numbers that no label changes; where each one is now, and which one is at a place.
        self.place, self.number = place, order
        at, weight, self.count, self.hits, self.tie = at[order], weight[order], count[order], hits[order], mixed[order]
        by_example = np.argsort(place[held[0]], kind="stable")
        self.held_doc, self.held_truth = held[1][by_example], truth[first][by_example]
        self.held_key = np.repeat(np.arange(len(terms)), self.count) * len(docs) + self.held_doc
        self.held = np.append(0, np.cumsum(self.count))
        self.labels = abusive[order].astype(np.float32)
        self.votes = np.log2(1.0 + self.count)
        window, slot = np.nonzero(at >= 0)
        flat, weight = at[window, slot], weight[window, slot]
        order = np.lexsort((window, flat))
        flat, self.window, self.weight = flat[order], window[order].astype(np.int32), weight[order].astype(np.float32)
        # runs of postings of one term in one block, with their largest weight
        block = self.window // BLOCK
        edge = np.ones(len(flat), bool)
        edge[1:] = (flat[1:] != flat[:-1]) | (block[1:] != block[:-1])
        self.run = np.append(np.flatnonzero(edge), len(flat))
        self.run_block = block[self.run[:-1]]
        self.run_max = np.maximum.reduceat(self.weight, self.run[:-1]) if len(flat) else np.empty(0, np.float32)
        run_term = flat[self.run[:-1]]
        self.term_run = np.searchsorted(run_term, np.arange(len(weights.vocabulary) + 1))
        self.blocks = int(block.max()) + 1 if len(flat) else 0
        # the last block with an abusive window, and where each term's runs up to it end
        self.hot_blocks = int(np.flatnonzero(self.labels > 0.5).max()) // BLOCK + 1 if (self.labels > 0.5).any() else 0
        cold = np.append(0, np.cumsum(self.run_block >= self.hot_blocks))
        self.hot_run = self.term_run[1:] - (cold[self.term_run[1:]] - cold[self.term_run[:-1]])
        hot = np.where(self.labels[self.window] > 0.5, self.weight, 0) if len(flat) else np.empty(0, np.float32)
        self.run_hot = np.maximum.reduceat(hot, self.run[:-1]) if len(flat) else np.empty(0, np.float32)
        self.hot_max = np.zeros(len(weights.vocabulary), np.float32)
        np.maximum.at(self.hot_max, run_term, self.run_hot)

    def hot_bounds(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that any abusive example's cosine can be, for each window of a batch."""
        return (np.where(at >= 0, self.hot_max[at], 0) * weights).sum(axis=1) if len(self.hot_max) else np.zeros(len(at))

    def search(self, at: np.ndarray, weights: np.ndarray, k: int, floor: float, hot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, example, cosine): the k examples of highest cosine of at least ``floor`` of each window, windows in
        order and best first; ties in an order blind to labels. With ``hot`` only abusive examples are searched."""
        blocks = self.hot_blocks if hot else self.blocks
        parts = [self._search(at[c : c + self.CHUNK], weights[c : c + self.CHUNK], k, floor, hot, blocks, c) for c in range(0, len(at), self.CHUNK)] if blocks else []
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        window, example, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
        return window, example, cosine

    def _search(self, at: np.ndarray, weights: np.ndarray, k: int, floor: float, hot: bool, blocks: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, slot = np.nonzero(at >= 0)
        term, weight = at[row, slot], weights[row, slot]
        begin, end = self.term_run[term], self.hot_run[term] if hot else self.term_run[term + 1]
        runs, row, weight = _ranges(begin, end), np.repeat(row, end - begin), np.repeat(weight, end - begin)
        cell = row * blocks + self.run_block[runs]
        bound = np.bincount(cell, weights=(self.run_hot if hot else self.run_max)[runs] * weight, minlength=len(at) * blocks).reshape(len(at), blocks)

        def exact(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keep = chosen.reshape(-1)[cell]
            some, cells = runs[keep], np.cumsum(chosen.reshape(-1)) - 1
            size = self.run[some + 1] - self.run[some]
            posts = _ranges(self.run[some], self.run[some + 1])
            slots = np.repeat(cells[cell[keep]] * BLOCK, size) + self.window[posts] % BLOCK
            scores = np.bincount(slots, weights=self.weight[posts] * np.repeat(weight[keep], size))
            good = np.flatnonzero(scores >= floor)
            of = np.flatnonzero(chosen.reshape(-1))[good // BLOCK]
            example = of % blocks * BLOCK + good % BLOCK
            if hot:
                abusive = self.labels[example] > 0.5
                good, of, example = good[abusive], of[abusive], example[abusive]
            return of // blocks, example, scores[good]

        def best(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            window, example, cosine = found
            order = np.lexsort((self.tie[example], -np.round(cosine, 6), window))
            window = window[order]
            rank = np.arange(len(window)) - np.searchsorted(window, window)
            top = rank < k
            return window[top], example[order][top], cosine[order][top], rank[top]

        able = bound >= floor - 1e-6
        if blocks > 2 * self.FIRST_BLOCKS:
            edge = -np.partition(-bound, self.FIRST_BLOCKS - 1, axis=1)[:, self.FIRST_BLOCKS - 1]
            first = able & (bound >= edge[:, None])
            window, example, cosine, rank = best(exact(first))
            least = np.full(len(at), floor)
            full = rank == k - 1
            least[window[full]] = cosine[full]
            more = exact(able & ~first & (bound >= least[:, None] - 1e-6))
            window, example, cosine, _ = best(tuple(np.concatenate(x) for x in zip((window, example, cosine), more, strict=True)))
        else:
            window, example, cosine, _ = best(exact(able))
        return window + base, example, cosine

    def vote(self, window: np.ndarray, found: np.ndarray, cosine: np.ndarray, windows_: int, own: np.ndarray | None = None) -> np.ndarray:
        """Distance-weighted share of abusive examples of each window, as if its document ``own`` (an index) had not been
        labelled."""
        labels, votes = self.labels[found], self.votes[found]
        if own is not None and len(found):
            key = found * len(self.docs) + own[window]
            at = np.minimum(np.searchsorted(self.held_key, key), len(self.held_key) - 1)
            mine, left, hits = self.held_key[at] == key, self.count[found] - 1, self.hits[found] - self.held_truth[at]
            labels = np.where(mine, (left > 0) & (2 * hits >= left), labels)
            votes = np.where(mine, np.log2(1.0 + left), votes)
        weight = cosine**4 * votes
        return np.bincount(window, weights=weight * labels, minlength=windows_) / (np.bincount(window, weights=weight, minlength=windows_) + SHRINK)


def score_documents(index: BlockMaxIndex, words: list[np.ndarray], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, evidence document or -1, its cosine) of each document; ``own`` places in the index's documents keep a
    document from voting for itself."""
    score, evidence, cosine = np.zeros(len(words)), np.full(len(words), -1, np.int64), np.zeros(len(words))
    terms, owner = windows(words)
    if not len(terms) or not index.hot_blocks:
        return score, evidence, cosine
    same = np.arange(len(terms))
    if own is None:
        mixer = np.random.default_rng(5).integers(1, 2**63, terms.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _, first, same = np.unique(((terms.astype(np.uint64) ^ (terms.astype(np.uint64) >> np.uint64(15))) * mixer).sum(axis=1), return_index=True, return_inverse=True)
        terms, same = terms[first], same.reshape(-1)
    at, weights = index.weights.of(terms)
    value, best, nearest = np.zeros(len(terms)), np.full(len(terms), -1, np.int64), np.zeros(len(terms))
    # without an abusive example in reach the vote is 0, whatever else is near
    near = np.flatnonzero(index.hot_bounds(at, weights) >= FLOOR)
    near = near[np.unique(index.search(at[near], weights[near], 1, FLOOR, hot=True)[0])]
    window, found, cosines = index.search(at[near], weights[near], NEIGHBOURS, FLOOR)
    value[near] = index.vote(window, found, cosines, len(near), None if own is None else own[owner[near]])
    hot = np.flatnonzero(index.labels[found] > 0.5)[::-1]  # the best one of a window comes last and stays
    best[near[window[hot]]], nearest[near[window[hot]]] = index.docs[index.held_doc[index.held[found[hot]]]], cosines[hot]
    order = np.lexsort((value[same], owner))
    last = np.append(owner[order][1:] != owner[order][:-1], True)
    docs, pick = owner[order][last], same[order][last]
    score[docs] = value[pick]
    evidence[docs], cosine[docs] = np.where(value[pick] > 0, best[pick], -1), nearest[pick]
    return score, evidence, cosine


def neighbours(index: BlockMaxIndex, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, words) -> (place, windows, window, example, cosine): the loosely nearest examples of each window of a
    document, by numbers that no label changes."""
    for pdf in batches:
        terms, owner = windows(pdf["words"].to_list())
        window, found, cosines = index.search(*index.weights.of(terms), LOOSE, LOOSE_FLOOR)
        begin = np.searchsorted(owner, np.arange(len(pdf) + 1))  # windows of a document, and what was found for them
        edge = np.searchsorted(window, begin)
        own = [slice(lo, hi) for lo, hi in zip(edge, edge[1:])]
        yield pd.DataFrame({
            "place": pdf["place"], "windows": np.diff(begin).astype(np.int32), "window": [(window[x] - first).astype(np.int32) for x, first in zip(own, begin)],
            "example": [index.number[found[x]].astype(np.int32) for x in own], "cosine": [cosines[x] for x in own],
        })


def cleaned(index: BlockMaxIndex, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, windows, window, example, cosine) -> (place, votes, nearest, harmless): the vote on each window of a labelled
    document, the cosine of its nearest example elsewhere, and whether what is loosely like it is mostly harmless."""
    for pdf in batches:
        out = []
        for place, size, window, example, cosines in pdf.itertuples(index=False):
            window, found, me = np.asarray(window), index.place[np.asarray(example, np.int64)], np.full(size, place)
            close = (cosines >= FLOOR) & (np.arange(len(window)) - np.searchsorted(window, window) < NEIGHBOURS)
            votes = index.vote(window[close], found[close], cosines[close], size, me)
            others = (index.count[found] > 1) | (index.held_doc[index.held[found]] != place)
            window, found, cosines = window[others], found[others], cosines[others]
            nearest, first = np.zeros(size), np.unique(window, return_index=True)
            nearest[first[0]] = cosines[first[1]]
            weight = np.bincount(window, weights=cosines**2, minlength=size)
            abusive_share = np.bincount(window, weights=cosines**2 * index.labels[found], minlength=size) / np.maximum(weight, 1e-9)
            out.append((place, votes, nearest, (np.bincount(window, minlength=size) >= LEAST_LOOSE) & (abusive_share < LOOSE_SHARE)))
        yield pd.DataFrame(out, columns=["place", "votes", "nearest", "harmless"])


def labelled_sample(labels: DataFrame, most_abusive: int = MOST_ABUSIVE, most_other: int = MOST_OTHER) -> DataFrame:
    """(doc_id, toxic, stands_for) by majority of the annotators, ties left out, at most about so many of either, by hash."""
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("mean")).where("mean <> 0.5")
    judged = cut(judged.select("doc_id", (F.col("mean") > 0.5).cast("int").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in judged.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, most_abusive / max(1, counts.get(1, 0)))).otherwise(min(1.0, most_other / max(1, counts.get(0, 0))))
    return judged.where(F.expr("pmod(xxhash64(doc_id), 1000000) / 1000000.0") < rate).withColumn("stands_for", 1 / rate)


def level_of(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, float, float] | None]:
    """(level, (F1, precision, recall) at it): the highest level whose F1 is within a quarter of a standard error of the best one.

    Labelled documents are richer in abuse than others, so where F1 is flat the lower levels only look as good.
    """
    order = np.argsort(-score, kind="stable")
    score, hit = score[order], (weight * toxic)[order]
    hits, called = np.cumsum(hit), np.cumsum(weight[order])
    if not len(order) or hits[-1] == 0:
        return 0.5, None
    f1 = np.where(np.append(score[:-1] > score[1:], True) & (score > 0.2), 2 * hits / (called + hits[-1]), 0)
    best = f1.max()
    if best == 0:
        return 0.5, None
    pick = int(np.flatnonzero(f1 >= best - 0.25 * np.sqrt(best * (1 - best) / max(1, (toxic > 0).sum())))[0])
    return float((score[pick] + (score[pick + 1] if pick + 1 < len(score) else 0)) / 2), (f1[pick], hits[pick] / called[pick], hits[pick] / hits[-1])


def build(words: DataFrame, labels: DataFrame) -> tuple[BlockMaxIndex, float]:
    """The cleaned index and the score from which a document is flagged (:func:`level_of` the labelled sample, left out)."""
    spark = words.sparkSession
    sample = words.join(F.broadcast(labelled_sample(labels)), "doc_id").select("doc_id", "toxic", "stands_for", "words").dropDuplicates(["doc_id"]).orderBy(F.desc("toxic"), "doc_id").toPandas()
    docs, toxic, lists = sample["doc_id"].to_numpy(np.int64), sample["toxic"].to_numpy(), sample["words"].to_list()
    terms, owner = windows(lists)
    vocabulary = np.unique(terms[terms >= 0])
    asked_terms = spark.sparkContext.broadcast(vocabulary)  # bounded by the sample
    counted = words.mapInPandas(lambda batches: _counted(batches, asked_terms.value), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # bounded
    counts = np.zeros(len(vocabulary) + COUNT_BUCKETS + 1)
    counts[counted["place"]] = counted["n"]
    idf = np.log1p(counts[-1] / (1.0 + counts[:-1]))
    weights = Weights(vocabulary, idf[: len(vocabulary)], idf[len(vocabulary) :])

    sample["place"] = np.arange(len(sample))
    hot = sample.loc[sample["toxic"] == 1, ["place", "words"]]
    index = BlockMaxIndex(terms, weights, toxic[owner].astype(float), owner, docs)
    if not len(hot):
        return index, 0.5
    parts, edges = 2 * spark.sparkContext.defaultParallelism, np.searchsorted(owner, np.arange(len(sample) + 1))
    first = spark.sparkContext.broadcast(index)  # bounded by the sample
    asked = spark.createDataFrame(hot, "place long, words array<int>").repartition(parts)
    near = cut(asked.mapInPandas(lambda batches: neighbours(first.value, batches), "place long, windows int, window array<int>, example array<int>, cosine array<double>"))
    for level in SURE:
        now = spark.sparkContext.broadcast(index)
        votes_of = near.mapInPandas(lambda batches, now=now: cleaned(now.value, batches), "place long, votes array<double>, nearest array<double>, harmless array<boolean>")
        truth = np.zeros(len(terms))
        for row in votes_of.collect():  # bounded by the sample
            votes, nearest = np.array(row["votes"]), np.array(row["nearest"])
            harmless = np.array(row["harmless"], bool)
            lone, sure = (nearest < UNLIKE) & ~harmless, (votes >= level) & ~harmless
            if not sure.any() and lone.any():
                # what is least like anything elsewhere, with the windows that overlap it
                least = int(np.where(lone, nearest, 2).argmin())
                sure = (np.abs(np.arange(len(nearest)) - least) <= 1) & lone
            truth[edges[row["place"]] : edges[row["place"] + 1]][sure] = 1
        index = BlockMaxIndex(terms, weights, truth, owner, docs)
    fine = spark.sparkContext.broadcast(index)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score, _, _ = score_documents(fine.value, pdf["words"].to_list(), pdf["place"].to_numpy())
            yield pdf[["toxic", "stands_for"]].assign(score=score)

    judged = spark.createDataFrame(sample[["place", "toxic", "stands_for", "words"]], "place long, toxic int, stands_for double, words array<int>")
    scores = judged.repartition(parts).mapInPandas(leave_out, "toxic int, stands_for double, score double").toPandas()  # bounded by the sample
    level, index.quality = level_of(scores["score"].to_numpy(), scores["toxic"].to_numpy(), scores["stands_for"].to_numpy())
    return index, level


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged, evidence_doc_id, similarity) of every document.

    Null, empty and wordless texts score 0 without evidence; repeated rows stay. ``source`` is cleaned.
    """
    rows = spread(documents.select("doc_id", clean_source("source").alias("source"), "text"))
    words = cut(rows.mapInPandas(_worded, "doc_id long, source string, words array<int>"))
    index, level = build(words, labels)
    shared = documents.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), 1000):
                part = pdf.iloc[begin : begin + 1000]
                score, evidence, cosine = score_documents(shared.value, part["words"].to_list())
                near = pd.array(np.where(evidence < 0, 0, evidence), dtype="Int64")
                near[evidence < 0] = pd.NA
                yield part[["doc_id", "source"]].assign(score=score, flagged=score >= level, evidence_doc_id=near, similarity=np.where(evidence < 0, np.nan, cosine))

    return spread(words).mapInPandas(run, "doc_id long, source string, score double, flagged boolean, evidence_doc_id long, similarity double")


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p10_found: (doc_id) of the documents that are abusive, hateful or sexually explicit in their own voice."""
    return scored(documents, labels).where("flagged and doc_id is not null").select("doc_id").distinct()


def abuse_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cleaned source (null for none): documents, flagged documents, their rate and the mean score."""
    return scored(documents, labels).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
