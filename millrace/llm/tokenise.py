"""Problem 8: encoding of a whole corpus with a public tokenizer, by monoid tree reduction.

A text is halved recursively. A node of the tree is a monoid element: the windows of its middle, whose ids nothing to the
left or right can change, and the text of its two margins, which a neighbour still can. Joining two nodes makes one more
window of the left one's tail and the right one's head; a node without a stable place is all margin, so the window grows
until there is one. A place is stable where the tokenizer's pre-token pattern ends a match whatever follows and starts
afresh whatever came before: between a letter, digit or closing mark and a plain blank, and between a letter or digit and
plain punctuation. The windows of a batch of texts are encoded together once their trees are done, each window once, and
a text's ids are those of its windows. They equal those of the text encoded in one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from millrace.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LEAF_CHARS = 2048
STABLE = re.compile(r"(?<=[^\W_])(?=[ .,;:!?，。！？；：])|(?<=[.,;:!?)])(?= )")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@dataclass
class Node:
    """``head`` and ``tail`` are open text; ``windows`` is None while the node has no stable place and is all ``head``."""

    head: str
    windows: list[str] | None = None
    tail: str = ""


def leaf(text: str) -> Node:
    first = STABLE.search(text)
    if first is None:
        return Node(text)
    last, reach = first.start(), 32
    while last == first.start() and reach < 2 * len(text):  # the last stable place, looked for from the end
        for found in STABLE.finditer(text, max(first.start(), len(text) - reach)):
            last = found.start()
        reach *= 4
    return Node(text[: first.start()], [text[first.start() : last]], text[last:])


def join(a: Node, b: Node) -> Node:
    """The monoid's product; it is associative."""
    if a.windows is None and b.windows is None:
        text = a.head + b.head
        # a stable place may lie on the seam itself
        return leaf(text) if STABLE.search(text, max(0, len(a.head) - 1), min(len(text), len(a.head) + 1)) else Node(text)
    if a.windows is None:
        return Node(a.head + b.head, b.windows, b.tail)
    if b.windows is None:
        return Node(a.head, a.windows, a.tail + b.head)
    return Node(a.head, [*a.windows, a.tail + b.head, *b.windows], b.tail)


def tree(text: str, leaf_chars: int = LEAF_CHARS) -> Node:
    if len(text) <= leaf_chars:
        return leaf(text)
    middle = len(text) // 2
    return join(tree(text[:middle], leaf_chars), tree(text[middle:], leaf_chars))


def windows(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """The windows of a text in order; together they are the text."""
    root = tree(text, leaf_chars)
    return [w for w in (root.head, *(root.windows or ()), root.tail) if w]


def encode(tokenizer: Tokenizer, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text``; an empty text has none."""
    return [i for done in tokenizer.encode_batch_fast(windows(text, leaf_chars), add_special_tokens=False) for i in done.ids]


def decode(tokenizer: Tokenizer, ids: list[int], leaf_ids: int = 4096) -> bytes:
    """Bytes of ``ids``: the two halves' bytes, concatenated up the same kind of tree."""
    if len(ids) > leaf_ids:
        middle = len(ids) // 2
        return decode(tokenizer, ids[:middle], leaf_ids) + decode(tokenizer, ids[middle:], leaf_ids)
    table = _byte_table()
    return b"".join(bytes(table[c] for c in tokenizer.id_to_token(i)) for i in ids)


@lru_cache(maxsize=1)
def _byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _encoded(path: str, leaf_chars: int, texts: list) -> Iterator[list]:
    """The encodings of each text's windows, in order."""
    tokenizer = load(path)
    for begin in range(0, len(texts), 256):
        cut_up = [windows(t, leaf_chars) if isinstance(t, str) and t else [] for t in texts[begin : begin + 256]]
        done = iter(tokenizer.encode_batch_fast([w for ws in cut_up for w in ws], add_special_tokens=False))
        for ws in cut_up:
            yield list(islice(done, len(ws)))


def encoder(path: str = TOKENIZER, leaf_chars: int = LEAF_CHARS):  # noqa: ANN201
    """A pandas UDF text -> ids; null and empty texts have the empty list."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = [list(chain.from_iterable([e.ids for e in parts])) for parts in _encoded(path, leaf_chars, batch.to_list())]
            yield pd.Series(out, index=batch.index, dtype=object)

    return ids.asNondeterministic()  # else a filter on the result would run it twice


def counter(path: str = TOKENIZER, leaf_chars: int = LEAF_CHARS):  # noqa: ANN201
    """A pandas UDF text -> number of ids, without making them into lists."""

    @F.pandas_udf(IntegerType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sum(map(len, parts)) for parts in _encoded(path, leaf_chars, batch.to_list())], index=batch.index, dtype=np.int32)

    return count.asNondeterministic()


def encode_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """p8_ids: (doc_id, ids) of every document. Repeated rows stay; extra columns are ignored."""
    return spread(documents.select("doc_id", "text")).select("doc_id", encoder(path)("text").alias("ids"))


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens); a null or empty text has 0 tokens."""
    rows = spread(documents.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", counter(path)("text").alias("n_tokens"))
