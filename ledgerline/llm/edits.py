"""Edit-aware token counts (operator 1).

A document's pre-tokens are the leaves of a segment tree that sums characters and tokens; the trees are kept as a table.
An edit finds its leaves by position and cuts the text into pre-tokens anew from a few characters before it until a
cut meets an old one behind it, from where on nothing changes. This region alone is encoded, and the sums above it are
updated.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO_BYTES, PATTERN, default_vocabulary, encoder
from .common import materialise, read_table

PRE_TOKEN = regex.compile(PATTERN)
#: Characters beyond a cut that it may depend on, besides those of a special token.
BEYOND = 3

# What the query masks, and the replacements. An address is a name of ADDRESS_NAME characters, "@" and
# ADDRESS_HOST.
ADDRESS_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"\+?\(?[0-9](?:[0-9() -]{5,}[0-9])")
ADDRESS_MASK, NUMBER_MASK = "<EMAIL>", "<NUMBER>"

EDITS = T.ArrayType(
    T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("replacement", T.StringType()),
    ])
)
TREE = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("leaf_chars", "leaf_tokens")]
ADDED = ("n_edits", "tokens_before", "tokens_after", "encoded_chars")
NUMBERS = [T.StructField(c, T.LongType()) for c in ADDED]
#: Rows that are worked on at once.
SLICE_ROWS = 256
#: Pre-tokens whose counts a worker keeps; when full, the memory is emptied and filled anew.
MEMO_ENTRIES = 150_000
#: What a task holds of the table of trees before it writes it out.
TREE_BLOCK_BYTES = 32 << 20
_LEAVES = pa.list_(pa.int32())
_ARROW_EDITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))


class Leaves:
    """Cuts texts into pre-tokens and counts the tokens of each, for one vocabulary."""

    def __init__(self, path: str):
        self.bpe = encoder(path)
        special = sorted((s.decode() for s in self.bpe.special), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.reach = BEYOND + max(map(len, special), default=0)
        self.memo: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of text, special tokens whole; an empty text has one empty leaf."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return PRE_TOKEN.findall(text) or [""]
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else PRE_TOKEN.findall(part))]

    def _count(self, word: str) -> int:
        data = word.encode()
        if len(data) > MEMO_BYTES:
            return len(self.bpe.encode_block(data, np.array([len(data)]))[0]) // 4
        n = 1 if data in self.bpe.special else len(self.bpe.encoding.encode_ordinary(word))
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[word] = n
        return n

    def counts(self, words: list[str]) -> list[int]:
        found = list(map(self.memo.get, words))
        if None in found:
            found = [self._count(w) if n is None else n for w, n in zip(words, found)]
        return found


def leaves(text: str, path: str | None = None) -> list[str]:
    return _leaves(path or default_vocabulary()).cut(text)


@lru_cache(maxsize=4)
def _leaves(path: str) -> Leaves:
    return Leaves(path)


class TokenTree:
    """Segment tree over the leaves of a text: sums of characters and of tokens.

    A place of the tree holds the leaves that took the place of one; at first that is one leaf.
    """

    def __init__(self, words: list[str], tokens: list[int], count: Callable[[str], int], cutter: Leaves | None = None):
        self.cutter = cutter or _leaves(default_vocabulary())
        self.count = count
        self.places = [[(w, int(n))] for w, n in zip(words, tokens)]
        self.size = 1 << max(0, len(words) - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        self.chars[self.size : self.size + len(words)] = [len(w) for w in words]
        self.tokens[self.size : self.size + len(words)] = tokens
        for sums in (self.chars, self.tokens):
            width = self.size
            while width > 1:
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
                width //= 2
        self.encoded_chars = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> list[tuple[str, int]]:
        """Every leaf and its tokens, in order."""
        return [leaf for place in self.places for leaf in place if leaf[0]] or [("", 0)]

    def text(self) -> str:
        return "".join(w for place in self.places for w, _ in place)

    def place_at(self, char: int) -> tuple[int, int]:
        """The place that holds the character numbered char, and where it starts; past the end, the last place."""
        char = min(char, int(self.chars[1]) - 1)
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _set(self, place: int, held: list[tuple[str, int]]) -> None:
        self.places[place] = held
        node = place + self.size
        more_chars = sum(len(w) for w, _ in held) - self.chars[node]
        more_tokens = sum(n for _, n in held) - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end (exclusive) of the present text; both are clipped to it."""
        n, reach = int(self.chars[1]), self.cutter.reach
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, at = self.place_at(max(start - reach, 0)) if n else (0, 0)
        more = reach
        while True:
            last = self.place_at(min(end + more, n - 1))[0] if n else 0
            held = [leaf for place in self.places[first : last + 1] for leaf in place]
            before = "".join(w for w, _ in held)
            after = before[: start - at] + replacement + before[end - at :]
            words = self.cutter.cut(after)
            if at + len(before) == n:
                known = []  # the region goes to the end of the text
                break
            # The first new cut behind the edit that is an old cut too, and does not depend on what is not looked at.
            old = {e: i for i, e in enumerate(accumulate(len(w) for w, _ in held), 1)}
            shift = len(after) - len(before)
            cuts = enumerate(accumulate(map(len, words)), 1)
            met = next(((i, e) for i, e in cuts if e >= start - at + len(replacement) and e - shift in old), None)
            if met and met[1] <= len(after) - reach:
                words, known = words[: met[0]], held[old[met[1] - shift] :]
                break
            more *= 2
        self.encoded_chars += sum(map(len, words))
        self._set(first, [*((w, self.count(w)) for w in words), *known])
        for place in range(first + 1, last + 1):
            if self.places[place]:
                self._set(place, [])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches cut into parts of SLICE_ROWS rows; a batch without rows goes on as it is."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def added(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with the columns of new, in place of its own of these names or after them."""
    columns = dict(zip(batch.schema.names, batch.columns)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def tree_batches(batches: Iterator[pa.RecordBatch], text_col: str, path: str) -> Iterator[pa.RecordBatch]:
    cutter = _leaves(path)
    for batch in slices(batches):
        chars, tokens = [], []
        for value in batch[text_col]:
            words = cutter.cut(value.as_py() or "")
            tokens.append(np.array(cutter.counts(words), np.int32))
            chars.append(np.fromiter(map(len, words), np.int32, len(words)))
        yield added(batch, {"leaf_chars": pa.array(chars, _LEAVES), "leaf_tokens": pa.array(tokens, _LEAVES)})


def edit_batches(batches: Iterator[pa.RecordBatch], edits_col: str, text_col: str, path: str) -> Iterator[pa.RecordBatch]:
    cutter = _leaves(path)

    def count(word: str) -> int:
        return cutter.counts([word])[0]

    for batch in slices(batches):
        texts, chars, tokens, numbers = [], [], [], []
        for text, sizes, counts, edits in zip(*(batch[c] for c in (text_col, "leaf_chars", "leaf_tokens", edits_col))):
            edits = [e for e in edits.as_py() or () if e and e["start"] is not None]
            size, before = (
                x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(1, np.int32) for x in (sizes, counts)
            )
            if not edits:
                texts.append(text.as_py()), chars.append(size), tokens.append(before)
                numbers.append((0, int(before.sum()), int(before.sum()), 0))
                continue
            ends = list(accumulate(size.tolist()))
            whole = text.as_py() or ""
            tree = TokenTree([whole[a:b] for a, b in zip([0, *ends], ends)], before, count, cutter)
            for e in edits:
                tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["replacement"] or "")
            texts.append(tree.text())
            kept = tree.leaves()
            chars.append(np.array([len(w) for w, _ in kept], np.int32))
            tokens.append(np.array([n for _, n in kept], np.int32))
            numbers.append((len(edits), int(before.sum()), tree.total, tree.encoded_chars))
        new = {text_col: pa.array(texts, pa.string())}
        new |= {"leaf_chars": pa.array(chars, _LEAVES), "leaf_tokens": pa.array(tokens, _LEAVES)}
        yield added(batch, new | {c: pa.array([x[i] for x in numbers], pa.int64()) for i, c in enumerate(ADDED)})


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every mail address, leftmost first. Linear: a name is looked for before an "@" alone."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in ADDRESS_NAME:
            start -= 1
        host = ADDRESS_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(done, at + 1))


def mask_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    def of(text: str) -> list[dict]:
        mails = list(addresses(text))
        ends = [b for _, b in mails]

        def apart(m: re.Match) -> bool:
            i = bisect_left(ends, m.start() + 1)  # the first address that ends after the number begins
            return i == len(mails) or m.end() <= mails[i][0]

        spans = [(a, b, ADDRESS_MASK) for a, b in mails]
        spans += [(*m.span(), NUMBER_MASK) for m in NUMBER.finditer(text) if apart(m)]
        return [{"start": a, "end": b, "replacement": r} for a, b, r in sorted(spans, reverse=True)]

    for batch in slices(batches):
        yield added(batch, {"edits": pa.array([of(t.as_py() or "") for t in batch[text_col]], _ARROW_EDITS)})


def _extended(docs: DataFrame, *fields: T.StructField) -> tuple[DataFrame, T.StructType]:
    """docs without columns of the fields' names, and its schema with the fields."""
    docs = docs.drop(*(f.name for f in fields))
    return docs, T.StructType([*docs.schema.fields, *fields])


def token_trees(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with leaf_chars and leaf_tokens, the leaves of every text's tree; columns of these names are replaced.

    A null text counts as empty; an empty text has one empty leaf. This is the one time that a text is encoded whole.
    """
    path = vocabulary or default_vocabulary()
    docs, schema = _extended(docs, *TREE)
    return docs.mapInArrow(lambda batches: tree_batches(batches, text_col, path), schema)


def apply_edits(
    trees: DataFrame, edits_col: str = "edits", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """trees (docs with leaf_chars and leaf_tokens) with edits_col applied to text and leaves.

    Adds n_edits, tokens_before, tokens_after and encoded_chars (characters that were encoded again). edits_col: array
    of (start, end, replacement), applied in order; places are code points of the text as the edits before left it,
    clipped to it; a null edit or start changes nothing, a null end is the start, a null replacement is empty. Null
    texts count as empty and come back as empty if there are edits. Other columns stay, as do rows that repeat; an
    empty table gives an empty table.
    """
    path = vocabulary or default_vocabulary()
    trees, schema = _extended(trees, *NUMBERS)
    return trees.mapInArrow(lambda batches: edit_batches(batches, edits_col, text_col, path), schema)


def mask_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with edits that replace addresses and long numbers, last first, so that each place holds when its turn
    comes. A number that touches an address is left out."""
    docs, schema = _extended(docs, T.StructField("edits", EDITS))
    return docs.mapInArrow(lambda batches: mask_batches(batches, text_col), schema)


def masked_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """apply_edits(mask_edits(trees)) in one pass over the written table of docs' trees, so that a task has one Python
    worker. The table stays, for further edits of the same documents."""
    path = vocabulary or default_vocabulary()
    trees = materialise(token_trees(docs, text_col, path), "trees", TREE_BLOCK_BYTES)
    trees, schema = _extended(trees, T.StructField("edits", EDITS), *NUMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edit_batches(mask_batches(batches, text_col), "edits", text_col, path)

    return trees.mapInArrow(run, schema)


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its addresses and long numbers are masked; see token_trees and
    apply_edits for nulls, empty texts and repeats."""
    counted = masked_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select(
        "doc_id", "n_edits", "tokens_before", "tokens_after", "encoded_chars",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_after"),
        F.size("leaf_tokens").cast("long").alias("n_leaves"),
    )
