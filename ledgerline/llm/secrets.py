"""Secret scans by base patterns and inferred grammars (operator 4).

Base patterns find assignments, access keys and long hexadecimal strings. What they find are labelled credentials: a
bounded sample of each kind becomes a prefix tree, whose statistically compatible states are merged (Hoeffding test)
into a probabilistic automaton. Every other run of credential characters in every text that is as long as the shortest
credential is a candidate, as is what a base span leaves of its run and the value behind the last "=" of one; it is
scored by its likelihood under the automata against that under a model of ordinary words and the odds of meeting a
credential at all, and likely ones are added. The model of words counts all words of all texts that are too short to
be candidates: keys would teach it their own alphabet.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read_table

# The base patterns. Letters of the assignment's name come in either case.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "grammar")
#: Kind of the counts of words of one length.
WORD = "word:"

#: A run of credential characters that may hold an access key or a hexadecimal string, and any run at all.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
ANY_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Characters that do not end a candidate.
ENDS = ".-=_"
#: Candidates whose verdicts a task keeps; when full, the memory is emptied and filled anew.
MEMO_ENTRIES = 200_000
#: What an assignment's name begins with, in lower case; a text without these has no assignment.
NAME_STARTS = ("passw", "secret", "token", "api")

#: Sample of labelled credentials per kind that the automata are fitted on, and the longest string in it (longer ones
#: are found and scored like any other, but not learned from). The sample is the strings with the smallest hashes.
SAMPLE = 512
SAMPLE_CHARS = 256
#: Significance of the test that keeps two states apart.
ALPHA = 0.05
#: Bits per character by which a candidate must be likelier as a credential than as an ordinary word.
MARGIN = 1.0

#: Character classes of words, numbered from 1 on, and the number of each byte; bytes outside words have 0.
SYMBOLS = "0fzA+/_.=-"
#: Bytes whose classes are counted at once.
COUNT_BYTES = 1 << 20


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def symbol(c: str) -> str:
    """Character class: digit, hexadecimal letter, other lower-case letter, upper-case letter, or c itself."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "f"
    if "g" <= c <= "z":
        return "z"
    return "A" if "A" <= c <= "Z" else c


CLASS = bytes(SYMBOLS.find(symbol(chr(b))) + 1 if b < 128 else 0 for b in range(256))


class Automaton:
    """Probabilistic automaton: step[state][symbol] = (state, log2 probability), stop[state] = log2 probability."""

    def __init__(self, step: list[dict[str, tuple[int, float]]], stop: list[float]):
        self.step, self.stop = step, stop

    def bits(self, word: str) -> float:
        """log2 likelihood of word; minus infinity if it has none."""
        state, total = 0, 0.0
        for c in word:
            to = self.step[state].get(symbol(c))
            if to is None:
                return -math.inf
            state, total = to[0], total + to[1]
        return total + self.stop[state]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton | None:
    """Merge the compatible states of the prefix tree of words; None without words."""
    if not words:
        return None
    arrived, ended, child = [0], [0], [{}]
    for word in words:
        at = 0
        arrived[0] += 1
        for c in map(symbol, word):
            if c not in child[at]:
                child[at][c] = len(child)
                arrived.append(0), ended.append(0), child.append({})
            at = child[at][c]
            arrived[at] += 1
        ended[at] += 1
    used = [dict.fromkeys(c, 0) for c in child]  # how often each edge is taken
    for state, edges in enumerate(child):
        for c, to in edges.items():
            used[state][c] = arrived[to]
    scale = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > scale * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if differ(ended[a], arrived[a], ended[b], arrived[b]):
                return False
            for c in child[a].keys() | child[b].keys():
                if differ(used[a].get(c, 0), arrived[a], used[b].get(c, 0), arrived[b]):
                    return False
                if c in child[a] and c in child[b]:
                    pairs.append((child[a][c], child[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree under b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            arrived[a] += arrived[b]
            ended[a] += ended[b]
            for c, to in child[b].items():
                used[a][c] = used[a].get(c, 0) + used[b][c]
                if c in child[a]:
                    pairs.append((child[a][c], to))
                else:
                    child[a][c] = to

    red = [0]
    blue = [(0, c) for c in sorted(child[0])]
    while blue:
        source, c = blue.pop(0)
        state = child[source][c]
        if state in red:
            continue
        for r in red:
            if compatible(r, state):
                child[source][c] = r
                fold(r, state)
                break
        else:
            red.append(state)
        blue = [(r, c) for r in red for c in sorted(child[r]) if child[r][c] not in red]
    place = {state: i for i, state in enumerate(red)}
    step = [
        {c: (place[to], math.log2(used[s][c] / arrived[s])) for c, to in child[s].items()} for s in red
    ]
    return Automaton(step, [math.log2(ended[s] / arrived[s]) if ended[s] else -math.inf for s in red])


class Ordinary:
    """How likely a run is as ordinary text: class bigrams of words with one added to each count."""

    def __init__(self, words: list[str]):
        count: dict[tuple[str, str], int] = defaultdict(int)
        total: dict[str, int] = defaultdict(int)
        for word in words:
            before = ""
            for c in map(symbol, word):
                count[before, c] += 1
                total[before] += 1
                before = c
        self.count, self.total = dict(count), dict(total)

    @classmethod
    def of_counts(cls, pairs: dict[str, int]) -> Ordinary:
        """From the counts of pairs of classes; a single class begins a word."""
        model = cls([])
        for pair, n in pairs.items():
            before, c = pair[:-1], pair[-1]
            model.count[before, c] = n
            model.total[before] = model.total.get(before, 0) + n
        return model

    def bits(self, word: str) -> float:
        sum_, before = 0.0, ""
        for c in map(symbol, word):
            sum_ += math.log2((self.count.get((before, c), 0) + 1) / (self.total.get(before, 0) + 12))
            before = c
        return sum_


class Model(NamedTuple):
    """prior: log2 of how many words there are for each credential. least: length of the shortest credential."""

    automata: tuple[Automaton, ...]
    ordinary: Ordinary
    prior: float = 0.0
    least: int = ACCESS_LENGTH

    def secret(self, run: str) -> bool:
        if not self.automata:
            return False
        best = max(a.bits(run) for a in self.automata)
        return best > -math.inf and best - self.ordinary.bits(run) >= MARGIN * len(run) + self.prior


def scan(text: str) -> tuple[list[Span], list[tuple[str, str]], list[Span]]:
    """Base spans in order, the credentials (kind, string) in them, and long runs that touch none of them."""
    spans, found, runs = base(text)
    return spans, found, [r for r in outside(text, runs, spans, whole=True) if r.end - r.start >= ACCESS_LENGTH]


def base(text: str) -> tuple[list[Span], list[tuple[str, str]], list[Span]]:
    """Base spans in order, the credentials (kind, string) in them, and all long runs."""
    spans, found = [], []
    low = text.lower()
    if any(n in low for n in NAME_STARTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                spans.append(Span("assign", *m.span()))
                found.append(("assign", m[2]))
    runs = [Span("grammar", *m.span()) for m in RUN.finditer(text)]
    for kind, pattern, least in (("access", ACCESS, ACCESS_LENGTH), ("hex", HEX, HEX_LENGTH)):
        for run in runs:
            for m in pattern.finditer(text, run.start, run.end):
                if m.end() - m.start() >= least:
                    spans.append(Span(kind, *m.span()))
                    found.append((kind, m[0]))
    spans.sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    return spans, found, runs


def outside(text: str, runs: list[Span], spans: list[Span], whole: bool = False) -> Iterator[Span]:
    """What spans (by start) leave of runs (by start), or with whole only the runs that they do not touch, without
    characters that end no candidate. Linear in the numbers of both."""
    at, done = 0, 0  # spans before at start before the run; they reach up to done
    for run in runs:
        start = max(run.start, min(done, run.end))
        parts, touched = [], done > run.start
        while at < len(spans) and spans[at].start < run.end:
            s = spans[at]
            if s.end > run.start:
                touched = True
                if s.start > start:
                    parts.append((start, s.start))
                start = max(start, min(s.end, run.end))
            done = max(done, s.end)
            at += 1
        parts.append((start, run.end))
        for a, b in parts if not (whole and touched) else ():
            b = a + len(text[a:b].rstrip(ENDS))
            if a > run.start:  # what parts it from the span before
                a = b - len(text[a:b].lstrip(ENDS + "/"))
            if b > a:
                yield Span("grammar", a, b)


def candidates(text: str, spans: list[Span], least: int) -> Iterator[Span]:
    """Parts of runs outside spans, and the value alone where a part is NAME=value, of at least least characters."""
    for part in outside(text, [Span("grammar", *m.span()) for m in ANY_RUN.finditer(text)], spans):
        value = text.rfind("=", part.start, part.end) + 1
        if value:
            part = Span("grammar", value, part.end)
        if part.end - part.start >= least:
            yield part


def find(text: str, model: Model, memo: dict[str, bool] | None = None) -> list[Span]:
    """All spans by start, then kind: the base spans and those that the grammars add. memo: verdicts to look up."""
    memo = {} if memo is None else memo
    spans, _, _ = base(text)
    added = []
    for part in candidates(text, spans, model.least) if model.automata else ():
        run = text[part.start : part.end]
        verdict = memo.get(run)
        if verdict is None:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            verdict = model.secret(run)
            if len(run) <= SAMPLE_CHARS:
                memo[run] = verdict
        if verdict:
            added.append(part)
    return sorted(spans + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def word_pairs(text: str, spans: list[Span], by_length: bool = False) -> np.ndarray:
    """How often class b follows class a in the words of text, at 16 * a + b; a word is a run of credential characters
    outside the base spans that is no long run. With by_length a row for each length of a word."""
    rest = RUN.sub(lambda m: " " * len(m[0]), text)
    if spans:
        parts, done = [], 0
        for s in spans:
            parts.append(rest[done : s.start])
            done = max(done, s.end)
        rest = " ".join([*parts, rest[done:]])
    data = b"\0" + rest.encode(errors="replace").translate(CLASS) + b"\0"
    counts, at = np.zeros((ACCESS_LENGTH, 256), np.int64), 0
    while at < len(data) - 1:
        end = data.find(b"\0", min(at + COUNT_BYTES, len(data) - 1))  # a block ends where no word is
        part = np.frombuffer(data[at : end + 1], np.uint8)
        gaps = np.flatnonzero(part == 0)
        lengths = np.diff(gaps) - 1  # of the word after each gap; a joined word may be longer than any run
        of = np.repeat(np.minimum(lengths, ACCESS_LENGTH - 1), lengths + 1)
        counts += np.bincount(of * 256 + part[:-1] * 16 + part[1:], minlength=counts.size).reshape(counts.shape)
        at = end
    return counts if by_length else counts.sum(axis=0)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The automata of all kinds of credentials in docs, from a sample of SAMPLE distinct strings of each kind with at
    most SAMPLE_CHARS characters, the model of ordinary words, from all words of docs that are shorter than the shortest
    credential, and the odds, from all words and credentials.

    A null text has none; without any credential there is no automaton and no span is added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "value", "n"])

        pairs = np.zeros((ACCESS_LENGTH, 256), np.int64)
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py() or ""
                spans, found, _ = base(text)
                rows += [(kind, word if len(word) <= SAMPLE_CHARS else None, 1) for kind, word in found]
                pairs += word_pairs(text, spans, by_length=True)
            yield made(rows)
        names = ["", *SYMBOLS]
        cells = ((int(size), int(i) // 16, int(i) % 16) for size, i in np.argwhere(pairs))
        yield made([(f"{WORD}{size}", names[a] + names[b], int(pairs[size, 16 * a + b])) for size, a, b in cells if b])

    found = docs.select(text_col).mapInArrow(run, "kind string, value string, n long")
    seen = materialise(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")

    def sample(kind: str) -> list[str]:
        rows = seen.where((F.col("kind") == kind) & F.col("value").isNotNull()).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        return [r.value for r in rows.collect()]  # bounded by SAMPLE

    samples = [sample(kind) for kind in KINDS[:3]]
    automata = tuple(a for a in map(infer, samples) if a)
    is_word = F.col("kind").startswith(WORD)
    keys, least = seen.where(~is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.min(F.char_length("value"))).first()
    least = least or ACCESS_LENGTH
    pairs, words = defaultdict(int), 0
    for r in seen.where(is_word).collect():  # a row for each pair of classes and length
        words += r.n if len(r.value) == 1 else 0
        if int(r.kind.removeprefix(WORD)) < least:  # longer ones are candidates
            pairs[r.value] += r.n
    prior = max(0.0, math.log2((words + 1) / (keys + 1)))
    return Model(automata, Ordinary.of_counts(pairs), prior, least)


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """docs with spans: array of (kind, start, end), code points of text, in order; replaces a column of that name.

    With redact, text_col has every span (overlapping ones as one) replaced by that string. A null text has no
    spans and stays null. Rows that repeat are scanned alike; an empty table gives an empty table. No shuffle.
    """
    docs = docs.drop("spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and the classes
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def cut(text: str, spans: list[Span]) -> str:
        parts, done = [], 0
        for s in spans:
            if s.end > done:
                if s.start >= done:
                    parts += [text[done : s.start], redact]
                done = s.end
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(at):
                text = value.as_py()
                found = find(text or "", shared.value, memo)
                spans.append([s._asdict() for s in found])
                if redact is not None:
                    texts.append(cut(text, found) if found else text)
            columns = list(batch.columns)
            if redact is not None:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    span = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(span))])
    return docs.mapInArrow(run, schema)


def op4_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's secrets; see with_spans for nulls, empty texts and repeats."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs)).select("doc_id", "spans")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[k].cast("string") for k in ("kind", "start", "end")))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select(
        "doc_id",
        *(number(k) for k in KINDS[:3]),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
