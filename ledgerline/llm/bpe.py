"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so the text may be
cut between them. The fragments repeat often (words, punctuation), so each is encoded once per worker and looked
up afterwards; a document's ids are the concatenation of its fragments' ids.

Where the vocabulary's pre-tokeniser looks beyond a cut, the cut is left out: after white space (a run of it
leaves its last character to the next word) and before an apostrophe (contractions). Special tokens are cut out
whole before that.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken

#: The pre-tokeniser of byte-level vocabularies with ``use_regex``: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fragments kept per worker; when full, the memory is emptied and filled anew.
MEMO_ENTRIES = 400_000
#: Fragments longer than this are encoded each time and not kept.
MEMO_BYTES = 64
#: Text is split in blocks of about this size, so that a batch of long texts needs bounded memory.
BLOCK_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file of the tokenizers library.

    Ids leave as bytes, each id as a little-endian unsigned 32-bit integer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token.encode() not in self.special
        }
        self.token_bytes = {i: b for b, i in ranks.items()} | {i: b for b, i in self.special.items()}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.may_cut = np.ones((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.may_cut[b[:-1], b[1:]] = False
        self._guard_table()
        self.memo: dict[bytes, bytes] = {}

    def _guard_table(self) -> None:
        space = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
        self.may_cut[space, :] = False
        self.may_cut[:, 0x27] = False
        self.may_cut[:, 0x80:0xC0] = False  # inside a character
        self.may_cut = self.may_cut.ravel()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """cuts[i]: data may be cut before byte i + 1."""
        cut = self.may_cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        # White space beyond ASCII: U+0085 and U+00A0 start with C2, all others with E1, E2 or E3.
        wide = np.zeros(len(data), bool)
        wide[1:] |= data[:-1] == 0xC2
        wide[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        return cut & ~wide[:-1]

    def _encode_fragment(self, fragment: bytes) -> bytes:
        if fragment in self.special:
            ids = [self.special[fragment]]
        else:
            ids = self.encoding.encode_ordinary(fragment.decode())
        packed = np.array(ids, "<u4").tobytes()
        if len(fragment) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[fragment] = packed
        return packed

    def encode_block(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """Packed ids of the texts that lie one after another in data; ends: where each text ends."""
        if not data:
            return [b""] * len(ends)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.cuts(np.frombuffer(data, np.uint8))
        starts = np.concatenate([[0], ends[:-1]])
        for content in self.special:
            at = data.find(content)
            while at >= 0:
                stop = at + len(content)
                text = np.searchsorted(ends, at, "right")
                if stop <= ends[text]:  # else it runs over the end of a text
                    cut[at + 1 : stop] = False
                    cut[[at, stop]] = True
                    at = data.find(content, stop)
                else:
                    at = data.find(content, at + 1)
        cut[starts] = True
        cut[ends] = True
        cut[[0, -1]] = True
        at = np.flatnonzero(cut)
        where = at.tolist()
        get, encode = self.memo.get, self._encode_fragment
        packed = []
        for s, e in zip(where, where[1:]):
            fragment = data[s:e]
            packed.append(get(fragment) or encode(fragment))
        first = np.searchsorted(at, starts).tolist()
        last = np.searchsorted(at, ends).tolist()
        return [b"".join(packed[i:j]) for i, j in zip(first, last)]

    def encode_array(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text, in order; a null text counts as empty."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        view = memoryview(raw) if raw is not None else memoryview(b"")
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1
            j = min(max(j, i + 1), len(texts))
            block = bytes(view[offsets[i] : offsets[j]])
            yield from self.encode_block(block, offsets[i + 1 : j + 1] - offsets[i])
            i = j

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and file."""
    return ForcedBoundaryBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
