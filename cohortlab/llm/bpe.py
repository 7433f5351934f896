"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The text is cut into pieces as the tokenizer's pattern says; every piece is encoded on its bytes. For each prefix of a
piece there is exactly one token that its encoding ends with. Candidates are the tokens that end there, longest first: the state of a
suffix-link automaton over the vocabulary (Aho-Corasick) names the longest, and links lead to the shorter ones. A
candidate is right if it and the last token of the prefix before it stay apart when encoded together (pair test, by undoing
merges, remembered). Back-pointers from the end give the ids. Time is linear in the piece's length times the tokens that end at one
place, also for one piece of a whole text.

Defined results: NULL counts as empty: no ids, empty text; repeated rows are encoded alike; lone halves of surrogate pairs cannot occur in
Spark's strings. Only ids, lengths and digests leave the tasks, unless the ids are asked for. Other columns are never read.
The vocabulary file is read where the path is valid: on the workers of a cluster it must be at the same place.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pattern of the public tokenizer, fixed: contractions, letters, digits, other, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in Latin-1 alone, where the standard library's engine is faster: its letters, numbers and white space.
LATIN_L, LATIN_N, LATIN_W = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = (
    rf" ?[{LATIN_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_N}]+| ?[^{LATIN_W}{LATIN_L}{LATIN_N}]+|[{LATIN_W}]+(?![^{LATIN_W}])|[{LATIN_W}]+"
)
#: Pieces remembered by a worker, new and old ones each; when the new ones are as many, they become the old ones.
REMEMBERED = 60_000
#: Longer pieces are not remembered.
LONG = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.token_bytes = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.token_bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (ids[raw(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            token = ids[self.token_bytes[left] + self.token_bytes[right]]
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(token, (left, right))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.specials.items():
            self.token_bytes[i] = text.encode()
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pieces, self.latin_pieces = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self._automaton(ids)
        # by id, for decoding many at once
        self.table = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """Trie of the tokens with suffix links; ``ends`` lists, per state, (id, length) of all tokens that are suffixes, longest first."""
        step: list[dict[int, int]] = [{}]
        token_at: list[int] = [-1]
        for word, i in ids.items():
            at = 0
            for b in word:
                if b not in step[at]:
                    step[at][b] = len(step)
                    step.append({})
                    token_at.append(-1)
                at = step[at][b]
            token_at[at] = i
        link = [0] * len(step)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        step[0] = {b: step[0].get(b, 0) for b in range(256)}  # from the root every byte leads on
        queue = [s for s in step[0].values() if s]
        for s in queue:
            ends[s] = ((token_at[s], len(self.token_bytes[token_at[s]])),) if token_at[s] >= 0 else ()
        for s in queue:
            for b, t in step[s].items():
                up = link[s]
                while up and b not in step[up]:
                    up = link[up]
                link[t] = step[up].get(b, 0)
                own = ((token_at[t], len(self.token_bytes[token_at[t]])),) if token_at[t] >= 0 else ()
                ends[t] = own + ends[link[t]]
                queue.append(t)
        self.step, self.link, self.ends = step, link, ends

    def _goto(self, state: int, b: int) -> int:
        """The state after byte ``b`` where the trie has no such edge; remembered as an edge."""
        at = state
        while b not in self.step[at]:
            at = self.link[at]
        self.step[state][b] = self.step[at][b]
        return self.step[at][b]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how their joined bytes are encoded."""
        if len(self.apart) > 2 * REMEMBERED:
            self.apart.clear()
        known = self.apart[left << 32 | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the last merges one by one. A pair across the border that merges earlier than those that made the two
        tokens would have been taken, so the tokens would not stand side by side.
        """
        none = len(self.rank) + 1
        limit = none
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            made_left = self.rank[self.parts[left]] if left in self.parts else -1
            made_right = self.rank[self.parts[right]] if right in self.parts else -1
            if made_left < 0 and made_right < 0:
                return True
            # undo the later of the two merges; of the same merge twice, the right one happened last
            if made_left > made_right:
                limit = made_left
                left = self.parts[left][1]
            else:  # across the border is further left, so there even the same merge comes first
                limit = made_right + 1
                right = self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        step, ends, apart = self.step, self.ends, self.apart
        last, size = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        state = 0
        for i, b in enumerate(piece, 1):
            after = step[state].get(b)
            state = self._goto(state, b) if after is None else after
            for token, length in ends[state]:
                if i != length:
                    left = last[i - length]
                    ok = apart.get(left << 32 | token)
                    if ok is None:
                        ok = self.stay_apart(left, token)
                    if not ok:
                        continue
                last[i], size[i] = token, length
                break
            else:
                raise ValueError("the vocabulary's merges do not give every prefix a last token")
        out, n = [], len(piece)
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit numbers; not called for those among the new known ones."""
        out = self.known_before.get(piece)
        if out is None:
            ids = self.encode_piece(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known, self.known_before = {}, self.known
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed. Special tokens in the text are special tokens."""
        if self.special_re is not None and any(s in text for s in self.specials):
            return b"".join(
                np.array([self.specials[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.special_re.split(text))
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        latin = text.isascii() or max(text) <= "\xff"
        packed = self.packed
        out = []
        for piece in (self.latin_pieces if latin else self.pieces)(text):
            out.append(self.known.get(piece) or packed(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")

    def forget(self) -> None:
        """Drop what was remembered; the worker may go on with other work."""
        self.known, self.known_before, self.apart = {}, {}, {}


_LOADED: dict[str, Bpe] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Bpe:
    """The encoder of a file, made once per process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256) of every row, and ``ids`` (packed) on demand. Nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in b.column(1):
                packed = bpe.encode(text.as_py() or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
                if with_ids:
                    ids.append(packed)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        bpe.forget()

    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, kinds)
