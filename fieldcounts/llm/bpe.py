"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens and accepts exactly the token sequences that the
merges produce.  It starts as one state that loops on every base symbol, and a
merge gadget is applied for each merge (u, v) -> w in order: the state that
u leads to is copied without its v arc (after an unmerged u no v may follow),
the u arcs are led to the copy, and every state with a u arc gets a w arc to
where v led.  All arcs of one label always lead to one state, so a state is
named by the token last read, and a state differs from the first one only by
the arcs its gadgets took away, each with the step that did.  An arc's label w
was added where, at its own step, the arc of its left part existed; so whether
state s has the arc w follows from the arcs removed along w's chain of left
parts before each part was merged, and along s's chain of right parts before
those were.  ``Automaton.step`` answers that from the table of removals and
keeps the answer in a transition table.

A word is encoded by walking the automaton along its symbols: every prefix of
a word has one accepted reading, so each position is entered by one arc at
most, and the walk that reaches the end is the word's tokens.

Texts are split as the tokenizer file says (NFC, white space, lower case, then
letters / single digits / other runs), and words are encoded once per task.
Decoding emits the labels of the ids' arcs; without a decoder in the file they
are joined by blanks, as the tokenizers library does.

Defined results: NULL and empty texts have no tokens and decode to an empty
text; strings of the file's special tokens become their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

CACHE_WORDS = 300_000      # encoded words a task remembers; it forgets all when full
TABLE_ARCS = 2_000_000     # entries of the transition table; it starts anew when full
NO_ARCS: dict = {}
TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves, the others for
    the code points from 256 on, in byte order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters, spare = [], 256
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Automaton:
    """The token automaton of a merge list over byte letters; words end with the symbol ``end``."""

    END = "\n"     # stands for the end-of-word suffix inside symbol strings

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], suffix: str):
        def symbol(text):
            return text[:-len(suffix)] + self.END if suffix and text.endswith(suffix) else text

        self.ids = {symbol(t): i for t, i in vocab.items()}
        if len(self.ids) != len(vocab):
            raise ValueError("two vocabulary entries denote one token")
        self.whole = bool(suffix)
        self.made: dict[str, tuple[int, str, str]] = {}       # token -> (step, left part, right part)
        self.removed: dict[str, dict[str, int]] = {}          # state -> label taken away -> step
        for step, (left, right) in enumerate(merges):
            u, v = symbol(left), symbol(right)
            self._gadget(step, u, v)
        self.table: dict[str, dict[str, bool]] = {}           # transition table: state -> label -> arc or none
        self.filled = 0
        self.reach: dict[str, int] = {}                       # longest label that starts with up to 3 symbols
        for t in self.ids:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None)
                        for t in self.ids}                    # next label on the same start

    def _gadget(self, step: int, u: str, v: str) -> None:
        w = u + v
        if w in self.made or w not in self.ids:
            raise ValueError("each merge must make one vocabulary token of its own")
        self.removed.setdefault(u, {})[v] = step
        self.made[w] = (step, u, v)

    def step(self, state: str, label: str) -> bool:
        """Whether the state after token ``state`` has an arc ``label``; fills the transition table."""
        if self.filled > TABLE_ARCS:
            self.table.clear()
            self.filled = 0
        known = self._arc(state, label)
        self.table.setdefault(state, {})[label] = known
        self.filled += 1
        return known

    def _arc(self, state: str, label: str) -> bool:
        chain = [(label, sys.maxsize)]                        # left parts, each with the step that merged it
        while chain[-1][0] in self.made:
            at, left, _ = self.made[chain[-1][0]]
            chain.append((left, at))
        part, before = state, sys.maxsize                     # right parts of the state likewise
        while True:
            gone = self.removed.get(part)
            if gone:
                for text, until in chain:
                    at = gone.get(text)
                    if at is not None and at < before and at <= until:
                        return False
            if part not in self.made:
                return True
            before, _, part = self.made[part]

    def _longest(self, text: str, i: int) -> str | None:
        """The longest label that starts at a position of the word."""
        ids = self.ids
        for k in range(min(self.reach.get(text[i:i + 3], 2), len(text) - i), 0, -1):
            label = text[i:i + k]
            if label in ids:
                return label
        return None

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one word given as byte letters (the end symbol is added here).

        Follows the longest arc first and steps back where the word cannot be
        finished; a position is entered by one arc only, so a position that
        failed once has failed for good.
        """
        text = symbols + self.END if self.whole else symbols
        n, shorter, table, longest = len(text), self.shorter, self.table, self._longest
        path, label, i, failed = [], longest(text, 0), 0, set()
        while True:
            if path:
                state = path[-1]
                arcs = table.get(state, NO_ARCS)
                while label is not None:
                    if i + len(label) not in failed:
                        arc = arcs.get(label)
                        if arc or arc is None and self.step(state, label):
                            break
                    label = shorter[label]
            else:
                while label is not None and len(label) in failed:
                    label = shorter[label]
            if label is not None:
                path.append(label)
                i += len(label)
                if i == n:
                    return [self.ids[t] for t in path]
                label = longest(text, i)
            elif path:
                failed.add(i)
                label = path.pop()
                i -= len(label)
                label = shorter[label]
            else:
                raise ValueError("the word has a symbol outside the vocabulary")


def _class(kind: str) -> str:
    """The ranges of code points whose general category starts with a letter, for a character class."""
    marks = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    inside = [unicodedata.category(c)[0] == kind for c in marks] + [False]
    edges = [k for k in range(len(inside)) if inside[k] != (k > 0 and inside[k - 1])]
    return "".join(f"\\U{ord(marks[a]):08x}-\\U{ord(marks[b - 1]):08x}" for a, b in zip(edges[::2], edges[1::2]))


#: White space of the tokenizer's pattern (Unicode White_Space); str.split() knows four controls more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """Texts to token ids and back, for one tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.build(path, model)
        self.labels = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        letter, digit = _class("L"), _class("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACE}{letter}{digit}]+")
        self.gap = re.compile(f"[{SPACE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}      # white-space separated piece -> its ids
        self.known: dict[str, bytes] = {}       # word -> its ids

    def build(self, path: str, model: dict) -> None:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(merges, model["vocab"], model.get("end_of_word_suffix") or "")

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            ids = self.word_ids("".join(map(self.letters.__getitem__, word.encode("utf-8"))))
            found = self.known[word] = np.array(ids, dtype="<u4").tobytes()
        return found

    def word_ids(self, letters: str) -> list[int]:
        return self.automaton.encode(letters)

    def _piece(self, piece: str) -> bytes:
        if self.specials and "<|" in piece:
            parts = self.specials.split(piece)
            if len(parts) > 1:
                return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p)
                                for k, p in enumerate(parts))
        return self._plain(piece)

    def _plain(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")   # no final-sigma rule
        return b"".join(map(self._word, self.words.findall(piece.lower())))

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = text.split() if not _ODD_SPACE.search(text) else [p for p in self.gap.split(text) if p]
        known, out = self.pieces, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = known[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: id, token ids (little-endian unsigned 32-bit, binary) and the text decoded from them."""
    path = tokenizer or default_tokenizer()
    text_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()),
                 pa.array([enc.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
            .withColumnRenamed("id", id_col))


def digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, and SHA-256 of the ids and of the decoded text."""
    path = tokenizer or default_tokenizer()
    text_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = enc.encode(text)
                count.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, "
                             "ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(table(spark, sf_dir, "documents"))
