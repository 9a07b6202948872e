"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three machines are compiled from a model file.  The normaliser is a trie of the character map's sources (the
longest one that matches is rewritten, all else is copied) with the rules for white space.  The pieces are an
automaton over characters that emits an id where a piece ends.  Byte fallback takes a character that no piece
covers to the ids of its bytes.

Composed with an input they are a lattice: its states are (position, machine state), its arcs are pieces with
weights, and the encoding is its shortest path in the tropical semiring (weights add along a path, the least
path counts).  A unigram model's machine has one state, and an arc weighs minus the piece's score.  A BPE model's
greedy merging is no sum of scores; its machine's states are the pieces, and an arc leads from the last piece
to the next only where those two are the encoding of their own text, at a weight of one.  Exactly one path of that
lattice is left (``bpe.Paths`` finds it without queueing states); ``shortest_path`` is the general search.

Words are independent parts of the lattice where no piece goes on from text into white space, so the paths of
words that recur are remembered, a bounded number of them; other models are composed with whole texts.

Defined results: a null text counts as empty and has no ids; a literal U+2581 reads as a space in decoding, as
in the library; a very long text or word is encoded whole; repeated rows are encoded each; an empty table gives
an empty result; further columns are ignored.  Unused pieces of a BPE model raise an error.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Paths, Remembered
from .common import map_slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words that are remembered, twice over, and the longest that is.  Most words of a large corpus come once, so many more
#: of them cost each worker memory and save little.
MOST_WORDS, LONGEST_WORD = 100_000, 48
#: Fixed values of the library: what an unknown character costs beyond the worst piece, and a user-defined piece's handicap.
UNKNOWN_PENALTY, OWN_HANDICAP = 10.0, 0.1


def character_map(blob: bytes) -> dict[str, str]:
    """Sources and targets of a model's compiled map: a double-array trie of UTF-8 bytes, then its target strings."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    letters, out, todo = np.arange(1, 256), {}, [(int(offset(units[0])), b"")]
    while todo:
        at, source = todo.pop()
        below = at ^ letters
        below = below[below < len(units)]
        found = below[(units[below] & ((1 << 31) | 0xFF)) == (at ^ below)]
        for child in found.tolist():
            unit = int(units[child])
            grown, deeper = source + bytes([at ^ child]), child ^ int(offset(unit))
            if unit >> 8 & 1:
                start = int(units[deeper]) & 0x7FFFFFFF
                out[grown.decode()] = targets[start : targets.index(b"\0", start)].decode()
            todo.append((deeper, grown))
    return out


class Normaliser:
    """The first machine: rewrites the longest source at each place, then treats white space as the model says."""

    def __init__(self, rules, own: list[str]):
        self.rules, self.targets = rules, character_map(rules.precompiled_charsmap)
        self.targets |= {x: x for x in own}  # user-defined pieces pass as they are
        trie: dict = {}
        for source in self.targets:
            at = trie
            for c in source:
                at = at.setdefault(c, {})
            at[""] = source
        self.trie = trie
        self.starts = re.compile("[" + "".join(map(re.escape, trie)) + "]") if trie else None

    def rewritten(self, text: str) -> str:
        if self.starts is None:
            return text
        out, at = [], 0
        while m := self.starts.search(text, at):
            i = m.start()
            out.append(text[at:i])
            state, k, source = self.trie, i, None
            while k < len(text) and text[k] in state:
                state = state[text[k]]
                k += 1
                source = state.get("", source)
            out.append(text[i] if source is None else self.targets[source])
            at = i + (1 if source is None else len(source))
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        """The normalised text, with spaces as spaces and without the mark before it."""
        text = self.rewritten(text)
        if self.rules.remove_extra_whitespaces:
            text = " ".join(x for x in text.split(" ") if x)
        return text


class Unigram:
    """The second machine of a unigram model: one state; ``arcs`` are the pieces of a text with their weights."""

    start = 0

    def __init__(self, pieces: list[tuple[str, int, float]], unknown: int, unknown_weight: float):
        self.unknown, self.unknown_weight = unknown, unknown_weight
        self.automaton = ahocorasick.Automaton()
        for piece, i, weight in pieces:
            self.automaton.add_word(piece, (len(piece), i, weight))
        self.automaton.make_automaton()

    def arcs(self, text: str) -> list[list[tuple[int, int, float]]]:
        """For each position the arcs that end there: (from position, id, weight); unknown: one character."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, (size, i, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            out[end + 1].append((end + 1 - size, i, weight))
        for i in range(1, len(text) + 1):
            if not any(a[0] == i - 1 for a in out[i]):
                out[i].append((i - 1, self.unknown, self.unknown_weight))
            out[i].sort()
        return out

    def step(self, state, i: int):
        return 0


class Merging:
    """The second machine of a BPE model: states are the pieces, and neighbours must encode their own text."""

    start = -1

    def __init__(self, paths: Paths, unknown: int):
        self.paths, self.unknown = paths, unknown

    def arcs(self, text: str) -> list[list[tuple[int, int, float]]]:
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, (size, i) in self.paths.automaton.iter(text):
            out[end + 1].append((end + 1 - size, i, 1.0))
        for i in range(1, len(text) + 1):
            if text[i - 1] not in self.paths.tokens:
                out[i].append((i - 1, self.unknown, 1.0))
        return out

    def step(self, state, i: int):
        if i == self.unknown:
            return -1
        fits = self.paths.fits[state * self.paths.width + i] if state >= 0 else self.paths.whole[i]
        return i if fits else None


def shortest_path(text: str, machine) -> list[tuple[int, int]]:
    """(start, id) of the arcs on the shortest path through the lattice of a text and a machine."""
    states: list[dict] = [{machine.start: (0.0, -1, None, -1)}]  # state: (cost, from position, from state, id)
    for into in machine.arcs(text)[1:]:
        here: dict = {}
        for start, i, weight in into:
            for state, (cost, *_) in states[start].items():
                to = machine.step(state, i)
                if to is not None and cost + weight < here.get(to, (math.inf,))[0]:
                    here[to] = (cost + weight, start, state, i)
        states.append(here)
    out, at = [], len(text)
    state = min(states[at], key=lambda s: states[at][s][0])
    while at:
        _, start, before, i = states[at][state]
        out.append((start, i))
        at, state = start, before
    return out[::-1]


class Transducer:
    """Normaliser, pieces and byte fallback of a model, given as a file or its bytes."""

    def __init__(self, source: str | bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = f.read()
        model.ParseFromString(source)
        self.rules = model.normalizer_spec
        kinds = {kind: [] for kind in range(1, 7)}  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        for i, p in enumerate(model.pieces):
            kinds[p.type].append((i, p.piece, p.score))
        self.unknown = kinds[2][0][0]
        self.bytes = {int(p[3:5], 16): i for i, p, _ in kinds[6]}
        self.output = [b""] * len(model.pieces)
        for i, p, _ in kinds[1] + kinds[4] + kinds[5]:
            self.output[i] = p.replace(SPACE, " ").encode()
        self.plain = [bool(x) for x in self.output]
        for b, i in self.bytes.items():
            self.output[i] = bytes([b])
        self.output[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.own = {p: i for i, p, _ in kinds[4]}
        self.normaliser = Normaliser(self.rules, [p.replace(SPACE, " ") for p in self.own])
        pieces, self.apart = {p: i for i, p, _ in kinds[1]}, None
        if model.trainer_spec.model_type == 2:
            if kinds[5]:
                raise ValueError("unused pieces of a BPE model are not compiled")
            scores = {p: s for _, p, s in kinds[1]}
            self.paths = Paths(pieces, lambda a, b: -scores[a + b] if a + b in scores else None)
            self.machine, self.names = Merging(self.paths, self.unknown), pieces
            if self.own:  # user-defined pieces never merge: what is between them is encoded by itself
                self.apart = re.compile("|".join(map(re.escape, sorted(self.own, key=len, reverse=True))))
        elif model.trainer_spec.model_type == 1:
            scores = [s for *_, s in kinds[1]]
            most, least = max(0.0, *scores), min(scores)  # the library takes no maximum below zero
            weighed = [(p, i, -s) for i, p, s in kinds[1]] + [(p, i, OWN_HANDICAP - len(p.encode()) * most) for p, i in self.own.items()]
            self.machine, self.names = Unigram(weighed, self.unknown, UNKNOWN_PENALTY - least), pieces | self.own
        else:
            raise ValueError("neither a unigram nor a BPE model")
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in (*pieces, *self.own)) and not any(SPACE in p for p in self.own)
        self.word = Remembered(lambda w: self._packed(SPACE + w), MOST_WORDS)

    def normalised(self, text: str) -> str:
        """What a decoded encoding gives back, where no character is unknown."""
        return self.normaliser(text).replace(SPACE, " ")

    def _path(self, text: str) -> list[str]:
        if isinstance(self.machine, Merging):
            return self.paths.path(text)
        found = shortest_path(text, self.machine)
        ends = [start for start, _ in found[1:]] + [len(text)]
        return [text[start:end] for (start, _), end in zip(found, ends)]

    def _emit(self, text: str) -> list[int]:
        """Ids of the shortest path through a part of the lattice, with byte fallback."""
        if self.apart and (m := self.apart.search(text)):
            return [*self._emit(text[: m.start()]), self.own[m[0]], *self._emit(text[m.end() :])]
        out: list[int] = []
        for piece in self._path(text) if text else ():
            i = self.names.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def _packed(self, text: str) -> bytes:
        return np.array(self._emit(text), np.int32).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The encoding as an array."""
        text = self.normaliser(text)
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_word:
            text = text.replace(" ", SPACE)
            out = np.array(self._emit(SPACE + text if self.rules.add_dummy_prefix else text), np.int32)
            return self._joined(out)
        parts, remembered = text.replace(SPACE, " ").split(" "), self.word
        lead = b""
        if not self.rules.add_dummy_prefix:
            first = parts.pop(0)
            lead = self._packed(first) if first else b""
        if "" in parts:  # runs of spaces belong to the word after them
            words, spaces = [], ""
            for i, part in enumerate(parts):
                if part or i == len(parts) - 1:
                    words.append(spaces + part)
                    spaces = ""
                else:
                    spaces += SPACE
            parts = words
        if len(text) > LONGEST_WORD and max(map(len, parts), default=0) > LONGEST_WORD:
            found = [remembered[p] if len(p) <= LONGEST_WORD else self._packed(SPACE + p) for p in parts]
        else:
            found = [remembered[p] for p in parts]
        return self._joined(np.frombuffer(lead + b"".join(found), np.int32))

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """Neighbouring unknown characters are one unknown."""
        if self.bytes or len(ids) < 2:
            return ids
        unknown = ids == self.unknown
        return ids[~(unknown & np.concatenate(([False], unknown[:-1])))]

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids) -> str:
        """The text of ids; white space at the start goes as the library takes it away, from pieces only."""
        skip = 0
        if self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces:
            for i in ids:
                piece = self.output[i]
                if not self.plain[i] or piece[:1] != b" ":
                    break
                skip += 1
                if len(piece) > 1 or not self.rules.remove_extra_whitespaces:
                    break
        return b"".join(map(self.output.__getitem__, ids))[skip:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    """A worker's transducer of a public model file."""
    import public_tokenizers

    return Transducer(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, decoded_sha256, restored) for each row.

    The text is decoded from the ids again; restored: it is the normalised text.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, flat, sizes, digests, restored = transducer(model), [np.zeros(0, np.int32)], [], [], []
        for text in batch.column(1).to_pylist():
            ids = own.ids(text or "")
            back = own.decode(ids.tolist())
            flat.append(ids)
            sizes.append(len(ids))
            digests.append(hashlib.sha256(back.encode()).hexdigest())
            restored.append(back == own.normalised(text or ""))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32()))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(digests), pa.array(restored)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids", "decoded_sha256", "restored"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_slices(chosen, work, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, restored boolean")
