"""Token counts at every prefix of a text, exactly as the tokenizers library gives them.

A byte-level BPE file splits texts by a fixed pattern and merges bytes within each piece.  The table of
``bpe.Paths`` holds the exact count at every prefix of a piece.  A prefix of a text is encoded like the text up
to the piece that it ends in, with three exceptions that the table takes into account: white space at a prefix's end
is one piece, a contraction is one only when it is whole, and so is a special token.  So ``prefix_counts`` gives a
text's table in one pass; with it stored, ``PrefixCounts`` (on the driver) and ``truncated`` (on a table of
stored counts) answer how many tokens a prefix has and where a budget ends without encoding anything again.

Runs of characters between single spaces are encoded independently of each other, so whole texts are counted as
sums over runs, and runs that recur are remembered (a bounded number); where a text goes over the limit, the table of
the one run that holds the limit gives the exact place.

Defined results: a null text counts as empty (no bytes, no tokens); strings of special tokens inside a text
count as the one token that the library's default makes of them; a very long text, or one without any space, is
counted whole; repeated rows are counted each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Paths, Remembered
from .common import map_slices

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Contractions that the splitting pattern of byte-level files names.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Runs that are remembered by a worker, twice over, and the longest that is.
MOST_RUNS, LONGEST_RUN = 300_000, 48


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level files: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Exact prefix counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = _byte_letters()
        back = lambda s: "".join(chr(letters[c]) for c in s)  # noqa: E731  one character for each byte
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = {back(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(back(a), back(b)): i for i, (a, b) in enumerate(merges)}
        self.paths = Paths(tokens, lambda a, b: ranks.get((a, b)))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.piece = Remembered(self._piece, MOST_RUNS)
        self.run = Remembered(self._count, MOST_RUNS)  # keys lack the space that they begin with
        self.inside = Remembered(self._inside, MOST_RUNS // 8)
        self.pieces = regex.compile(public_tokenizers.PATTERN).finditer
        self.white = regex.compile(r"\s+")

    def _piece(self, piece: str) -> int:
        return self.paths.table(piece.encode().decode("latin-1"))[0][-1]

    def _count(self, run: str) -> int:
        return self.count_run(" " + run)

    def count_run(self, run: str) -> int:
        return sum(self.piece[p] if len(p) <= LONGEST_RUN else self._piece(p) for p in self.split(run))

    def runs(self, text: str) -> list[str]:
        """The text cut before each single space between two characters that are no white space."""
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def sums(self, text: str) -> tuple[list[int], list[int]]:
        """(chars, tokens): code points and tokens of each run of the text; a special token is a run."""
        chars: list[int] = []
        tokens: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            self._segment(text[at : m.start()], chars, tokens)
            chars.append(len(m[0]))
            tokens.append(1)
            at = m.end()
        self._segment(text[at:] if at else text, chars, tokens)
        return chars, tokens

    def _segment(self, text: str, chars: list[int], tokens: list[int]) -> None:
        if not text:
            return
        runs = self.runs(text)
        chars += map(len, runs)
        remembered = self.run
        tokens.append(self.count_run(runs[0]))
        tokens += [remembered[r[1:]] if len(r) <= LONGEST_RUN and r[0] == " " else self.count_run(r) for r in runs[1:]]

    def _inside(self, piece: str) -> list[int]:
        """Tokens of every prefix of a piece, in code points, the empty one first."""
        counts = self.paths.table(piece.encode().decode("latin-1"))[0]
        if len(counts) == len(piece) + 1:
            return counts
        ends = accumulate((len(c.encode()) for c in piece), initial=0)
        return [counts[i] for i in ends]

    def _within(self, piece: str) -> list[int]:
        return self.inside[piece] if len(piece) <= LONGEST_RUN else self._inside(piece)

    def segment_counts(self, text: str) -> list[int]:
        """Tokens of every prefix of a text whose special tokens are ordinary text."""
        out, before = [0], 0
        white_start = white_before = -1
        for m in self.pieces(text):
            piece, start = m[0], m.start()
            lead = self.white.match(piece)
            lead = lead.end() if lead else 0
            if lead:
                if white_start < 0:
                    white_start, white_before = start, before
                run = self._within(self.white.match(text, white_start)[0])
                out += [white_before + run[k - white_start] for k in range(start + 1, start + lead + 1)]
            whole = self._within(piece)
            if lead < len(piece):
                white_start = -1
                if piece in CONTRACTIONS:
                    out += [before + self.count_run(piece[:k]) for k in range(1, len(piece))]
                    out.append(before + whole[-1])
                else:
                    out += [before + c for c in whole[lead + 1 :]]
            before += whole[-1]
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every prefix of the text, in code points, the empty one first."""
        out, at = [0], 0
        for m in self.special.finditer(text) if self.special else ():
            before, counts = out[-1], self.segment_counts(text[at : m.end()])
            out += [before + c for c in counts[1:-1]]
            out.append(before + counts[m.start() - at] + 1)
            at = m.end()
        before = out[-1]
        return out + [before + c for c in self.segment_counts(text[at:])[1:]]

    def limit_chars(self, text: str, chars: list[int], tokens: list[int], limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens, given the sums of its runs."""
        upto = list(accumulate(tokens, initial=0))
        if upto[-1] <= limit:
            return len(text)
        i = bisect_right(upto, limit) - 1  # the first run that ends above the limit; all later prefixes are above it
        starts = list(accumulate(chars, initial=0))
        special = self.special is not None and self.special.fullmatch(text, starts[i], starts[i + 1]) is not None
        # what is before a special token may join its first characters
        first = i - 1 if special and i and not self.special.fullmatch(text, starts[i - 1], starts[i]) else i
        counts = self.segment_counts(text[starts[first] : starts[i + 1]])
        last = len(counts) - (1 if special else 0)
        return starts[first] + max(k for k in range(last) if upto[first] + counts[k] <= limit)


class PrefixCounts:
    """The stored table of a text: counts of prefixes and places of budgets, without encoding again."""

    def __init__(self, coder: ByteLevel, text: str):
        self.counts = np.array(coder.prefix_counts(text), np.int64)
        self.least = np.minimum.accumulate(self.counts[::-1])[::-1]  # of this prefix and all longer ones

    def at(self, chars: int) -> int:
        """Tokens of the prefix of so many code points."""
        return int(self.counts[chars])

    def fits(self, budget: int) -> int:
        """Code points of the longest prefix with at most so many tokens."""
        return int(np.searchsorted(self.least, budget, "right")) - 1


@functools.lru_cache(maxsize=2)
def coder(name: str) -> ByteLevel:
    """A worker's coder of a public tokenizer file."""
    import public_tokenizers

    return ByteLevel(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) for each row.

    limit_chars: code points of the text's longest prefix with at most ``limit`` tokens.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, sizes, counts, cuts = coder(tokenizer), [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            chars, tokens = own.sums(text)
            counts.append(n := sum(tokens))
            sizes.append(len(text.encode()))
            cuts.append(len(text) if n <= limit else own.limit_chars(text, chars, tokens, limit))
        over = [n > limit for n in counts]
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over), pa.array(cuts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_slices(chosen, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_tables(docs: DataFrame, tokenizer: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, counts): the tokens of every prefix of each text, the empty one first."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(tokenizer)
        tables = [own.prefix_counts(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int32()))], ["doc_id", "counts"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_slices(chosen, work, "doc_id long, counts array<int>", rows=32)


def truncated(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, tokens): from stored tables, the longest prefix with at most ``budget`` tokens."""
    chars = F.size("counts") - 1 - F.array_position(F.transform(F.reverse("counts"), lambda c: c <= budget), True).cast("int") + 1
    return tables.select("doc_id", chars.alias("chars"), F.get("counts", chars).alias("tokens"))
