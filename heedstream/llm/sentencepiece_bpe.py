"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment of text starts as single symbols. An agenda of adjacent pairs,
best score first and leftmost first among equals, names the next pair to
merge; each merge puts at most two new pairs on the agenda. Characters
outside the vocabulary fall back to byte pieces. The vocabulary holds no
piece with a word mark behind another character, so words are independent
of each other: a task keeps the pieces of words it has met, in two
generations so that frequent words stay, and leaves the first ones, which
tend to be the frequent ones, to the worker's next task. Short words keep their agenda as a
list of pair scores, long ones as a heap. In every Arrow batch the words new
to the worker are also given to the sentencepiece library, and so is one whole
text of every 256, encoded and decoded; a difference raises an error and ends
the job, since a result that the library would not give is of no use.

Nulls are empty texts; an empty text has no pieces and decodes to nothing.
Texts are taken whole. Rows repeat in the output as in the input, other
columns stay out.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import lean

MARK = "▁"
#: Words of a generation that a task keeps, and of those left to the next task; they bound memory only.
KEPT_WORDS, CORE_WORDS = 250_000, 60_000
#: Characters of the longest word that is kept; with them the count of words bounds their bytes.
LONGEST_KEPT = 64
#: Symbols up to which the agenda is a list.
SHORT = 24


NEVER = float("inf")


class Model:
    """The vocabulary of a SentencePiece BPE model file, and its two directions."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = self.library.id_to_piece(list(range(size)))
        self.names = names
        self.special = {i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i)}
        self.bytes = {i: int(names[i][3:5], 16) for i in range(size) if self.library.is_byte(i)}
        self.byte_id = {v: k for k, v in self.bytes.items()}
        self.rank = {n: (-self.library.get_score(i), i) for i, n in enumerate(names) if i not in self.special and i not in self.bytes}
        self.score = {n: r[0] for n, r in self.rank.items()}.get
        many = {c for n in self.rank if len(n) > 1 for c in n}
        if any(MARK in n.lstrip(MARK) for n in self.rank):
            raise ValueError("pieces that hold a word mark behind other characters aren't supported")
        alone = "".join(c for c in "\n\t" if c not in many)
        gap = re.escape(alone)
        self.split = re.compile(f"[{gap}]|{MARK}*[^{MARK}{gap}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merge(self, segment: str) -> list[int]:
        """Piece ids of one segment by the agenda."""
        return self._ids(self._merge_short(list(segment)) if len(segment) <= SHORT else self._merge_long(list(segment)))

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list of scores: the least is the next pair, the leftmost of equal ones first."""
        score, never = self.score, NEVER
        agenda = [score(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < never:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], never)
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over a linked list of symbols."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, agenda = self.rank, []

        def offer(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if (found := rank.get(pair)) is not None:
                agenda.append((found[0], i, j, len(pair))) if not ready else heapq.heappush(agenda, (found[0], i, j, len(pair)))

        ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        ready = True
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s in self.rank:
                out.append(self.rank[s][1])
            else:
                out.extend(self.byte_id[b] for b in s.encode())
        return out

    def pieces_to_text(self, ids: list[int]) -> str:
        """The text of ids without regard to a text's first word mark."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.special:
                out.append(self.names[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def segments(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, new: list[str]) -> None:
        """Merge words that are new, and hold them against the library."""
        marked = [s[0] == MARK and len(s) > 1 for s in new]
        want = self.library.encode([s[1:].replace(MARK, " ") if m else "\n" + s.replace(MARK, " ") for s, m in zip(new, marked, strict=True)], num_threads=1)
        for s, m, theirs in zip(new, marked, want, strict=True):
            ids = self.merge(s)
            if ids != (theirs if m else theirs[2:]):
                raise ValueError(f"pieces of {s!r} differ from the library's: {ids}, {theirs}")
            self.kept[s] = ",".join(map(str, ids))
            if (back := self.pieces_to_text(ids)) != s.replace(MARK, " "):
                self.odd[s] = back

    def rest(self) -> None:
        """At the end of a task: keep the words learnt first."""
        self.older = {}
        self.kept = dict(itertools.islice(self.kept.items(), CORE_WORDS))
        self.odd = {s: t for s, t in self.odd.items() if s in self.kept}

    def batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        parts = [self.segments(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.older, self.kept = self.kept, dict(itertools.islice(self.kept.items(), CORE_WORDS))
        new = []
        for s in set(itertools.chain.from_iterable(parts)).difference(self.kept):
            if (known := self.older.get(s)) is None:
                new.append(s)
            else:
                self.kept[s] = known
        self.learn(new)
        pick = self.kept.__getitem__
        for text, own in zip(texts, parts, strict=True):
            if self.odd and not self.odd.keys().isdisjoint(own):
                back = "".join([self.odd.get(s, s.replace(MARK, " ")) for s in own])
            else:  # every word decodes to itself
                back = " " + text.replace(MARK, " ") if text else ""
            yield ",".join(map(pick, own)), back[1:] if back[:1] == " " else back
        for s in new:
            if len(s) > LONGEST_KEPT:
                self.kept.pop(s, None)
                self.odd.pop(s, None)

    def hold(self, text: str, ids: str, decoded: str) -> None:
        """Hold a whole text's ids and decoded form against the library's."""
        want = self.library.encode(text)
        if ids != ",".join(map(str, want)) or decoded != self.library.decode(want):
            raise ValueError(f"ids or decoded text of a text of {len(text)} characters differ from the library's")

    def encode(self, text: str) -> list[int]:
        ids = next(iter(self.batch([text])))[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_to_text(ids)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.names[first].startswith(MARK) else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256[, token_ids][, decoded])."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                count, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
                texts = part.column("text").to_pylist()
                done = list(own.batch(texts))
                own.hold(texts[0], *done[0])
                for ids, text in done:
                    count.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids_out.append(pa.array(ids.split(",") if ids else [], pa.string()).cast(pa.int32()))
                    if keep_text:
                        text_out.append(text)
                columns = [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    flat = pa.concat_arrays(ids_out) if ids_out else pa.array([], pa.int32())
                    ends = [0]
                    for x in ids_out:
                        ends.append(ends[-1] + len(x))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                    names.append("token_ids")
                if keep_text:
                    columns.append(pa.array(text_out, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)
        own.rest()

    return source.mapInArrow(lean(run), schema)
