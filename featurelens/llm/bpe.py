"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A token list is the BPE encoding of its bytes exactly if each token encodes to itself and each pair
of neighbours encodes to that pair (merges never look further than the pair they join).  So the
encodings of all prefixes of a text are the paths of a transducer whose configuration is (bytes of the
token begun, last whole token, tokens not yet emitted): a byte extends the token begun, and where
that is a token compatible with the last one, a path may close it.  For each prefix one path ends closed.
``Transducer`` determinises this while it reads: a state is a set of configurations, numbered when first
reached and kept as one row of integers; tokens on which all live paths agree are emitted.  Paths differ only within the token
begun, so the lookahead is bounded by the longest token.  States and remembered words are dropped
together when ``max_states`` or ``max_words`` is reached, so memory is bounded.

A text is split by the pattern first and each match encoded separately; a match that is itself in the
vocabulary is that token, as in the usual library.  ``decode`` turns ids into bytes and
bytes into text through ``Utf8Stream``, a state machine that holds back an unfinished character.

* Nulls: a null text has no tokens; null ids decode to an empty text.
* Empty texts have no tokens.  Repeated rows are encoded each; very long texts are split and encoded
  match by match.  An empty table gives an empty result.  Input columns are kept, but the one read, whose
  place the result takes; one named like a result column is replaced.
* Ids outside the vocabulary raise ``KeyError``; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STATES = 400_000
MAX_WORDS = 150_000
LONG_WORD = 48
LONG_TEXT = 1 << 20
OUT_BYTES = 4 << 20
NEVER = float("inf")
ONE = [bytes([b]) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary file: a line has a token in base64 and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """States are numbers; all else is flat.  A state's configurations are one row, for each path, the closed one first: the token
    begun, the last whole token (numbers of ``texts``) and the tokens that wait.  Transitions are entries of
    one table, (state, byte) -> next state, or its complement if tokens are emitted, which a second table holds."""

    def __init__(self, ranks: dict[bytes, int], max_states: int | None = None):
        self.max_states = max_states or MAX_STATES
        if any(b not in ranks for b in ONE):
            raise ValueError("the vocabulary lacks a single byte")
        self.ranks = ranks
        self.longer = {t[:i] for t in ranks for i in range(1, len(t))}  # proper prefixes of tokens
        self.reset()

    def reset(self) -> None:
        self.texts: list[bytes] = [b""]  # tokens begun that were met, by number
        self.rank: list[int | None] = [None]
        self.more: list[bool] = [True]
        self.child: dict[int, int] = {}  # (number, byte) -> number, or -1 where no token begins so
        self.compatible: dict[int, bool] = {}  # (last token, token) -> whether one can follow the other
        self.histories: dict[bytes, tuple] = {}
        self.known: dict[tuple, int] = {}  # configurations -> state
        self.configs: list[tuple] = []
        self.next: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.start = self.state((0, 0, ()))

    def state(self, row: tuple) -> int:
        found = self.known.setdefault(row, len(self.configs))
        if found == len(self.configs):
            self.configs.append(row)
        return found

    def grown(self, begun: int, byte: int) -> int:
        """The number of the token begun that ``byte`` leads to, -1 if there is none."""
        text = self.texts[begun] + ONE[byte]
        found = -1
        if text in self.longer or text in self.ranks:
            found = len(self.texts)
            self.texts.append(text)
            self.rank.append(self.ranks.get(text))
            self.more.append(text in self.longer)
        self.child[begun << 8 | byte] = found
        return found

    def history(self, token: bytes) -> tuple[bool, list[tuple[float, bytes, bytes]]]:
        """Whether ``token`` encodes to itself, and its merges (the lowest-ranked neighbouring pair is joined,
        leftmost first): (rank of the next one, first and last part before it), ended by an infinite rank."""
        known = self.histories.get(token)
        if known is None:
            parts, steps = [token[i:i + 1] for i in range(len(token))], []
            while True:
                ranked = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranked, default=NEVER)
                steps.append((best, parts[0], parts[-1]))
                if best == NEVER:
                    break
                i = ranked.index(best)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            known = self.histories[token] = len(parts) == 1, steps
        return known

    def fits(self, last: bytes, token: bytes) -> bool:
        """Whether ``token`` can follow ``last`` (the empty one: begin a match): replays the merges of
        both in the order of joint encoding, and looks for one across their border."""
        whole, right = self.history(token)
        if not whole or not last:
            return whole
        left, i, j = self.history(last)[1], 0, 0
        while True:
            (a, _, end), (b, begin, _) = left[i], right[j]
            across = self.ranks.get(end + begin, NEVER)
            if across < a and across <= b and across != NEVER:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> int:
        """Determinises one transition: the paths that ``byte`` leaves alive, the closed one first, less the tokens they
        agree on."""
        child, ranks, more, compatible = self.child, self.rank, self.more, self.compatible
        row = iter(self.configs[state])
        paths: list = []
        last, first = 0, ()
        for begun, before, out in zip(row, row, row):
            node = child.get(begun << 8 | byte)
            if node is None:
                node = self.grown(begun, byte)
            if node < 0:
                continue
            rank = ranks[node]
            if rank is not None:
                key = before << 32 | node
                fits = compatible.get(key)
                if fits is None:
                    fits = compatible[key] = self.fits(self.texts[before], self.texts[node])
                if fits:
                    last, first = node, (*out, rank)
            if more[node]:
                paths += (node, before, out)
        if paths:
            n, outs = 0, paths[2::3]
            for token in first:
                for out in outs:
                    if len(out) <= n or out[n] != token:
                        break
                else:
                    n += 1
                    continue
                break
            if n:
                paths[2::3] = [out[n:] for out in outs]
        else:
            n = len(first)
        found, key = self.state((0, last, first[n:], *paths)), state << 8 | byte
        if n:
            self.emitted[key] = first[:n]
            found = ~found
        self.next[key] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        ids: list[int] = []
        if len(self.configs) > self.max_states:
            self.reset()
        state, known = self.start, self.next.get
        for byte in word:
            key = state << 8 | byte
            state = known(key)
            if state is None:
                state = self.step(key >> 8, byte)
            if state < 0:
                ids += self.emitted[key]
                state = ~state
        ids += self.configs[state][2]
        return ids


class Words(dict):
    """Match -> its ids as 4-byte integers.  When full, the words since the last time become the older
    generation, from which those met again return."""

    def __init__(self, transducer: Transducer, max_words: int | None = None):
        self.transducer, self.older, self.max_words = transducer, {}, max_words or MAX_WORDS

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            data = word.encode()
            whole = self.transducer.ranks.get(data)
            packed = array("i", [whole] if whole is not None else self.transducer.encode(data)).tobytes()
            if len(data) > LONG_WORD:
                return packed
        if len(self) >= self.max_words:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str, max_states: int | None = None, max_words: int | None = None):
        import regex

        self.words = Words(Transducer(read_ranks(vocabulary), max_states), max_words)
        self.pattern = regex.compile(pattern)

    def packed(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        return b"".join(self.words[m[0]] for m in self.pattern.finditer(text))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), np.int32).tolist()


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters that are whole by now."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the begun character at the end of ``data``; 0 if the end is a character's end."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 0
                return back if back < need else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode(errors="replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode(errors="replace")


class Decoder:
    def __init__(self, vocabulary: bytes):
        ranks = read_ranks(vocabulary)
        self.length = np.full(max(ranks.values()) + 1, -1, np.int64)
        self.begin = np.zeros(len(self.length), np.int64)
        tokens, at = sorted(ranks, key=ranks.get), 0
        for t in tokens:
            self.length[ranks[t]], self.begin[ranks[t]] = len(t), at
            at += len(t)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or (self.length[ids] < 0).any()):
            raise KeyError("an id outside the vocabulary")
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.begin[ids] - ends + length, length) + np.arange(total)].tobytes()

    def decode(self, ids: Iterable[int] | np.ndarray, step: int = 65536) -> str:
        ids, stream = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64), Utf8Stream()
        parts = [stream.feed(self.bytes_of(ids[i:i + step])) for i in range(0, len(ids), step)]
        return "".join([*parts, stream.finish()])


def replacing(df: DataFrame, column: str, *new: T.StructField) -> tuple[DataFrame, T.StructType]:
    """The columns kept with the one to read last, and the schema with the new ones in its place."""
    names = [f.name for f in new]
    kept = [F.col(c) for c in df.columns if c != column and c not in names]
    rows = df.select(*kept, F.col(column).alias("__in"))
    return rows, T.StructType([*rows.schema.fields[:-1], *new])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column has about ``OUT_BYTES`` each."""
    size = max(1, batch.column(batch.num_columns - 1).nbytes)
    rows = max(1, batch.num_rows * OUT_BYTES // size)
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", out: str = "ids",
           decoded: str | None = None, max_states: int | None = None, max_words: int | None = None) -> DataFrame:
    """``docs`` with ``out``, the token ids (array of int), and, if a name is given, ``decoded``, the text decoded
    from them in the same pass.  The vocabulary file, at most a few MB whatever the input, is read once by the
    driver and broadcast.  ``max_states`` and ``max_words`` bound the caches of a task: smaller ones take more time and
    less memory and give the same ids.  A task makes its own transducer and frees it at its end."""
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    new += [T.StructField(decoded, T.StringType())] if decoded else []
    rows, schema = replacing(docs, text_col, *new)
    names = schema.names

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value, pattern, max_states, max_words)  # a task's own: it ends with the task
        d = Decoder(shared.value) if decoded else None
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for b in batches:
            for part in pieces(b):
                texts = part.column(part.num_columns - 1).to_pylist()
                gc.disable()  # the tables hold no cycles, and the collector would walk them again and again
                try:
                    packed = [e.packed(t or "") for t in texts]
                finally:
                    gc.enable()
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                found = [pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)]
                if d:
                    found.append(pa.array([d.decode(np.frombuffer(p, np.int32)) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=names)

    return rows.mapInArrow(encoded, schema)


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text that the ids stand for."""
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows, schema = replacing(df, ids_col, T.StructField(out, T.StringType()))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(shared.value)
        for b in batches:
            for part in pieces(b):
                ids = part.column(part.num_columns - 1)
                texts = [d.decode(x.values.to_numpy() if x.is_valid else ()) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())],
                                                 names=[*part.schema.names[:-1], out])

    return rows.mapInArrow(decoded, schema)


def digest(ids: Iterable[int]) -> str:
    """Hex SHA-256 of the decimal ids joined by commas."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
