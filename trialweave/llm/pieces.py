"""SentencePiece encoding and decoding with forward states shared between words.

A text is marked (a mark in front, every space a mark) and cut before each run of marks, where no piece
reaches across. The distinct marked words of a block are sorted, which lays them out as a trie in
depth-first order: each word keeps the forward states of the prefix it shares with the word before and
adds only the rest.

The forward state of a prefix depends on the model. For a unigram model it is the best score and the
piece that ends there (Viterbi). For a byte-pair model the scores are merge ranks, so a sum means
nothing; the state is the last piece of the prefix's encoding, which is the one piece that fits behind
the state at its start (two pieces fit if merging their joined text gives the same two pieces). Both
give the ids of the reference encoder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from trialweave.llm import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs of pieces a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 250_000
_UNKNOWN_PENALTY = 10.0
#: Bytes of text that are encoded, and ids that are decoded, at once.
ENCODED, DECODED = 1 << 20, 1 << 19


class Pieces:
    """Vocabulary of a model file, with encoding of marked words and decoding of ids."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.unknown = sp.unk_id()
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self._build()

    @classmethod
    def of(cls, scores: dict[str, float]) -> "Pieces":
        """A vocabulary given as piece -> score, without bytes; id 0 is unknown."""
        self = cls.__new__(cls)
        self.ids = {p: i for i, p in enumerate(scores, start=1)}
        self.scores, self.byte_ids, self.unknown = dict(scores), {}, 0
        self.raw = [" ⁇ ".encode(), *(p.replace(MARK, " ").encode() for p in scores)]
        self._build()
        return self

    def _build(self) -> None:
        plain = [s for p, s in self.scores.items() if len(p) > 1 and s > -1e8]
        # merge ranks are whole numbers, all different
        self.merges = len(set(plain)) == len(plain) and all(s == round(s) for s in plain)
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        if inner:
            raise ValueError("a piece reaches across a mark; words cannot be encoded apart")
        # a line feed that no piece holds is a boundary of its own
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.split = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else "")).findall
        # while a string grows leftwards, it can still become a piece as long as it ends one
        self.endings = {p[i:] for p in self.ids for i in range(len(p))}
        self.forget()
        self.fits: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.table: tuple | None = None
        self.edges: dict[str, tuple[list, list] | None] = {}

    def merged(self, text: str, halves: dict | None = None) -> list[str]:
        """Byte-pair merging of a short text: best score first, leftmost of equals. ``halves`` collects the merges."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            if halves is not None:
                halves[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edge(self, piece: str) -> tuple[list, list] | None:
        """What stands at the right and at the left edge of a piece while it is merged.

        Rows (text, score when it came, score when it went); None if merging does not give the piece.
        """
        if piece not in self.edges:
            halves: dict[str, tuple[str, str]] = {}
            if self.merged(piece, halves) != [piece]:
                self.edges[piece] = None
            else:
                sides = []
                for side in (1, 0):
                    x, gone, rows = piece, -np.inf, []
                    while True:
                        came = self.scores[x] if x in halves else np.inf
                        rows.append((x, came, gone))
                        if x not in halves:
                            break
                        x, gone = halves[x][side], came
                    sides.append(rows)
                self.edges[piece] = (sides[0], sides[1])
        return self.edges[piece]

    def _fit(self, before: str, piece: str) -> bool:
        """Whether merging ``before + piece`` leaves the two apart.

        They join if two texts stand at the border at the same time whose union is a piece that comes
        before either goes on; of equal scores the left one goes first.
        """
        own = self._edge(piece)
        if own is None:
            return False
        if not before:
            return True
        if before[-1] == MARK or piece[0] == MARK:
            return self.merged(before + piece) == [before, piece]  # runs of marks share one score
        scores = self.scores
        for x, x_came, x_gone in self._edge(before)[0]:
            for y, y_came, y_gone in own[1]:
                score = scores.get(x + y)
                if score is not None and score > x_gone and score >= y_gone:
                    if min(x_came, y_came) > max(x_gone, y_gone):
                        return False
        return True

    def _last_merges(self, word: str, states: list) -> None:
        """Extend the states (last piece, what fits behind it, state before, own ids, last id) of prefixes of ``word`` to all of it.

        The pieces that can end at a place are tried from the shortest on; exactly one fits.
        """
        get, fits, endings = self.ids.get, self.fits, self.endings
        for i in range(len(states), len(word) + 1):
            j, piece = i - 1, word[i - 1]
            while True:
                own = get(piece)
                if own is not None or j == i - 1:
                    last, behind, _, _, id_before = states[j]
                    fit = behind.get(piece)
                    if fit is None:
                        fit = behind[piece] = self._fit(last, piece)
                        self.known_pairs += 1
                    if fit:
                        break
                j -= 1
                piece = word[j] + piece
                if j < 0 or piece not in endings:
                    raise AssertionError(f"no piece ends at {i} of {word!r}")
            behind = fits.get(piece)
            if behind is None:
                behind = fits[piece] = {}
            own_ids = (own,) if own is not None else self._own(piece, id_before)
            states.append((piece, behind, j, own_ids, own_ids[-1] if own_ids else id_before))

    def _best_sums(self, word: str, states: list) -> None:
        """Extend the states (last piece, best sum of scores, state before, own ids, last id) of prefixes of ``word`` to all of it."""
        for i in range(len(states), len(word) + 1):
            states.append(self._best_sum(word, i, states))

    def _best_sum(self, word: str, i: int, states: list) -> tuple:
        best, at = None, 0
        for j in range(max(0, i - self.longest), i):
            score = self.scores.get(word[j:i])
            if score is None:
                if j < i - 1:
                    continue
                score = self.low
            score += states[j][1]
            if best is None or score > best:
                best, at = score, j
        own, id_before = self._own(word[at:i], states[at][4]), states[at][4]
        return (word[at:i], best, at, own, own[-1] if own else id_before)

    @staticmethod
    def _ids(states: list) -> list[int]:
        """The ids of the last state, walked back to the first."""
        parts, at = [], len(states) - 1
        while at > 0:
            parts.append(states[at][3])
            at = states[at][2]
        return [i for own in reversed(parts) for i in own]

    def _own(self, piece: str, before: int) -> tuple[int, ...]:
        own = self.ids.get(piece)
        if own is not None:
            return (own,)
        if self.byte_ids:
            return tuple(self.byte_ids[b] for b in piece.encode())
        return () if before == self.unknown else (self.unknown,)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not remembered, in sorted order."""
        known, flat, ends = self.words, [], []
        if self.known_pairs > REMEMBERED:
            self.fits, self.known_pairs = {}, 0
        extend = self._last_merges if self.merges else self._best_sums
        states: list[tuple] = [("", self.fits.setdefault("", {}) if self.merges else 0.0, 0, (), -1)]
        before, at = "", len(self.ends)
        for word in sorted(w for w in words if w not in known):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            extend(word, states)
            before = word
            known[word] = at + len(ends)
            flat += self._ids(states)
            ends.append(len(flat))
        if ends:
            self.ends = np.concatenate([self.ends, np.array(ends, dtype=np.int64) + len(self.flat)])
            self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.int32)])

    def forget(self) -> None:
        """Words are numbered as they come; number k has the ids ``flat[ends[k - 1]:ends[k]]``."""
        self.words: dict[str, int] = {}
        self.ends = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        self.words[""] = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, edges): text i has ``ids[edges[i]:edges[i + 1]]``."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.forget()
        self.learn(set().union(*split))
        sizes = [len(w) for w in split]
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(sizes))
        first = self.ends[number - 1]
        length = self.ends[number] - first
        behind = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(first - behind[:-1], length) + np.arange(behind[-1])
        return self.flat[place], behind[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes joined, the mark in front taken off; broken bytes become U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Texts of many rows, row i having ``ids[edges[i]:edges[i + 1]]``: the pieces' bytes are gathered at once."""
        if self.table is None:
            size = np.array([len(r) for r in self.raw], dtype=np.int64)
            self.table = (np.frombuffer(b"".join(self.raw), dtype=np.uint8), np.cumsum(size) - size, size)
        data, first, size = self.table
        length = size[ids]
        behind = np.concatenate([[0], np.cumsum(length)])
        out = data[np.repeat(first[ids] - behind[:-1], length) + np.arange(behind[-1])]
        cuts = behind[edges]
        keep = np.ones(len(out), dtype=bool)
        filled = cuts[1:] > cuts[:-1]
        heads = cuts[:-1][filled]
        keep[heads[out[heads] == 32]] = False
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        out = out[keep]
        try:
            out.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            texts = [out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.array(texts, pa.string())
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)]
        return pa.Array.from_buffers(pa.string(), len(edges) - 1, buffers)


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """The model file, read by the driver and sent with the tasks (some hundred kilobytes)."""
    with open(path, "rb") as f:
        return f.read()


def _encode(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    pieces = load(model.value)
    for batch in batches:
        for lo, hi in blocks.slices(batch.column(at), ENCODED):
            part = batch.slice(lo, hi - lo)
            ids, edges = pieces.encode([t or "" for t in part.column(at).to_pylist()])
            columns = [c for i, c in enumerate(part.columns) if i != at]
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(edges)), lists], names=[f"c{i}" for i in range(len(columns) + 2)]
            )


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``docs`` without its text column, and with ``n_tokens`` and ``token_ids`` as last columns.

    Missing and empty texts have no tokens. Whole texts are encoded, without control pieces. Other
    columns pass through, whatever they hold; one named like a new column is an error.
    """
    clash = {"n_tokens", "token_ids"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    at = docs.columns.index(text_col)
    kept = [f for f in docs.schema.fields if f.name != text_col]
    plain = blocks.small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]
    fields += [StructField(f"c{len(kept)}", LongType()), StructField(f"c{len(kept) + 1}", ArrayType(IntegerType()))]
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    done = plain.mapInArrow(partial(_encode, model=model, at=at), StructType(fields))
    return done.toDF(*[f.name for f in kept], "n_tokens", "token_ids")


def _decode(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    pieces = load(model.value)
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(counts, dtype=np.int64) // DECODED)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part, sizes = batch.slice(lo, hi - lo), counts[lo:hi]
            lists = part.column(at)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pieces.decode_all(ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, "d"])


def decode(tokens: DataFrame, ids_col: str = "token_ids", model_path: str = MODEL) -> DataFrame:
    """``tokens`` with the text of its ids as last column ``decoded``; missing ids give a missing text."""
    at = tokens.columns.index(ids_col)
    plain = blocks.small_batches(tokens).toDF(*[f"c{i}" for i in range(len(tokens.columns))])
    model = tokens.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = StructType([*plain.schema.fields, StructField("d", StringType())])
    return plain.mapInArrow(partial(_decode, model=model, at=at), kind).toDF(*tokens.columns, "decoded")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens, token_ids, ids_xxhash64, decoded_sha256, round_trip) of whole texts; missing ones are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("was"), "text"
    )
    found = decode(encode(rows, "text", model_path), "token_ids", model_path)
    return found.select(
        "doc_id",
        "n_chars",
        "n_tokens",
        "token_ids",
        F.xxhash64("token_ids").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("was")).alias("round_trip"),
    )
