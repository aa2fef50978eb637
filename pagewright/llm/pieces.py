"""Encoding and decoding with a SentencePiece vocabulary.

Texts are cut into marked words: runs of word markers with the characters up to the next marker.
The distinct words of a run of texts are sorted, so that words with a common beginning are
neighbours, and walked as the depth-first traversal of their trie: the Viterbi lattice of a shared
prefix is computed once and only new characters extend it.  One vector gather then puts the ids of
all words in the order of the texts.  There is no shuffle; words a worker has met are kept in a
cache of bounded bytes, and the tables of what else it remembers have a bounded number of entries.

For a unigram vocabulary the best path is the one with the largest sum of scores.  For a merge
(BPE) vocabulary sums of scores would give other ids than its encoder, so a path may only put two
pieces side by side if the merges would leave them apart; then each prefix has one path, which is
the encoder's result.  Runs of white space, whose pieces share one score, and characters outside
the vocabulary, which become bytes, are handled beside the lattice.

Null texts have null ids; the empty text has none.  A literal word marker in a text reads as a
space, as in the public encoder.  Texts of any length are encoded whole.  Repeated rows are
encoded each; other columns take no part.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagewright.llm import hashing
from pagewright.session import map_batches

MARK = "▁"
#: Bound of what a worker keeps of words and their ids, in bytes
CACHE_BYTES = 64 << 20
#: Transitions and pairs of pieces that a worker remembers; a full table starts anew
MEMO = 1 << 18
#: Bytes that an entry of a word takes beside its ids (key, objects and table)
ENTRY = 130
#: Text that is encoded at a time: more shares more words
ENCODE_BYTES = 1 << 20

# Kinds of pieces in the model file
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


@dataclass
class Vocabulary:
    """Pieces of a model with what the lattice needs; built once on the driver and broadcast."""
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    merges: bool
    #: Rank of each piece in merge order and the two pieces of its last merge (itself if a character)
    rank: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    usable: dict[str, int] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    _tools: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def tools(self) -> tuple["Encoder", "Decoder"]:
        """Encoder and decoder, built once in each worker."""
        if self._tools is None:
            self._tools = Encoder(self), Decoder(self)
        return self._tools

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a model file; its path is known on the driver only."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces \
                or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only vocabularies that keep texts as they are, after a leading marker")
        return Vocabulary.of(
            [(p.piece, p.score, p.type) for p in proto.pieces], merges=proto.trainer_spec.model_type == 2)

    @staticmethod
    def of(rows: list[tuple[str, float, int]], merges: bool) -> "Vocabulary":
        names = [r[0] for r in rows]
        at = {r[0]: i for i, r in enumerate(rows)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)]
        v = Vocabulary(names, [r[1] for r in rows], byte_ids, merges)
        v.known = {r[0]: i for i, r in enumerate(rows) if r[2] in (NORMAL, USER_DEFINED)}
        v.left, v.right = list(range(len(rows))), list(range(len(rows)))
        order = sorted(v.known.values(), key=lambda i: (-rows[i][1], i))
        v.rank = [len(rows)] * len(rows)
        for place, i in enumerate(order):
            v.rank[i] = place
        for name, i in v.known.items():
            if MARK * len(name) == name and len(name) > 1:
                continue  # runs of markers are merged apart from words
            if len(name) == 1 or not merges:
                v.usable[name] = i
                continue
            whole, last = v.merge(name)
            if whole == [i]:  # others never come out of the merges
                v.left[i], v.right[i] = last
                v.usable[name] = i
        return v

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pieces of a short text by merging, highest score and then leftmost first; the last merge."""
        known, scores = self.known, self.scores
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue = []

        def offer(a, b):
            if a >= 0 and b < len(parts):
                joint = known.get(parts[a] + parts[b])
                if joint is not None:
                    heapq.heappush(queue, (-scores[joint], a, b, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        last = None
        while queue:
            _, a, b, joint = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != joint:
                continue
            last = (known.get(parts[a], -1), known.get(parts[b], -1))
            parts[a], parts[b] = joint, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [known.get(p, -1) for p in parts if p is not None], last


class Lattice:
    """Forward states of the word on the current path of the trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.mark = vocabulary.known.get(MARK, -1)
        self._apart: dict[int, bool] = {}
        self._jumps: dict[int, int] = {}
        self._runs: dict[int, list[int]] = {}
        self._build(vocabulary.usable)
        # By length of prefix: automaton state, score, last piece (-1: start, -2: bytes), where it begins.
        self.state, self.score, self.last, self.begin = [0], [0.0], [-1], [0]
        self.word = ""

    def _build(self, usable: dict[str, int]) -> None:
        """Automaton that tells all pieces that end at a character, in flat arrays.

        `children` maps (state, character) to a state; `fall` is the state of the longest proper
        ending, `ends` the piece that a state is, `longest` the nearest state down the endings, the state itself
        included, that is a piece, and `shorter` the next one after that (0: none).
        """
        children: dict[int, int] = {}
        ends, depth = array("i", [-1]), array("i", [0])
        for name, i in usable.items():
            at = 0
            for c in name:
                key = at << 21 | ord(c)
                to = children.get(key)
                if to is None:
                    to = children[key] = len(ends)
                    ends.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            ends[at] = i
        fall, longest, shorter = (array("i", [0]) * len(ends) for _ in range(3))
        for key, to in sorted(children.items(), key=lambda x: depth[x[1]]):
            parent, c = key >> 21, key & 0x1FFFFF
            if parent:
                at = fall[parent]
                while at and (at << 21 | c) not in children:
                    at = fall[at]
                fall[to] = children.get(at << 21 | c, 0)
            longest[to] = to if ends[to] >= 0 else longest[fall[to]]
            shorter[to] = longest[fall[to]]
        self.children, self.fall, self.ends, self.depth, self.longest, self.shorter = children, fall, ends, depth, longest, shorter

    def _next(self, state: int, c: int) -> int:
        """Follow a character; pairs of state and character that fall back are remembered."""
        key = state << 21 | c
        to = self.children.get(key)
        if to is not None:
            return to
        to = self._jumps.get(key)
        if to is None:
            children, at = self.children, state
            while at and (at << 21 | c) not in children:
                at = self.fall[at]
            to = children.get(at << 21 | c, 0)
            if len(self._jumps) >= MEMO:
                self._jumps.clear()
            self._jumps[key] = to
        return to

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b, side by side, as they are.

        Going back through the merges, latest first: no merge across the border may have come
        before the one that is undone.
        """
        key = a << 21 | b
        known = self._apart.get(key)
        if known is not None:
            return known
        v = self.v
        rank, pieces, joint_of = v.rank, v.pieces, v.known
        left, right, limit = a, b, (len(rank) + 1) * 2
        result = True
        while True:
            joint = joint_of.get(pieces[left] + pieces[right])
            # Equal ranks merge from the left: the left piece's own merge wins, the right one's loses.
            if joint is not None and 2 * rank[joint] < limit:
                result = False
                break
            can_left, can_right = v.left[left] != left, v.left[right] != right
            if not can_left and not can_right:
                break
            if can_left and (not can_right or rank[left] > rank[right]):
                limit, left = 2 * rank[left], v.right[left]
            else:
                limit, right = 2 * rank[right] + 1, v.left[right]
        if len(self._apart) >= MEMO:
            self._apart.clear()
        self._apart[key] = result
        return result

    def _extend(self, c: str) -> None:
        state = self._next(self.state[-1], ord(c))
        end = len(self.state)
        found, shorter, score, scores = self.longest[state], self.shorter, self.score, self.v.scores
        best, piece, start = float("-inf"), -2, end - 1
        if not found:
            state, best = 0, score[-1]
        while found:
            i, at = self.ends[found], end - self.depth[found]
            found = shorter[found]
            if at < 0:
                continue
            last = self.last[at]
            if self.v.merges:
                if last < 0 or self.apart(last, i):
                    best, piece, start = score[at] + scores[i], i, at
                    break
            elif score[at] + scores[i] > best:
                best, piece, start = score[at] + scores[i], i, at
        self.state.append(state)
        score.append(best)
        self.last.append(piece)
        self.begin.append(start)

    def _run(self, markers: int) -> list[int]:
        """Pieces of a run of markers only."""
        if markers not in self._runs:
            ids = self.v.merge(MARK * markers)[0]
            if markers > 10_000:
                return ids
            self._runs[markers] = ids
        return self._runs[markers]

    def encode(self, markers: int, word: str) -> list[int]:
        """Ids of a word after a number of markers; words should come in sorted order."""
        if not word:
            return self._run(markers)
        full = MARK + word if markers else word
        shared, old = 0, self.word
        for x, y in zip(old, full):
            if x != y:
                break
            shared += 1
        for states in (self.state, self.score, self.last, self.begin):
            del states[shared + 1:]
        for c in full[shared:]:
            self._extend(c)
        self.word = full
        ids, at = [], len(full)
        while at:
            piece, start = self.last[at], self.begin[at]
            if piece == -2:
                ids.extend(self.v.byte_ids[b] for b in reversed(full[start:at].encode("utf-8", "surrogatepass")))
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        if markers > 1:
            # Lone markers merge with each other, after everything else.
            ids = self._run(markers) + ids[1:] if ids[0] == self.mark else self._run(markers - 1) + ids
        return ids


class Encoder:
    """Encodes columns of texts; one per worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.lattice = Lattice(vocabulary)
        self.byte_ids = vocabulary.byte_ids
        self.cache: dict[int, bytes] = {}
        self.room = CACHE_BYTES
        alphabet = {ord(c) for name in vocabulary.usable for c in name}
        # Control characters outside the vocabulary stand alone and end a word.
        self.stops = np.array([b < 32 and b not in alphabet for b in range(256)])
        self.gap = self.stops.copy()
        self.gap[32] = True

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin."""
        column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
        empty = pc.equal(pc.binary_length(column), 0)
        column = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = hashing.buffer_of(column)
        begins, ends, _ = hashing.word_spans(data, offsets, self.gap)
        hashes = hashing.word_hashes(data, begins, ends)
        not_space = np.array([b != 32 for b in range(256)])
        run_begin, run_end, _ = hashing.word_spans(data, offsets, not_space)
        # A word is marked by the run of spaces that ends where it begins, if there is one.
        after = np.searchsorted(run_end, begins)
        there = (after < len(run_end)) & (run_end[np.minimum(after, len(run_end) - 1)] == begins) if len(run_end) else np.zeros(len(begins), bool)
        # The run must belong to the same text; every text begins with a marker, so it does.
        markers = np.zeros(len(begins), np.int64)
        markers[there] = (run_end - run_begin)[after[there]]
        lone = np.ones(len(run_begin), bool)
        lone[after[there]] = False
        stops = np.flatnonzero(self.stops[data])
        place = np.concatenate([begins, run_begin[lone], stops])
        size = (run_end - run_begin)[lone]
        key = np.concatenate([
            hashing.mix(hashes + markers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
            hashing.mix(size.astype(np.uint64) + np.uint64(1 << 62)), hashing.mix(data[stops].astype(np.uint64) + np.uint64(3 << 61))])
        order = np.argsort(place, kind="stable")
        place, key = place[order], key[order]
        kinds, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        source = order[first]
        words = len(begins)
        # Ids as bytes: a fraction of what tuples of numbers take.
        ids: list[bytes | None] = [self.cache.get(k) for k in kinds.tolist()]
        fresh = []
        raw = data.tobytes() if any(x is None for x in ids) else b""
        for n, have in enumerate(ids):
            if have is not None:
                continue
            s = source[n]
            if s < words:
                fresh.append((raw[begins[s]: ends[s]].decode("utf-8", "surrogatepass"), int(markers[s]), n))
            elif s < words + len(size):
                fresh.append(("", int(size[s - words]), n))
            else:
                ids[n] = array("i", [self.byte_ids[data[stops[s - words - len(size)]]]]).tobytes()
        # Marked words first: a marker is the first letter of their path.
        fresh.sort(key=lambda x: (x[1] > 0, x[0], x[1]))
        encode = self.lattice.encode
        names = kinds.tolist()
        for word, count, n in fresh:
            ids[n] = got = array("i", encode(count, word)).tobytes()
            if self.room > 0 and len(got) < 256:
                self.cache[names[n]] = got
                self.room -= len(got) + ENTRY
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin_of = np.cumsum(lengths) - lengths
        sizes = lengths[inverse]
        total = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.arange(total[-1]) + np.repeat(begin_of[inverse] - total[:-1], sizes)
        starts = total[np.searchsorted(place, offsets)]
        return flat[gather], starts


class Decoder:
    """Decodes columns of ids."""

    def __init__(self, vocabulary: Vocabulary):
        byte_of = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        known = set(vocabulary.known.values())
        parts = [byte_of.get(i, p.replace(MARK, " ").encode() if i in known else b"") for i, p in enumerate(vocabulary.pieces)]
        self.sizes = np.array([len(p) for p in parts])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and where each begins, without the leading marker."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.arange(total[-1]) + np.repeat(self.begins[ids] - total[:-1], sizes)
        data, offsets = self.data[gather], total[starts]
        # Every text that has ids begins with the marker that the encoder put there.
        lead = offsets[:-1][np.diff(offsets) > 0]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _text_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back (a marker reads as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, decoder = shared.value.tools()
        for batch in batches:
            for part in hashing.slices(batch, "text", ENCODE_BYTES):
                text = part.column("text")
                ids, starts = encoder.encode(text)
                back = _text_column(*decoder.decode(ids, starts))
                wanted = pc.replace_substring(text.cast(pa.large_string()), MARK, " ").cast(pa.large_binary())
                absent = pc.is_null(text).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(
                    pa.array(starts.astype(np.int32), mask=np.append(absent, False)), pa.array(ids))
                yield pa.record_batch(
                    [part.column("doc_id"), lists, pc.if_else(pa.array(absent), None, pa.array(np.diff(starts).astype(np.int32))),
                     pc.equal(back, wanted)], ["doc_id", "ids", "n_tokens", "round_trip"])
            # What the batch took goes back to the system before the next one comes.
            batch = part = text = back = wanted = lists = None
            pa.default_memory_pool().release_unused()

    return map_batches(
        docs.select("doc_id", docs[column].alias("text")), run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of a table with doc_id and ids; bytes that are no UTF-8 become the replacement character."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        _, decoder = shared.value.tools()
        for batch in batches:
            lists = batch.column("ids")
            absent = pc.is_null(lists)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            back = _text_column(*decoder.decode(ids, np.concatenate([[0], np.cumsum(sizes)])))
            texts = [None if gone else b.decode("utf-8", "replace") for b, gone in zip(back.to_pylist(), absent.to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
