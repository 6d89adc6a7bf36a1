"""SentencePiece ids by a streaming Viterbi search over a public vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.names import column, sliced, unused

SPACE = "▁"
#: Bytes that a remembered part, pair of pieces or step between states takes, rounded up from measurements, and its share of a task's memory.
MEMO, PAIRS, STEPS = (320, 0.65), (160, 0.2), (100, 0.15)
#: Steps that take as much as a state.
STATE = 6


@dataclass
class Vocabulary:
    """Pieces with scores, as a SentencePiece model file holds them.

    kind: "bpe", where a text is encoded as merges by falling score would leave
    it, or "unigram", where the ids have the highest sum of scores.
    """

    pieces: list[str]
    scores: list[float]
    kind: str = "bpe"
    unk: int = 0
    hidden: frozenset[int] = frozenset()  # control and unknown pieces: no text makes them
    bytes_at: dict[int, int] = field(default_factory=dict)  # id to byte
    prefix: bool = True
    squeeze: bool = False

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a .model file. Only the identity normaliser is supported."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, kind = m.normalizer_spec, {1: "unigram", 2: "bpe"}.get(m.trainer_spec.model_type)
        if kind is None or norm.precompiled_charsmap or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE and unigram models with the identity normaliser are supported")
        at = {i: int(p.piece[3:5], 16) for i, p in enumerate(m.pieces) if p.type == 6}
        hidden = frozenset(i for i, p in enumerate(m.pieces) if p.type in (2, 3, 5))
        unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], kind, unk, hidden, at, norm.add_dummy_prefix, norm.remove_extra_whitespaces)


class State(dict):
    """The state after each next character, worked out when it is first asked for.

    A state is the longest end of the text that begins a piece (``read``), so the
    pieces that end there (``found``, longest first, with their lengths) are ends
    of it.
    """

    __slots__ = ("codec", "found", "read")

    def __init__(self, codec: Codec, read: str):
        self.codec, self.read = codec, read
        self.found = [(read[k:], len(read) - k) for k in range(len(read)) if read[k:] in codec.ids]

    def __missing__(self, c: str) -> State:
        codec, read = self.codec, self.read + c
        while read not in codec.begun:
            read = read[1:]
        after = codec.heads.get(read) if read else codec.start
        if after is None:
            after = codec.heads[read] = State(codec, read)
            codec.n_steps += STATE
        self[c] = after
        codec.n_steps += 1
        return after


class After(dict):
    """What may stand after a piece of a BPE vocabulary ("": at the beginning or
    after a character outside the vocabulary, which no merge reaches over): each
    next piece with its own After, or None if merges don't leave the two."""

    __slots__ = ("codec", "piece")

    def __init__(self, codec: Codec, piece: str):
        self.codec, self.piece = codec, piece

    def __missing__(self, piece: str) -> After | None:
        codec = self.codec
        codec.n_pairs += 1
        known = self[piece] = codec.after(piece) if codec.stable(self.piece, piece) else None
        return known


class Codec:
    """Encodes and decodes with one vocabulary.

    The search goes over a text once. The best path to a position ends with a
    piece that starts up to ``longest`` positions earlier, so no more states than
    that are open; back pointers are followed from all of them every STRIDE
    positions, and where they meet, everything before is final and given out.

    For unigram models the best path has the highest score. For BPE models it is
    the one in which every two neighbours are what the merges make of the two
    joined: exactly one path to each position is, and it is what the merges make
    of the text so far.
    """

    STRIDE = 64

    def __init__(self, v: Vocabulary, memory_mb: int = 160):
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in v.hidden and i not in v.bytes_at}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_id = {b: i for i, b in v.bytes_at.items()}
        self.fallback = len(self.byte_id) == 256
        self.low = min((v.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.raw = [bytes([v.bytes_at[i]]) if i in v.bytes_at else b"" if i in v.hidden else p.encode() for i, p in enumerate(v.pieces)]
        self.raw[v.unk] = " ⁇ ".encode()
        #: characters that are neighbours in a piece: all paths meet between any others
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.words = self.cuts()
        self.rank = {p: -v.scores[i] for p, i in self.ids.items()}
        #: beginnings of pieces, and the states of those that were met
        self.begun = {p[:k] for p in self.ids for k in range(len(p) + 1)} | {""}
        self.heads: dict[str, State] = {}
        self.start = State(self, "")
        self.pairs: dict[str, After] = {}
        self.ends: dict[str, tuple[list, list] | None] = {}
        self.remember(memory_mb)

    def remember(self, memory_mb: int) -> None:
        """Forgets what was met, and sets how much may be remembered from now on."""
        self.most_parts, self.most_pairs, self.most_steps = (max(1, int(memory_mb * 2**20 * share) // size) for size, share in (MEMO, PAIRS, STEPS))
        self.most_parts = max(1, self.most_parts // 2)  # there are two generations
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.forget_pairs()
        self.forget_heads()

    def forget_pairs(self) -> None:
        for after in self.pairs.values():
            after.clear()  # they hold one another
        self.pairs.clear()
        self.n_pairs = 0

    def forget_heads(self) -> None:
        for state in (self.start, *self.heads.values()):
            state.clear()
        self.heads.clear()
        self.n_steps = 0

    def cuts(self) -> re.Pattern:
        """Finds parts of a text that no piece reaches over, where all paths meet:
        before space marks, before signs that no piece has after the letter or the
        like that they follow, and around white space that no piece has at all."""
        inside = self.inside
        if any(b == SPACE and a != SPACE for a, b in inside):
            return re.compile("(?s).+")
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        tied: dict[str, set[str]] = {}
        for a, b in inside:
            if b in marks and a not in marks and a != SPACE:
                tied.setdefault(b, set()).add(a)
        strange = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        every = re.escape("".join(sorted(marks)))
        bound = "|".join(f"(?<=[{re.escape(''.join(sorted(tied[b])))}]){re.escape(b)}" for b in sorted(tied))
        rest = f"[^{SPACE}{strange}{every}]*"
        more = f"(?:(?:{bound})[{every}]*{rest})*" if tied else ""
        return re.compile(f"(?=[^{strange}]){SPACE}*[{every}]*{rest}{more}|[{strange}]" if strange else f"(?s)(?=.){SPACE}*[{every}]*{rest}{more}")

    def merged(self, s: str) -> tuple[list[str], tuple[str, str] | None, bool]:
        """What the merges leave of a short string, the last pair that they joined,
        and whether their ranks (lower ones go first) rose all the way."""
        parts, last, rising, rank = list(s), None, True, -np.inf
        while len(parts) > 1:
            found = [(self.rank[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.rank]
            if not found:
                break
            now, k = min(found)
            rising, rank, last = rising and now >= rank, now, (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last, rising

    def edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and the right end of a piece while it is merged:
        each symbol with the rank of the merge that ends it. None if merges don't
        make the piece, or not in rising order."""
        known = self.ends.get(piece, 0)
        if known == 0:
            parts, last, rising = self.merged(piece)
            known = None
            if parts == [piece] and rising:
                known = ([(piece, np.inf)], [(piece, np.inf)])
                if last:
                    rank, (left, right) = self.rank[piece], map(self.edges, last)
                    if left is None or right is None:
                        known = None
                    else:
                        known = ([*left[0][:-1], (last[0], rank), *known[0]], [*right[1][:-1], (last[1], rank), *known[1]])
            self.ends[piece] = known
        return known

    def stable(self, a: str, b: str) -> bool:
        """Whether merges leave a and b of the two joined; a may be empty. They do
        unless, at some time, the symbols on either side of the joint merge before
        a merge within a (the left one goes first on a tie) or b ends them."""
        at, to = (self.edges(a) if a else ([], [])), self.edges(b)
        if at is None or to is None:
            return self.merged(a + b)[0] == ([a, b] if a else [b])
        if not a:
            return True
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = at[1][i], to[0][j]
            joint = self.rank.get(x + y, np.inf)
            if joint < x_ends and joint <= y_ends:
                return False
            if x_ends == y_ends == np.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def after(self, piece: str) -> After:
        found = self.pairs.get(piece)
        if found is None:
            found = self.pairs[piece] = After(self, piece)
        return found

    def extend(self, s: str, off: int, back: list[int], piece_at: list[str], best: list[float] | list[After], to: int) -> None:
        """Appends to back (where the last piece of the best path to a position
        starts), piece_at (that piece) and best (the path's score, for BPE what may
        stand after it) up to the position ``to``. The lists begin with the
        position ``off``."""
        if self.n_pairs > self.most_pairs:
            self.forget_pairs()
        if self.n_steps > self.most_steps:
            self.forget_heads()
        done = off + len(back) - 1
        state = self.start
        for c in s[max(off, done - self.longest) : done]:
            state = state[c]
        if self.v.kind == "bpe":
            for end, c in enumerate(s[done:to], done + 1):
                state = state[c]
                for piece, size in state.found:
                    after = best[-size][piece]
                    if after is not None:
                        break
                else:
                    piece, size, after = c, 1, self.after(c if c in self.ids else "")
                back.append(end - size)
                piece_at.append(piece)
                best.append(after)
            return
        ids, scores = self.ids, self.v.scores
        for end, c in enumerate(s[done:to], done + 1):
            state = state[c]
            top, last, far = None, c, 1
            for piece, size in state.found:
                value = best[-size] + scores[ids[piece]]
                if top is None or value > top:
                    top, last, far = value, piece, size
            if c not in ids:
                value = best[-1] + self.low
                if top is None or value > top:
                    top, last, far = value, c, 1
            back.append(end - far)
            piece_at.append(last)
            best.append(top)

    def search(self, s: str) -> Iterator[list[str]]:
        """The pieces of s, in runs as they become final; a character outside the
        vocabulary is a piece of its own."""
        n, off = len(s), 0
        back, piece_at, best = [0], [""], [self.after("") if self.v.kind == "bpe" else 0.0]
        while True:
            end = min(n, max(off + 2 * self.longest + self.STRIDE, off + len(back) - 1))
            self.extend(s, off, back, piece_at, best, end)
            meet = end
            if end < n:  # where do the paths to all positions meet from which a piece can go on?
                paths = set(range(end - self.longest + 1, end + 1))
                while len(paths) > 1:
                    top = max(paths)
                    paths.remove(top)
                    paths.add(max(back[top - off], off))
                meet = paths.pop()
            at, run = meet, []
            while at > off:
                run.append(piece_at[at - off])
                at = back[at - off]
            if run:
                yield run[::-1]
            if end == n:
                return
            if meet == off:  # they haven't met yet: go on with a wider window
                self.extend(s, off, back, piece_at, best, min(n, end + self.STRIDE))
            else:
                del back[: meet - off], piece_at[: meet - off], best[: meet - off]
                off = meet

    def word(self, word: str) -> list[int]:
        """The ids of a part of a text, from memory if it was met before."""
        found = self.memo.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = [i for run in self.search(word) for i in self.ids_of(run)]
            if len(word) <= 40:
                if len(self.memo) >= self.most_parts:
                    self.older, self.memo = self.memo, {}
                self.memo[word] = found
        return found

    def ids_of(self, pieces: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            rest = lambda p: [self.byte_id[b] for b in p.encode()] if self.fallback else [self.v.unk]
            return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else rest(p))]

    def encode(self, text: str) -> list[int]:
        if self.v.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        s = (" " if self.v.prefix and text else "") + text
        out: list[int] = []
        for word in self.words.findall(s.replace(" ", SPACE)):
            out += self.memo.get(word) or self.word(word)
        if not self.fallback:
            out = [x for k, x in enumerate(out) if x != self.v.unk or not k or out[k - 1] != x]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if self.v.prefix and s.startswith(" ") else s


_codecs: dict[str, Codec] = {}


def _codec(path: str, vocabulary: Broadcast) -> Codec:
    """The worker's codec: the tables of its vocabulary stay from task to task, what it remembers of texts doesn't."""
    if path not in _codecs:
        _codecs[path] = Codec(vocabulary.value, 1)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, memory_mb: int = 160) -> DataFrame:
    """The ``keep`` columns (all, if None) and n_ids, ids and exact: whether the
    ids give the text again.

    A null text gives null in all three, an empty one no ids. Columns of these
    names are replaced. exact is false for texts that hold the space mark U+2581
    itself, which decodes to a space. Whole texts are encoded, one after the
    other; rows repeat as they do in docs. A task remembers the parts of texts
    that it has met in about ``memory_mb`` and gives that back at its end; less
    of it takes longer and changes no id.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_path))  # of a fixed size
    made = ("n_ids", "ids", "exact")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, vocabulary)
        codec.remember(memory_mb)
        try:
            for part in sliced(batches, 500):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [None if t is None else codec.encode(t) for t in texts]
                exact = [None if x is None else codec.decode(x) == t for x, t in zip(found, texts, strict=True)]
                flat = np.fromiter(chain.from_iterable(x for x in found if x), np.int32)
                ends = np.cumsum([0, *(len(x or ()) for x in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append([x is None for x in found], False)), pa.array(flat))
                sizes = pa.array([None if x is None else len(x) for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes, lists, pa.array(exact, pa.bool_())], names)
        finally:
            codec.remember(1)

    rows = docs.select(*map(column, keep), column(text_col).alias(unused(keep, "text")[0]))
    return rows.mapInArrow(run, T.StructType([*rows.schema[:-1], T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]))
