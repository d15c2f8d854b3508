"""SentencePiece vocabularies by a streaming Viterbi search.

The best segmentation (largest sum of piece scores) is found from left to right. Only boundaries that a piece from a
start already dealt with can reach are open, at most as many as the longest piece has characters; ids are committed
whenever the backpointer paths of all open boundaries meet at one. What waits for that are backpointers of one stretch,
short but where a text repeats itself so that two paths run side by side ("qqqq...").

Where one boundary is open nothing before it matters, so what the search does from there up to the next such boundary
hangs only on the characters that it looks at. An encoder keeps such stretches in a tree of characters, and what they
give for whole words that begin and end between them, and goes on by looking them up; the search itself runs where a
stretch has not been seen. Words that have not been seen are searched many at a time, all one place further in each step
(lockstep), by arrays; what doesn't fit that (long words and long waits) one by one.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept_columns, map_texts

UNKNOWN_PENALTY = 10.0
#: Stretches of at most so many characters are remembered by a worker, until their tree has so many nodes; then it begins anew.
STRETCH, NODES, HEAD = 64, 500_000, 3
#: Words are remembered while they and what belongs to them take so many bytes.
REMEMBERED, ENTRY = 160_000_000, 160
#: Words that are searched in lockstep at once.
LOCKSTEP = 16_384
#: Words with the marks before them.
MARK = "▁"
WORDS = re.compile("▁*[^▁]+|▁+")
#: What stands behind a text's last character: no text and no piece has it.
END = "\ud800"
#: Characters that the search is fed at once, and committed ones that it drops at once.
STEP = 4096


class Vocabulary:
    """Pieces and scores of a SentencePiece model file (a parameter; it is read, never copied)."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usual = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in usual}
        self.bytes_ = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        #: Every beginning of a piece: its id and score if it is one, else nothing.
        self.table: dict[str, tuple] = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces

    @functools.cached_property
    def crosses(self) -> bool:
        """Whether pieces go on from one word into the next."""
        return any(MARK in p.lstrip(MARK) for p in self.pieces)

    @functools.cached_property
    def steps(self) -> Steps:
        return Steps(self)

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers: its bytes, or the unknown id."""
        raw = char.encode()
        return [self.bytes_[b] for b in raw] if all(b in self.bytes_ for b in raw) else [self.unknown]


class Steps:
    """A vocabulary's table as arrays: beginnings of pieces have numbers (none: 0), and a number and a character lead to the next."""

    def __init__(self, v: Vocabulary):
        number = {"": 0} | {p: i for i, p in enumerate(v.table, 1)}
        self.kind = np.zeros(0x110000, np.int64)  # of characters; 0 is in no piece
        chars = sorted({ord(p[-1]) for p in v.table})
        self.kind[chars] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        keys = np.array([number[p[:-1]] * self.kinds + self.kind[ord(p[-1])] for p in v.table], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], order + 1
        self.piece, self.gain = np.full(len(number), -1, np.int64), np.zeros(len(number))
        for p, (i, gain) in v.pieces.items():
            self.piece[number[p]], self.gain[number[p]] = i, gain
        self.goes_on = np.zeros(len(number), bool)  # beginnings that a mark goes on
        self.goes_on[[number[p[:-1]] for p in v.table if p[-1] == MARK]] = True

    def next(self, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Numbers of the beginnings that are longer by a character; 0 where there is none."""
        keys = at * self.kinds + kind
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        return np.where(self.keys[found] == keys, self.to[found], 0)


def search_words(v: Vocabulary, words: list[str]) -> Iterator[tuple[str, tuple[bytes, int, int]]]:
    """What the search gives for words from a single open boundary before each: ids, commits and the widest wait.

    No word ends with a mark, and behind each stands a mark or the end of its text. Left out are words that a piece might
    go on beyond, or where paths run side by side for longer than the longest piece. As every start reaches the next
    place, by a piece or the unknown id, all places are boundaries, and one is open where no piece so far goes further.
    """
    steps = v.steps
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1  # places of the ENDs, one behind each word
    starts = ends - sizes
    code = np.frombuffer((END.join(words) + END).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, size = steps.kind[code], len(code)
    word_of = np.repeat(np.arange(len(words)), sizes + 1)
    place = np.arange(size) - starts[word_of]
    left_out = np.zeros(len(words), bool)
    inside = np.ones(size, bool)
    inside[ends] = False
    # All pieces from all places, by length.
    far = np.arange(size) + inside
    at = np.flatnonzero(inside)
    node = np.zeros(len(at), np.int64)
    edges: list[tuple] = []
    for k in range(1, v.longest + 1):
        node = steps.next(node, kind[at + k - 1])
        if k == 1:
            alone = at[steps.piece[node] < 0]
            edges.append((alone, alone + 1, np.full(len(alone), v.unknown_score), np.full(len(alone), -1)))
        going = node > 0
        at, node = at[going], node[going]
        whole = steps.piece[node]
        some = whole >= 0
        edges.append((at[some], at[some] + k, steps.gain[node[some]], whole[some]))
        far[at[some]] = at[some] + k
        left_out[word_of[at[~inside[at + k] & steps.goes_on[node]]]] = True
        going = inside[at + k]
        at, node = at[going], node[going]
        if not len(at):
            break
    source, target, gain, piece = map(np.concatenate, zip(*edges, strict=True))
    # Starts are dealt with from left to right, in all words at once; an equal sum doesn't displace an earlier start's.
    order = np.argsort(place[source].astype(np.min_scalar_type(int(sizes.max()))), kind="stable")
    source, target, gain, piece = source[order], target[order], gain[order], piece[order]
    bounds = np.searchsorted(place[source], np.arange(sizes.max() + 1))
    score, back, last = np.full(size, -math.inf), np.zeros(size, np.int64), np.zeros(size, np.int64)
    score[starts] = 0.0
    for low, high in itertools.pairwise(bounds.tolist()):
        sums = score[source[low:high]] + gain[low:high]
        better = np.flatnonzero(sums > score[target[low:high]])
        to = target[low:high][better]
        score[to], back[to], last[to] = sums[better], source[low:high][better], piece[low:high][better]
    # Backpointers from the words' ends; every word's end is the only open boundary.
    cut = np.zeros(size, bool)
    at = ends
    while len(at):
        cut[at] = True
        at = back[at]
        at = at[place[at] > 0]
    cuts = np.flatnonzero(cut)
    ids = last[cuts]
    bare = ids < 0
    chars, which = np.unique(code[cuts[bare] - 1], return_inverse=True)
    spelled = [v.spelled(chr(c)) for c in chars.tolist()]
    times = np.ones(len(cuts), np.int64)
    times[bare] = np.array([len(x) for x in spelled], np.int64)[which]
    ids, bare = np.repeat(ids, times), np.repeat(bare, times)
    ids[bare] = np.fromiter(itertools.chain.from_iterable([spelled[i] for i in which.tolist()]), np.int64)
    raw = ids.astype("<i4").tobytes()
    ids_to = (4 * np.cumsum(times)[np.searchsorted(cuts, ends)]).tolist()
    single = np.flatnonzero(inside & (np.maximum.accumulate(far) == np.arange(size) + 1)) + 1
    waits = place[single] - np.where(np.diff(word_of[single], prepend=-1) > 0, 0, place[np.roll(single, 1)])
    first = np.searchsorted(single, starts, "right")
    commits, widest = np.diff(np.append(first, len(single))), np.maximum.reduceat(waits, first)
    left_out |= widest > v.longest
    low = 0
    for word, high, out, n, wait in zip(words, ids_to, left_out.tolist(), commits.tolist(), widest.tolist(), strict=True):
        if not out:
            yield word, (raw[low:high], n, wait)
        low = high


class StreamingViterbi:
    """feed() text bit by bit and finish(); both give the ids that are certain by then. Equal sums: the longer last piece wins.

    commits counts the boundaries at which all paths met, widest is the longest stretch that waited for one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.commits = self.widest = 0
        self._reset()

    def _reset(self) -> None:
        self.text = ""
        self.base = self.done = self.reach = 0  # places in text: committed up to, starts dealt with, the furthest open boundary
        self.score, self.back = [0.0], [0]

    def feed(self, more: str) -> list[int]:
        out: list[int] = []
        if self.base >= STEP:
            cut = self.base
            self.text, self.score = self.text[cut:], self.score[cut:]
            self.back = [b - cut for b in self.back[cut:]]
            self.base, self.done, self.reach = 0, self.done - cut, self.reach - cut
        self.text += more
        self.score += [-math.inf] * len(more)
        self.back += [0] * len(more)
        self._advance(len(self.text) - self.v.longest, out)
        return out

    def stretch(self, text: str, start: int) -> tuple[list[int], int, int]:
        """Ids from start up to the next place where one boundary is open, its distance, and the place behind the last character looked at.

        The same search without waiting: text is whole, ends with END, and is read where it is. What is committed on the
        way is let go, so no more is held than waits.
        """
        v = self.v
        table, pieces, longest, unknown, size = v.table, v.pieces, v.longest, v.unknown_score, len(text) - 1
        none = -math.inf
        score, back, low = [0.0], [0], start  # of the places from low on
        ids: list[int] = []
        base = reach = s = start
        looked = start + 1
        while True:
            here, after = score[s - low], s + 1
            if here != none:
                single = False
                for e in range(after, s + longest + 1):
                    found = table.get(text[s:e])
                    if e > looked:
                        looked = e
                    if found is None:
                        break
                    if found:
                        if e == after:
                            single = True
                        k = e - low
                        while k >= len(score):
                            score.append(none)
                            back.append(0)
                        if here + found[1] > score[k]:
                            score[k], back[k] = here + found[1], s
                            if e > reach:
                                reach = e
                if not single:
                    k = after - low
                    if k >= len(score):
                        score.append(none)
                        back.append(0)
                    if here + unknown > score[k]:
                        score[k], back[k] = here + unknown, s
                        if after > reach:
                            reach = after
            elif after - low >= len(score):
                score.append(none)
                back.append(0)
            one = reach == after
            end = base
            if one:
                end = after
            elif not (after - base) % longest:
                ends = {e for e in range(after, reach + 1) if score[e - low] != none}
                while len(ends) > 1:  # the furthest steps back until one is left
                    furthest = max(ends)
                    ends.remove(furthest)
                    ends.add(back[furthest - low])
                end = ends.pop()
            if end > base:
                at, made = end, []
                while at > base:
                    before = back[at - low]
                    found = pieces.get(text[before:at])
                    made += [found[0]] if found else v.spelled(text[before:at])[::-1]
                    at = before
                ids += made[::-1]
                self.widest = max(self.widest, after - base)
                self.commits += 1
                base = end
                if one:
                    return ids, end - start, looked
                if base - low > STEP:
                    del score[: base - low], back[: base - low]
                    low = base
            s = after

    def finish(self) -> list[int]:
        out: list[int] = []
        self._advance(len(self.text), out)
        self._reset()
        return out

    def _advance(self, until: int, out: list[int]) -> None:
        """Deals with all starts before until; later ones might see longer pieces once more text is there."""
        v, text, score, back, reach = self.v, self.text, self.score, self.back, self.reach
        table, longest, unknown, size = v.table, v.longest, v.unknown_score, len(self.text)
        for s in range(self.done, until):
            here, after = score[s], s + 1
            if here != -math.inf:
                single = False
                for e in range(after, min(s + longest, size) + 1):
                    found = table.get(text[s:e])
                    if found is None:
                        break
                    if found:
                        if e == after:
                            single = True
                        if here + found[1] > score[e]:
                            score[e], back[e] = here + found[1], s
                            if e > reach:
                                reach = e
                if not single and here + unknown > score[after]:
                    score[after], back[after] = here + unknown, s
                    if after > reach:
                        reach = after
            if reach == after:  # one boundary is open
                self._commit(after, after, out)
            elif not (after - self.base) % longest:
                meet = self._meeting(after, reach)
                if meet > self.base:
                    self._commit(meet, after, out)
        self.done, self.reach = max(self.done, until), reach

    def _meeting(self, first: int, last: int) -> int:
        """The last boundary that the paths of all open boundaries share: the furthest steps back until one is left."""
        ends = {e for e in range(first, last + 1) if self.score[e] != -math.inf}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(self.back[furthest])
        return ends.pop()

    def _commit(self, end: int, now: int, out: list[int]) -> None:
        """Ids of the path from the last committed boundary to this one."""
        text, pieces, at, ids = self.text, self.v.pieces, end, []
        while at > self.base:
            start = self.back[at]
            found = pieces.get(text[start:at])
            ids += [found[0]] if found else self.v.spelled(text[start:at])[::-1]
            at = start
        out += ids[::-1]
        self.widest = max(self.widest, now - self.base)
        self.commits += 1
        self.base = end


class Encoder:
    """Whole texts to ids: the streaming search over each, with its stretches between single open boundaries remembered."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.known: dict = {}  # a tree of the first HEAD characters and then of single ones; its leaves are (length, ids, commits, widest wait, characters looked at)
        self.words: dict[str, tuple[bytes, int, int]] = {}  # what stretches give a word that begins and ends between them
        self.nodes = self.searched = self.held = 0

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, int, int]]:
        """The ids of each text as little-endian 32-bit bytes, how often the search committed some, and its widest wait."""
        out = []
        normal = [self.v.model.normalize(raw) for raw in texts]
        parted = [WORDS.findall(text) for text in normal]
        self.learn(set().union(*parted))
        for text, parts in zip(normal, parted, strict=True):
            found = list(map(self.words.get, parts))
            if None in found:
                found = self.walk(text, parts)
            raws, commits, waits = zip(*found, strict=True) if found else ((), (), ())
            out.append((b"".join(raws), sum(commits), max(waits, default=0)))
            if self.held > REMEMBERED:
                self.words, self.held = {}, 0
        return out

    def learn(self, words: set[str]) -> None:
        """Searches, in lockstep, words that have not been seen."""
        fresh = [x for x in words if x not in self.words and len(x) <= STRETCH and x[-1] != MARK]
        for i in range(0, len(fresh), LOCKSTEP):
            if self.held > REMEMBERED:
                break
            for word, whole in search_words(self.v, fresh[i : i + LOCKSTEP]):
                self.words[word] = whole
                self.held += 4 * len(word) + len(whole[0]) + ENTRY

    def walk(self, text: str, parts: list[str]) -> list[tuple[bytes, int, int]]:
        """What the search gives for a text's words, one after the other."""
        ended, words, at, start, found = text + END, self.words, 0, 0, []
        for word in parts:
            whole = words.get(word) if at == start else None
            start += len(word)
            if whole is None:
                if at >= start:  # a stretch has passed this word
                    continue
                whole, at = self.word(ended, word, at, start)
            else:
                at = start
            found.append(whole)
        return found

    def word(self, text: str, word: str, at: int, end: int) -> tuple[tuple[bytes, int, int], int]:
        """What the search gives from a single open boundary up to the end of a word or beyond, and where it comes to.

        Where it has begun with the word, comes to its end and has looked no further than one character behind it, that
        is remembered for the word: behind words stands a mark of the next one or nothing, and neither goes on a piece
        (where the vocabulary has pieces across words, only what is learnt is remembered).
        """
        begun, ids, commits, widest, furthest = at == end - len(word), [], 0, 0, at
        while at < end:
            i = at + HEAD
            node = self.known.get(text[at:i])
            while node.__class__ is dict:
                node = node.get(text[i])
                i += 1
            length, more, n, wait, looked = node or self.search(text, at)
            furthest = max(furthest, at + looked)
            at += length
            ids.append(more)
            commits += n
            widest = max(widest, wait)
        whole = (b"".join(ids), commits, widest)
        if begun and at == end and furthest <= end + 1 and len(word) <= STRETCH and not self.v.crosses:
            self.words[word] = whole
            self.held += 4 * len(word) + len(whole[0]) + ENTRY
        return whole, at

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0][0], dtype="<i4").tolist()

    def search(self, text: str, start: int) -> tuple[int, bytes, int, int, int]:
        """The stretch from start, where one boundary is open, to the next such place; remembered by the characters looked at."""
        search = StreamingViterbi(self.v)
        ids, length, looked = search.stretch(text, start)
        leaf = (length, struct.pack(f"<{len(ids)}i", *ids), search.commits, search.widest, looked - start)
        self.searched += 1
        if looked - start <= STRETCH:
            if self.nodes > NODES:
                self.known, self.nodes = {}, 0
            keys = [text[start : start + HEAD], *text[start + HEAD : looked]]
            node = self.known
            for key in keys[:-1]:
                below = node.get(key)
                if below is None:
                    below = node[key] = {}
                    self.nodes += 1
                node = below
            node[keys[-1]] = leaf
        return leaf

    def decode(self, ids: list[int]) -> str:
        return self.v.model.decode(ids)


@functools.lru_cache(maxsize=1)
def load_encoder(model_file: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(model_file)


def encode_texts(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with _ids, _decoded_sha256 (the hash of what the ids decode to), _commits and _widest.

    _commits is how often the search committed ids, _widest the longest stretch of characters that waited for it. Null
    and empty texts give no ids. Equal texts give equal ids. An empty table gives no rows.
    """
    kept = kept_columns(df, keep if keep is not None else [c for c in df.columns if c != text], "_ids", "_decoded_sha256", "_commits", "_widest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                raw, commits, widest = zip(*encoder.encode_all([x or "" for x in part.column(part.num_columns - 1).to_pylist()]), strict=True)
                ends = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                digests = [hashlib.sha256(encoder.decode(np.frombuffer(x, dtype="<i4").tolist()).encode()).hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(digests, pa.string()), pa.array(commits, pa.int64()), pa.array(widest, pa.int64())], names=[*part.schema.names[:-1], "_ids", "_decoded_sha256", "_commits", "_widest"])

    return map_texts(df, text, kept, work, "_ids array<int>, _decoded_sha256 string, _commits long, _widest long")


def decode_ids(df: DataFrame, model_file: str, ids: str = "_ids", to: str = "_text") -> DataFrame:
    """df with the text that the ids decode to; null for null."""

    df = df.drop(to)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(model_file)
        for batch in batches:
            texts = [x if x is None else encoder.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))
