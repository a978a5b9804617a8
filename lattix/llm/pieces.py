"""SentencePiece BPE models: whole texts to piece ids and back, many words at a time in rounds of merges over flat arrays.

A round finds in each word the pair of neighbouring symbols of the best score (the leftmost of equals), merges all
these pairs at once, and closes the gaps; words without a pair that the vocabulary knows leave the rounds. This gives
what the library's queue gives, pair by pair, since words don't touch each other: text is parted wherever no piece of
the vocabulary has the two characters side by side, and equal words of a batch are merged once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import bounded
from lattix.llm.tokens import batched

#: Characters that are worked on at once; longer texts are parted between two words.
CHUNK = 1 << 20
#: Rounds after which the words that still have pairs (long ones that repeat a pair all along) are merged through a queue.
ROUNDS = 128
SPACE = "▁"
#: The rank of no pair, above that of any piece; a rank stands above ``PLACES`` bits for the place.
NEVER = np.int64(1) << 22
PLACES = np.int64(40)
_NEIGHBOURS = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Encodes and decodes as ``SentencePieceProcessor`` does without sampling and without begin or end ids.

    For BPE models with byte fallback, no character map, a space put before the text and no other change of spaces,
    and only normal, byte, control and unknown pieces; others are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, norm, trained = proto.SentencePiece, proto.normalizer_spec, proto.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not trained.treat_whitespace_as_suffix
        kinds = {p.type for p in proto.pieces}
        if trained.model_type != trained.BPE or not trained.byte_fallback or not plain or kinds - {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}:
            raise ValueError("only BPE models with byte fallback, a space before the text and no character map or symbols of their own")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.is_byte = np.zeros(len(proto.pieces), bool)
        self.is_byte[self.bytes] = True
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        self.surface = [b"" if p.type == kind.CONTROL else trained.unk_surface.encode() if p.type == kind.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        #: By code point: the piece of a single character, or below zero.
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        score = {p: proto.pieces[i].score for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: True where some piece may have two such characters side by side (hashed: a few others are true too, which only makes words longer).
        self.beside = np.zeros(_NEIGHBOURS, bool)
        self.longest = max(map(len, self.ids), default=1)
        self.n = len(proto.pieces)
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    found[self.ids[p[:k]] * self.n + self.ids[p[k:]]] = (place[score[p]], i)
            points = np.frombuffer(p.encode("utf-32-le"), "<u4")
            self.beside[self._hashed(points[:-1], points[1:])] = True
        self.pairs = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.pairs.tolist()], np.int64)
        self.made = np.array([found[k][1] for k in self.pairs.tolist()], np.int32)

    @staticmethod
    def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) * 40503 + right) & (_NEIGHBOURS - 1)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        counts, out, group, held = np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            nonlocal group, held
            if group:
                ids, n = self._encode([part for _, part in group])
                np.add.at(counts, [k for k, _ in group], n)
                out.append(ids)
            group, held = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            for part in self._parts((SPACE + text).replace(" ", SPACE)):
                group.append((k, part))
                if (held := held + len(part)) >= CHUNK:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """The code points of a text, in parts of some ``CHUNK`` that end between two words."""
        held = np.zeros(0, np.uint32)
        for at in range(0, len(text), CHUNK):
            points = np.concatenate([held, np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")])
            cut = len(points)
            if at + CHUNK < len(text):
                apart = np.flatnonzero(~self.beside[self._hashed(points[:-1], points[1:])])
                cut = int(apart[-1]) + 1 if len(apart) else 0
            if cut:
                yield points[:cut]
            held = points[cut:]

    def _encode(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        points = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        new = np.ones(len(points), bool)
        new[1:] = ~self.beside[self._hashed(points[:-1], points[1:])]
        new[ends[:-1]] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(points))
        first, which = self._distinct(points, starts, sizes)
        symbols, n = self._merged(*_taken(points, starts[first], sizes[first]))
        counts = n[which]
        ids, _ = _taken(symbols, (np.cumsum(n) - n)[which], counts)
        until = np.cumsum(counts)[np.searchsorted(starts, ends) - 1]
        return ids, np.diff(until, prepend=0)

    def _distinct(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each kind, and the kind of each word: equal hashes whose code points are equal, too."""
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        mixed = (points.astype(np.uint64) | place.astype(np.uint64) << np.uint64(21)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        _, first, which = np.unique(np.add.reduceat(mixed, starts), return_index=True, return_inverse=True)
        same = sizes[first][which] == sizes
        there = np.minimum(np.arange(len(points)) + np.repeat(starts[first][which] - starts, sizes), len(points) - 1)
        if same.all() and (points[there] == points).all():
            return first, which
        return np.arange(len(starts)), np.arange(len(starts))

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NEVER), self.made[at]

    def _merged(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that lie one after another -> their ids when no pair remains, and how many each word has."""
        n_words = len(sizes)
        word = np.repeat(np.arange(n_words, dtype=np.int64), sizes)
        symbol = self.single[points]
        unknown = symbol < 0
        symbol[unknown] = -1 - points[unknown].astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], made[inside] = self._ranked(symbol[inside], symbol[inside + 1])
        alive = np.zeros(n_words, bool)
        for _ in range(ROUNDS):
            alive[:] = False
            alive[word[rank < NEVER]] = True
            stays = alive[word]
            done.append((word[~stays], symbol[~stays]))
            word, symbol, rank, made = word[stays], symbol[stays], rank[stays], made[stays]
            if not len(word):
                break
            best = self._best(word, rank)
            symbol[best] = made[best]
            stays = np.ones(len(word), bool)
            stays[best + 1] = False
            best = (np.cumsum(stays) - 1)[best]
            word, symbol, rank, made = word[stays], symbol[stays], rank[stays], made[stays]
            near = np.zeros(len(word) + 1, bool)
            near[best] = near[best - 1] = True  # the place before the first is the last one, which is spare
            touched = np.flatnonzero(near[:-1])
            rank[touched] = NEVER
            touched = touched[touched < len(word) - 1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], made[touched] = self._ranked(symbol[touched], symbol[touched + 1])
        for group in np.split(np.arange(len(word)), np.flatnonzero(np.diff(word)) + 1):
            if len(group):
                left = self._queued(symbol[group].tolist())
                done.append((np.full(len(left), word[group[0]]), np.array(left, np.int32)))
        word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return self._spelled(word[order], symbol[order], n_words)

    def _best(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the pairs of this round stand: each word's best. A long word is laid out in blocks of the longest piece's
        length; a block's best pair may go at once if neither block beside it has a better one, for no piece that
        takes one of its symbols away reaches beyond these, and the queue would take the better pair first."""
        n = len(word)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(starts, append=n)
        blocks = np.maximum(sizes // self.longest, 1)
        blocks[sizes <= 4 * self.longest] = 1
        if (blocks > 1).any():
            nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = np.repeat(starts, blocks) + nth * self.longest
        least = np.minimum.reduceat(rank << PLACES | np.arange(n), starts)
        place, level = least & ((1 << PLACES) - 1), least >> PLACES
        owner = word[starts]
        wins = level < NEVER
        beside = owner[1:] == owner[:-1]
        wins[1:] &= ~(beside & (level[:-1] <= level[1:]))
        wins[:-1] &= ~(beside & (level[1:] < level[:-1]))
        return place[wins]

    def _queued(self, symbols: list[int]) -> list[int]:
        """One word by a queue of pairs, best score first and leftmost of equals."""
        known = {k: v for k, v in zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.made.tolist()))}
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(a, b):
            if a >= 0 and b >= 0 and symbols[a] >= 0 and symbols[b] >= 0 and (pair := symbols[a] * self.n + symbols[b]) in known:
                heapq.heappush(queue, (known[pair][0], a, b, pair))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        gone = [False] * len(symbols)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if gone[a] or gone[b] or after[a] != b or symbols[a] * self.n + symbols[b] != pair:
                continue
            symbols[a], gone[b], after[a] = known[pair][1], True, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, g in zip(symbols, gone) if not g]

    def _spelled(self, word: np.ndarray, symbol: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece has become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbol < 0)
        if len(odd):
            spelled = [chr(-1 - s).encode("utf-8", "surrogatepass") for s in symbol[odd].tolist()]
            n = np.ones(len(symbol), np.int64)
            n[odd] = [len(b) for b in spelled]
            word, symbol = np.repeat(word, n), np.repeat(symbol, n)
            symbol[symbol < 0] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return symbol, np.bincount(word, minlength=n_words)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces one after another without the space put before; bytes that are no UTF-8 become U+FFFD each."""
        listed = ids.tolist()
        parts = [self.surface[i] for i in listed]
        lead = next((k for k, i in enumerate(listed) if i not in self.control), None)
        if lead is not None and not self.is_byte[listed[lead]] and listed[lead] in self._spaced():
            parts[lead] = parts[lead][1:]
        raw = b"".join(parts)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)

    def _spaced(self) -> set[int]:
        if not hasattr(self, "spaced"):
            self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        return self.spaced


def _taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[start : start + size]`` one after another, and their sizes."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], sizes


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model of a file, made once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text as ``array<int>`` in column ``out`` (which replaces one of that name).

    Null and empty texts have no ids; rows that repeat each have theirs; an empty table stays empty; other columns pass.
    Nothing is shuffled. A worker holds one Arrow batch (bounded in bytes, or one longer text) and arrays of some ``CHUNK`` characters.
    """
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        m, found, counts = model(path), [], []
        for group in batched(texts):
            ids, n = m.encode_many(group)
            found.append(ids)
            counts.append(n)
        ends = np.cumsum(np.concatenate([[0], *counts]), dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()))

    return bounded(docs).withColumn(out, of(F.col(f"`{text}`")))


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids in column ``out`` (which replaces one of that name); null stays null, no ids are the empty text."""
    path = path or default_path()

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        m, flat = model(path), lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        return pa.array([m.decode(flat[a:b]) if valid else None for a, b, valid in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist())], pa.string())

    return bounded(rows).withColumn(out, of(F.col(f"`{ids}`")))
