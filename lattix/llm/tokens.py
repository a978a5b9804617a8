"""Encoding whole texts with a public tokenizer file, through a memo of words that have been encoded before."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import bounded

#: Bytes that a worker's memo may hold, as estimated; beyond half of it the older half is forgotten.
MEMO_BYTES = 160 << 20
#: Bytes of an entry besides its word and ids.
ENTRY_BYTES = 230
#: Characters that are split into words at once: longer texts are cut at blanks, so neither they nor their words pile up.
CHUNK = 1 << 21
#: Groups of words whose encodings are held at once.
GROUPS = 64
#: Words that are encoded in one call, as one text.
JOINED = 64
#: Latin-1 white space that str.split parts at and the tokenizer may not, and the white space that both part at.
RARE = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
BLANK = re.compile("[ \t\n\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Steps that leave a lower-cased Latin-1 word of letters as it is and whole, by the names that tokenizer files give them.
IDLE_NORMALIZERS = ("NFC", "Lowercase", {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
WHOLE_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def _bare(tokenizer):
    """A tokenizer with the same model that gives lower-cased Latin-1 words of letters the same ids with fewer steps; ``tokenizer`` itself where its steps are others."""
    from tokenizers import Tokenizer, pre_tokenizers

    def steps(part, names: str) -> list:
        told = json.loads(part.__getstate__()) if part else {}
        return told.get(names, [told]) if told else []

    normal, parts = steps(tokenizer.normalizer, "normalizers"), steps(tokenizer.pre_tokenizer, "pretokenizers")
    if not all(x in IDLE_NORMALIZERS or x["type"] in IDLE_NORMALIZERS for x in normal) or len(parts) != 2 or parts[0] != WHOLE_WORDS:
        return tokenizer
    if parts[1]["type"] != "ByteLevel" or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
        return tokenizer
    bare = Tokenizer(tokenizer.model)  # shared, not copied
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return bare


class WordEncoder:
    """``encode(text)`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, as little-endian uint32 bytes.

    For tokenizer files whose pre-tokenizer parts text at white space and never joins across it, whose tokens end words
    with a suffix, and that lower-case: then a text's ids are its words' ids one after another. Words of letters are
    encoded many at a time and told apart by the suffix; a trailing run of ASCII punctuation is a word of its own;
    all others are encoded singly.
    """

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("the tokenizer has no suffix for the end of words")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.quick = _bare(self.tokenizer)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo = memo
        self.held = 0

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        # Words and their ids make no cycles, and there are too many to look for some.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_groups(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_groups(self, texts: list[str | None]) -> list[bytes]:
        out, group, held = [], [], 0
        for text in texts:
            if len(text := text or "") > CHUNK:
                out += self._encode(group)
                out.append(b"".join(self._encode([part])[0] for part in _cut(text)))
                group, held = [], 0
                continue
            group.append(text)
            held += len(text)
            if held >= CHUNK:
                out += self._encode(group)
                group, held = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.held > self.memo // 2:
            self.old, self.young, self.held = self.young, {}, 0
        lower, others = [], {}
        for k, text in enumerate(texts):
            try:
                raw = text.encode("latin-1")
                common = len(raw.translate(None, RARE)) == len(raw)
            except UnicodeEncodeError:
                common = False
            # Lower-cased as the tokenizer does; other scripts and rare white space are left to it.
            lower.append(text.lower() if common else "")
            if not common:
                others[k] = BLANK.split(text)
        # Each distinct word of the texts meets the memo once.
        split = pc.ascii_split_whitespace(pa.array(lower, pa.string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = dict(zip(words, map(self.young.get, words)))
        self._learn(known, self.quick)
        ids = pa.array(list(known.values()), pa.binary()).take(coded.indices)
        at, raw = np.frombuffer(ids.buffers()[1], np.int32)[split.offsets.to_numpy()].tolist(), ids.buffers()[2]
        out = [raw[a:b].to_pybytes() for a, b in zip(at, at[1:])]
        if others:
            words = set().union(*others.values())
            known = dict(zip(words, map(self.young.get, words)))
            self._learn(known, self.tokenizer)
            for k, words in others.items():
                out[k] = b"".join(map(known.__getitem__, words))
        return out

    def _learn(self, known: dict[str, bytes | None], tokenizer) -> None:
        """Gives the words of ``known`` that have no ids theirs, and the memo too. ``tokenizer``: for words of letters."""
        young, new, plain, odd, later = self.young, {}, [], [], []
        words = [w for w, ids in known.items() if ids is None]
        if old := self.old:
            new.update([(w, ids) for w, ids in zip(words, map(old.get, words)) if ids is not None])
            words = [w for w in words if w not in new]
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif (core := w.rstrip(punctuation)).isalpha() and core.lower().isalpha():
                later.append((w, core, w[len(core) :]))
            else:
                odd.append(w)
        fresh = set(words)
        for group, at in ((plain, 1), (odd, 2)):
            parts = list({part[at] for part in later}.difference(fresh, new))
            met = dict(zip(parts, map(young.get, parts)))
            group += [x for x, ids in met.items() if ids is None]
            new.update([(x, ids) for x, ids in met.items() if ids is not None])
        encode = tokenizer.encode_batch_fast
        for at in range(0, len(plain), JOINED * GROUPS):
            groups = [plain[i : i + JOINED] for i in range(at, min(at + JOINED * GROUPS, len(plain)), JOINED)]
            for group, found in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(group):
                    odd.extend(group)
                    continue
                raw, cuts = ids.tobytes(), [0, *(cuts * 4).tolist()]
                new.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        encode = self.tokenizer.encode_batch_fast
        for at in range(0, len(odd), JOINED * GROUPS):
            slice_ = odd[at : at + JOINED * GROUPS]
            new.update((w, np.array(found.ids, "<u4").tobytes()) for w, found in zip(slice_, encode(slice_, add_special_tokens=False)))
        new.update([(w, new[core] + new[tail]) for w, core, tail in later])
        young.update(new)
        known.update([(w, new[w]) for w, ids in known.items() if ids is None])
        self.held += sum(map(len, new)) * 2 + len(new) * ENTRY_BYTES


def _cut(text: str) -> Iterator[str]:
    """A long text in parts that end before a blank: ids of words never reach across one."""
    at = 0
    while at < len(text):
        found = BLANK.search(text, at + CHUNK)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def batched(texts: pa.Array, most_chars: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts in lists of some millions of characters, or one longer text."""
    group, chars = [], 0
    for t in texts:
        s = t.as_py()
        group.append(s)
        chars += len(s or "")
        if chars >= most_chars:
            yield group
            group, chars = [], 0
    if group:
        yield group


def with_ids(docs: DataFrame, path: str | None = None, end: int | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian uint32 bytes, then the id ``end`` if given. Null is empty."""
    path = path or default_path()
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([x + tail for group in batched(texts) for x in e.encode_many(group)], pa.binary())

    return bounded(docs).withColumn(out, of(F.col(text)))
