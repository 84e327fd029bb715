"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of all documents are counted; the most frequent ones (at most `lexicon_size`, which bounds what is broadcast)
are compiled with their token ids into a minimal acyclic automaton: common suffixes are shared, each arc carries a
number, and the sum along a word's path is the place of its ids in an output table. The compiled bytes are mapped into
memory by each worker (in a local file of the worker's own, made anew from what was sent). Words that the automaton
doesn't hold are merged exactly, in batches: lowest merge rank first, leftmost first. The lexicon never changes a result,
only the work done for it.

Workers hold a bounded part of the texts at a time: about a million characters. Longer texts are cut before a blank that
follows another character, where a word begins whatever stands around it. What a worker has learnt of words is forgotten
once it takes `_MEMO_BYTES`.

Special tokens of the tokenizer file found in a text become their single id, as the tokenizers library does by default.
Tokenizer files with parts that this module doesn't have (normalisers, other splits, options of added tokens) are refused.

Defined results: a null text is encoded as the empty one (no ids, decoded ''); whole texts are encoded however long;
repeated rows are encoded each; an empty table gives an empty result; the input's other columns are kept, and where one
is called `ids` or `decoded` it is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.common import documents, eased, text_or_empty, written

# Fixed value: the pattern by which byte-level BPE splits text before merging; \s is written as the Unicode property.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NEVER = np.int32(2**31 - 1)
_LONG = 64  # longer words are merged one by one over a heap
_MEMO_BYTES = 32 << 20  # what a worker keeps of words and their ids; beyond it, it starts anew


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _refuse_unknown(whole: dict) -> None:
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] if whole.get("normalizer") else []
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer")
    wrong += [x["content"] for x in whole["added_tokens"] if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized")]
    if wrong:
        raise ValueError(f"not supported in a tokenizer file: {wrong}")


class Packed:
    """Byte strings side by side, and any choice of them joined."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Vocabulary:
    """The tables of a tokenizer file, in a form that is cheap to send: under 3 MB for 50,000 merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        _refuse_unknown(whole)
        vocab = whole["model"]["vocab"]
        letters = byte_letters()
        back = {letter: b for b, letter in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, at in vocab.items():
            self.pieces[at] = bytes(back[x] for x in piece)
        for content, at in self.special.items():
            self.pieces[at] = content.encode()
        self.of_byte = np.array([vocab[x] for x in letters], np.int32)
        merges = [x if isinstance(x, list) else x.split(" ") for x in whole["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; a pair with an end below 0 has none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], _NEVER)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, exactly."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= _LONG]
        for at in order[len(short) :]:
            out[at] = self._merge_long(words[at])
        for k in range(0, len(short), 8192):
            self._merge_block(words, short[k : k + 8192], out)
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, out: list) -> None:
        width = max(2, max(len(words[k]) for k in rows))
        data = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(-1, width)
        size = np.array([len(words[k]) for k in rows])
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[data], np.int32(-1))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            lowest = ranks[line, best]
            done = lowest == _NEVER
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k][ids[k] >= 0]
            go = ~done
            rows, ids, ranks, best, lowest = rows[go], ids[go], ranks[go], best[go], lowest[go]
            n, width = ids.shape
            if not n:
                return
            line = np.arange(n)
            ids[line, best] = self.result[lowest]
            stays = np.ones((n, width), bool)
            stays[line, best + 1] = False
            ids = ids[stays].reshape(n, width - 1)
            stays = np.ones((n, width - 1), bool)
            stays[line, best] = False
            ranks = ranks[stays].reshape(n, width - 2)
            if width == 2:  # one id is left in each row
                for k in range(n):
                    out[rows[k]] = ids[k]
                return
            right = best < width - 2
            ranks[line[right], best[right]] = self.rank(ids[line[right], best[right]], ids[line[right], best[right] + 1])
            left = best > 0
            ranks[line[left], best[left] - 1] = self.rank(ids[line[left], best[left] - 1], ids[line[left], best[left]])

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(int(r), k) for k, r in enumerate(self.rank(np.array(ids[:-1]), np.array(ids[1:]))) if r != _NEVER]
        heapq.heapify(queue)
        pair = {k: r for r, k in queue}

        def look(k: int) -> None:
            pair.pop(k, None)
            if k >= 0 and after[k] >= 0:
                r = int(self.rank(np.array([ids[k]]), np.array([ids[after[k]]]))[0])
                if r != _NEVER:
                    pair[k] = r
                    heapq.heappush(queue, (r, k))

        while queue:
            r, k = heapq.heappop(queue)
            if pair.get(k) != r:
                continue
            gone = after[k]
            ids[k], after[k], ids[gone] = int(self.result[r]), after[gone], -1
            pair.pop(gone, None)
            if after[k] >= 0:
                before[after[k]] = k
            look(k)
            if before[k] >= 0:
                look(before[k])
        return np.array([x for x in ids if x >= 0], np.int32)


class Lexicon:
    """A minimal acyclic transducer from words to id lists, built from sorted words and read from mapped memory."""

    @staticmethod
    def compile(entries: dict[bytes, np.ndarray]) -> bytes:
        """The automaton's bytes. States are made minimal as soon as no later word can change them."""
        known: dict[tuple, int] = {}
        final: list[bool] = []
        arcs: list[tuple] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(final)
                final.append(node[0])
                arcs.append(key[1])
            return known[key]

        path: list[list] = [[False, []]]
        last = b""
        words = sorted(entries)
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = settle(path[0])
        below = [0] * len(final)
        for k in range(len(final)):  # targets come before their sources
            below[k] = final[k] + sum(below[t] for _, t in arcs[k])
        keys, targets, skips = [], [], []
        for k in range(len(final)):
            n = int(final[k])
            for label, t in arcs[k]:
                keys.append(k << 8 | label)
                targets.append(t)
                skips.append(n)
                n += below[t]
        outs = [entries[w] for w in words]
        ends = np.cumsum([0, *map(len, outs)])
        parts = [keys, targets, skips, final, ends, np.concatenate(outs) if outs else []]
        head = np.array([root, *map(len, parts)], "<i8")
        return head.tobytes() + b"".join(np.array(x, "<i4" if k else "<i8").tobytes() for k, x in enumerate(parts))

    def __init__(self, data):
        head = np.frombuffer(data, "<i8", 7)
        self.root, at, parts = int(head[0]), 56, []
        for k, n in enumerate(head[1:].tolist()):
            parts.append(np.frombuffer(data, "<i4" if k else "<i8", n, at))
            at += n * (4 if k else 8)
        self.keys, self.targets, self.skips, self.final, self.ends, self.ids = parts

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Over a file mapped into memory; its name goes at once, so nothing is left behind."""
        handle, name = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(handle, "wb") as file:
                file.write(data)
            with open(name, "rb") as file:
                return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        finally:
            os.unlink(name)

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word, None for those it doesn't hold; all words walk in step."""
        found: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size.max(initial=0))
        if not len(self.keys) or not longest:
            return found
        live = np.flatnonzero(size <= _LONG)
        letters = np.frombuffer(b"".join(words[k].ljust(_LONG, b"\0") for k in live), np.uint8).reshape(-1, _LONG)
        state, place = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        row = np.arange(len(live))
        for depth in range(min(longest, _LONG) + 1):
            over = size[live[row]] == depth
            for k in row[over & (self.final[state] != 0)] if len(row) else ():
                n = place[k]
                found[live[k]] = self.ids[self.ends[n] : self.ends[n + 1]]
            row, state = row[~over], state[~over]
            if not len(row):
                break
            key = state << 8 | letters[row, depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            row, at = row[hit], at[hit]
            place[row] += self.skips[at]
            state = self.targets[at].astype(np.int64)
        return found


def _latin_split():
    """The same split for texts whose characters all lie below U+0250, in the faster standard engine: there the classes are short lists."""
    kinds = {"L": [], "N": [], "Z": []}
    for k in range(0x250):
        kind = "Z" if chr(k) in "\t\n\v\f\r \x85\xa0" else unicodedata.category(chr(k))[0]
        kinds.get(kind, []).append(f"\\u{k:04x}")
    letter, number, space = ("".join(kinds[x]) for x in "LNZ")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class _Places(dict):
    """Places of words in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Splits texts, looks words up in the lexicon and merges the rest; keeps what it has seen up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split, self.latin = regex.compile(_SPLIT).findall, _latin_split()
        self.beyond = re.compile("[^\\u0000-\\u024f]").search
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.blanks = any(" " in x for x in special)  # then no blank is a safe place to cut at
        self._forget()

    def _forget(self) -> None:
        self.at = _Places()
        tokens = list(self.vocabulary.special.items())
        for content, _ in tokens:
            self.at["\0special" + content]  # noqa: B018  takes a place
        self.known, self.bytes = len(tokens), 0
        self.store = np.array([x for _, x in tokens], np.int32)
        self.filled = len(tokens)
        self.start, self.count = np.arange(len(tokens)), np.ones(len(tokens), np.int64)

    def pieces(self, text: str) -> Iterator[str]:
        """A text, cut into parts where words begin."""
        while len(text) > _PIECE and (cut := self._cut(text, _PIECE)):
            yield text[:cut]
            text = text[cut:]
        yield text

    def words(self, text: str) -> list[str]:
        split = self.split if self.beyond(text) else self.latin
        if self.special is None or not any(x in text for x in self.vocabulary.special):
            return split(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            out += ["\0special" + piece] if k % 2 else split(piece)
        return out

    def _learn(self) -> None:
        new = [x.encode() for x in itertools.islice(self.at, self.known, None)]
        if not new:
            return
        ids = self.lexicon.find(new) if self.lexicon else [None] * len(new)
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.vocabulary.merge([new[k] for k in rest]), strict=True):
            ids[k] = x
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        self.store, self.start, self.count = (_room(x, n) for x, n in ((self.store, self.filled + total), (self.start, self.known + len(ids)), (self.count, self.known + len(ids))))
        self.store[self.filled : self.filled + total] = np.concatenate(ids)
        self.start[self.known : self.known + len(ids)] = self.filled + np.cumsum(count) - count
        self.count[self.known : self.known + len(ids)] = count
        self.filled, self.known = self.filled + total, self.known + len(ids)
        self.bytes += sum(map(len, new)) + 200 * len(new) + 8 * total  # about: words as strings in a dict, ids in grown arrays

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the offsets of each text."""
        if self.bytes > _MEMO_BYTES:
            self._forget()
        place = self.at.__getitem__
        places = []
        for text in texts:
            words = self.words(text)
            places.append(np.fromiter(map(place, words), np.int32, len(words)))
        self._learn()
        flat = np.concatenate(places) if places else np.empty(0, np.int32)
        start, count = self.start[flat], self.count[flat]
        ends = np.cumsum(count)
        ids = self.store[np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, places)])]
        return ids, bounds

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """A column of texts in bounded parts: (first row, row after the last, ids, offsets, whether the last row ends here); a row that doesn't goes on in the next part."""
        row, part, size = 0, [], 0
        for k in range(len(column)):
            text = column[k].as_py() or ""
            while size + len(text) > _PIECE and (cut := self._cut(text, max(_PIECE - size, 1))):
                part.append(text[:cut])
                yield row, k + 1, *self.encode(part), False
                text, row, part, size = text[cut:], k, [], 0
            part.append(text)
            size += len(text)
            if size >= _PIECE:
                yield row, k + 1, *self.encode(part), True
                row, part, size = k + 1, [], 0
        if part:
            yield row, len(column), *self.encode(part), True

    def _cut(self, text: str, at: int) -> int:
        """A place from `at` on where a word begins whatever stands around it; 0 if there is none."""
        if self.blanks or at >= len(text):
            return 0
        found = _EDGE.search(text, at)
        return found.start() + 1 if found else 0


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` entries, grown by doubling."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(vocabulary: Vocabulary, compiled: bytes) -> Encoder:
    """A worker's encoder; tasks that follow in the same worker go on with what it has learnt."""
    key = hashlib.sha256(compiled).digest() + len(vocabulary.pieces).to_bytes(4, "big")
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, Lexicon.mapped(compiled))
    return _ENCODERS[key]


_PIECE = 1 << 20  # characters that are encoded at a time
_EDGE = re.compile(r"\S(?= )")


def word_counts(docs: DataFrame, vocabulary, flush_at: int = 300_000) -> DataFrame:
    """(word, n) over all texts; workers count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(vocabulary.value), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in eased(batches):
            for text in batch.column("text"):
                for piece in encoder.pieces(text.as_py()):
                    seen.update(encoder.words(piece))
                    if len(seen) > flush_at:
                        yield out()
                        seen.clear()
        yield out()

    counted = docs.select(text_or_empty().cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, lexicon_size: int = 1 << 16) -> bytes:
    """The compiled lexicon of the most frequent words: at most lexicon_size of them, of at most 64 bytes, so what is collected and sent is bounded."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counts = written(word_counts(docs, sent).where((F.col("n") > 1) & (F.octet_length("word") <= _LONG)), "words")
    # Counts fall into classes by their leading bits, a few hundred at most; the classes that fit are collected whole.
    counts = counts.withColumn("kind", F.expr("length(bin(n)) * 16 + cast(shiftright(n, greatest(length(bin(n)) - 5, 0)) AS int) % 16"))
    left, least = lexicon_size, None
    for row in counts.groupBy("kind").agg(F.count("*").alias("words")).orderBy(F.desc("kind")).collect():
        left -= row.words
        if left < 0:
            break
        least = row.kind
    top = [] if least is None else [x.word.encode() for x in counts.where(F.col("kind") >= least).select("word").collect()]
    return Lexicon.compile(dict(zip(top, vocabulary.merge(top), strict=True)))


def encode(docs: DataFrame, tokenizer: str, lexicon_size: int = 1 << 16) -> DataFrame:
    """The input with `ids`, the token ids of `text`."""
    sc = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(tokenizer)
    table = sc.broadcast(vocabulary)
    compiled = sc.broadcast(build_lexicon(docs, vocabulary, lexicon_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(table.value, compiled.value)
        for batch in eased(batches):
            held: list[np.ndarray] = []  # of a row that isn't finished
            for first, stop, ids, bounds, whole in encoder.encode_rows(batch.column("text")):
                ids = np.concatenate([*held, ids])
                bounds = bounds + sum(map(len, held))
                bounds[0], held = 0, []
                if not whole:
                    held, stop, bounds, ids = [ids[bounds[-2] :]], stop - 1, bounds[:-1], ids[: bounds[-2]]
                column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                rows = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, "ids"])

    kept = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """The input with `decoded`, the text of its `ids`; bytes that aren't UTF-8 become the replacement character. Null ids decode to ''."""
    table = coded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Packed(table.value.pieces)
        for batch in eased(batches):
            texts = [pieces.join(x.values.to_numpy()).tobytes().decode("utf-8", "replace") if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    coded = coded.drop("decoded")
    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


class _Digests:
    """SHA-256 of a text's ids, written with commas between, and of what they decode to; ids may come in parts."""

    def __init__(self, pieces: Packed, numbers: Packed):
        self.pieces, self.numbers = pieces, numbers
        self.count, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray, last: bool) -> None:
        written_ = self.numbers.join(ids).tobytes()
        self.ids.update(written_[not self.count :] if len(ids) else b"")  # each number comes with a comma before it
        self.text.update(self.decoder.decode(self.pieces.join(ids).tobytes(), last).encode())
        self.count += len(ids)


def round_trip(docs: DataFrame, tokenizer: str, lexicon_size: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass of a worker; neither ids nor texts leave it."""
    sc = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(tokenizer)
    table = sc.broadcast(vocabulary)
    compiled = sc.broadcast(build_lexicon(docs, vocabulary, lexicon_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(table.value, compiled.value)
        pieces, numbers = Packed(table.value.pieces), Packed([b",%d" % k for k in range(len(table.value.pieces))])
        for batch in eased(batches):
            out, held = [], None
            for _, _, ids, bounds, whole in encoder.encode_rows(batch.column("text")):
                last = len(bounds) - 2
                for k in range(last + 1):
                    held = held or _Digests(pieces, numbers)
                    ends = whole or k < last
                    held.add(ids[bounds[k] : bounds[k + 1]], ends)
                    if ends:
                        out.append((held.count, held.ids.hexdigest(), held.text.hexdigest()))
                        held = None
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer())


QUERIES = {"op3_bpe": op3_bpe}
SQL: dict[str, str] = {}
