"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

``frequent_words`` counts the pre-tokenised words of all texts; ``build_lexicon`` merges the most
frequent ones exactly and compiles them into a minimal acyclic automaton with shared suffixes whose arcs
carry additive outputs: their sum along a word is its place in the table of id runs. The automaton is a
flat file that ``addFile`` hands to every executor, where workers memory-map it. In the tasks every
distinct word of a slice runs through the automaton once (all words together, a byte a step); unseen
words are merged exactly, so the size of the lexicon never changes a result.

Encoding is that of the tokenizer file with add_special_tokens=False: special-token strings in a text
are cut out first, the rest is normalised (NFC, lower case, white space only separates), split by its
pattern and merged with an end-of-word suffix. A null text is encoded as the empty text; it and texts of
white space only have no ids. Decoding joins the tokens' strings with one space, as the tokenizer file
(which has no decoder) does; ids outside the vocabulary are skipped. Repeated rows and ids are harmless. Texts of any
length are encoded whole; columns named as a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import heapq
import itertools
import json
import mmap
import os
import shutil
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, steps, text_sizes

END = "</w>"
NO_RANK = 1 << 30
#: Words kept by a worker between slices and tasks, about.
CACHE_WORDS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE shows for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-end BPE tokenizer file: splitting, exact merging, token strings."""

    def __init__(self, content: str):
        import re

        from tokenizers import Regex, normalizers, pre_tokenizers

        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        # the file's own normaliser and pattern, so that letters and numbers are those of its Unicode version
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]).normalize_str
        self.pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        # the same split where all characters are below U+0100 and none is a number but 0-9
        letters = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
        self.plain = re.compile(rf"[{letters}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{letters}0-9]+").findall
        self.odd = re.compile("[Ā-\U0010ffff\xb2\xb3\xb9\xbc-\xbe]").search

    def split(self, text: str) -> list:
        """Words of a text; special tokens stand as their ids."""
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.plain(text.lower())
        return [w for w, _ in self.pieces(self.normal(text))]

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of a word: the pair of least rank first, the leftmost of equals."""
        letters = self.letters
        parts = [letters[b] for b in word.encode()]
        parts[-1] += END
        ranks = self.ranks
        if len(parts) > 48:
            parts = self._merge_long(parts)
        else:
            while len(parts) > 1:
                best = min((ranks.get(pair, NO_RANK), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == NO_RANK:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        vocab = self.vocab
        return tuple(vocab[p] for p in parts if p in vocab)

    def merge_all(self, words: list[str]) -> list:
        """``merge`` of many words at once: each step merges the first pair of least rank in every word."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for low, high in ((0, 8), (8, 12), (12, 20), (20, 48)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(rows), 1 << 14):
                self._merge_rows(rows[i : i + (1 << 14)], raw, out)
        for i in np.flatnonzero((sizes == 0) | (sizes > 48)):
            out[i] = self.merge(words[i]) if words[i] else ()
        return out

    @functools.cached_property
    def _pairs(self):
        """Arrays of the first symbols of a word, and of the pairs by key: rank and merged id."""
        vocab = self.vocab
        begin = np.array([vocab[x] for x in self.letters])
        end = np.array([vocab[x + END] for x in self.letters])
        rows = sorted((vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for (a, b), rank in self.ranks.items())
        keys, ranks, merged = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        by_rank = np.zeros(len(self.ranks) + 1, np.int64)
        by_rank[ranks] = merged
        return begin, end, keys, ranks, by_rank

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, _, keys, ranks, _ = self._pairs
        key = a << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (b >= 0), ranks[at], NO_RANK)

    def _merge_rows(self, rows: np.ndarray, raw: list[bytes], out: list) -> None:
        begin, end, _, _, merged = self._pairs
        sizes = np.fromiter((len(raw[i]) for i in rows), np.int64, len(rows))
        flat = begin[np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
        lasts = np.cumsum(sizes) - 1
        flat[lasts] = end[np.frombuffer(bytes(raw[i][-1] for i in rows), np.uint8)]
        width = int(sizes.max())
        symbols = np.full((len(rows), width), -1, np.int64)
        symbols[np.arange(width) < sizes[:, None]] = flat
        ranks = self._ranks_of(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(rows)), at]
                going = least < NO_RANK
            else:
                going = np.zeros(len(rows), bool)
            done = ~going
            if done.any():
                left = symbols[done]
                ends = np.cumsum((left >= 0).sum(axis=1)).tolist()
                ids = left[left >= 0].astype(np.int32)
                for i, start, stop in zip(rows[done].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[start:stop]
                if not going.any():
                    return
                rows, symbols, ranks, at, least = rows[going], symbols[going], ranks[going], at[going], least[going]
            one = np.arange(len(rows))
            symbols[one, at] = merged[least]
            columns = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, columns + (columns > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), axis=1)
            if ranks.shape[1]:
                has = at > 0
                ranks[one[has], at[has] - 1] = self._ranks_of(symbols[one[has], at[has] - 1], symbols[one[has], at[has]])
                has = at < ranks.shape[1]
                ranks[one[has], at[has]] = self._ranks_of(symbols[one[has], at[has]], symbols[one[has], at[has] + 1])

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list."""
        ranks, n = self.ranks, len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]


@functools.lru_cache(maxsize=2)
def parsed(content: str) -> WordBpe:
    """A worker keeps the parsed file between tasks."""
    return WordBpe(content)


@functools.lru_cache(maxsize=1)
def token_strings(content: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, width, bytes) of every id's string and a space; all that decoding needs of the file."""
    spec = json.loads(content)
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    names = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
    width = np.array([len(x) + 1 if x else 0 for x in names])
    return np.cumsum(width) - width, width, np.frombuffer(b"".join(x + b" " for x in names if x), np.uint8)


# ---------------------------------------------------------------- the transducer


class Transducer:
    """A minimal acyclic automaton: word bytes -> place among its sorted words.

    Arrays: ``keys`` (state * 256 + byte, ascending), ``target``, ``output`` (words passed over) for
    the arcs; ``final`` for the states; ``start`` and ``ids`` for the id runs by place.
    """

    NAMES = (("keys", np.uint64), ("target", np.uint32), ("output", np.uint32), ("final", np.uint8), ("start", np.uint32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, tuple[int, ...]]) -> Transducer:
        """Words are added in order; states that no later word can reach are shared if equal."""
        words = sorted(entries)
        nodes: list[tuple[bool, dict[int, int]]] = []
        known: dict[tuple, int] = {}
        counts: list[int] = []

        def settle(node) -> int:
            key = (node[0], tuple(node[1].items()))
            if key not in known:
                known[key] = len(nodes)
                nodes.append(node)
                counts.append(node[0] + sum(counts[t] for t in node[1].values()))
            return known[key]

        path: list[list] = [[False, {}]]  # the unsettled states along the last word
        last = b""
        for word in words:
            same = len(os.path.commonprefix([word, last]))
            while len(path) > same + 1:
                child = path.pop()
                path[-1][1][last[len(path) - 1]] = settle(child)
            for _ in word[same:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            child = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(child)
        root = settle(path[0])
        arcs = []
        for state, (final, out) in enumerate(nodes):
            passed = int(final)
            for byte, target in sorted(out.items()):
                arcs.append((state * 256 + byte, target, passed))
                passed += counts[target]
        arcs.sort()
        keys, target, output = (np.array(c) for c in zip(*arcs, strict=True)) if arcs else (np.empty(0, int),) * 3
        runs = [entries[w] for w in words]
        arrays = {"keys": keys, "target": target, "output": output, "final": [f for f, _ in nodes] + [root >> s & 255 for s in (0, 8, 16, 24)], "start": np.cumsum([0, *map(len, runs)]), "ids": [i for r in runs for i in r]}
        return cls({n: np.asarray(arrays[n]).astype(k) for n, k in cls.NAMES})

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            head = [len(getattr(self, n)) for n, _ in self.NAMES]
            f.write(np.array(head, np.int64).tobytes())
            for n, _ in self.NAMES:
                data = getattr(self, n).tobytes()
                f.write(data + b"\0" * (-len(data) % 8))

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(view, np.int64, len(cls.NAMES))
        at, arrays = sizes.nbytes, {}
        for (name, kind), n in zip(cls.NAMES, sizes.tolist(), strict=True):
            arrays[name] = np.frombuffer(view, kind, n, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1: all words take a step together."""
        place = np.zeros(len(words), np.int64)
        if not len(self.keys) or not words:
            return place - 1
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        root = int.from_bytes(self.final[-4:].tobytes(), "little")
        state = np.full(len(words), root, np.uint64)
        live = np.flatnonzero(lengths)
        place[lengths == 0] = -1
        step = 0
        while len(live):
            key = state[live] * np.uint64(256) + data[offsets[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[arc] == key
            place[live[~good]] = -1
            live, arc = live[good], arc[good]
            state[live] = self.target[arc]
            place[live] += self.output[arc]
            step += 1
            done = lengths[live] == step
            ended = live[done]
            place[ended[self.final[state[ended].astype(np.int64)] == 0]] = -1
            live = live[~done]
        return place


class Encoder:
    """Encodes texts with the automaton, and keeps the words it has met."""

    def __init__(self, bpe: WordBpe, automaton: Transducer):
        self.bpe, self.automaton = bpe, automaton
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list) -> None:
        place = self.automaton.find([w.encode() if isinstance(w, str) else b"" for w in words]).tolist()
        unseen = iter(self.bpe.merge_all([w for w, p in zip(words, place, strict=True) if p < 0 and isinstance(w, str)]))
        ids, start = self.automaton.ids, self.automaton.start.tolist()
        runs = [ids[start[p] : start[p + 1]] if p >= 0 else next(unseen) if isinstance(w, str) else (w,) for w, p in zip(words, place, strict=True)]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(lengths) - lengths)
        self.size = np.append(self.size, lengths)
        self.ids = np.append(self.ids, np.concatenate([np.asarray(r, np.int32) for r in runs]))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i+1]]."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = [self.bpe.split(x) if x else [] for x in texts]
        if new := list(set().union(*split).difference(self.known)):
            self.learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.array(list(map(self.known.__getitem__, itertools.chain.from_iterable(split))), np.int64)
        lengths = self.size[at]
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        return np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int32), flat


@functools.lru_cache(maxsize=1)
def _encoder(content: str, path: str) -> Encoder:
    return Encoder(parsed(content), Transducer.mapped(path))


# ---------------------------------------------------------------- Spark


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_words(docs: DataFrame, limit: int, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The most frequent words of all texts with their counts, ``limit`` at most (words of like counts together)."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(tokenizer or default_path()))

    def run(batches):
        bpe, counts = parsed(shared.value), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in steps(batch, text_sizes(batch.column(0))):
                for value in part.column(0).to_pylist():
                    if value:
                        counts.update(bpe.split(value) if bpe.cut is None or not bpe.cut.search(value) else [w for w in bpe.split(value) if isinstance(w, str)])
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    counts = docs.select(F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # a word seen once is no frequent one; sizes by steps of a twelfth of an octave find the least count
    counts = checkpointed(counts.filter("n > 1").withColumn("step", F.floor(F.log2("n") * 12).cast("int")))
    total, least = 0, None
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > limit:
            break
        least = row["step"]
    return counts.filter(F.col("step") >= (1 << 30 if least is None else least)).select("word", "n")


_folder: list[str] = []


def build_lexicon(words: DataFrame, *, tokenizer: str | None = None) -> str:
    """Compiles a (bounded) table of words and hands the file to all executors; returns its name."""
    bpe = WordBpe(_read(tokenizer or default_path()))
    listed = [r["word"] for r in words.select("word").collect()]
    entries = {w.encode(): tuple(map(int, ids)) for w, ids in zip(listed, bpe.merge_all(listed), strict=True)}
    if not _folder:  # the driver's own copy, from which Spark serves the file
        _folder.append(os.path.realpath(tempfile.mkdtemp()))
        atexit.register(shutil.rmtree, _folder[0], True)
    path = f"{_folder[0]}/new"
    Transducer.build(entries).save(path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}.fst"
    context = words.sparkSession.sparkContext
    os.replace(path, f"{_folder[0]}/{name}")
    if not any(x.endswith(name) for x in context.listFiles):
        context.addFile(f"{_folder[0]}/{name}")
    return name


def encode(docs: DataFrame, lexicon: str, *, text: str = "text", output: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with the array of token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(tokenizer or default_path()))

    def make():
        encoder = _encoder(shared.value, SparkFiles.get(lexicon))

        def function(texts):
            offsets, ids = encoder.encode(texts.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]

        return function

    return append_columns(docs, text, [text], [(output, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, *, ids: str = "ids", output: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the text of each id array: the tokens' strings joined with one space."""
    shared = df.sparkSession.sparkContext.broadcast(_read(tokenizer or default_path()))
    fields = [f for f in df.schema.fields if f.name != output]
    schema = T.StructType([*fields, T.StructField(output, T.StringType())])
    of_ids = [f.name for f in fields].index(ids)

    def run(batches):
        start, width, table = token_strings(shared.value)
        for batch in batches:
            lists = batch.column(of_ids)
            for part in steps(batch, [4 * (n or 0) for n in pa.compute.list_value_length(lists).to_pylist()]):
                lists = part.column(of_ids).fill_null([]) if part.column(of_ids).null_count else part.column(of_ids)
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.where((flat >= 0) & (flat < len(width)), flat, -1)
                wide = np.where(flat >= 0, width[flat], 0)
                ends = np.cumsum(wide)
                data = table[np.repeat(start[flat] - (ends - wide), wide) + np.arange(int(wide.sum()))]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])]
                made = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes()))
                made = pa.compute.utf8_slice_codeunits(made, 0, -1)  # the last space
                columns = [part.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*columns, made], names=schema.names)

    import pyarrow.compute  # noqa: F401

    return df.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, schema)


def lexicon_for(docs: DataFrame, *, text: str = "text", words: int = 1 << 16, tokenizer: str | None = None) -> str:
    """Counts, compiles and distributes the lexicon of a table's most frequent words."""
    return build_lexicon(frequent_words(docs, words, text=text, tokenizer=tokenizer), tokenizer=tokenizer)
