"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The most frequent words of the corpus are merged once and compiled, in sorted order, into
a minimal acyclic automaton: words share prefixes and suffixes, and the outputs on a
word's path add up to its number, which points to its ids.  The automaton is a flat file
that tasks map into memory; all words of a batch walk through it side by side.  Words
that it does not know are merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_rows, scratch_dir, session, stored, table
from .registry import query
from .warc import open_store

# Fixed values of the vocabulary file's normaliser and word rule.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """A vocabulary file: ids, merges by rank, word end, and special strings."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    word_end: str
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        return cls(
            model["vocab"], {tuple(pair): i for i, pair in enumerate(model["merges"])}, model["end_of_word_suffix"],
            {t["content"]: t["id"] for t in whole["added_tokens"]},
        )


NO_PAIR = 1 << 30


class Merger:
    """Exact merging of words, given in UTF-8; many words side by side."""

    WIDTHS = (4, 8, 12, 16, 24, 48)  # words of about one length share a matrix; longer ones go one by one

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.ranks, self.end = vocabulary.ids, vocabulary.ranks, vocabulary.word_end
        self.letters = byte_letters()
        # Numbers of parts: ids where they have one, else numbers above them.
        number = dict(self.ids)
        for part in [x for letter in self.letters for x in (letter, letter + self.end)] + [x for pair in self.ranks for x in (*pair, pair[0] + pair[1])]:
            number.setdefault(part, len(number))
        self.known = np.zeros(len(number), bool)
        self.known[[number[p] for p in self.ids]] = True
        self.inner, self.last = (np.array([number[letter + end] for letter in self.letters], np.int64) for end in ("", self.end))
        pairs = np.array([(number[a] << 32 | number[b], rank, number[a + b]) for (a, b), rank in self.ranks.items()], np.int64).reshape(-1, 3)
        self.pairs, self.rank, _ = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.merged = np.zeros(int(pairs[:, 1].max(initial=0)) + 1, np.int64)  # by rank
        self.merged[pairs[:, 1]] = pairs[:, 2]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts, NO_PAIR for parts that never merge."""
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.rank[at], NO_PAIR)

    def _side_by_side(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each word, filled up with -1, and their number: in every step each word merges its first pair of least rank."""
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        column, row = np.arange(width), np.arange(n)
        part = np.where(column < size[:, None], self.inner[raw], -1)
        part[row, size - 1] = self.last[raw[row, size - 1]]
        rank = np.full((n, width), NO_PAIR)
        rank[:, :-1] = self._ranks(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, width - 1)
        done, live = np.full((n, width), -1), row
        while len(live):
            at = rank.argmin(1)
            i = np.arange(len(live))
            least = rank[i, at]
            over = least == NO_PAIR
            if over.any():
                done[live[over]] = part[over]
                live, part, rank, at, least = live[~over], part[~over], rank[~over], at[~over], least[~over]
                if not len(live):
                    break
                i = np.arange(len(live))
            # What stands after the pair moves up by one.
            source = np.minimum(column + (column > at[:, None]), width - 1)
            part, rank = np.take_along_axis(part, source, 1), np.take_along_axis(rank, source, 1)
            part[i, -1], rank[i, -1] = -1, NO_PAIR
            part[i, at] = self.merged[least]
            right = np.minimum(at + 1, width - 1)
            rank[i, at] = np.where(at + 1 < width, self._ranks(part[i, at], part[i, right]), NO_PAIR)
            left = at > 0
            rank[i[left], at[left] - 1] = self._ranks(part[i[left], at[left] - 1], part[i[left], at[left]])
        return done, (done >= 0).sum(1)

    def merge_all(self, words: list[bytes], together: int = 20_000) -> list[np.ndarray]:
        """The ids of each word; a part without an id is left out, as the library does where there is no unknown token."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in self.WIDTHS if len(self.pairs) else ():
            mine = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(mine), together):
                which = mine[k : k + together].tolist()
                parts, number = self._side_by_side([words[i] for i in which], width)
                flat = parts[parts >= 0]
                if not self.known.all() and not self.known[flat].all():
                    number = np.array([int(self.known[p[p >= 0]].sum()) for p in parts])
                    flat = flat[self.known[flat]]
                ends = np.cumsum(number).tolist()
                for i, a, b in zip(which, [0, *ends], ends):
                    out[i] = flat[a:b]
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = np.array(self.merge(words[i]), np.int64)
        return out

    def merge(self, word: bytes) -> list[int]:
        """One word of any length in n log n, with a heap and linked parts."""
        letters = [self.letters[b] for b in word]
        parts = self._linked([*letters[:-1], letters[-1] + self.end]) if letters else []
        return [i for p in parts if (i := self.ids.get(p)) is not None]

    def _linked(self, parts: list[str]) -> list[str]:
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, (parts[a], parts[b])))
        return [p for p in parts if p]


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal automaton of ``words`` with their ids as outputs.

    States are made from the sorted words with one open path; when a word leaves the
    path, its tail is closed and states with equal continuation become one.
    """
    known: dict[tuple, int] = {}
    closed: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def close(node: list) -> int:
        final, edges = node
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(closed)
            closed.append(key)
        return known[key]

    ordered = sorted(words)
    path: list[list] = [[False, []]]  # open states: final, closed edges
    last = b""
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], close(path.pop())))
    root = close(path[0])
    below = np.zeros(len(closed), np.int64)  # words in each state's continuation
    keys, targets, outputs = [], [], []
    for state, (final, edges) in enumerate(closed):  # children are closed first
        count = int(final)
        for letter, target in edges:
            keys.append(state * 256 + letter)
            targets.append(target)
            outputs.append(count)
            count += below[target]
        below[state] = count
    order = np.argsort(np.array(keys, np.int64)) if keys else np.empty(0, np.int64)
    lists = [words[w] for w in ordered]
    return {
        "keys": np.array(keys, np.int64)[order], "targets": np.array(targets, np.int64)[order], "outputs": np.array(outputs, np.int64)[order],
        "final": np.array([f for f, _ in closed], np.int64), "root": np.array([root], np.int64),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64),
        "ids": np.array([i for x in lists for i in x], np.int64),
    }


PARTS = ("keys", "targets", "outputs", "final", "root", "starts", "ids")


def save_lexicon(parts: dict[str, np.ndarray], uri: str) -> None:
    """One flat file: the lengths of the arrays, then the arrays."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(np.array([len(parts[p]) for p in PARTS], "<i8").tobytes())
        for p in PARTS:
            out.write(parts[p].astype("<i8").tobytes())


class Lexicon:
    """The compiled automaton, mapped into memory from a mounted folder (else its bytes are read)."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        if isinstance(store, pafs.LocalFileSystem):
            flat = np.memmap(path, "<i8", "r").view(np.ndarray)
        else:
            with store.open_input_stream(path, compression=None) as source:
                flat = np.frombuffer(source.read(), "<i8")
        at = len(PARTS)
        for part, n in zip(PARTS, flat[:at].tolist()):
            setattr(self, part, flat[at : at + n])
            at += n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that it does not know; all walk side by side."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(length) - length
        live = np.arange(len(words))
        state, total = np.full(len(words), self.root[0]), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            ends = length[live] == depth
            if ends.any():
                done = ends & (self.final[state] == 1)
                out[live[done]] = total[done]
                live, state, total = live[~ends], state[~ends], total[~ends]
                if not len(live):
                    break
            key = state * 256 + flat[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            live, at = live[there], at[there]
            state, total = self.targets[at], total[there] + self.outputs[at]
            depth += 1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


class Splitter:
    """Text to words as UTF-8 bytes; special strings come as their id."""

    def __init__(self, special: dict[str, int]):
        self.words, self.special = regex.compile(WORDS), special
        self.marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _plain(self, text: str) -> list[str]:
        # Blanks of any kind only part words here, so they need not become one space first.
        if not text.isascii():
            # Lower case letter by letter: no special form of sigma at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def split(self, text: str) -> list[str | int]:
        if not self.marks or not self.marks.search(text):
            return self._plain(text)
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += [*self._plain(text[at : mark.start()]), self.special[mark[0]]]
            at = mark.end()
        return out + self._plain(text[at:])


# Marks that begin a word of their own after a letter or digit; an apostrophe may join what follows.
ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def split_pieces(splitter: Splitter, pieces: list[bytes]) -> list[list[bytes]]:
    """The words of each piece between blanks; most are letters and a few marks after them."""
    out = []
    for piece in pieces:
        core = piece.rstrip(ENDS)
        if core.isalpha():  # ASCII letters
            out.append([core, piece[len(core) :]] if len(core) < len(piece) else [core])
        else:
            out.append([w.encode() for w in splitter._plain(piece.decode())])
    return out


def plain_pieces(text: str, special: list[bytes]) -> list[bytes] | None:
    """The pieces between blanks, A-Z in lower case; None if the text may hold a special string, which is as written."""
    data = text.encode()
    return None if any(s in data for s in special) else data.lower().split()


def frequent_words(docs: DataFrame, text: str, special: dict[str, int], top: int) -> list[bytes]:
    """The most frequent words of all texts, ``top`` at most; counted in tasks first, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts, pieces = Splitter(special), Counter(), Counter()
        begins = sorted({s[:2].encode() for s in special})

        def flush() -> pa.RecordBatch:
            for words, n in zip(split_pieces(splitter, list(pieces)), pieces.values()):
                for w in words:
                    counts[w] += n
            rows = [(w, n) for w, n in counts.items() if len(w) <= 64]
            pieces.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64()))], ["word", "n"])

        for batch in batches:
            for (t,) in arrow_rows(batch, text):
                if not t:
                    continue
                if (found := plain_pieces(t, begins)) is not None:
                    pieces.update(found)
                else:
                    counts.update(w.encode() for w in splitter.split(t) if isinstance(w, str))
                if len(pieces) + len(counts) > 400_000:
                    yield flush()
        yield flush()

    counted = stored(docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # The lowest class of counts whose words are not too many; only those words reach the driver.
    level = F.floor(F.log2("n") * 8).cast("int")
    room, least = top, 1 << 30
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return [bytes(r.word) for r in counted.filter(level >= least).collect()]


def build_lexicon(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, text: str = "text", top: int = 32_768) -> str:
    """Compile the ``top`` most frequent words (of up to 64 bytes) to a file in the shared folder; its place."""
    session(spark)
    words = frequent_words(docs, text, vocabulary.special, top)
    uri = f"{scratch_dir(spark, 'lexicon')}/words.bin"
    save_lexicon(compile_lexicon({w: ids.tolist() for w, ids in zip(words, Merger(vocabulary).merge_all(words))}), uri)
    return uri


class _Numbers(dict):
    """Numbers of pieces in the order in which they are met first."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class Encoder:
    """Encodes batches of texts with the automaton, and unknown words by merging.

    Pieces between blanks are numbered as they are met.  Only a piece that is new is split
    into words, which the automaton looks up or which are merged; a text's ids are gathered
    by the numbers of its pieces.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, memo: int = 400_000):
        self.lexicon, self.merger, self.splitter = lexicon, Merger(vocabulary), Splitter(vocabulary.special)
        self.begins, self.limit = sorted({s[:2].encode() for s in vocabulary.special}), memo
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.at, self.size, self.flat = (np.empty(0, k) for k in (np.int64, np.int64, np.uint32))

    def _words(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of distinct words."""
        number = self.lexicon.numbers(words)
        out = {words[i]: self.lexicon.ids_of(int(number[i])) for i in np.flatnonzero(number >= 0).tolist()}
        rest = [words[i] for i in np.flatnonzero(number < 0).tolist()]
        out.update(zip(rest, self.merger.merge_all(rest)))
        return out

    def _learn(self) -> None:
        pieces, self.numbers.new = self.numbers.new, []
        split = split_pieces(self.splitter, pieces)
        ids = self._words(list({w for words in split for w in words}))
        lists = [ids[w] for words in split for w in words]
        flat = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.uint32)
        word_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        ends = word_ends[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        size = np.diff(ends, prepend=0)
        self.at = np.concatenate([self.at, len(self.flat) + ends - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > self.limit:
            self._forget()
        number, held, odd = self.numbers.__getitem__, [], {}
        for i, t in enumerate(texts):
            pieces = plain_pieces(t, self.begins) if t else []
            if pieces is None:
                odd[i], pieces = self.splitter.split(t), []
            held.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.numbers.new:
            self._learn()
        out = []
        for which in held:
            size = self.size[which]
            place = np.repeat(self.at[which] - np.cumsum(size) + size, size)
            out.append(self.flat[place + np.arange(len(place))])
        ids = self._words(list({w.encode() for words in odd.values() for w in words if isinstance(w, str)}))
        for i, words in odd.items():
            out[i] = np.concatenate([np.empty(0, np.int64), *([w] if isinstance(w, int) else ids[w.encode()] for w in words)]).astype(np.uint32)
        return out


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, lexicon_uri: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` and ``decoded``.

    A null text is an empty one: no ids, an empty decoded text.  Columns of these names
    are replaced.  Decoding puts a space between the tokens of all ids, specials kept.
    """
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)  # the vocabulary file: a fixed size
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary, Lexicon(lexicon_uri))
        names = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        token = np.array([names.get(i) for i in range(max(names, default=-1) + 1)], object)
        for batch in batches:
            rows = []
            for ids in encoder.encode([t for (t,) in arrow_rows(batch, text)]):
                decoded = " ".join(token[ids].tolist())
                row = [len(ids), hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + ([ids, decoded] if with_ids else []))
            kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return docs.mapInArrow(run, schema)


def vocabulary_path() -> str:
    """Where the public vocabulary file of the named query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe")
def bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = Vocabulary.load(vocabulary_path())
    uri = build_lexicon(spark, docs, vocabulary)
    return encode_texts(docs, vocabulary, uri, with_ids=False).drop("text")
