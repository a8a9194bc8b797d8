"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text into chunks, so texts that share a
passage share chunks whatever stands before it. A chunk's inside is encoded
once: those that many documents share once for the whole corpus (a dictionary
of bounded size that every worker gets), others once in each worker's bounded
cache. What remains is the join of two chunks: the tail of one and the head of
the next, encoded together again. A window grows until it starts and ends where
both encodings must agree, which is before a space that follows a character
other than white space: the pre-tokenizer splits there whatever else the text
holds. A chunk without such a place belongs to the window as a whole.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

TOKENIZER = "byte_bpe_50k.json"
#: Bytes that the rolling hash sees.
WINDOW = 32
#: Least, usual and most bytes of a chunk.
LEAST, USUAL, MOST = 128, 512, 2048
#: At most so many chunks are in the corpus dictionary: under SHARED * MOST * 4 bytes of ids, 2 bytes a token as a rule.
SHARED = 16_384
#: Entries of a worker's cache of words (about 200 bytes each), of its cache of words that start a text, and of its cache of chunks, which starts anew when it is full.
WORDS, STARTS, CHUNKS = 700_000, 50_000, 20_000
#: Longer words are not kept.
LONGEST = 64
#: White space, of one character, before a space: no place to cut the text.
UNSAFE = re.compile(rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) ")
#: A letter of Latin scripts, and a mark of ASCII other than the apostrophe, which may begin a contraction.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
_MARK = rb"[!-&(-/:-@\[-`{-~]"
#: Words that the pre-tokenizer surely splits into letters, marks, a line's end, letters and marks.
SPLIT = re.compile(rb"(%b+)(%b*)(?:\n(%b+)(%b*))?" % (_LETTER, _MARK, _LETTER, _MARK))
WITHIN = re.compile(rb"%b*%b*(?:\n%b*%b*)?" % (_LETTER, _MARK, _LETTER, _MARK))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def open_ended(word: bytes) -> bool:
    """Whether a word is empty or ends in white space, so that a space after it is no place to cut."""
    return not word or word[-1] <= 0x20 or word[-1] >= 0x80 and word.decode("utf-8", "replace")[-1].isspace()


class Cache(dict):
    """Ids of words: ``most`` of them at most, and ``over`` for what comes after."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.over: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.over[word]

    def put(self, word: bytes, ids: bytes) -> None:
        (self if len(self) < self.most and len(word) <= LONGEST else self.over)[word] = ids


#: Bytes of texts whose words are looked up together, and whose ids are gathered together.
STRETCH, GATHERED = 4 << 20, 2 << 20
#: Words that are encoded as one text.
JOINED = 500


class Codec:
    """Encodes and decodes bytes of UTF-8 as the tokenizers library does its text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # words come once; a cache inside would only be filled
            self.tokenizer.model._resize_cache(0)
        self.bytes = token_bytes(self.tokenizer)
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.first, self.spaced = Cache(STARTS), Cache(WORDS)
        self.marks: dict[bytes, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.splits = not any(WITHIN.fullmatch(t.content.encode()) for t in added)  # an added token inside a word would be matched first
        #: Added tokens, and whether they match whatever stands beside them.
        self.added = [(t.content.encode(), not (t.lstrip or t.rstrip or t.single_word)) for t in added]
        self.joins = all(plain and not re.search(rb"\s", t) for t, plain in self.added)  # none can match across pieces that are joined

    def numbers(self, text: bytes) -> np.ndarray:
        """Ids of a text by the tokenizer, which needs no offsets here."""
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")

    def whole(self, text: bytes) -> bytes:
        return self.numbers(text).tobytes()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; exact, since words split where the pre-tokenizer must.

        Words that the caches lack are encoded all at once. A full cache stays;
        what it has no room for is kept until the next call.
        """
        self.spaced.over.clear()
        self.first.over.clear()
        look, head = self.spaced.get, self.first.get
        held, new = [], set()
        for text in texts:
            words = text.split(b" ")
            got = list(map(look, words))
            got[0] = head(words[0])
            if None in got:
                new.update([w for w, g in zip(words, got, strict=True) if g is None][got[0] is None :])
            held.append((words, got))
        odd = self.learned(new)
        out = []
        for text, (words, got) in zip(texts, held, strict=True):
            if None not in got:
                out.append(b"".join(got))
            elif len(words) > 1 and words[0] and open_ended(words[0]) or odd and not odd.isdisjoint(words[1:-1]):
                out.append(self.whole(text))
            else:
                if got[0] is None:
                    got[0] = head(words[0])
                    if got[0] is None:
                        got[0] = self.whole(words[0])
                        self.first.put(words[0], got[0])
                for i, g in enumerate(got):
                    if g is None:
                        got[i] = self.whole(b" " + words[i]) if words[i] in odd else self.spaced[words[i]]
                out.append(b"".join(got))
        return out

    def stretches(self, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch, each with the ids of its texts one after the other and how many each has; words are looked up once for STRETCH bytes of text."""
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for at, end in spans(starts, STRETCH):
            rows = batch.slice(at, end - at)
            for a, b, ids, counts in self.encode_column(rows.column(column)):
                yield rows.slice(a, b - a), ids, counts
            pa.default_memory_pool().release_unused()

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For texts ``a`` to ``b`` of a column, some after the other: a, b, their ids and how many each has; null is empty.

        As ``encode_many``, but texts are cut wherever the pre-tokenizer surely
        splits (between letters and marks and at ends of lines, too), Arrow finds
        the distinct pieces of all texts, only these are looked up, before this
        returns, and their ids are gathered by place.
        """
        data, codes, starts = texts_of(column)
        cuts = [(self.places(codes[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) + starts[a]).astype(np.int32) for a, b in spans(starts, GATHERED)]
        ends = np.concatenate([np.zeros(1, np.int32), *(c[1:] for c in cuts)])  # 32 bits do, since no text has more bytes
        del cuts
        found = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        known = self.looked_up(found.dictionary)
        places, of_texts = found.indices, np.searchsorted(ends, starts)

        def gathered() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for a, b in spans(starts, GATHERED):
                taken = known.take(places.slice(of_texts[a], of_texts[b] - of_texts[a]))
                reached = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
                ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")[: reached[-1]]
                yield a, b, ids, np.diff(reached[of_texts[a : b + 1] - of_texts[a]])

        return gathered()

    def places(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the texts in ``codes``, which begin at ``starts``, are cut: at their ends, and where the pre-tokenizer must split.

        What stands between two cuts has the same ids by itself.
        """
        kinds, last = kinds_of(codes), max(len(codes) - 1, 0)
        begins = np.zeros(len(codes) + 1, bool)
        begins[starts] = True
        cut = begins.copy()
        between = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(SURE), np.uint8)
        cut[1 : last + 1] = between == 1
        others = np.flatnonzero(between == 2)
        cut[others[~white_or_control(codes, others)] + 1] = True
        lines = np.flatnonzero(kinds == LINE)  # a cut comes after one that is the only white space there; a run of more is split before its last character
        lines = lines[cut[lines] & BLACK[codes[np.minimum(lines + 1, last)]]]
        cut[lines + 1] = True
        raw = codes.tobytes()
        for token, plain in self.added:
            i = raw.find(token)
            while i >= 0:
                a, b = i, i + len(token)
                if not plain:  # no cut in the whole text
                    a, b = starts[np.searchsorted(starts, a, "right") - 1], starts[np.searchsorted(starts[:-1], b, "left")]
                cut[a + 1 : b] = False
                i = raw.find(token, i + 1)
        return np.flatnonzero(cut | begins)

    def looked_up(self, pieces: pa.BinaryArray) -> pa.LargeBinaryArray:
        """Ids of distinct pieces that aren't empty. What the caches lack is encoded; pieces that end in white space aren't kept."""
        self.spaced.over.clear()
        self.first.over.clear()
        if not len(pieces):
            return pa.array([], pa.large_binary())
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        codes = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]]
        kinds = kinds_of(codes)
        spaces = kinds[ends[:-1]] == SPACE
        starts = ends[:-1] + spaces
        joins = (starts < ends[1:]) & SEEN[kinds[np.minimum(starts, len(codes) - 1)]] & SEEN[kinds[ends[1:] - 1]] & self.joins
        raw = codes.tobytes()
        keys = [raw[a:b] for a, b in zip(starts.tolist(), ends[1:].tolist(), strict=True)]
        look, head = self.spaced.get, self.first.get
        got = [look(key) if space else head(key) for key, space in zip(keys, spaces.tolist(), strict=True)]
        new = [i for i, ids in enumerate(got) if ids is None]
        after, others = [], []
        for i, space, join in zip(new, spaces[new].tolist(), joins[new].tolist(), strict=True):
            key = keys[i]
            if not join:
                own = b" " + key if space else key
                cache = self.spaced if space else self.first
                if open_ended(key):
                    cache.over[key] = self.whole(own)
                    continue
                if not self.joins or key.decode("utf-8", "replace")[0].isspace():
                    cache.put(key, self.whole(own))
                    continue
            (after if space else others).append(key)
        for at in range(0, len(after), JOINED):
            self.words(after[at : at + JOINED])
        self.lines(others)
        for i, space in zip(new, spaces[new].tolist(), strict=True):
            got[i] = (self.spaced if space else self.first)[keys[i]]
        return pa.array(got, pa.large_binary())

    def learned(self, new: set[bytes]) -> set[bytes]:
        """Encodes words that follow a space for the caches; gives back those that are empty or end in white space, which aren't kept."""
        odd = {w for w in new if open_ended(w)}
        missing, made = new - odd, {}
        if self.splits:
            for w in missing:
                m = SPLIT.fullmatch(w)
                if m and m.end(1) < len(w):
                    made[w] = m.groups()
            # looked up one by one: a set's difference from a subclass of dict goes through all of that
            missing = {w for w in missing if w not in made} | {m[0] for m in made.values() if m[0] not in self.spaced}
            self.lines(list({m[2] for m in made.values() if m[2] and m[2] not in self.first}))
        missing = list(missing)
        for at in range(0, len(missing), JOINED):
            self.words(missing[at : at + JOINED])
        for w, (letters, marks, more, last) in made.items():
            ids = self.spaced[letters] + self.mark(marks)
            self.spaced.put(w, ids + self.mark(b"\n") + self.first[more] + self.mark(last) if more else ids)
        return odd

    def mark(self, marks: bytes) -> bytes:
        """Ids of a run of marks, or of a line's end, which stands by itself."""
        if not marks:
            return b""
        if marks not in self.marks:
            if len(self.marks) > STARTS:
                self.marks.clear()
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]

    def divided(self, words: list[bytes], between: bytes) -> list[bytes] | None:
        """Ids of ``between`` and each word, from one text that joins them; none if they don't divide by their bytes."""
        ids = self.numbers(between + between.join(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        reached, wanted = np.cumsum(self.lengths[ids]), np.cumsum(lengths)
        ends = np.searchsorted(reached, wanted)
        if reached[-1] != wanted[-1] or (reached[ends] != wanted).any():
            return None
        raw, at = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def words(self, words: list[bytes]) -> None:
        """Encodes words after a space, joined to one text where that can't change them."""
        ids = None if UNSAFE.search(b" " + b" ".join(words) + b" ") else self.divided(words, b" ")
        for i, word in enumerate(words):
            self.spaced.put(word, ids[i] if ids else self.whole(b" " + word))

    def lines(self, words: list[bytes]) -> None:
        """Encodes words of letters that begin a line, joined by ends of lines, which are tokens of their own."""
        end = self.mark(b"\n")
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = self.divided(some, b"\n")
            for i, word in enumerate(some):
                self.first.put(word, ids[i][len(end) :] if ids and ids[i].startswith(end) else self.whole(word))

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text, special tokens included."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        out = b"".join(map(self.bytes.__getitem__, numbers))
        try:
            out.decode("utf-8")
            return out
        except UnicodeDecodeError:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode("utf-8")


def spans(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours of ``most`` bytes at most, or one that is longer, and all of about one size: where they begin and end, from where each begins and the last ends."""
    at, n = 0, len(starts) - 1
    while at < n:
        left = int(starts[-1] - starts[at])
        even = left // max(1, -(-left // most))
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + even, "right")) - 1)
        yield at, end
        at = end


#: Kinds of bytes: unknown, a space, other white space of ASCII, letters of Latin scripts, marks of ASCII other than the apostrophe, that, digits.
OTHER, SPACE, LINE, LETTER, MARK, QUOTE, DIGIT = range(7)


def _kind(byte: int) -> int:
    if byte >= 0x7F or byte < 9 or 13 < byte < 32:
        return OTHER
    c = chr(byte)
    return SPACE if c == " " else LINE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else MARK


KINDS = bytes(map(_kind, range(256)))
#: Kinds of characters that are no white space for sure.
SEEN = np.isin(np.arange(8), [LETTER, MARK, QUOTE, DIGIT])
_SPLITS = {LETTER: {SPACE, LINE, MARK, QUOTE, DIGIT}, MARK: {SPACE, LINE, LETTER, DIGIT}, DIGIT: {SPACE, LINE, LETTER, MARK, QUOTE}, QUOTE: {SPACE, LINE}}
#: Bytes with which no white space begins; bytes within characters, too.
BLACK = np.array([bool(SEEN[k]) or b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b, k in enumerate(KINDS)])
#: By the kinds of two neighbours, 8 times the first and the second: 1 if the pre-tokenizer splits between them whatever stands around, 2 if it does unless the first is white space.
SURE = bytes(2 if k in (8 * OTHER + SPACE, 8 * OTHER + LINE) else k % 8 in _SPLITS.get(k // 8, ()) for k in range(256))


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a Latin letter beyond ASCII are letters."""
    kinds = np.frombuffer(bytearray(codes).translate(KINDS), np.uint8)
    at = np.flatnonzero((codes >= 0xC3) & (codes <= 0xC9))
    at = at[at + 1 < len(codes)]
    lead, then = codes[at], codes[at + 1]
    at = at[(then & 0xC0 == 0x80) & ~((lead == 0xC3) & ((then == 0x97) | (then == 0xB7))) & ~((lead == 0xC9) & (then > 0x8F))]
    kinds[at] = kinds[at + 1] = LETTER
    return kinds


def white_or_control(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the characters of unknown kind whose last bytes stand at ``ends`` are of ASCII or white space."""
    last, second, third = codes[ends], codes[np.maximum(ends - 1, 0)], codes[np.maximum(ends - 2, 0)]
    white = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    white |= (third == 0xE1) & (second == 0x9A) & (last == 0x80) | (third == 0xE3) & (second == 0x80) & (last == 0x80)
    white |= (third == 0xE2) & ((second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)) | (second == 0x81) & (last == 0x9F))
    return white | (last < 0x80)


def token_bytes(tokenizer) -> list[bytes]:  # noqa: ANN001
    """The bytes of each id: the vocabulary writes a byte as a printable character, others as 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(odd)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode("utf-8")
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec; its word cache outlives a task, until ``forget``."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget() -> None:
    """Gives back the codecs of this worker, which outlives the stage that encoded; for tasks of operators that don't encode."""
    if _codecs:
        _codecs.clear()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)


#: A fixed pseudo-random number for each byte.
GEAR = np.frombuffer(hashlib.shake_128(b"content-defined chunks").digest(1024), dtype="<u4")


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last WINDOW bytes says to cut, about one in USUAL - LEAST bytes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero(h >> np.uint32(23) == 0) + 1


def chunks(data: memoryview, codes: np.ndarray, starts: np.ndarray) -> Iterator[list[int]]:
    """Of each text between two of ``starts``: where its chunks begin, and its end. Cuts fall between characters."""
    found = cut_candidates(codes).tolist() if len(codes) else []
    at, n = 0, len(found)
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        cuts = [begin]
        while at < n and found[at] <= begin:
            at += 1
        last = begin
        while True:
            while at < n and found[at] < last + LEAST:
                at += 1
            cut = min(found[at] if at < n else end, last + MOST)
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= end:
                break
            cuts.append(cut)
            last = cut
        cuts.append(end)
        yield cuts


def inside(chunk: bytes) -> tuple[int, int] | None:
    """Where a chunk's inside starts and ends: at its first and last safe place, if it has two."""
    if UNSAFE.search(chunk):
        return None
    a, b = chunk.find(b" ", 1), chunk.rfind(b" ")
    return (a, b) if 0 < a < b else None


def texts_of(column: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of a text column without a copy, as numbers too, and where each row starts; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return memoryview(b""), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = memoryview(raw)[starts[0] : starts[-1]] if raw is not None else memoryview(b"")
    return raw, np.frombuffer(raw, dtype=np.uint8), starts - starts[0]


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, which bound what is held beside it."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, n): hash of each chunk's inside and how often it occurs; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for part in parts(batch, 2048):
                data, codes, starts = texts_of(part.column(0))
                for cuts in chunks(data, codes, starts):
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        chunk = bytes(data[a:b])
                        if place := inside(chunk):
                            key = xxhash.xxh3_128_digest(chunk[place[0] : place[1]])
                            seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])

    return docs.select("text").mapInArrow(count, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, bytes]:
    """Hash and ids of the chunks that occur so often that no more than ``most`` can: each encoded once."""
    spark = docs.sparkSession
    counts = stored(chunk_counts(docs).filter("n > 1"), "chunk-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = max(2, -(-total // most))
    wanted = spark.sparkContext.broadcast({bytes(r[0]) for r in counts.filter(F.col("n") >= often).select("chunk").toLocalIterator()})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            for part in parts(batch, 2048):
                data, codes, starts = texts_of(part.column(0))
                for cuts in chunks(data, codes, starts):
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        chunk = bytes(data[a:b])
                        if place := inside(chunk):
                            body = chunk[place[0] : place[1]]
                            if (key := xxhash.xxh3_128_digest(body)) in wanted.value:
                                seen[key] = body
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["chunk", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = own.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    if not wanted.value:
        return {}
    once = docs.select("text").mapInArrow(pick, "chunk binary, body binary").groupBy("chunk").agg(F.first("body").alias("body"))
    return {bytes(r[0]): bytes(r[1]) for r in once.mapInArrow(encode, "chunk binary, ids binary").toLocalIterator()}


def encode_part(part: pa.Array, own: Codec, known: dict[bytes, bytes], cache: dict[bytes, bytes]) -> list[bytes]:
    """Ids of each text: insides of chunks looked up or encoded, joins repaired."""
    data, codes, starts = texts_of(part)
    plans, new = [], {}
    for cuts in chunks(data, codes, starts):
        plan, open_at = [], cuts[0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            chunk = bytes(data[a:b])
            if place := inside(chunk):
                body = chunk[place[0] : place[1]]
                key = xxhash.xxh3_128_digest(body)
                plan.append((bytes(data[open_at : a + place[0]]), key))
                open_at = a + place[1]
                if key not in known and key not in cache:
                    new[key] = body
        plan.append((bytes(data[open_at : cuts[-1]]), None))
        plans.append(plan)
    encoded = iter(own.encode_many([*new.values(), *(window for plan in plans for window, _ in plan)]))
    fresh = {key: next(encoded) for key in new}
    out = []
    for plan in plans:
        ids = []
        for _, key in plan:
            ids.append(next(encoded))
            if key is not None:
                ids.append(known.get(key) or fresh.get(key) or cache[key])
        out.append(b"".join(ids))
    if len(cache) > CHUNKS:
        cache.clear()
    cache.update(fresh)
    return out


def encode(docs: DataFrame, path: str | None = None, *, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (binary, little-endian unsigned 32-bit) and, if wanted, ``decoded`` text of each row.

    A null text is empty: no ids. Texts of any length are encoded whole, without
    truncation or padding. Repeated rows give repeated rows; an empty table
    gives an empty result; a special token's string in a text is that token.
    """
    path = path or tokenizer_path()
    known = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path))
    names = [*keep, "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = codec(path), {}
        for batch in batches:
            for part in parts(batch):
                ids = encode_part(part.column(len(keep)), own, known.value, cache)
                columns = [*part.columns[: len(keep)], pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, ids binary" + ", decoded string" * decoded)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the decoded text, for each document."""
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    out = encode(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
