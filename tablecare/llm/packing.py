"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents keep the order in which Spark reads them. Inside a partition their ids form one stream, and cuts between windows are chosen
among document ends, sentence ends and, where neither is near, any place. The cost of a set of cuts is the padding of all windows, plus
``sequence_cost`` per window, plus a truncation penalty per cut: 0 at a document end, ``sentence_cost`` at a sentence end, ``free_cost``
elsewhere. A window of a power of two is not padded. f(j) = penalty(j) + sequence_cost + min over i of f(i) + padding(p_j - p_i) is solved
with a monotone queue over f(i) + p_i (padding is window - length) and a lookup of the starts that give a power of two.

The stream is solved in stretches of about ``stretch`` ids; the last windows of a stretch are given back and solved again with the next
one, so memory doesn't grow with the partition. Only the end of a partition is cut at any place, into powers of two.

There is no shuffle: a partition is packed where it is read, so a hot source or id changes nothing. Null and empty texts consist of the
end id alone. A null id is passed on. Repeated rows are packed as often as they occur. A document of any length is tokenized whole and lies
in as many pieces as it needs. An empty table gives no pieces. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import modest_batches, release_memory

CACHE_PARTS, CACHE_WORDS = 50_000, 100_000
TEXT_CHARS = 1 << 20  # looked up at a time, if no text is longer
SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_LINES = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-zß-öø-ÿ0-9]+")
_loaded: dict[str, Words] = {}


class Words:
    """Ids of texts by one tokenizer file, as little-endian 32-bit bytes.

    The vocabulary of this kind never joins what white space parts, so the ids of a text are those of its parts. Parts, and the words in
    parts of Latin letters, are remembered; everything else goes to the tokenizer as it is. The memory has a fixed size: once it is full, the
    words seen first stay, as frequent ones come early, and of the parts the first half; a half full memory takes only parts that are repeated.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"\n": b""}
        fine = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(b) for b in fine} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in fine)}
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.sentence_end[i] = piece.endswith((".</w>", "!</w>", "?</w>"))

    def forget(self) -> None:
        self.parts.clear()
        self.parts[""] = b""
        self.words.clear()
        self.words["\n"] = b""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            raw = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            got = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
            if len(self.words) < CACHE_WORDS:
                self.words[word] = got
        return got

    def look_up(self, parts: list[str]) -> list[bytes]:
        """The ids of each part; the words of all of them are found by one search."""
        lines = "\n".join(parts)
        if not _PLAIN_LINES.fullmatch(lines):
            strange = {p for p in parts if not _PLAIN.fullmatch(p)}
            plain = iter(self.look_up([p for p in parts if p not in strange]))
            return [self.whole(p) if p in strange else next(plain) for p in parts]
        tokens = _TOKEN.findall(lines.lower())
        got = list(map(self.words.get, tokens))
        for k in [k for k, x in enumerate(got) if x is None]:
            got[k] = self.word(tokens[k])
        ids, stops = b"".join(got), list(accumulate(map(len, got)))
        ends = [stops[k] for k, t in enumerate(tokens) if t == "\n"] + stops[-1:]
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Distinct parts are looked up once for all texts, and the ids are gathered by numpy."""
        odd = {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        lines = ["" if i in odd else (text.lower() if text.isascii() or _PLAIN_LINES.fullmatch(text) else text).replace("\n", " ") for i, text in enumerate(texts)]
        split = pc.split_pattern(pa.array(lines), " ")
        coded = split.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.parts) > CACHE_PARTS:
            self.parts = dict(islice(self.parts.items(), CACHE_PARTS // 2))
        found = list(map(self.parts.get, names))
        new, often = [i for i, x in enumerate(found) if x is None], (np.bincount(code, minlength=len(names)) > 1).tolist()
        for i, got in zip(new, self.look_up([names[i] for i in new])):
            found[i] = got
            if often[i] or len(self.parts) < CACHE_PARTS // 2:
                self.parts[names[i]] = got
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        n = sizes[code]
        stops = np.append(np.int32(0), np.cumsum(n, dtype=np.int32))
        # The place of each id in the ids of the distinct parts.
        places = np.arange(stops[-1], dtype=np.int32)
        places += np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[code] - stops[:-1], n)
        ids = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
        bounds = (4 * stops[split.offsets.to_numpy()].astype(np.int64)).tolist()
        return [self.whole(text) if i in odd else ids[a:b] for i, (text, a, b) in enumerate(zip(texts, bounds, bounds[1:]))]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


def words_of(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
        release_memory()  # what reading the file took
    return _loaded[path]


def groups(batch: pa.RecordBatch):
    """The batch's keys and texts (null: empty), about TEXT_CHARS characters at a time."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        keys.append(key.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= TEXT_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def cuts(places: np.ndarray, penalty: np.ndarray, window: int, sequence_cost: float) -> list[int]:
    """Best cut places. ``places`` rise from 0, and two neighbours are at most ``window`` apart; the last place is always cut."""
    m = len(places)
    at = np.full(int(places[-1]) + 1, -1, np.int32)
    at[places] = np.arange(m)
    ends, starts, size = [], [], 1
    while size <= window:  # windows of a power of two need no padding
        j = np.flatnonzero(places >= size)
        i = at[places[j] - size]
        ends.append(j[i >= 0])
        starts.append(i[i >= 0])
        size *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    whole_end, whole_start = [*np.concatenate(ends)[order].tolist(), m], np.concatenate(starts)[order].tolist()
    p, cost = places.tolist(), (penalty + sequence_cost).tolist()
    best, back, k = [0.0] * m, [0] * m, 0
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(i) + p_i rising, p_i, i
    push, drop, shift = queue.append, queue.pop, queue.popleft
    for j in range(1, m):
        here = p[j]
        while queue[0][1] < here - window:
            shift()
        low, _, i = queue[0]
        low += window - here
        while whole_end[k] == j:
            start = whole_start[k]
            if best[start] < low:
                low, i = best[start], start
            k += 1
        low += cost[j]
        best[j], back[j] = low, i
        low += here
        while queue and queue[-1][0] >= low:
            drop()
        push((low, here, j))
    out, j = [], m - 1
    while j > 0:
        out.append(p[j])
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int, sentence_cost: float, free_cost: float, last: bool):
    """Places at which the stream may be cut, with their penalties."""
    n, costs = len(ids), np.array([np.inf, 0, sentence_cost, free_cost])
    kind = np.zeros(n + 1, np.uint8)
    if last:
        kind[max(1, n - 2 * window) :] = 3
    kind[1:][sentence_end[ids] if n and ids.max() < len(sentence_end) else [i < len(sentence_end) and sentence_end[i] for i in ids]] = 2
    kind[ends] = 1
    kind[0] = kind[n] = 1
    places = np.flatnonzero(kind)
    wide = np.flatnonzero(np.diff(places) > window // 2)
    if len(wide):
        step = max(1, window // 16)
        kind[np.concatenate([np.arange(places[w] + step, places[w + 1], step) for w in wide])] = 3
        places = np.flatnonzero(kind)
    return places, costs[kind[places]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, end_id: int = 2, window: int = 4096,
         sequence_cost: float = 48.0, sentence_cost: float = 4.0, free_cost: float = 24.0, stretch: int = 1 << 19) -> DataFrame:
    """One row per piece: id_col, start and length in the document's ids, doc_tokens, sequence_id, offset there, ids (little-endian)."""
    if window < 1:
        raise ValueError("window must be at least 1")
    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[0].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = words_of(tokenizer)
        first = (TaskContext.get().partitionId()) << 36
        # Pieces not yet placed: document id, ids before it, its number of ids, bytes.
        waiting: list[tuple[object, int, int, bytes]] = []
        held = 0

        def settle(last: bool):
            nonlocal first, waiting, held
            stream = np.frombuffer(b"".join(x[3] for x in waiting), "<u4")
            ends = np.cumsum([len(x[3]) // 4 for x in waiting])
            chosen = cuts(*candidates(stream, ends, words.sentence_end, window, sentence_cost, free_cost, last), window, sequence_cost)
            if not last:
                chosen = chosen[:-2]
            bounds = np.array([0, *chosen])
            begin = np.unique(np.concatenate([[0], ends[:-1], bounds]))
            begin = begin[begin < bounds[-1]]
            stop = np.append(begin[1:], bounds[-1])
            owner = np.searchsorted(ends, begin, "right")
            inside = begin - (ends[owner] - np.array([len(x[3]) // 4 for x in waiting])[owner])
            sequence = np.searchsorted(bounds, begin, "right") - 1
            rows = [waiting[o] for o in owner]
            out = pa.record_batch([
                pa.array([x[0] for x in rows], batch_type), pa.array([x[1] + int(s) for x, s in zip(rows, inside)], pa.int64()), pa.array(stop - begin, pa.int64()),
                pa.array([x[2] for x in rows], pa.int64()), pa.array(first + sequence, pa.int64()), pa.array(begin - bounds[sequence], pa.int64()),
                pa.array([x[3][4 * int(s) : 4 * int(s + k)] for x, s, k in zip(rows, inside, stop - begin)], pa.binary())], names=names)
            first += len(chosen)
            at = int(np.searchsorted(ends, bounds[-1], "right"))
            rest = waiting[at:]
            if rest:
                done = int(bounds[-1] - (ends[at] - len(rest[0][3]) // 4))
                rest[0] = (rest[0][0], rest[0][1] + done, rest[0][2], rest[0][3][4 * done :])
            waiting, held = rest, int(len(stream) - bounds[-1])
            return out

        names, batch_type = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"], None
        for batch in batches:
            batch_type = batch.schema.field(0).type
            for keys, texts in groups(batch):
                for key, ids in zip(keys, words.many(texts)):
                    ids += end
                    waiting.append((key, 0, len(ids) // 4, ids))
                    held += len(ids) // 4
                    if held >= stretch + 4 * window:
                        yield settle(False)
        if waiting:
            yield settle(True)
        words.forget()
        release_memory()

    modest_batches(docs.sparkSession)
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def padding(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """sequences, tokens, padded: how full the windows are (a power of two is not padded)."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    short = F.when(F.expr("(size & (size - 1)) = 0"), 0).otherwise(window - F.col("size"))
    return sizes.agg(F.count("*").alias("sequences"), F.sum("size").alias("tokens"), F.sum(short).alias("padded"))
