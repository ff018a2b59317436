"""Problem 6: byte-level BPE of a whole corpus.

1. *Words.* Batches of texts are cut into words (the tokenizer's pattern, on code points, without a loop over texts) and
   dictionary-encoded by Arrow: every block of about ``BLOCK_BYTES`` becomes numbers into its own word list.
2. *Ids.* The distinct words of the corpus are encoded once each by Spark higher-order functions: an ``aggregate`` folds
   the ranked merges over the word's tokens, starting from its bytes, with the rank of a pair looked up in a literal
   rank map (a flat hash table of fixed size, since Spark scans a map literal key by key).
3. *Texts.* The ids of a block's words return to the block by a join on the word and a shuffle by block; numbers are
   replaced by ids with one gather.

Words repeat, so steps 2 and 3 move little beside the numbers themselves. Nothing that grows with the texts is broadcast
or collected. A text of more than a block is cut where a word surely begins into rows of blocks apart from the others, so
a task holds no more of it than a block beside the text as it was read; its parts come together at the end.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

BLOCK_BYTES = 4 << 20
#: Longer words would make the fold quadratic; they take the same merges from a heap.
FOLD_BYTES = 256

_L, _N, _S, _O = 1, 2, 3, 4
#: Unicode White_Space (fixed values).
_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a word of its own (fixed values).
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": _L, "N": _N}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACE] = _S
    return out


def word_starts(chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words begin in concatenated texts of code points: a mask as long as ``chars``.

    The pattern is that of byte_bpe_50k: a contraction; letters, numbers or others with one space before; white space,
    of which the last character goes to the next word if it is a space, else stands alone.
    """
    n = len(chars)
    cls = _classes()[chars]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= cls[1:] != cls[:-1]
    space = cls == _S
    last = space.copy()  # white space before a character of the same text that is none
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    begin |= last
    joins = np.flatnonzero(last & (chars == 32)) + 1
    begin[joins] = False
    # an apostrophe at the start of a word, alone in its run, before letters
    quote = np.flatnonzero(begin & (chars == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == _L) & ~first[quote + 1]]
    for tail in _CONTRACTIONS:
        at = quote[quote + len(tail) < n]
        for k, ch in enumerate(tail, 1):
            at = at[(chars[at + k] == ord(ch)) & ~first[at + k]]
        begin[at + 1] = False
        ends = at + 1 + len(tail)
        begin[ends[ends < n]] = True
    return begin


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where each text's words begin (``len(texts) + 1`` offsets). Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte of each character
    text_starts = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(raw)])
    starts = at[word_starts(chars, text_starts)]
    buffer = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(starts), buffer, pa.py_buffer(raw)), np.searchsorted(starts, offsets)


def sure_starts(chars: np.ndarray) -> np.ndarray:
    """Places of a run of code points where a word begins whatever stands before the run and after it: the class changes
    there, but not from white space, which may join what follows, and not behind an apostrophe, which may be a contraction.
    """
    cls = _classes()[chars]
    return np.flatnonzero((cls[1:] != cls[:-1]) & (cls[:-1] != _S) & ~((chars[:-1] == 39) & (cls[1:] == _L))) + 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sections(text: str, size: int):
    """A long text in parts of about ``size`` characters that each begin with a word of the text."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            sure = sure_starts(code_points(text[end : end + size]))
            if len(sure):
                end += int(sure[0])
                break
            end += size - 1  # a change at the window's first character counts in the next one
        yield text[at : min(end, len(text))]
        at = end


def _blocks(batches, text: str):
    """The rows in pieces of about ``BLOCK_BYTES`` of text each, and a row of more bytes alone."""
    for b in batches:
        size = pc.binary_length(b.column(text).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


class Words:
    """Texts as numbers into the word lists of blocks, written once to the shared folder.

    Blocks ``apart`` hold parts of long texts: parts of texts above ``BLOCK_BYTES``, with the number of their text (``whole``)
    and of the part (``part``), and rows that ``docs`` itself marks in a column ``apart``.
    """

    def __init__(self, docs: DataFrame, keys: list[str], text: str = "text"):
        self.keys = keys
        fields = [f for f in docs.select(*keys).schema.fields]
        names = ["block", "apart", "whole", "part", *keys, "idx", "words"]
        marked = "apart" in docs.columns

        def run(batches):
            task, number, wholes = TaskContext.get().partitionId(), 0, 0

            def block(texts, own, apart, whole, part):
                nonlocal number
                flat, at = words_of(texts)
                coded = flat.dictionary_encode()
                idx = coded.indices.to_numpy().astype("<i4")
                name, n = (task << 32) | number, len(texts)
                number += 1
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(idx)]) if len(flat) else pa.array([b""] * n, pa.binary())
                none = pa.nulls(n, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, apart)), pa.array([whole] * n, pa.int64()), pa.array([part] * n, pa.int32()), *own, data, none], names)
                words = pa.array([coded.dictionary.cast(pa.string()).to_pylist()], pa.list_(pa.string()))
                nulls = [pa.nulls(1, k.type) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([apart]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *nulls, pa.nulls(1, pa.binary()), words], names)

            for b in _blocks(batches, text):
                own, apart = [b.column(k) for k in keys], marked and b.column("apart")[0].as_py()
                if b.num_rows == 1 and not apart and (long := b.column(text)[0].as_py()) is not None and len(long) > BLOCK_BYTES // 4 and len(long.encode()) > BLOCK_BYTES:
                    for part, one in enumerate(_sections(long, BLOCK_BYTES // 4)):
                        yield from block(pa.array([one], pa.large_string()), own, True, (task << 32) | wholes, part)
                    wholes += 1
                else:
                    yield from block(b.column(text), own, bool(apart), None, None)

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        both = docs.select(*keys, text, *["apart"][: int(marked)])
        with small_batches(docs.sparkSession):
            self.rows = written(both.mapInArrow(run, f"block long, apart boolean, whole long, part int, {own}, idx binary, words array<string>"))
        blocks = {r["apart"]: r["n"] for r in self.rows.groupBy("apart").agg(F.count_distinct("block").alias("n")).collect()}
        self.blocks = {apart: blocks.get(apart, 0) for apart in (False, True)}

    def of(self, apart: bool) -> tuple[DataFrame, DataFrame]:
        """``(block, whole, part, keys, idx)`` of the rows and ``(block, words)`` of the lists."""
        own = self.rows.where("apart" if apart else "not apart")
        return own.where("words is null").select("block", "whole", "part", *self.keys, "idx"), own.where("words is not null").select("block", "words")


# --- the rank map ---------------------------------------------------------------------------------------------------


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks (which are the ids) of the tokens of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def merges(path: str) -> dict[tuple[int, int], int]:
    """``(left id, right id) -> id``: the one merge that makes each token, found by encoding it with the earlier ones."""
    ranks, out = vocabulary(path), {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((out.get(p, rank), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        if len(parts) == 2:
            out[parts[0], parts[1]] = rank
    return out


_BITS = 17
_SPAN = 1 << _BITS  # ids stay below it


@functools.cache
def rank_table(path: str) -> tuple[np.ndarray, int]:
    """Two halves of a cuckoo table of ``m`` slots each: a slot holds ``pair * _SPAN + id``, or -1.

    A pair is ``left << _BITS | right``; it lies in slot ``pair % m`` of the first half or in slot
    ``(pair ^ pair >> 9) % m`` of the second.
    """
    pairs = merges(path)
    if max(vocabulary(path).values()) >= _SPAN:
        raise ValueError(f"ids of {_SPAN} and more do not fit the rank table")
    m = 2 * len(pairs) + 1001
    while True:
        slots, ok = np.full(2 * m, -1, np.int64), True
        for (a, b), rank in pairs.items():
            pair, entry = a * _SPAN + b, (a * _SPAN + b) * _SPAN + rank
            at = pair % m
            for _ in range(200):
                entry, slots[at] = slots[at], entry
                if entry < 0:
                    break
                entry = int(entry)
                pair = entry // _SPAN
                at = m + (pair ^ pair >> 9) % m if at < m else pair % m
            else:
                ok = False
                break
        if ok:
            return slots, m
        m = m * 3 // 2 + 1


def _let(value: Column, fn) -> Column:
    """``fn`` of ``value`` evaluated once."""
    return F.transform(F.array(value), fn)[0]


def _literal(spark: SparkSession, numbers: np.ndarray) -> Column:
    """A literal array of long integers, passed to the JVM as one block of bytes."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = spark.sparkContext._jvm
    values = spark.sparkContext._gateway.new_array(jvm.long, len(numbers))
    data = jvm.java.nio.ByteBuffer.wrap(bytearray(numbers.astype(">i8").tobytes()))
    data.asLongBuffer().get(values)
    return ClassicColumn(getattr(jvm, "org.apache.spark.sql.functions").lit(values))


def _fold(word: Column, slots: Column, m: int, of_byte: Column) -> Column:
    """The ids of a word of at least one byte: its bytes' ids, then the best-ranked pair joined again and again."""

    def hit(entry: Column, pair: Column, otherwise: Column | None = None) -> Column:
        found = F.when(F.shiftright(entry, _BITS) == pair, entry.bitwiseAND(F.lit(_SPAN - 1)))
        return found if otherwise is None else found.otherwise(otherwise)

    def rank(pair: Column) -> Column:
        second = _let(F.get(slots, (F.lit(m) + pair.bitwiseXOR(F.shiftright(pair, 9)) % m).cast("int")), lambda e: hit(e, pair))
        return _let(F.get(slots, (pair % m).cast("int")), lambda e: hit(e, pair, second))

    def ranks(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: _let(F.shiftleft(F.get(ids, i), _BITS).bitwiseOR(F.get(ids, i + 1)), rank))

    def join(ids: Column, best: Column, at: Column) -> Column:
        joined = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids)))
        return F.struct(joined.alias("ids"), (F.size(joined) > 1).alias("more"))

    def step(state: Column, _: Column) -> Column:
        ids = state["ids"]
        stay = F.struct(ids.alias("ids"), F.lit(False).alias("more"))
        pairs = lambda r: _let(F.array_min(r), lambda best: F.when(best.isNull(), stay).otherwise(join(ids, best, F.array_position(r, best).cast("int"))))
        return F.when(state["more"], _let(ranks(ids), pairs)).otherwise(state)

    chars = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    first = F.transform(chars, lambda c: F.get(of_byte, F.ascii(c)))
    n = F.octet_length(word)
    start = F.struct(first.alias("ids"), (n > 1).alias("more"))
    ids = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: s["ids"])
    return F.when(n > 0, F.transform(ids, lambda i: i.cast("int"))).otherwise(F.array().cast("array<int>"))


def heap_ids(word: bytes, pairs: dict[tuple[int, int], int], first: list[int]) -> list[int]:
    """The same merges for a long word: a heap of pairs over a linked list, n log n."""
    import heapq

    ids = [first[b] for b in word]
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j] = rank, -1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (ids[a], ids[b]) in pairs:
                heapq.heappush(heap, (pairs[ids[a], ids[b]], a))
    return [i for i in ids if i >= 0]


def encode_words(words: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """``word, ids`` for a table of distinct words (strings). An empty word has no ids; null words drop out."""
    spark = words.sparkSession
    slots, m = rank_table(path)
    first = [vocabulary(path)[bytes([i])] for i in range(256)]
    literal = _literal(spark, slots)
    of_byte = F.array(*[F.lit(i).cast("long") for i in first])
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = words.where("word is not null").repartition(tasks, "word")
    short = words.where(F.octet_length("word") <= FOLD_BYTES).select("word", _fold(F.col("word"), literal, m, of_byte).alias("ids"))
    sent = spark.sparkContext.broadcast((merges(path), first))  # a vocabulary has a fixed size; executors need no file

    def long(batches):
        for b in batches:
            ids = [heap_ids(w.encode("utf-8", "surrogatepass"), *sent.value) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return short.unionByName(words.where(F.octet_length("word") > FOLD_BYTES).mapInArrow(long, "word string, ids array<int>"))


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + len]`` one after the other."""
    ends = np.cumsum(lens)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]


#: Blocks of one task on average, about 4 MB of text; where blocks fall by their hash some tasks get several.
TASK_BLOCKS = 1


def resolve(index: Words, apart: bool, path: str, what: Column, fn, schema: str) -> DataFrame:
    """``fn(rows of a block, what of its words in order)`` over all blocks, where ``what`` is made of ``word`` and ``ids``.

    The tasks follow the number of blocks. A word has one row in each block that has it, however often it occurs; the most
    frequent ones have one in all blocks, which an adaptive join splits.
    """
    docs, words = index.of(apart)
    blocks = index.blocks[apart]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(least, 2 * blocks), -(-blocks // TASK_BLOCKS))
    spread = words.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    known = encode_words(spread.select("word").distinct(), path, max(least, tasks)).select("word", what.alias("what"))
    spread = spread.join(known, "word").select("of", "at", "what")

    def block(rows, parts):
        return fn(rows, parts.take(pc.sort_indices(parts.column("at"))).column("what").combine_chunks())

    return docs.repartition(tasks, "block").groupBy("block").cogroup(spread.repartition(tasks, "of").groupBy("of")).applyInArrow(block, schema)


def _numbers(idx) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and the offsets of its rows."""
    idx = idx.combine_chunks() if isinstance(idx, pa.ChunkedArray) else idx
    at = np.append(0, np.cumsum(pc.binary_length(idx).to_numpy(zero_copy_only=False) // 4)).astype(np.int64)
    return np.frombuffer(b"".join(idx.to_pylist()), "<i4"), at


def _of_texts(docs: DataFrame, path: str, key: str, text: str, name: str, kind: str, what: Column, fn, joined: Column) -> DataFrame:
    """``key, name`` of every row, ``fn`` giving the values of a block's rows; ``joined`` makes one of a text's parts."""
    index = Words(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), ["_key"], "_text")
    own = docs.schema[key].dataType.simpleString()

    def values(rows, parts):
        columns = [rows.column(c).combine_chunks() for c in ("whole", "part", "_key")]
        return pa.table([*columns, fn(*_numbers(rows.column("idx")), parts)], names=["whole", "part", "_key", "_value"])

    made = lambda apart: resolve(index, apart, path, what, values, f"whole long, part int, _key {own}, _value {kind}")
    out = made(False).select(F.col("_key").alias(key), F.col("_value").alias(name))
    if index.blocks[True]:
        parts = F.array_sort(F.collect_list(F.struct("part", "_value")))
        long = made(True).groupBy("whole").agg(F.first("_key").alias(key), parts.alias("_parts"))
        out = out.unionByName(long.select(key, joined.alias(name)))
    return out


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: every row's text as token ids of the vocabulary at ``path``, without special tokens.

    A null and an empty text have an empty list; blank texts, strings that look like special tokens and control
    characters are ordinary text. Rows of equal keys stay separate rows; other columns may have any name.
    """

    def ids(numbers, at, parts):
        lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten().to_numpy(zero_copy_only=False)
        own = lens[numbers] if len(numbers) else np.zeros(0, np.int64)
        starts = (np.cumsum(lens) - lens)[numbers] if len(numbers) else own
        ends = np.append(0, np.cumsum(own))[at]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_gather(flat, starts, own).astype(np.int32)))

    return _of_texts(docs, path, key, text, "ids", "array<int>", F.col("ids"), ids, F.flatten(F.col("_parts._value")))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens``: the length of what ``encode`` gives, without moving the ids."""

    def count(numbers, at, parts):
        lens = parts.to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.append(0, np.cumsum(lens[numbers] if len(numbers) else np.zeros(0, np.int64)))
        return pa.array(upto[at[1:]] - upto[at[:-1]])

    total = F.aggregate(F.col("_parts._value"), F.lit(0).cast("long"), lambda s, n: s + n)
    return _of_texts(docs, path, key, text, "n_tokens", "long", F.size("ids"), count, total)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> Column:
    """A binary column: the pieces of the ids, concatenated. A null list gives null, an empty one no bytes."""
    spark: SparkSession = rows.sparkSession
    ranks = vocabulary(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = spark.sparkContext._jvm
    values = jvm.java.util.regex.Pattern.compile(",").split(",".join(p.hex() for p in pieces) + ",")
    literal = ClassicColumn(getattr(jvm, "org.apache.spark.sql.functions").lit(values))
    return F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(literal, i)), ""))
