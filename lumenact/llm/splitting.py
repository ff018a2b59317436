"""Problem 8: cutting long texts into overlapping pieces at natural boundaries.

Texts of at most ``SECTION`` bytes are numbered word by word (see ``bytebpe``) and cut by the task that has their block. Longer
ones are read as byte ranges: every range is a slice of the text with a halo on both sides, sent to a task of its own, which
finds in the halos where its section begins and ends: at a cue, else at a line, else at white space, else where a word surely
begins. The neighbour sees the same bytes and finds the same places, so sections fit without anyone having seen the whole.
A piece ends where its section ends; the next section brings a little text from before it, for the repeated part of its first
piece. The sections' lengths and numbers of pieces, summed up before each, give the offsets and numbers in the text.

Cues and lines are seen in the words: a word is a number, a colon, an arrow and so on, and a cue begins at the line of a time
stamp with its arrow, or at the number before it. Pieces are written from the words, so no text is read again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import Words, _gather, _let, _numbers, code_points, resolve, sure_starts, vocabulary
from .common import written

SECTION = 1 << 20
#: Bytes before a section that may hold the repeated part of its first piece, and those looked at for a cue's number.
BEFORE, LOOK = 1024, 512
WORD, LINE, CUE = 1, 2, 3
#: Numbers of words, in bytes, that are cut at a time.
WORDS_BYTES = 1 << 20
#: A cue of a long text: its number, if it has one, and its times, or a frame pair; returns are line feeds here.
_CUE = re.compile(rb"^(?:\d{1,18}[ \t]{0,32}\n\n?[ \t]{0,32}(?:\d{1,6}:)?|(?:\d{1,6}:)?)\d{1,2}:\d{2}[,.:]\d{1,3}[ \t]{0,32}-->|^\{\d{1,18}\}\{\d{1,18}\}", re.MULTILINE)
_LINE = re.compile(rb"[\r\n](?=[\x21-\xff])")
_WHITE = r"^[\s\u0085   -     　]"
#: Parts a word plays in a cue.
_NUMBER, _COLON, _POINT, _ARROW, _BRACES, _BRACE = 1, 2, 3, 4, 5, 6


# --- sections of long texts ------------------------------------------------------------------------------------------


def _on_character(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _white(char: str) -> bool:
    return re.match(_WHITE, char) is not None


def _edge(data: bytes, at: int, halo: int) -> tuple[int, int, bool]:
    """Where the section at the range end ``at`` ends, the kind of place, and whether it is inside a word: none of the ``halo``
    bytes from there on has a place where a word surely begins."""
    if at >= len(data):
        return len(data), 0, False
    window = data[max(0, at - LOOK) : at + halo].replace(b"\r", b"\n")
    skipped = at - max(0, at - LOOK)
    for m in _CUE.finditer(window):
        if m.start() >= skipped and window[m.start() - 1 : m.start()] == b"\n":
            return at + m.start() - skipped, CUE, False
    for m in _LINE.finditer(data, at, at + halo):
        end = _on_character(data, m.end() + 1)
        if end <= at + halo and not _white(data[m.end() : end].decode("utf-8", "replace")):
            return m.end(), LINE, False
    start = _on_character(data, at)
    text = data[start : at + halo].decode("utf-8", "ignore")
    sure = sure_starts(code_points(text))
    if len(sure):
        white = next((i for i in sure.tolist() if _white(text[i])), None)
        i = int(sure[0]) if white is None else white
        return start + len(text[:i].encode()), 0 if white is None else WORD, False
    if at + halo >= len(data):
        return len(data), 0, False
    return start, 0, True


def _section(data: bytes, begin: int, last: bool, size: int, halo: int) -> tuple[bytes, int, int, int] | None:
    """``(text, characters before the section, end kind, inside)`` of the section of a slice ``data`` whose range starts at
    ``begin``; ``inside`` is 1 if it begins within a word, 2 if it ends in one, 3 if both. None if it is empty."""
    start, _, hard = _edge(data, begin, halo) if begin else (0, 0, False)
    end, kind, cut = (len(data), 0, False) if last else _edge(data, begin + size, halo)
    if start >= end:
        return None
    before = start
    if begin and not hard:
        low = _on_character(data, max(0, start - BEFORE))
        text = data[low:start].decode("utf-8", "ignore")
        sure = sure_starts(code_points(text))
        if len(sure):
            before = low + len(text[: int(sure[0])].encode())
    return data[before:end], len(data[before:start].decode("utf-8", "replace")), kind, int(hard) + 2 * int(cut)


_SECTION = "doc_id long, section int, before int, end_kind int, inside int, apart boolean, text string"


def sections(docs: DataFrame, at_least: int, size: int, halo: int) -> DataFrame:
    """``doc_id, section, before, end_kind, inside, apart, text``: texts of more than ``at_least`` bytes; those of more than
    ``size`` bytes (``apart``) in sections of about that size.

    ``before`` is the number of characters of ``text`` that belong to the section before. Rows without ``doc_id`` drop out.
    """
    rows = docs.select("doc_id", "text").where((F.octet_length("text") > at_least) & F.col("doc_id").isNotNull())
    zero = F.lit(0)
    short = rows.where(F.octet_length("text") <= size).select("doc_id", zero.alias("section"), zero.alias("before"), zero.alias("end_kind"), zero.alias("inside"), F.lit(False).alias("apart"), "text")

    back = LOOK + BEFORE + 8

    def slices(raw):
        piece = lambda k: F.struct(k.alias("section"), F.substring(raw, F.greatest(k * size - back, zero) + 1, F.least(k * size, F.lit(back)) + size + halo + 8).alias("data"))
        return F.transform(F.sequence(zero, F.ceil(F.octet_length(raw) / size).cast("int") - 1), piece)

    long = rows.where(F.octet_length("text") > size).select("doc_id", F.octet_length("text").alias("n"), F.explode(_let(F.col("text").cast("binary"), slices)).alias("s"))
    long = long.select("doc_id", F.col("s.section").alias("section"), (F.ceil(F.col("n") / size) - 1 == F.col("s.section")).alias("last"), F.col("s.data").alias("data")).hint("rebalance")

    def cut(batches):
        for b in batches:
            for doc, k, last, data in zip(*[b.column(c).to_pylist() for c in ("doc_id", "section", "last", "data")], strict=True):
                if found := _section(data, min(k * size, back), last, size, halo):
                    text, before, kind, inside = found
                    own = [doc, k, before, kind, inside, True, text.decode("utf-8", "replace")]
                    kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(own, kinds, strict=True)], ["doc_id", "section", "before", "end_kind", "inside", "apart", "text"])

    return short.unionByName(long.mapInArrow(cut, _SECTION))


# --- boundaries and pieces ---------------------------------------------------------------------------------------------


def _inner(limit: int) -> int:
    """A word of more tokens than a piece may have is cut every so many characters, of at most four bytes each."""
    return limit // 8


def choose(tokens: np.ndarray, kind: np.ndarray, limit: int, overlap: int, done: int = 0, end_kind: int = 0) -> list[tuple[int, int, int]]:
    """``(first, last, kind of the cut)`` of the pieces of a text, as indices into its boundaries.

    The first boundary is the text's start and the last its end; ``tokens`` counts the tokens before a boundary. A piece ends
    at the last cue it can reach, else line end, else word end, else between tokens; the next begins at the first boundary of
    the best kind within ``overlap`` tokens before that end. What comes before the boundary ``done`` may be repeated only.
    """
    n = len(tokens)
    places = [np.flatnonzero(kind >= k).tolist() for k in (CUE, LINE, WORD)]
    tokens, kind = tokens.tolist(), kind.tolist()

    def best(end: int) -> int:
        for own in places:
            i = bisect_right(own, end) - 1
            if i >= 0 and own[i] > done:
                return own[i]
        return end if end > done else -1

    def repeated(cut: int, after: int) -> int:
        low = max(bisect_left(tokens, tokens[cut] - overlap, 0, cut), after)
        near = kind[low:cut]
        return low + near.index(most) if near and (most := max(near)) >= WORD else cut

    out, first = [], repeated(done, 0) if done else 0
    while tokens[-1] - tokens[first] > limit:
        cut = best(bisect_right(tokens, tokens[first] + limit, first) - 1)
        if cut < 0:  # with the repeated part the next unit does not fit: begin without it
            first = done
            if tokens[-1] - tokens[first] <= limit:
                break
            cut = best(bisect_right(tokens, tokens[first] + limit, first) - 1)
            cut = cut if cut >= 0 else done + 1
        out.append((first, cut, kind[cut]))
        first, done = repeated(cut, first + 1), cut
    if done < n - 1:
        out.append((first, n - 1, end_kind))
    return out


def _cues(kind: np.ndarray, role: np.ndarray, blank: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The words that begin a cue: those that begin the line of a time stamp with an arrow, or the number line before it, or
    the line of a pair of frames. ``text`` is the text of each word."""
    n, index = len(kind), np.arange(len(kind))
    begins = kind >= LINE
    line = np.maximum.accumulate(np.where(begins, index, 0))  # the first word of a word's line
    arrow = np.flatnonzero(role == _ARROW)
    start = line[arrow]
    long = arrow - start
    arrow, start = arrow[(long == 5) | (long == 7)], start[(long == 5) | (long == 7)]
    ok = (role[start] == _NUMBER) & (role[start + 1] == _COLON) & (role[start + 2] == _NUMBER) & (role[arrow - 1] == _NUMBER)
    ok &= (role[arrow - 2] == _POINT) | (role[arrow - 2] == _COLON)
    start = start[ok]
    before = np.append(0, np.maximum.accumulate(np.where(~blank, index, 0))[:-1])[start]  # the last word that is not blank
    numbered = (start - before <= 3) & (role[before] == _NUMBER) & begins[before] & (text[before] == text[start]) & (before < start)
    braces = np.flatnonzero(role == _BRACES)
    braces = braces[braces >= 2] - 2
    braces = braces[begins[braces] & (role[braces] == _BRACE) & (role[braces + 1] == _NUMBER) & (text[braces] == text[braces + 2])]
    return np.concatenate([np.where(numbered, before, start), braces])


class _Boundaries:
    """The boundaries of the texts of a block, whose words lie one after the other from ``offsets`` on: of all words at once,
    as texts are many and short."""

    def __init__(self, facts: dict[str, np.ndarray], numbers: np.ndarray, offsets: np.ndarray, weights: np.ndarray, before: np.ndarray, limit: int):
        n, starts = len(numbers), offsets[:-1]
        head, tail, breaks = facts["head"][numbers], facts["tail"][numbers], facts["breaks"][numbers]
        self.limit, self.offsets = limit, offsets
        self.chars, self.weights = facts["chars"][numbers], weights
        self.begin, self.upto = (np.append(0, np.cumsum(x)) for x in (self.chars, weights))
        first = np.zeros(n, bool)
        first[starts] = True
        ended = np.append(0, tail[:-1])  # 2: the word before ends a line
        ended[first] = 0
        kind = np.where((head > 0) | (ended > 0), WORD, 0).astype(np.int8)
        line = (ended == 2) | ((ended == 3) & (head != 2))  # a return ends a line unless a line feed follows
        kind[line | first] = LINE
        # a blank line before a word: the break words just before hold two line ends
        one = np.append(0, breaks[:-1])
        one[first] = 0
        other = np.append(0, one[:-1])
        other[first | (one == 0)] = 0
        pair = (np.append([0, 0], tail[:-2])[:n] == 3) & (np.append(0, head[:-1]) == 2) & (one > 0) & (other > 0)  # one line end
        kind[line & (breaks == 0) & (one + other - pair >= 2)] = CUE
        kind[_cues(kind, facts["role"][numbers], facts["blank"][numbers] > 0, np.cumsum(first))] = CUE
        keep = (kind > 0) | first
        for i in np.flatnonzero(before):  # a section begins at a boundary
            keep[offsets[i] + np.searchsorted(self.begin[offsets[i] : offsets[i + 1]] - self.begin[offsets[i]], before[i])] = True
        kept = np.append(np.flatnonzero(keep), n)
        for k in np.flatnonzero(np.diff(self.upto[kept]) > limit).tolist():  # no natural place within a piece's length: any word
            keep[kept[k] : kept[k + 1]] = True
        self.kind, self.kept = kind, np.flatnonzero(keep)
        self.cuts = np.searchsorted(self.kept, offsets)

    def of(self, i: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in characters, tokens before and kinds of the boundaries of a text, its end included; ``wide`` marks the
        words without an inner boundary, which are cut by characters."""
        a, b = self.offsets[i], self.offsets[i + 1]
        kept = self.kept[self.cuts[i] : self.cuts[i + 1]]
        ends = np.append(kept, b)
        at, tokens = self.begin[ends] - self.begin[a], self.upto[ends] - self.upto[a]
        kind = np.append(self.kind[kept], LINE)
        words = np.flatnonzero(wide[a:b]) + a
        if not len(words):
            return at, tokens, kind
        inner = _inner(self.limit)
        steps = [np.arange(inner, self.chars[w], inner) for w in words]
        more = [self.begin[w] - self.begin[a] + s for w, s in zip(words, steps, strict=True)]
        before = [self.upto[w] - self.upto[a] + s * 4 for w, s in zip(words, steps, strict=True)]
        at, tokens, kind = np.concatenate([at, *more]), np.concatenate([tokens, *before]), np.append(kind, np.zeros(sum(map(len, steps)), kind.dtype))
        order = np.argsort(at, kind="stable")
        return at[order], tokens[order], kind[order]


_PIECE = "doc_id long, section int, piece int, pieces int, start long, `end` long, n_tokens int, cut int, chars long, text string"


def _table(out: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), *[pa.int32()] * 2, pa.int64(), pa.string()]
    names = ["doc_id", "section", "piece", "pieces", "start", "end", "n_tokens", "cut", "chars", "text"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)


def _facts():
    """What the choice of boundaries needs to know of a word, and the word."""
    w = F.col("word")
    first, last, bare = F.substring(w, 1, 1), F.substring(w, -1, 1), F.ltrim(w)
    role = F.when(w.rlike(r"^ ?[0-9]+$"), _NUMBER).when(w == ":", _COLON).when(w.isin(",", "."), _POINT).when(bare == "-->", _ARROW).when(w == "}{", _BRACES).when(bare == "{", _BRACE)
    blank = w.rlike(f"{_WHITE}+$")
    return F.struct(
        F.size("ids").alias("tokens"), F.char_length(w).alias("chars"),
        F.when(first == "\n", 2).when(first.rlike(_WHITE), 1).otherwise(0).alias("head"),
        F.when(last == "\n", 2).when(last == "\r", 3).when(last.rlike(_WHITE), 1).otherwise(0).alias("tail"),
        F.when(blank, F.regexp_count(w, F.lit(r"\r\n|\r|\n"))).otherwise(0).cast("int").alias("breaks"),
        blank.cast("int").alias("blank"), role.otherwise(0).alias("role"), w.alias("word"),
    )


def _pieces(rows: pa.Table, parts: pa.StructArray, keys: list[str], limit: int, overlap: int) -> list[tuple]:
    """The pieces of the texts of a block, from the numbers of their words and the facts of these."""
    numeric = ("tokens", "chars", "head", "tail", "breaks", "blank", "role")
    facts = {f: parts.field(f).to_numpy(zero_copy_only=False).astype(np.int32 if f in ("tokens", "chars") else np.int8) for f in numeric}
    numbers, offsets = _numbers(rows.column("idx"))
    columns = [rows.column(k).to_numpy() for k in keys]
    # texts of more tokens than the limit, and sections of long texts; tokens of cut words count by their bytes
    sums = np.append(0, np.cumsum(facts["tokens"][numbers], dtype=np.int64))
    wanted = (sums[offsets[1:]] - sums[offsets[:-1]] > limit) | ((columns[1] > 0) | (columns[3] > 0) | (columns[4] > 0)) & (np.diff(offsets) > 0)
    if not wanted.any():
        return []
    lens = np.diff(offsets)[wanted]
    numbers = _gather(numbers, offsets[:-1][wanted], lens)
    offsets = np.append(0, np.cumsum(lens))
    doc, section, before, end_kind, inside = (c[wanted] for c in columns)
    wide = (facts["tokens"] > limit)[numbers]
    wide[offsets[:-1][inside & 1 > 0]] = True
    wide[offsets[1:][inside & 2 > 0] - 1] = True
    by_chars = -(-facts["chars"].astype(np.int64) // _inner(limit)) * _inner(limit) * 4
    found = _Boundaries(facts, numbers, offsets, np.where(wide, by_chars[numbers], facts["tokens"][numbers]), before, limit)
    words = parts.field("word").cast(pa.large_string()).take(pa.array(numbers))
    place = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = words.buffers()[2]
    out: list[tuple] = []
    for i in range(len(doc)):
        at, tokens, kind = found.of(i, wide)
        skipped = int(before[i])
        made = choose(tokens, kind, limit, overlap, int(np.searchsorted(at, skipped)) if skipped else 0, int(end_kind[i]))
        text = str(data[place[offsets[i]] : place[offsets[i + 1]]], "utf-8")
        own = len(text) - skipped
        at, tokens = at.tolist(), tokens.tolist()
        for p, (a, b, cut) in enumerate(made):
            out.append((doc[i], section[i], p, len(made), at[a] - skipped, at[b] - skipped, tokens[b] - tokens[a], cut, own, text[at[a] : at[b]]))
    return out


def split(docs: DataFrame, path: str, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """``doc_id, piece, pieces, start, end, n_tokens, cut, text``: the pieces of every text of more than ``limit`` tokens.

    Pieces are numbered from 0; ``text`` is the characters ``start`` to ``end`` of the document's text, and each piece
    after the first begins at most ``overlap`` tokens before the end of the one before. ``cut`` is the kind of place the piece
    ends at (3 between cues, 2 line end, 1 between words, 0 end or none). Null, empty and short texts have no row.
    ``n_tokens`` counts the tokens of the piece as they are in the whole text; encoded alone a piece has at most as many,
    since white space at its end may join. ``doc_id`` is unique; rows without one are left out. A word that alone exceeds the
    limit is cut inside. A text of more than ``SECTION`` bytes also has a cut at the end of each of its sections.
    """
    if limit < 32 or not 0 <= overlap <= limit // 2:
        raise ValueError("the limit is 32 at least, the overlap at most half of it")
    # a token has a byte at least, so texts of no more bytes than the limit need no look; and so many bytes at most, that a
    # halo without a place to cut is within a word of more tokens than the limit
    halo = limit * max(len(t) for t in vocabulary(path))
    keys = ["doc_id", "section", "before", "end_kind", "inside"]
    index = Words(sections(docs, limit, max(SECTION, 2 * halo), halo), keys)

    def pieces(rows, parts):
        # some texts at a time, so that the arrays over their words stay small
        upto, at, out = np.cumsum(pc.binary_length(rows.column("idx")).to_numpy()), 0, []
        while at < len(upto):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS_BYTES, "right")))
            out.append(_table(_pieces(rows.slice(at, end - at), parts, keys, limit, overlap)))
            at = end
        return pa.concat_tables(out)

    columns = ["doc_id", "piece", "pieces", "start", "end", "n_tokens", "cut", "text"]
    short = resolve(index, False, path, _facts(), pieces, _PIECE).select(*columns)
    if not index.blocks[True]:
        return short
    made = written(resolve(index, True, path, _facts(), pieces, _PIECE))
    sums = made.groupBy("doc_id", "section").agg(F.max("pieces").alias("own"), F.max("chars").alias("chars"))
    upto = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    sums = sums.select(
        "doc_id", "section", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("p"), F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("c"), F.sum("own").over(whole).cast("int").alias("all")
    )
    long = made.join(sums, ["doc_id", "section"]).withColumn("pieces", F.col("all")).withColumn("piece", (F.col("piece") + F.col("p")).cast("int"))
    long = long.withColumn("start", F.col("start") + F.col("c")).withColumn("end", F.col("end") + F.col("c"))
    return short.unionByName(long.select(*columns))
