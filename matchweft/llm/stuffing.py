"""Pages of stuffed keywords, link lists and product tags.

Two things are measured on each page, on the characters themselves and without word lists:
what its suffix automaton says is repeated, and what its punctuation says of clauses. The page
is cut into segments (lines and sentences). A segment counts as stuffed if repeated maximal
substrings cover enough of it, and how much is enough depends on its structure: little where it
is a row of short items or links, nearly all where it just does not end as a sentence does.
A sentence counts only if repeats cover it that come about once in each of the page's sentences
and close together, as a stuffed phrase does. A page without repeats is never found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import covered, ending_order, repeated_states

#: Characters of a repeat between the items of a list, and of one anywhere else.
ITEM_REPEAT, LEAST_REPEAT = 3, 6
#: How much of a list, of an open line and of a sentence repeats must cover.
IN_LIST, IN_LINE, IN_SENTENCE = 0.3, 0.75, 0.25
#: A stuffed phrase: times in the page, share of its sentences, and characters from one to the next on average.
TIMES, THEME, NEAR = 5, 0.6, 50
SPAM_SHARE = 0.5
#: A list: items, and words for each of them; a clause has more words between its separators.
ITEMS, ITEM_WORDS, CLAUSE_WORDS = 4, 2.5, 4
#: A code of one kind of character for so long, or one character so often in a row, is no text.
NOISE, SAME = 40, 10
CHARS_AT_ONCE = 250_000

_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,9}(?:\s*/?>|\s[^<>]*>)|<\|[^|>]{1,30}\|>|&[a-zA-Z]{2,8};")
_ANCHOR = re.compile(r"<a\s[^>]*?href=[\"']?([^\s>\"']*)[^>]*>", re.IGNORECASE)

SPACE, NEWLINE, WORD, LETTER, DIGIT, LOWER, END, FULL, CLOSER, SEPARATOR, WIDE, DROP, CODE = (1 << i for i in range(13))
_KINDS = {"\r\n": NEWLINE | SPACE, ".!?…。！？": END, "。！？…": FULL, "\"'»”)": CLOSER, ",;|•·/>#[]": SEPARATOR, "@$'": WORD, "+/=_": CODE, "�": DROP}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kinds and lower case of the code points of the basic plane, from the Unicode database."""
    kinds, lower = np.zeros(65_536, np.int32), np.arange(65_536, dtype=np.int32)
    for i in range(65_536):
        c = chr(i)
        category = unicodedata.category(c)
        if c.isspace():
            kinds[i] |= SPACE
        if category[0] in "LMN":
            kinds[i] |= WORD | (LETTER if category[0] != "N" else DIGIT if category == "Nd" else 0)
            kinds[i] |= WIDE if unicodedata.east_asian_width(c) in "WF" and category == "Lo" else 0
            kinds[i] |= CODE if i < 128 else 0
        if category == "Ll":
            kinds[i] |= LOWER
        if category == "Cf":
            kinds[i] |= DROP
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    for signs, kind in _KINDS.items():
        for c in signs:
            kinds[ord(c)] |= kind
    return kinds, lower


def _plain(text: str) -> str:
    """Text without markup; a link keeps its address."""
    if "<" in text or "&" in text:
        text = _TAG.sub("", _ANCHOR.sub(r" \1 ", text))
    return text


def _last(flag: np.ndarray) -> np.ndarray:
    """At each place, the last place so far that is flagged; -1 before the first."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag), dtype=np.int32), np.int32(-1)))


def _next(flag: np.ndarray) -> np.ndarray:
    """At each place, the next flagged place from here on; the length if there is none."""
    n = len(flag)
    return np.minimum.accumulate(np.where(flag, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]


def _runs(flag: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Length of the run of flagged places that each place lies in; runs end at cuts."""
    start = flag & (cut | ~np.r_[False, flag[:-1]])
    number = np.cumsum(start) * flag
    return np.bincount(number, minlength=1)[number] * flag


class _Batch:
    """The texts of a batch as one array of characters, and the segments they are cut into."""

    def __init__(self, texts: list[str]) -> None:
        kinds, lower = _tables()
        plain = [_plain(t) for t in texts]
        raw = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        page = np.repeat(np.arange(len(plain), dtype=np.int32), [len(t) for t in plain])
        kind = np.where(raw < 65_536, kinds[np.minimum(raw, 65_535)], 0)
        keep = (kind & DROP) == 0
        raw, page, kind = raw[keep], page[keep], kind[keep]
        keep = ~self._noise(raw, page, kind)
        raw, page, kind = raw[keep], page[keep], kind[keep]
        self.pages, self.page, self.kind = len(plain), page, kind
        self.codes = np.where(raw < 65_536, lower[np.minimum(raw, 65_535)], raw)
        self.raw = raw
        self._segments()

    @staticmethod
    def _noise(raw: np.ndarray, page: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Long codes outside of links, and one sign many times in a row."""
        n = len(raw)
        if not n:
            return np.zeros(0, bool)
        cut = np.r_[True, page[1:] != page[:-1]]
        long = _runs((kind & CODE) > 0, cut) >= NOISE
        if long.any():
            token = np.cumsum(cut | ((kind & SPACE) > 0))
            mark = np.zeros(n, bool)
            mark[: n - 2] = (raw[: n - 2] == ord(":")) & (raw[1 : n - 1] == ord("/")) & (raw[2:] == ord("/"))
            linked = np.zeros(token[-1] + 1, bool)
            linked[token[mark]] = True
            long &= ~linked[token]
        equal = np.r_[False, (raw[1:] == raw[:-1]) & (page[1:] == page[:-1]) & ((kind[1:] & SPACE) == 0)]
        same = _runs(equal, cut) >= SAME - 1
        return long | same

    def _segments(self) -> None:
        n, raw, kind = len(self.codes), self.raw, self.kind
        is_ = lambda k: (kind & k) > 0
        shift = lambda x, fill=False: np.r_[np.full(min(1, n), fill), x[:-1]]  # noqa: E731  the place before
        ahead = lambda x, fill=False: np.r_[x[1:], np.full(min(1, n), fill)]  # noqa: E731  the place after
        new_page = np.r_[np.ones(min(1, n), bool), self.page[1:] != self.page[:-1]]
        space, ends, closer = is_(SPACE), is_(END), is_(CLOSER)
        after_end = shift(ends) | (shift(closer) & shift(shift(ends)))
        cut = new_page | is_(NEWLINE) | (space & after_end) | shift(is_(FULL))
        self.segment = segment = np.cumsum(cut) - 1 if n else np.zeros(0, np.int64)
        m = int(segment[-1]) + 1 if n else 0
        total = lambda flag: np.bincount(segment[flag], minlength=m)
        self.solid = solid = ~space
        self.size = total(solid)
        self.page_of = self.page[cut]
        word = is_(WORD)
        self.words = total(word & (cut | ~shift(word)))
        # Items: pieces of content between separators; a dash between blanks and a colon inside a tag separate too.
        dash = ((raw == ord("-")) | (raw == ord("–"))) & shift(space) & ahead(space)
        colon = raw == ord(":")
        inner = colon & (shift(is_(LETTER)) | shift(raw == ord("@"))) & ahead(word & (raw != ord("'")))
        separator = is_(SEPARATOR) | dash | inner
        content = solid & ~separator
        bound = _last(cut | separator)
        self.items = total(content & (shift(_last(content), -1) < bound))
        # The last sign of a segment, closing signs apart.
        final = np.full(m, -1, np.int64)
        said = np.flatnonzero(solid & ~closer)
        final[segment[said]] = said
        self.ended = np.where(final >= 0, ends[np.maximum(final, 0)], False) if n else np.zeros(0, bool)
        # Recorder lines: key and value, arrows, names with underscores. Remarks: a speaker and a colon.
        following, before = _next(solid), shift(_last(solid), -1)
        following = ahead(following, n)
        there = following < n
        value = np.zeros(n, bool)
        value[there] = (is_(DIGIT) | np.isin(raw, [ord(x) for x in "\"{["]))[following[there]]
        keyed = colon & value & (before >= 0) & (word | (raw == ord('"')))[np.maximum(before, 0)]
        arrow = (raw == ord(">")) & shift(raw == ord("-"))
        equals = (raw == ord("=")) & shift(word) & ahead(solid)
        low = is_(LOWER) & (raw < 128)
        snake = (raw == ord("_")) & shift(low) & ahead(low)
        self.record = total(keyed | arrow | equals | snake) > 0
        opening = np.full(m, n, np.int64)
        first = np.flatnonzero(solid)[::-1]
        opening[segment[first]] = first
        says = np.flatnonzero(colon & ahead(space, True) & shift(word))
        near = says[says - opening[segment[says]] <= 20]
        self.speaker = np.bincount(segment[near], minlength=m) > 0
        self.wide = total(is_(WIDE)) * 4 >= self.size
        # Links: from their mark to the next blank.
        mark = colon & ahead(raw == ord("/")) & ahead(ahead(raw == ord("/")))
        www = (self.codes == ord("w")) & shift(self.codes == ord("w")) & shift(shift(self.codes == ord("w"))) & ahead(raw == ord("."))
        self.linked = solid & (_last(mark | www) > _last(space | new_page & ~(mark | www)))
        self.links = total(self.linked)
        self.need_rows = (self.links >= 0.3 * self.size) | ((self.items >= ITEMS) & (self.words < ITEM_WORDS * self.items))
        told = (self.record | self.speaker | self.wide) & ~self.need_rows
        clause = ~self.need_rows & ((self.words >= CLAUSE_WORDS * np.maximum(self.items, 1)) | (self.ended & (self.words >= ITEM_WORDS * np.maximum(self.items, 1))) | (self.words == 0))
        self.sentence = (clause & self.ended) | (self.wide & ~self.need_rows) | (self.words == 0)
        self.exempt = (self.record | self.speaker) & ~self.need_rows
        self.line = clause & ~self.sentence & ~told
        self.list = ~self.sentence & ~self.line & ~told


def page_scores(texts: list[str]) -> np.ndarray:
    """For each text: the share of stuffed characters, the share that repeats cover, and the share of links (blanks apart)."""
    b = _Batch(texts)
    out = np.zeros((b.pages, 3))
    if not len(b.codes):
        return out
    by_page = lambda x: np.bincount(b.page_of, weights=x, minlength=b.pages)
    total = by_page(b.size)
    sentences = by_page((b.sentence & (b.words > 0)).astype(float))
    need = np.maximum(TIMES, np.ceil(THEME * sentences))
    # Exact bounds spare the automaton: a page can only be found if lists, open lines and sentences that hold some often repeated characters are most of it.
    loose = by_page(b.size * (b.list | b.line))
    held = _may_be_stuffed(b, need, loose + by_page(b.size * (b.sentence & ~b.exempt)) > SPAM_SHARE * total)
    phrased = loose + by_page(b.size * (b.sentence & ~b.exempt & held)) > SPAM_SHARE * total
    wanted = phrased | (loose > SPAM_SHARE * total)
    chosen = wanted[b.page]
    if not chosen.any():
        return out
    codes, page, segment = b.codes[chosen], b.page[chosen], b.segment[chosen]
    order = ending_order(codes, np.flatnonzero(np.r_[True, page[1:] != page[:-1]]))
    # The longest ending of each place that comes again is that of the suffix link of its state.
    twice = np.maximum(order.shared, np.r_[order.shared[1:], 0])
    cover = lambda least: covered(len(codes), twice[twice >= least], order.places[twice >= least])
    phrased &= by_page((b.sentence | b.line) & ~b.exempt & held) > 0
    states = repeated_states(order, LEAST_REPEAT, TIMES, phrased[page])
    dense = (states.count >= need[page[states.first]]) & (states.last - states.first <= NEAR * (states.count - 1))
    longest = np.zeros(len(codes), np.int64)
    for low, high, length in sorted(zip(states.low[dense].tolist(), states.high[dense].tolist(), states.length[dense].tolist()), key=lambda x: x[2]):
        longest[low:high] = length
    stuffed = covered(len(codes), longest[longest > 0], order.places[longest > 0])
    solid = b.solid[chosen]
    m = len(b.size)
    share = lambda flag: np.bincount(segment[flag & solid], minlength=m) / np.maximum(b.size, 1)
    r, d = share(cover(LEAST_REPEAT)), share(stuffed)
    spam = (b.list & (share(cover(ITEM_REPEAT)) >= IN_LIST)) | (b.line & (r >= IN_LINE)) | ((b.sentence | b.line) & ~b.exempt & (d >= IN_SENTENCE))
    whole = np.maximum(total, 1)
    out[:, 0] = by_page(b.size * spam) / whole
    out[:, 1] = by_page(b.size * r) / whole
    out[:, 2] = by_page(b.links) / whole
    out[~wanted] = 0
    return out


def _may_be_stuffed(b: _Batch, need: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Segments of the pages asked for of which LEAST_REPEAT characters that come often enough to be a stuffed phrase cover enough; elsewhere the automaton's states cannot."""
    m, out = len(b.size), np.zeros(len(b.size), bool)
    asked = asked & (np.bincount(b.page, minlength=b.pages) >= LEAST_REPEAT + need)
    n = max(len(b.codes) - LEAST_REPEAT + 1, 0)
    if not asked.any():
        return out
    codes, hashed = b.codes.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(LEAST_REPEAT):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += codes[j : j + n]
    hashed >>= np.uint64(20)

    def grams(pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(pages[b.page[:n]] & (b.page[:n] == b.page[LEAST_REPEAT - 1 :]))
        return at, (b.page[at].astype(np.uint64) << np.uint64(44)) | hashed[at]  # pages stay together

    _, key = grams(asked)
    if not len(key):
        return out
    key.sort()
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    of = (key[heads] >> np.uint64(44)).astype(np.int64)
    often = np.zeros(b.pages, bool)
    np.logical_or.at(often, of, np.diff(np.r_[heads, len(key)]) >= need[of])
    at, key = grams(often)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    at = at[times[inverse] >= need[b.page[at]]]
    cover = covered(len(b.codes), np.full(len(at), LEAST_REPEAT), at + LEAST_REPEAT - 1)
    return np.bincount(b.segment[cover & b.solid], minlength=m) >= IN_SENTENCE * np.maximum(b.size, 1)


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about CHARS_AT_ONCE characters, at least one text and at most a million texts each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS_AT_ONCE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def is_stuffed(text: str | None) -> bool:
    """Most of the page is keywords, links or tags that repeat themselves."""
    return bool(text) and page_scores([text])[0, 0] > SPAM_SHARE


def stuffed_pages(documents: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The pages of keyword or link spam: id, share, repeated, linked (shares of the page's characters).

    Each row is judged by its own whole text, so repeated rows are found again; null, empty and
    blank texts are none, and no text is too short or too long to be judged. Further columns are
    ignored. There is no shuffle.
    """
    kind = documents.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, rows = [], []
            for part in _parts(texts):
                scores = page_scores([t or "" for t in texts[part]])
                found = np.flatnonzero(scores[:, 0] > SPAM_SHARE)
                at.append(found + part.start)
                rows.append(scores[found])
            index = np.concatenate(at) if at else np.zeros(0, np.int64)
            scores = np.concatenate(rows) if rows else np.zeros((0, 3))
            columns = [batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(scores[:, j]) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_, "share", "repeated", "linked"])

    return documents.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, share double, repeated double, linked double")
