"""Byte-level BPE of whole texts by corpus-level merge replay.

The distinct words of many texts are laid out as one sequence of symbols. An inverted index
holds the places of every pair of neighbours; the merges are replayed in rank order over all
words at once, and each merge touches only the places of its pair and their neighbours.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS, WORDS_AT_ONCE = 300_000, 20_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others for letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A byte-level vocabulary: ids of the bytes, and (rank, id of the result) of each pair of ids."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.of_byte = [vocab[x] for x in _byte_letters()]
        self.width = max(vocab.values()) + 1
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] * self.width + vocab[b]] = (rank, vocab[a + b])

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word."""
        ids, width, pairs = self.of_byte, self.width, self.pairs
        symbols: list[int] = []
        bounds = [0]
        for w in words:
            symbols.extend([ids[b] for b in w])
            symbols.append(-1)
            bounds.append(len(symbols))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        places: dict[int, list[int]] = {}
        heap: list[tuple[int, int, int]] = []

        def note(pair: int, at: int) -> None:
            found = places.get(pair)
            if found is not None:
                found.append(at)
            elif (merge := pairs.get(pair)) is not None:
                places[pair] = [at]
                heapq.heappush(heap, (merge[0], pair, merge[1]))

        for i in range(len(symbols) - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0:
                note(a * width + b, i)
        while heap:
            _, pair, result = heapq.heappop(heap)
            a, b = divmod(pair, width)
            for i in sorted(places.pop(pair)):
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                symbols[i] = result
                symbols[j] = -2
                k = after[j]
                after[i] = k
                before[k] = i
                if symbols[k] >= 0:
                    note(result * width + symbols[k], i)
                h = before[i]
                if h >= 0 and symbols[h] >= 0:
                    note(symbols[h] * width + result, h)
        return [[s for s in symbols[a : b - 1] if s >= 0] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Encodes texts; words met before are looked up, at most KEPT_WORDS of them."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.known, self.split = merges, {}, regex.compile(PATTERN).findall

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for words in split for w in words}.difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = list({w for words in split for w in words})
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i : i + WORDS_AT_ONCE]
            self.known.update(zip(part, self.merges.replay([w.encode() for w in part])))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


def _parts(texts: list[str | None], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of texts with about so many characters, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _shared_merges(spark: SparkSession, tokenizer: str, tokenizer_dir: str):
    """The vocabulary on every executor; its size is that of the vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast(Merges(f"{tokenizer_dir}/{tokenizer}.json"))


def encode_corpus(documents: DataFrame, id_: str = "doc_id", text: str = "text", *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Token ids of every text: the id column and ``ids`` (array of int).

    No special tokens are added, and their spellings in a text are ordinary text. Null and
    empty texts have the empty list. Every row gives one row, repeated and null ids too;
    further columns are ignored. Texts are encoded whole. There is no shuffle.
    """
    shared = _shared_merges(documents.sparkSession, tokenizer, tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _parts(texts):
                ids = encoder.encode(texts[part])
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), lists], names=[id_, "ids"])

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, id_: str = "doc_id", text: str = "text", *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Number of tokens of every text: the id column and ``n_tokens``; as ``encode_corpus``, without sending the ids back."""
    shared = _shared_merges(documents.sparkSession, tokenizer, tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [len(x) for part in _parts(texts) for x in encoder.encode(texts[part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_, "n_tokens"])

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, n_tokens bigint")
