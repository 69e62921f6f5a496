"""BPE encoding by a queue of merge ranks over a linked symbol list, and decoding.

A word is a doubly linked list of symbols. A heap holds (rank, position) of each
adjacent pair that has a merge; the best is popped, skipped if the symbols at its
position have changed since, and otherwise merged, which may push two new pairs.
Decoding concatenates vocabulary strings through the file's decoder, or joins
them by blanks if it names none.

The file's normaliser and pre-tokenizer cut texts into words. As neither looks
past white space, texts are first cut there and what a piece gives is remembered.
Null texts count as empty: no ids, and the digests of empty strings. Texts of any length are
encoded whole; a word of any length takes time in proportion to its length times the logarithm
of it. Repeated rows stay, and digests() encodes those that follow each other once; of two merges of one rank the left one goes first. An
empty table gives an empty result; further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.byte_tokens import Remembered, byte_level
from tesserae.llm.common import documents, map_arrow, tokenizer_path

#: Pieces and words that a worker process remembers.
PIECES, WORDS = 400_000, 300_000

_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space to Python, though not to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")
#: A word of letters that NFC leaves alone, and signs after it.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#*$%&]*)")


class Bpe:
    """Merges of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, end_of_word: str = "") -> None:
        self.vocab, self.end_of_word = vocab, end_of_word
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: (left id, right id) to (rank, merged id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def encode_word(self, word: str) -> list[int]:
        if not word:
            return []
        letters = [*word[:-1], word[-1] + self.end_of_word]
        symbols = [self.vocab[x] for x in letters]
        n = len(symbols)
        if n == 1:
            return symbols
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*m, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        queue = [(rank, i, merged, left, right) for rank, merged, i, left, right in queue]
        heapq.heapify(queue)
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((merged, symbols[k])):
                    heapq.heappush(queue, (m[0], i, m[1], merged, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], merged))):
                heapq.heappush(queue, (m[0], h, m[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]


class BpeCodec:
    """A tokenizers file with a BPE model, encoded by our own merges."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.bpe = Bpe(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (model["vocab"] | self.added).items()}
        reader = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.decoder = reader.normalizer, reader.pre_tokenizer, reader.decoder
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        #: Whether the file asks for what simple() does.
        self.plain = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        #: Byte-level word to its ids as text, and piece likewise.
        self.words = Remembered(lambda word: " ".join(map(str, self.bpe.encode_word(word))), WORDS)
        self.pieces = Remembered(self._piece, PIECES)
        self.spelt = {str(i): s for i, s in self.strings.items()}

    def _piece(self, piece: str) -> str:
        """Ids of a piece as text."""
        if piece in self.added:
            return str(self.added[piece])
        if self.plain and (m := _SIMPLE.fullmatch(piece)):
            word, signs = m[1].lower(), m[2]
            ids = self.words[word if word.isascii() else byte_level(word)]
            return f"{ids} {self.words[signs]}" if signs else ids
        text = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return " ".join([self.words[word] for word, _ in self.pre_tokenizer.pre_tokenize_str(text)])

    def cut(self, text: str) -> list[str]:
        """Pieces between white space, special strings apart."""
        parts = self.special.split(text) if any(x in text for x in self.added) else [text]
        pieces: list[str] = []
        for x in parts:
            if x in self.added:
                pieces.append(x)
            else:
                pieces += x.split() if _CONTROL.search(x) is None else [p for p in _BLANK.split(x) if p]
        return pieces

    def _ids(self, text: str | None) -> str:
        return " ".join([x for x in map(self.pieces.__getitem__, self.cut(text or "")) if x])

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self._ids(text).split()))

    def decode(self, ids: list[int]) -> str:
        strings = [self.strings[i] for i in ids]
        return self.decoder.decode(strings) if self.decoder else " ".join(strings)

    def summary(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of them and of the decoded text."""
        ids = self._ids(text)
        each = ids.split()
        strings = list(map(self.spelt.__getitem__, each))
        decoded = self.decoder.decode(strings) if self.decoder else " ".join(strings)
        return len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_open: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each worker process and file."""
    if path not in _open:
        _open[path] = BpeCodec(path)
    return _open[path]


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _summaries(path: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = codec(path).summary
        text, own = None, summary(None)

        def told(t: str | None) -> tuple[int, str, str]:
            nonlocal text, own
            if t != text:  # copies stand next to each other in a mix
                text, own = t, summary(t)
            return own

        for b in batches:
            n, ids, decoded = zip(*[told(t.as_py()) for t in b.column(1)]) if b.num_rows else ((), (), ())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encoded(path: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the decoded text of every row. Repeated rows stay; further columns are left out."""
    return map_arrow(_thin(docs, id_col, text_col), _encoded(tokenizer), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text, of every row."""
    return map_arrow(_thin(docs, id_col, text_col), _summaries(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    return digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
