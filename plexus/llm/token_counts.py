"""Token counts by byte-pair merging with a heap over a linked list: no identifier is ever made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else 256 upwards in turn."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


# Capitals that are newer than Python's Unicode tables, and what the library has for them in lower case.
NEWER = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


class _Cached(dict):
    """Results of a function, kept as they are asked for; emptied when it holds ``size``."""

    def __init__(self, function: Callable[[str], int], size: int):
        super().__init__()
        self.function, self.size = function, size

    def __missing__(self, key: str) -> int:
        if len(self) >= self.size:
            self.clear()
        n = self[key] = self.function(key)
        return n


class TokenCounter:
    """Counts by a word-level BPE file; remembers at most ``max_words`` words and as many blank-separated chunks.

    Equals the library's counts, whatever the letters (held against it for each code point).
    """

    def __init__(self, path: str, max_words: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("a plain BPE model with an end-of-word suffix is expected")
        self.ranks = {tuple(p) if isinstance(p, list) else tuple(p.split(" ")): i for i, p in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        self.by_word = _Cached(self.merged, max_words)
        self.by_chunk = _Cached(self._words, max_words)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is the Unicode property, as in the library; regex's \s and str.split have four controls besides.
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.controls = regex.compile("[\x1c-\x1f]").search
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def merged(self, word: str) -> int:
        """Symbols that are left of a word: its bytes less the merges done, lowest rank first, leftmost of equals."""
        ranks, symbols = self.ranks, [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        symbols[-1] += self.suffix
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        left, last = n, n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= last or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, None
            k = after[i] = after[j]
            left -= 1
            if k < last:
                before[k] = i
                if (r := ranks.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text. Special strings in it are one token each."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Letter by letter, as the library does: no final form of sigma.
            text = text.replace("Σ", "σ").translate(NEWER)
        text = text.lower()
        # No word spans white space, so chunks between it are counted for themselves.
        return self._words(text) if self.controls(text) else sum(map(self.by_chunk.__getitem__, text.split()))

    def _words(self, text: str) -> int:
        return sum(map(self.by_word.__getitem__, self.words(text)))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, from whole texts.

    ``tokenizer``: path of a word-level BPE file that every executor has. Null texts count as empty (0 tokens,
    not over the limit); a null key stays null; repeated rows give a row each; other columns are not read.
    Nothing is shuffled. A worker keeps counts of at most ``max_words`` words (see TokenCounter).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer)
        for batch in batches:
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["_key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    counted = rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
