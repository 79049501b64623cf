"""Token counts with a whole-token shortcut.

The tokenizer cuts a text into pre-tokens and merges inside each. Which vocabulary strings encode
alone as one token is proved once, on the driver; a matching pre-token is counted directly and only
the rest is merged. A pre-token's count does not depend on its neighbours, so each distinct one is
merged once for each worker's cache.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
CACHE = 400_000  # remembered merged pre-tokens for each worker; then the cache starts anew
#: The byte-level pre-tokenizer's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's classes in the regex package agree with the library's on these characters (tested);
#: the words around another one are counted by the library itself.
PLAIN = r"[^\x00-\x1B\x20-\x84\x86-ɏḀ-ỿ‐-‧‰-⁞₠-₵]"
#: Between one of these characters and white space no pre-token or special string goes on.
BREAK = r"(?<=[!-~À-ɏ])(?=[ \t\n\r\x0B\x0C])"


def _odd_ranges(text: str, odd, breaks) -> list[tuple[int, int]]:
    """Ranges from break to break that hold characters not tested, in order."""
    at = [0, *(m.start() for m in breaks.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    for m in odd.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        i = bisect_right(at, m.start())
        out.append((at[i - 1], at[i]))
    return out


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer encodes alone as exactly one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    strings = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size(with_added_tokens=False))]
    strings = [s for s in strings if s and "�" not in s]
    encoded = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class _Counts(dict):
    """pre-token -> tokens; unknown ones are merged by the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(dict.fromkeys(whole, 1))
        self.base = len(self)
        self.merger = Tokenizer.from_file(path)
        self.merger.encode_special_tokens = True
        self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = whole

    def __missing__(self, piece: str) -> int:
        n = len(self.merger.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def trim(self) -> None:
        if len(self) > self.base + CACHE:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))


@lru_cache(maxsize=2)
def _ready(path: str, whole: frozenset[str]):
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")
    return tok, cut, regex.compile(PATTERN), regex.compile(PLAIN), regex.compile(BREAK), _Counts(path, whole)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, as the library counts without added tokens.

    Null text: no bytes, no tokens. Rows are independent: repeated rows repeat, other columns are ignored; an
    empty table gives an empty result. A very long text is counted in one task.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cut, pattern, odd, breaks, counts = _ready(path, whole.value)
        find, get = pattern.findall, counts.__getitem__

        def plain(text):
            n, at = 0, 0
            for m in cut.finditer(text):
                n, at = n + 1 + sum(map(get, find(text[at : m.start()]))), m.end()
            return n + sum(map(get, find(text[at:] if at else text)))

        for batch in batches:
            sizes, numbers = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                n, at = 0, 0
                for a, b in _odd_ranges(text, odd, breaks) if odd.search(text) else ():
                    n, at = n + plain(text[at:a]) + len(tok.encode(text[a:b], add_special_tokens=False).ids), b
                numbers.append(n + plain(text[at:] if at else text))
                counts.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
