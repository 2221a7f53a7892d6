"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

#: The pre-token pattern that word_bpe_49k.json names, and the white space it drops.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = r"[\t-\r \x85\xa0  -     　]+"
#: Characters for which Python's and the library's classes surely agree; words with others go to the library whole.
PLAIN = r"[!-~¡-ɏ‐-‧‰-⁞₠-₿]*"

#: Entries that a task's memory of words may hold before it starts afresh.
CACHE_WORDS = 400_000


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token: they survive normalisation, form one
    pre-token, and the library merges them down to a single id. At most one entry per vocabulary item."""
    byte_of = _byte_letters()
    found = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            found.append(bytes(byte_of[c] for c in piece.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    match = regex.compile(PRETOKEN)
    found = [s for s in dict.fromkeys(found) if s and regex.fullmatch(PLAIN, s) and match.findall(s) == [s] and tokenizer.normalizer.normalize_str(s) == s]
    return frozenset(s for s, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts:
    """Tokens by white-space delimited word, and by pre-token that has to be merged, as far as a task has met them."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]):
        self.tokenizer, self.whole = tokenizer, whole
        self.words: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.pretokens, self.plain = regex.compile(PRETOKEN).findall, regex.compile(PLAIN).fullmatch

    def learn(self, words: set[str]) -> None:
        """Work out what isn't known of the words: whole tokens count one, all other pre-tokens are merged together."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.merged) > CACHE_WORDS:
            self.merged.clear()
        new = words - self.words.keys()
        normal = self.tokenizer.normalizer.normalize_str
        # Of plain words the parts are told here; a word with other characters is merged as it is.
        parts = {w: self.pretokens(w.lower() if w.isascii() else normal(w)) if self.plain(w) else None for w in new}
        rest = {t for p in parts.values() if p is not None for t in p} - self.whole - self.merged.keys()
        ask = [*rest, *(w for w, p in parts.items() if p is None)]
        found = dict(zip(ask, (len(e.ids) for e in self.tokenizer.encode_batch_fast(ask, add_special_tokens=False)), strict=True))
        self.merged.update((t, found[t]) for t in rest)
        for w, p in parts.items():
            self.words[w] = found[w] if p is None else sum(self.merged.get(t, 1) for t in p)


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library gives them without added special tokens.

    Rows: one per input row with id_col, n_bytes and n_tokens. A null text counts as empty: 0 and 0. Special
    strings inside a text are one token each, as is the library's default. Repeated rows give repeated rows; an empty
    table gives none; other columns of docs are not looked at. Texts of any length are read whole.

    Map-only: no shuffle. The tokenizer (a file of fixed size) and the table of whole tokens (one string per vocabulary
    item at most) go to the tasks.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    tokenizer = Tokenizer.from_str(source)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    shipped = docs.sparkSession.sparkContext.broadcast((source, whole_tokens(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counts = _Counts(Tokenizer.from_str(shipped.value[0]), shipped.value[1])
        white, odd = regex.compile(WHITE), regex.compile("[\x1c-\x1f]").search
        cut = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        for batch in slices(batches):
            n_bytes, special_tokens, words = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                parts = cut.split(text) if "<|" in text else [text]
                special_tokens.append(len(parts) - 1)
                words.append([w for part in parts for w in (filter(None, white.split(part)) if odd(part) else part.split())])
            counts.learn(set().union(*words))
            n_tokens = [n + sum(map(counts.words.__getitem__, w)) for n, w in zip(special_tokens, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
