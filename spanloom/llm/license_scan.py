"""License scans: phrases, and an exact containment join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: What separates words of lower-cased text.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by which licenses are granted, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
]
#: Share of a template's distinct words that a block has to hold.
CONTAINED = 0.8


class Template(NamedTuple):
    label: str
    #: Distinct words as numbers in the global order, rarest first.
    tokens: tuple[int, ...]
    #: Words that a block has to hold, and the step of the blocks that it is compared with.
    need: int
    step: int


def block_step(n_words: int) -> int:
    """Templates of n words are compared with blocks of twice as many words, one beginning at every step; steps are powers of two from 8 on."""
    return max(8, 1 << (n_words - 1).bit_length())


def flat_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of the lower-cased (A-Z) texts, flat, and where each text's begin (one offset more than texts). Nulls have none."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAK)
    flat, offsets = parts.flatten(), np.asarray(parts.offsets) - parts.offsets[0].as_py()
    real = np.asarray(pc.binary_length(flat)) > 0
    return np.concatenate([[0], np.cumsum(real)])[offsets], flat.filter(pa.array(real))


def word_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """word and n, how often each of the words stands in all texts; counted in the tasks, then summed. A word that never stands has no row."""
    asked = pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in slices(batches, 500):
            at = pc.index_in(flat_words(batch.column(0))[1], value_set=asked).drop_null()
            total += np.bincount(np.asarray(at), minlength=len(asked))
        yield pa.RecordBatch.from_arrays([asked, pa.array(total)], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def ordered_templates(templates: list[tuple[str, str]], counts: dict[str, int], contained: float) -> tuple[list[str], list[Template]]:
    """All words of the templates, rarest in the corpus first (ties by the word), and the templates over these numbers."""
    words = sorted({w for _, text in templates for w in text.split()}, key=lambda w: (counts.get(w, 0), w))
    number = {w: k for k, w in enumerate(words)}
    out = []
    for label, text in templates:
        tokens = tuple(sorted({number[w] for w in text.split()}))
        out.append(Template(label, tokens, math.ceil(contained * len(tokens) - 1e-9), block_step(len(text.split()))))
    return words, out


class BlockJoin:
    """Joins the blocks of a text with the templates whose words they hold to the threshold. Words outside the templates can't count, so blocks are sets of
    template words in the global order."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        #: By step and word: templates with the word in their prefix, and its position there. A block that lacks the whole prefix lacks too many words.
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, template in enumerate(templates):
            for k, token in enumerate(template.tokens[: len(template.tokens) - template.need + 1]):
                self.prefixes[template.step][token].append((t, k))

    def candidates(self, step: int, block: list[int]) -> set[int]:
        """Templates that share a prefix word with the block and can still reach what they need: the first shared word stands at k in
        the template and at i in the block, so no more can be shared than what is left of either from there on."""
        prefixes, met = self.prefixes[step], {}
        for i, token in enumerate(block):
            for t, k in prefixes.get(token, ()):
                if t not in met:
                    template = self.templates[t]
                    met[t] = len(block) >= template.need and min(len(template.tokens) - k, len(block) - i) >= template.need
        return {t for t, possible in met.items() if possible}

    def blocks(self, numbers: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(start, words, template, containment) of every block and template that meet the threshold.

        numbers: of each word of the text, or -1 for words of no template.
        """
        found, n = [], len(numbers)
        at = np.flatnonzero(numbers >= 0)
        tokens = numbers[at]
        for step, prefixes in self.prefixes.items():
            hits = at[np.isin(tokens, list(prefixes))] // step
            last = max(0, -(-n // step) - 2)
            for b in np.unique(np.minimum(np.concatenate([hits, hits - 1]), last)).tolist():
                if b < 0:
                    continue
                lo, hi = np.searchsorted(at, [b * step, (b + 2) * step])
                block = sorted(set(tokens[lo:hi].tolist()))
                for t in self.candidates(step, block):
                    template = self.templates[t]
                    shared = len(set(block).intersection(template.tokens))
                    if shared >= template.need:
                        found.append((b * step, min(n - b * step, 2 * step), t, shared / len(template.tokens)))
        return found


def phrase_places(numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    n = len(numbers) - len(phrase) + 1
    same = np.ones(max(0, n), bool)
    for k, token in enumerate(phrase):
        same &= numbers[k : k + len(same)] == token
    return np.flatnonzero(same)


BLOCK_TYPE = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, contained: float = CONTAINED) -> DataFrame:
    """License phrases and blocks of text that hold a license notice.

    Rows: one per input row with id_col, n_words, places (array of structs start, label: where a phrase's words stand), and blocks (array of structs start, words,
    label, containment). A text of lower-cased words is cut into blocks of 2s words that begin at 0, s, 2s, ... (the last one may be shorter), for each power of
    two s that is the least one not below some template's length, so that every stretch of a template's length lies whole in a block. A block counts for the template of its size
    with the largest share of distinct words in it, if that is at least `contained`; of equals the template with more words, then the first.

    A null text counts as empty. Repeated rows repeat, an empty table gives none, other columns are not looked at; whole texts are read.

    The templates' words are counted in all texts first and ordered from the rarest on. Blocks are joined with templates through their prefixes in that order, with
    length and positional filters; what passes is counted exactly, so no block is lost. Templates, and their words' counts, are the only data sent to all tasks.
    """
    words = sorted({w for _, text in templates for w in text.split()} | {w for p in phrases for w in p.split()})
    counts = {r.word: r.n for r in word_counts(docs, words, text_col).collect()}  # a row for each word of the templates at most
    order, sets = ordered_templates([*templates, *((label, p) for p, label in phrases.items())], counts, contained)
    sets, number = sets[: len(templates)], {w: k for k, w in enumerate(order)}
    told = [([number[w] for w in p.split()], label) for p, label in phrases.items()]
    lengths = [len(text.split()) for _, text in templates]
    place_type = pa.struct([("start", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, known = BlockJoin(sets), pa.array(order, pa.string())
        for batch in slices(batches, 500):
            offsets, flat = flat_words(batch.column(1))
            numbers = np.asarray(pc.fill_null(pc.index_in(flat, value_set=known), -1))
            places, blocks = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = numbers[a:b]
                places.append([{"start": k, "label": label} for phrase, label in told for k in phrase_places(own, phrase).tolist()])
                best: dict[tuple[int, int], tuple] = {}
                for start, n, t, share in join.blocks(own):
                    rank = (share, lengths[t], -t)
                    key = (start, sets[t].step)
                    if key not in best or rank > best[key][0]:
                        best[key] = (rank, {"start": start, "words": n, "label": sets[t].label, "containment": share})
                blocks.append([best[k][1] for k in sorted(best)])
            out = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(places, pa.list_(place_type)), pa.array(blocks, pa.list_(BLOCK_TYPE))]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_words", "places", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, blocks array<struct<start:bigint,words:bigint,label:string,containment:double>>")
