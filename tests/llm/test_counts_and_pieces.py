import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import pieces
from spanloom.llm.token_counts import count_tokens, whole_tokens

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_tokens_are_single_ids():
    t = Tokenizer.from_file(BPE)
    whole = sorted(whole_tokens(t))
    assert len(whole) > 10_000
    assert all(len(e.ids) == 1 for e in t.encode_batch(whole, add_special_tokens=False))


def test_counts_are_the_librarys(docs, rows, clashing, empty):
    t = Tokenizer.from_file(BPE)
    want = sorted(((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=key)
    for df in (docs, clashing):
        assert sorted((tuple(r) for r in count_tokens(df, BPE).collect()), key=key) == want
    assert count_tokens(empty, BPE).isEmpty()


@pytest.mark.parametrize("chunk", [50, 1 << 16])
def test_ids_are_the_librarys_and_round_trip(docs, rows, clashing, empty, chunk):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r[0], sp.encode(r[1] or "")) for r in rows), key=key)
    for df in (docs, clashing):
        found = pieces.decode(pieces.encode(df, PIECES, chunk), PIECES).select("row.doc_id", "row.text", "ids", "decoded", "chunks").collect()
        assert sorted(((r.doc_id, r.ids) for r in found), key=key) == want
        assert all(r.decoded == (r.text or "").replace(pieces.MARK, " ") for r in found)
        assert (max(r.chunks for r in found) > 1) == (chunk == 50)
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).isEmpty()


def test_cuts_are_safe():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces.check_marks(sp)
    text = "  a b  c   d\ne f " * 9
    known = pieces._Units(open(PIECES, "rb").read())
    for t in (text, "", " ", "  ", "a", " a", "a ", "a  b", "a b"):
        assert b"".join(known[u] for u in pieces.units(t)) == np.array(sp.encode(t), np.int32).tobytes()


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decode(df, PIECES).orderBy("k").collect()] == [None, ""]


def odd_text(rng, n):
    some = ["the", "tion", "a", "e", " ", " ", "  ", " " * 20, "\n", "\t", "\x00", "\u00e9", "e\u0301", "\u65e5\u672c", "\U0001f600", "\ue000", "=", "====", "0", "1234", "\u2581", "ing", "ABC", "</s>", "<0x41>"]
    return "".join(rng.choice(some) for _ in range(n))


@pytest.mark.parametrize("chunk", [17, 40, 400])
def test_scans_give_the_librarys_ids(spark, chunk):
    """Chunks cut anywhere in texts of all kinds, one without any space."""
    import random

    rng, sp = random.Random(chunk), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [odd_text(rng, rng.choice((10, 60, 300))) for _ in range(40)] + ["x" * 900, " " * 333, "ab" * 500, "the" * 300, "aaaaaaaab" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.ids for r in pieces.encode(df, PIECES, chunk).select("row.doc_id", "ids").collect()}
    for k, text in enumerate(texts):
        assert found[k] == sp.encode(text), text


def test_matrices_combine_associatively():
    import random

    from spanloom.llm.merge_scan import Merges, between, product

    rng, sp = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table, _, longest = pieces.merge_table(sp)
    merges = Merges({p: s for p, (_, s) in table.items()})
    for _ in range(8):
        text = pieces.MARK + odd_text(rng, 60).replace(" ", pieces.MARK)
        whole = merges.trace(text, 0, len(text), 0, 0)
        assert [sp.id_to_piece(i) for i in sp.encode(text[1:])] == [q for p in whole for q in ([p] if p in table else [f"<0x{b:02X}>" for b in p.encode()])]
        cuts = [*range(0, len(text), 20), len(text)]
        ms = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            low = max(0, a - longest)
            ms.append(merges.matrix(text[low : b + longest], a - low, b - low))
        assert (product([product(ms[:2]), product(ms[2:])]) == product([ms[0], product(ms[1:])])).all() and product(ms).tolist() == [0]
        states, parts = between(ms, 0, 0), []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            low = max(0, a - longest)
            parts += merges.trace(text[low : b + longest], a - low, b - low, states[k], states[k + 1])
        assert parts == whole
