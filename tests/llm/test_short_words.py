"""Words that are searched beside their neighbours in order get the ids of the stream and of the library."""

import random

import pytest

pytest.importorskip("weftgraph.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from weftgraph.llm import pieces  # noqa: E402

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "aa", "aaaaaaa", "日本語", "日本語x", "é" * 40, "𝔘𝔫𝔦", "▁", "▁▁a", "  b", "\n\nx", "\x00", "<s>", "<0x41>", "x" * 1001]


def test_words_in_order():
    rng, sp = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    start = ["inter", "internation", "un", "re", "Straße", "日本", "the", "q́"]
    words = [*ODD, *(rng.choice(start) + "".join(rng.choice("etaoinshrdlu-éß日\t") for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    own, streams = pieces.Pieces(PIECE_BPE), []
    streamed = own.stream
    own.stream = lambda chars: streams.append(chars) or streamed(chars)
    got = [x.tolist() for x in own.ids(words)]
    assert got == [sp.encode(w) for w in words]
    assert [x.tolist() for x in own.ids(words[::-1])] == got[::-1] and own.counts(words).tolist() == [len(x) for x in got]
    assert all(len(x) > pieces.SHORT for x in streams)
    other = pieces.Pieces(PIECE_BPE)
    assert [[i for p in other.stream((pieces.SPACE + w).replace(" ", pieces.SPACE) if w else "") for i in other.piece_ids(p)] for w in words] == got
