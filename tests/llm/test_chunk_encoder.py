"""The encoder behind packing: ids as by the tokenizer itself, and no more words encoded than are new."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from keelstone.llm import packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\t\n\x0b\x0c\r", "the", " the ", "THE Cat's, it's don't 'S x'", "a.b.c... (x) [y] {z}~ `q`", "...", "x1! 1x? 12.5% é. É! ñ,", "ÀÉÎ Σίσυφος ΟΔΟΣ İstanbul ǅ ﬁ ﬀ.",
    "é. àb ́x ñ̃", "日本語、テスト。 한국어 한", "a b c\u0085d　e\x1cf\x00g", "<|startoftext|> hi <|endoftext|>. <| x", "😀😀 ok😀. 👩‍👩‍👧", "²³ ½ Ⅷ ٣٤ _a_ a_. 5_", "\U0001e900\U0001e922 ꟊ ß ẞ",
]


def made(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    syllables = ["the", "ou", "è", "ción", "Sch", "ing", "ß", "n't", "x1", "'s", "日", "İ"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "&&&", "!?", "'"])
    return [rng.choice([" ", "", "\n"]).join(word() + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("run", "known"), [(4 << 20, 600_000), (700, 40), (30, 1)])
def test_ids_are_those_of_the_tokenizer(monkeypatch, run, known):
    monkeypatch.setattr(packing, "RUN_BYTES", run)
    monkeypatch.setattr(packing, "KNOWN_WORDS", known)
    texts = ODD + made(150, run) + ["a " * 3 + "<|endoftext|>" + " Long" * 40] + ODD
    encode, whole = packing.ChunkEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    found = []
    for kind in (pa.string(), pa.large_string()):
        for part in packing._runs(pa.array(["before é", *texts], kind).slice(1)):
            ids, bounds = encode(part)
            assert ids.dtype == np.uint32 and len(bounds) == len(part) + 1 and bounds[-1] == len(ids)
            found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == 2 * [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_only_new_words_are_encoded():
    encode, encoded = packing.ChunkEncoder(WORD_BPE), []
    real = encode.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            encoded.append(sum(len(t.split()) for t in texts))
            return real.encode_batch_fast(texts, **options)

    encode.tokenizer = Counted()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(w) for n, w in zip(range(500_000), ((a, b, c, d) for a in letters for b in letters for c in letters for d in letters), strict=False)]
    words = [*words, *(w + "q" for w in words[: 500_000 - len(words)])]
    parts = [" ".join(words[at : at + 125_000]) for at in range(0, 500_000, 125_000)]
    for text in parts:
        encode(pa.array([text]))
    assert sum(encoded) == 500_000
    # again, in capitals and with signs at the end: nothing is new but the signs
    for text in parts:
        encode(pa.array([text.upper().replace(" ", "!? ")]))
    assert sum(encoded) == 500_001
