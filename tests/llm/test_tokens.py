import hashlib
import random

import pytest
from tokenizers import Tokenizer

from joblode.llm import bpe, tokens
from tests.llm.conftest import BYTE, TEXTS, WORD

ODD = ["", "  ", "Hello  world's test 'test don't\n\n x", "ΑΣ Σίσυφος ὈΔΥΣΣΕΎΣ", "日本語 ½ ² x²", "<|endoftext|>a <|startoftext|> <|x",
       "é É İ", "a" * 3000, "\x1c\x85\xa0 n　x", "🙂🙂", "ß ſ K Å ǅ", "\u0000­​", "12345 1½", "'S 'LL I'LL", "x \n y", "\n"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab cé\n\t'st12.,  #É<|") for _ in range(rng.randrange(40))) for _ in range(800)]


@pytest.mark.parametrize("forced", [True, False])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_same_as_the_library(path, forced, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 200)  # tables are emptied on the way
    library, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path, forced)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain():
    own = bpe.ForcedBoundaryBPE(WORD)
    assert own.fragments("qjxq") != ["qjxq"] and "".join(own.fragments("qjxq")) == "qjxq"
    pairs = {a + b for t in own.vocab for a, b in zip(t.removesuffix("</w>"), t.removesuffix("</w>")[1:])}
    for word in ("therefore", "zqxjkv", "a", "ééé"):
        parts = own.fragments(word)
        assert all(a[-1] + b[0] not in pairs for a, b in zip(parts, parts[1:]))


def test_documents(odd, empty):
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, tokens.round_trip_digests(odd, WORD).collect()))) == sorted(map(str, want))
    encoded = tokens.encode_documents(odd, BYTE)
    back = tokens.decode_documents(encoded, BYTE)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((i, t or "")) for i, t in TEXTS)
    for made in (tokens.round_trip_digests(empty, WORD), tokens.encode_documents(empty, BYTE)):
        assert made.count() == 0
