"""Token files: round trips, and boundaries by selection."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents
from tokenizers import Tokenizer

from tendero.llm.elias_fano import EliasFano
from tendero.llm.token_files import Encoder, TokenFile, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5], [0, 1, 2, 3], [0, 10**9, 10**9, 10**12], list(range(0, 70000, 7)), [0] * 1000 + [9999]])
def test_selection_gives_every_number(values):
    coded = EliasFano.of(np.array(values))
    head, parts = coded.parts()
    again = EliasFano.from_parts(head, parts)
    for first in {0, 1, 255, 256, 257, len(values) - 1}:
        for last in {first, first + 1, first + 300, len(values)}:
            if first <= last <= len(values):
                assert again.between(first, last).tolist() == values[first:last]
    assert again.all().tolist() == values and [again.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        again.select(len(values))


def test_pieces_encode_like_whole_texts():
    pick = random.Random(2)
    letters = ["a", "word", " ", "  ", "\n", " \n", "\t", ".", ",x", "é", "ß", "1", "'s", "<|endoftext|>", "\u00a0", "\u2003", "日本", "\x1c", "_", ")", "...", "?", "don't", ":", "Ж", "\0"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(30))) for _ in range(3000)]
    whole = Tokenizer.from_file(PATH)
    encode = Encoder(PATH)
    for text in texts:
        made = encode.encode(text)
        assert np.frombuffer(made, encode.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("settings", [{}, {"FILE_BYTES": 3000}, {"FILE_DOCUMENTS": 2}, {"READ_IDS": 5, "READ_DOCUMENTS": 3}])
def test_documents_come_back_in_order(docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(f"tendero.llm.token_files.{name}", value)
    whole = Tokenizer.from_file(PATH)
    wanted = {}
    for i, text, *_ in documents():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    files = write_tokens(docs, PATH)
    rows = sorted(read_tokens(files).collect(), key=lambda r: r["start"])
    at, ids = 0, []
    for r in rows:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in wanted[r["doc_id"]]
        at += r["n_tokens"]
        ids.append(r["doc_id"])
    assert len(rows) == len(documents()) and ids == sorted(ids, key=lambda i: -1 if i is None else i)
    file = TokenFile(files.first()["uri"])
    assert [file.document(i).tolist()[-1] for i in range(len(file))] == [0] * len(file)


def test_empty_table(no_docs):
    assert read_tokens(write_tokens(no_docs, PATH)).collect() == []
