"""The chunk cache against whole-text encoding."""

import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import tokens

PATHS = {tokens.BYTE_CHUNKS: "byte_bpe_50k.json", tokens.WORD_CHUNKS: "word_bpe_49k.json"}
PLAIN = {}
for kind, name in PATHS.items():
    PLAIN[kind] = Tokenizer.from_file(public_tokenizers.path(name))
    PLAIN[kind].encode_special_tokens = True
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 　᠎́\x00aB'sé1.-ß語"), st.characters(codec="utf-8")), max_size=40)


def whole(kind, text):
    return list(PLAIN[kind].encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("kind", PATHS)
def test_chunks_give_the_ids_of_the_whole_text(kind):
    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[kind]), kind, cache_entries=50)

    @settings(max_examples=1500, deadline=None)
    @given(TEXT)
    def same(text):
        data = enc.encode([text])[0]
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == whole(kind, text)

    same()
    for text in ("", " ", "\n", "a  b", "a\n\nb", "a \n b", " a", "a ", "it's <|endoftext|> x", "x" * 5000, "\x00a \x00", "a\x00 b"):
        data = enc.encode([text])[0]
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == whole(kind, text), text


def test_plain_words_need_no_sign_between(monkeypatch):
    """Words of letters, with or without signs at their end, are cut after the tokens that end them; what this can't tell takes the longer way."""
    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[tokens.WORD_CHUNKS]), tokens.WORD_CHUNKS)
    signed, seen = enc._encode_signed, []
    monkeypatch.setattr(enc, "_encode_signed", lambda chunks: seen.append(sorted(chunks)) or signed(chunks))
    text = "Straße, Ñandú! enchenbe.$$$ äbege### plain ab,`$_ x2 don't a.b \u0130x \xb5m \ufb01n \xd7 l's --"
    data = enc.encode([text])[0]
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == whole(tokens.WORD_CHUNKS, text)
    assert seen == [sorted(["x2", "don't", "a.b", "\u0130x", "\xb5m", "\ufb01n", "\xd7", "l's", "--"])]
    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[tokens.WORD_CHUNKS]), tokens.WORD_CHUNKS)
    enc.last[:] = False  # a vocabulary whose words end otherwise
    assert enc._encode_plain(text.split()) == {}
    assert enc.encode([text])[0] == data


@pytest.mark.parametrize("kind", PATHS)
def test_texts_are_looked_up_together(kind, monkeypatch):
    """One call of the library for all new chunks of a stretch of texts; each text's ids stay its own."""
    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[kind]), kind)
    texts = [f"word{chr(97 + i)} common wordy Straße{i} {'x' * 60}{i}\n\nend" for i in range(20)] + ["", "odd\x1ctext here", "common"]
    calls, encode = [], enc._encode_chunks
    monkeypatch.setattr(enc, "_encode_chunks", lambda chunks: calls.append(len(chunks)) or encode(chunks))
    got = [list(struct.unpack(f"<{len(d) // 4}I", d)) for d in enc.encode(texts)]
    assert got == [whole(kind, t) for t in texts] and len(calls) == 1
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    assert [list(struct.unpack(f"<{len(d) // 4}I", d)) for d in enc.encode(texts)] == got


@pytest.mark.parametrize("kind", PATHS)
def test_each_different_chunk_is_looked_up_once(kind, monkeypatch):
    """However often the texts of a stretch repeat a chunk; new chunks go to the library in calls of bounded size."""

    class Seen(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[kind]), kind)
    enc.known = Seen()
    texts = ["common words come\nagain, Straße \u00ad again", "common words", "a  b\tc common", "", "odd\x1cone"] * 20
    monkeypatch.setattr(tokens, "_CALL", 2, raising=False)
    for _ in range(2):
        enc.known.asked = 0
        assert [list(struct.unpack(f"<{len(d) // 4}I", d)) for d in enc.encode(texts)] == [whole(kind, t) for t in texts]
        assert enc.known.asked <= 15


def test_starts_of_lines_are_encoded_with_the_words(monkeypatch):
    enc = tokens.ChunkEncoder(public_tokenizers.path(PATHS[tokens.BYTE_CHUNKS]), tokens.BYTE_CHUNKS)
    alone, encode = [], enc._encode
    monkeypatch.setattr(enc, "_encode", lambda texts: alone.extend(texts) or encode(texts))
    texts = ["first line\nsecond, line\n'third' line\n(4) 語 line\n\u0301x end", "other\n\ntext \n  x"]
    assert [list(struct.unpack(f"<{len(d) // 4}I", d)) for d in enc.encode(texts)] == [whole(tokens.BYTE_CHUNKS, t) for t in texts]
    assert "first" in alone and not {"\nsecond,", "\n'third'", "\n(4)", "\n\u0301x"} & set(alone)
