"""Token ids from the public tokenizers, with a bounded cache of chunk encodings.

Both vocabularies split a text at white space before any merge takes place, so
the ids of a text are the ids of its chunks, joined. Natural text repeats its
chunks; each is encoded by the tokenizers library once and then looked up.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: Kinds of vocabulary: byte-level, where a word takes one blank before it, and one that drops white space.
BYTE_CHUNKS, WORD_CHUNKS = "byte", "word"
#: White space to Python alone, or differing by version; such texts are encoded whole.
_ODD = re.compile(r"[\x1c-\x1f\u180e]")
#: White space other than blank and line feed, or the mark itself: chunks of such texts are found by the vocabulary's own split.
_OTHER = re.compile(r"[^\S \n]|\x00")
_SPLIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Chunks of Latin letters, with signs but no apostrophe at their end: two words at most to a vocabulary that drops white space.
_PLAIN = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+([!-&(-/:-@\[-`{-~]*)")
#: How a token that ends a word is spelled.
_LAST = "</w>"
#: A sign that is a token of its own, put between chunks.
_SIGN = "\x01"
#: Longer chunks are encoded each time, so that a cache entry has a bounded size.
LONGEST_CACHED = 48
#: Chunks in a generation of the cache, about 150 bytes each.
CACHE_ENTRIES = 700_000
#: Chunks encoded in one call, about 1000 bytes each until it ends.
_CALL = 1 << 14
#: Characters of text whose chunks are looked up together.
TOGETHER = 1 << 22


class ChunkEncoder:
    """Encodes texts with one tokenizer file; at most ``2 * cache_entries`` chunks are kept, those used last."""

    def __init__(self, path: str, kind: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.most = cache_entries
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks = {BYTE_CHUNKS: self.byte_chunks, WORD_CHUNKS: str.split}[kind]
        self.plain = self.unmarked if kind == BYTE_CHUNKS else str
        self.sizes = self.sign_id = self.last = None
        self.spaced = (lambda t: "\x00" + t.replace("\n", " \x00\n")) if kind == BYTE_CHUNKS else (lambda t: t.replace("\n", " "))
        if kind == BYTE_CHUNKS:
            by_id = sorted((k, len(t)) for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items())
            self.sizes = np.zeros(by_id[-1][0] + 1, np.int64)
            self.sizes[[k for k, _ in by_id]] = [n for _, n in by_id]
            self.joint = lambda c: c[0] != "\x00" or (c[1] == "\n" and not c[-1].isspace())
            self.joined = "".join
        else:
            self.sign_id = self.tokenizer.encode(_SIGN, add_special_tokens=False).ids[0]
            self.joint, self.joined = (lambda c: _SIGN not in c), (lambda some: f" {_SIGN} ".join(some) + f" {_SIGN}")
            vocab, words = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.pre_tokenizer
            ends = [k for t, k in vocab.items() if t.endswith(_LAST)]
            if ends and words and all(len(words.pre_tokenize_str(c)) == n for c, n in (("aZé", 1), ("ab.", 2), ("ab,`$_", 2))):
                self.last = np.zeros(max(vocab.values()) + 1, bool)
                self.last[ends] = True

    @staticmethod
    def byte_chunks(text: str) -> list[str]:
        """The chunks of a text: a bare word stands for one with a blank before it, any other chunk has a mark before it.

        Where single blanks and line feeds stand between words, cutting at them
        gives what the vocabulary's split gives; other texts take that split.
        """
        if not _OTHER.search(text):
            out: list[str] = []
            for line in text.split("\n"):
                words = line.split(" ")
                if "" in words:
                    break
                words[0] = f"\x00\n{words[0]}"
                out += words
            else:
                out[0] = f"\x00{out[0][2:]}"
                return out
        return [f"\x00{c}" for c in _SPLIT.findall(text)]

    @staticmethod
    def unmarked(chunk: str) -> str:
        return chunk[1:] if chunk[0] == "\x00" else f" {chunk}"

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in found]

    def _encode_plain(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of those chunks whose number of words is known beforehand: encoded as one text, cut after the tokens that end words. None, if the numbers differ."""
        words = {c: 1 + bool(m[1]) for c in chunks if (m := _PLAIN.fullmatch(c))}
        if len(words) < 4:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends, upto = np.flatnonzero(self.last[ids]) + 1, np.cumsum(list(words.values()))
        if len(ends) != upto[-1] or ends[-1] != len(ids):
            return {}
        cuts, data = (4 * ends[upto - 1]).tolist(), ids.tobytes()
        return dict(zip(words, (data[i:j] for i, j in zip([0, *cuts], cuts))))

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk: those that white space may join are encoded as one text and cut apart."""
        if self.last is not None and (plain := self._encode_plain(chunks)):
            rest = [c for c in chunks if c not in plain]
            plain.update(zip(rest, self._encode_signed(rest)))
            return [plain[c] for c in chunks]
        return self._encode_signed(chunks)

    def _encode_signed(self, chunks: list[str]) -> list[bytes]:
        joint = [c for c in chunks if self.joint(c)]
        if len(joint) < 4:
            return self._encode([self.plain(c) for c in chunks])
        plain = list(map(self.plain, joint))
        ids = np.array(self.tokenizer.encode_batch_fast([self.joined(plain)], add_special_tokens=False)[0].ids, "<u4")
        if self.sizes is not None:  # a token's bytes are those of its text
            sizes = pc.binary_length(pa.array(plain, pa.large_string()))
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
            starts = np.concatenate([[0], ends[:-1]])
        else:  # the sign between chunks has an id of its own
            ends = np.flatnonzero(ids == self.sign_id)
            starts = np.concatenate([[0], ends[:-1] + 1])
        data = ids.tobytes()
        found = dict(zip(joint, (data[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist()))))
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._encode([self.plain(c) for c in rest])))
        return [found[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._encode_together(some)
                some, size = [], 0
        return out + self._encode_together(some)

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        """Texts with single blanks and line feeds between words are cut by Arrow; each different chunk of all texts is looked up once."""
        out = [b""] * len(texts)
        even, other = [], []
        for k, text in enumerate(texts):
            if _even(text):
                even.append(k)
            elif _ODD.search(text):
                out[k] = self._encode([text])[0]
            else:
                other.append(k)
        cut = pc.split_pattern(pa.array([self.spaced(texts[k]) for k in even], pa.large_string()), " ")
        chunks = [self.chunks(texts[k]) for k in other]
        every = pa.concat_arrays([cut.flatten(), pa.array(chain(*chunks), pa.large_string())]).dictionary_encode()
        if not len(every):
            return out
        ids = pa.array(self._ids(every.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(every.indices)
        _, offsets, data = ids.buffers()
        counts = np.concatenate([pc.list_value_length(cut), [len(c) for c in chunks]])
        ends = np.frombuffer(offsets, np.int64)[np.cumsum(counts, dtype=np.int64)].tolist()
        for k, start, end in zip(even + other, [0, *ends], ends):
            out[k] = data[start:end].to_pybytes()
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks; many of those that are missed are encoded in one call, whose start costs as much as many chunks."""
        got = list(map(self.known.get, chunks))
        missed = [c for c, x in zip(chunks, got) if x is None]
        found = {c: self.older[c] for c in missed if c in self.older}
        new = [c for c in missed if c not in found]
        for some in (new[k : k + _CALL] for k in range(0, len(new), _CALL)):
            found.update(zip(some, self._encode_chunks(some)))
        self.known.update(found)
        for c in [c for c in missed if len(c) > LONGEST_CACHED]:
            del self.known[c]
        if len(self.known) > self.most:  # a full generation becomes the older one; what is used of it comes back
            self.known, self.older = {}, self.known
        return [found[c] if x is None else x for c, x in zip(chunks, got)]


def _even(text: str) -> bool:
    """Whether single blanks and line feeds, and no other white space, stand between words only. Any other white space and the mark are unprintable."""
    if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
        return False
    return text.replace("\n", "").isprintable() or not (_ODD.search(text) or _OTHER.search(text))


def encoder(path: str, chunks: str) -> ChunkEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    return worker_cache(f"encoder:{chunks}:{path}", lambda: ChunkEncoder(path, chunks))
