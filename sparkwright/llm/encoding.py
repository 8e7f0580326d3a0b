"""Token ids of many texts by a public tokenizer of the tokenizers library, word by word.

The vocabulary file's rules never join characters across white space, so a text's ids are those of
its white-space-separated words in turn. A word of Latin letters followed by ASCII punctuation other
than an apostrophe falls into two pieces there, which its rules lower-case, map to byte symbols and
hand to the merges; for such pieces that is done here, and the library's model merges. Any other word
goes through the whole of the library. Words of a batch are told apart by Arrow; each process keeps
the ids of the pieces that it has met. Ids are the library's in every case, which the tests hold
against it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
LATIN = "\u0250"  # the first character beyond the Latin letters whose case and form are simple
CHUNK = 500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _ends(words: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """The last bytes of each word, as many as told."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    upto = np.cumsum(sizes)
    at = np.repeat(ends - upto, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)
    own = np.frombuffer(data, np.uint8)[at] if data is not None else np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], upto]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(own))


class WordEncoder:
    """Of one vocabulary file; end_id, if given, closes each text. max_pieces bounds what is kept."""

    def __init__(self, path: str, end_id: int | None = None, max_pieces: int = 600_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        ends = [i for w, i in self.library.get_vocab(True).items() if w.endswith("</w>")]
        self.is_end = np.zeros(self.library.get_vocab_size(True), bool)
        self.is_end[ends] = True
        self.symbols = {k: v for k, v in byte_symbols().items() if k != 32}
        self.end_id, self.max_pieces = end_id, max_pieces
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        if self.end_id is not None:
            self._add_pieces(["\0end"], np.array([self.end_id], np.int32), np.array([1]))

    def _add_pieces(self, names: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """ids of these pieces one after the other, and where each one's end."""
        first = len(self.pieces)
        n = first + len(names)
        while n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[first:n] = sizes = np.diff(ends, prepend=0)
        self.starts[first:n] = self.used + ends - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.pieces.update(zip(names, range(first, n)))

    def _encode_simple(self, pieces: list[str]) -> None:
        mapped = [p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols) for p in pieces]
        texts = [" ".join(mapped[at : at + CHUNK]) for at in range(0, len(mapped), CHUNK)]
        ids = np.array([i for e in self.merges.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        (cuts,) = np.nonzero(self.is_end[ids])
        if len(cuts) != len(pieces):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        self._add_pieces(pieces, ids, cuts + 1)

    def _encode_whole(self, names: list[str], texts: list[str]) -> None:
        found = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self._add_pieces(names, np.array([i for e in found for i in e], np.int32), ends)

    def _numbers(self, names: pa.Array, simple: bool) -> np.ndarray:
        """Of pieces, which may repeat, their numbers; new ones are encoded."""
        coded = names.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not simple:
            own = ["\0" + w for w in own]
        found = list(map(self.pieces.get, own))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            new, first = [own[i] for i in at], len(self.pieces)
            if simple:
                self._encode_simple(new)
            else:
                self._encode_whole(new, [w[1:] for w in new])
            for i, k in enumerate(at):
                found[k] = first + i
        return np.array(found, np.int32)[coded.indices.to_numpy()]

    def _pieces_of(self, words: pa.Array) -> np.ndarray:
        """(n, 2): the numbers of the pieces of distinct words; 0 for none."""
        core = pc.utf8_rtrim(words, PUNCTUATION)
        tail = _ends(words, pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy())
        plain, dotted = pc.string_is_ascii(core), pc.match_substring(core, "\u0130")  # that letter's lower case has a mark
        core = pc.if_else(plain, pc.ascii_lower(core), pc.utf8_lower(core))
        simple = pc.or_(pc.equal(core, ""), pc.and_(pc.utf8_is_alpha(core), pc.or_(plain, pc.invert(pc.match_substring_regex(core, f"[^\0-{chr(ord(LATIN) - 1)}]")))))
        simple = pc.and_not(simple, dotted).to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), 2), np.int32)
        out[simple, 0] = self._numbers(core.filter(pa.array(simple)), True)
        out[simple, 1] = self._numbers(tail.filter(pa.array(simple)), True)
        if not simple.all():
            out[~simple, 0] = self._numbers(words.filter(pa.array(~simple)), False)
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Null counts as empty."""
        return self.encode_words(texts)[:2]

    def encode_words(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """As encode(), and the texts' words: the distinct ones, which stands at each place, and how many each text has."""
        if len(self.pieces) > self.max_pieces:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        which, own = coded.indices.to_numpy(), counts
        both = self._pieces_of(coded.dictionary)[which]
        if self.end_id is not None:
            both = np.insert(both, np.cumsum(counts), (1, 0), 0)
            counts = counts + 1
        both = both.ravel()
        sizes = self.sizes[both]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[both] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds), coded.dictionary, which, own


_KEPT: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int | None = None, max_pieces: int = 600_000) -> WordEncoder:
    """This process's encoder of that file; further tasks find its pieces there."""
    key = (path, end_id, max_pieces)
    if key not in _KEPT:
        _KEPT[key] = WordEncoder(path, end_id, max_pieces)
    return _KEPT[key]
