"""Encoding whole texts with a public tokenizer inside tasks, each distinct piece once.

word_bpe_49k folds case, cuts a text into pieces (letters, single digits, other marks; white space is dropped) and
encodes each piece by itself. No piece holds white space, so a word's ids are its pieces' ids. For texts within Latin-1,
where folding and Unicode composition change no lengths, a worker cuts a run of texts into words at ASCII white space and
looks each distinct word up once. Ids of words and pieces that it has met stay in a table; new words are cut into pieces by
the same pattern, and only new pieces go to the library's model. Any other text, and one that may hold a special token's
string, goes to the library whole; so does every text, if the file's own steps aren't the ones that are written here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from .common import single_threaded

#: Bounds of a worker's table: longer words and pieces are encoded each time, and a full table starts anew with the next words.
LONGEST_KEPT, MOST_KEPT = 40, 1_000_000
#: Characters of a run of texts, if it isn't a single longer text, and words that are looked up at once.
RUN, WORDS = 4_000_000, 1_000_000
#: The steps of word_bpe_49k that pieces are cut for.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTER, _NUMBER, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class WordEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        own = json.loads(self.tokenizer.to_str())
        self.by_piece = all(own.get(k) == v for k, v in _STEPS.items())
        self.letters = _byte_letters()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"\Z\A")
        self.kept: dict[str, bytes] = {}

    def _encoded(self, pieces: Iterable[str]) -> list[bytes]:
        import numpy as np

        tokenize, ids, ends = self.model.tokenize, [], [0]
        for p in pieces:
            if not p.isascii() or not p.isprintable():
                p = p.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in tokenize(p)]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words and of their pieces."""
        kept, cut = self.kept, [(w, _PIECE.findall(w)) for w in words if not w.isalpha()]
        new = dict.fromkeys(filter(str.isalpha, words))
        new.update(dict.fromkeys([p for _, pieces in cut for p in pieces if p not in kept]))
        kept.update(zip(new, self._encoded(new), strict=True))
        kept.update([(w, b"".join([kept[p] for p in pieces])) for w, pieces in cut])

    def _long(self, words: list[str]) -> list[bytes]:
        """ids of words that aren't kept."""
        cut = [_PIECE.findall(w) for w in words]
        self._learn([p for p in {p for pieces in cut for p in pieces} if len(p) <= LONGEST_KEPT and p not in self.kept])
        return [b"".join([self.kept[p] if len(p) <= LONGEST_KEPT else self._encoded([p])[0] for p in pieces]) for pieces in cut]

    def _looked_up(self, words):
        """ids of words, an array of large_string, as one of large_binary."""
        import numpy as np
        import pyarrow as pa

        if len(self.kept) >= MOST_KEPT:
            self.kept.clear()
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.kept.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in new if len(distinct[i]) <= LONGEST_KEPT])
        for i in new:
            found[i] = self.kept.get(distinct[i])
        if long := [i for i in new if found[i] is None]:
            places = np.flatnonzero(np.isin(which, long))
            ids, which = self._long([distinct[i] for i in which[places].tolist()]), which.copy()
            which[places] = np.arange(len(found), len(found) + len(ids))
            found += ids
        return pa.array(found, pa.large_binary()).take(pa.array(which))

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.by_piece and not self.special.search(text)

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = list(map(self._plain, texts))
        lists = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        words = lists.flatten()
        ids = pa.concat_arrays([self._looked_up(words.slice(at, WORDS)) for at in range(0, len(words), WORDS)] or [pa.array([], pa.large_binary())])
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[lists.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for t, p, a, b in zip(texts, plain, ends, ends[1:], strict=False):
            yield bytes(data[a:b]) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= RUN:
                yield from self._run(run)
                run, size = [], 0
        if run:
            yield from self._run(run)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
