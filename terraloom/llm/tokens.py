"""Token ids of whole Arrow text columns by a given tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces, and distinct strings that merges see, whose ids a worker remembers between batches.
REMEMBERED = 300_000
#: Texts where a blank touches other white space, or a separator other than the line feed, are encoded in one go.
IRREGULAR = r"^[\s\v\x1c-\x1f\x85\p{Z}]|[\s\v\x1c-\x1f\x85\p{Z}]$|[\s\v\x1c-\x1f\x85\p{Z}] | [\s\v\x1c-\x1f\x85\p{Z}]"
#: Marks that end a word, and the first code point past the Latin letters whose class every Unicode version agrees on.
MARKS, LATIN_END = ".,;:!?|", "\u0250"


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


BYTE_NAMES = _byte_names()
BLANK = BYTE_NAMES[32]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Encodes texts piece by piece, each distinct piece once.

    `joined` tells whether a blank belongs to the piece after it (byte-level files) or is dropped (word files). Both kinds of
    tokenizer cut at a blank between two other characters before any merge, so the pieces of a regular text encode
    independently; texts with other white space around blanks, or with a string that the file adds as one token
    (end-of-text marks and the like), are encoded whole.
    """

    def __init__(self, path: str, joined: bool, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([IRREGULAR, *([f"(?i:{'|'.join(added)})"] if added else [])])
        self.joined, self.end_id = joined, end_id
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.seen: dict[str, bytes] = {}
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def pretokens(self, word: str, opened: bool) -> list[str]:
        """The strings that the tokenizer's merges see, of a piece that a blank opens or not.

        A Latin word, also with marks after it, is cut here; anything else by the tokenizer itself.
        """
        base = word.rstrip(MARKS)
        if base.isalpha() and (base.isascii() or max(base) < LATIN_END):
            x = base if self.joined else base.lower()
            if x.isascii() or x.isalpha():
                if not x.isascii():
                    x = x.encode().decode("latin-1").translate(BYTE_NAMES)
                if opened:
                    x = BLANK + x
                return [x] if base == word else [x, word[len(base):]]
        piece = " " + word if opened else word
        if self.tokenizer.normalizer is not None:
            piece = self.tokenizer.normalizer.normalize_str(piece)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def pieces(self, words: list[str], opened: bool) -> list[bytes]:
        known, seen, tokenize, pretokens, out = self.known[opened], self.seen, self.tokenizer.model.tokenize, self.pretokens, []
        new, fresh = {}, {}
        for word in words:
            coded = known.get(word)
            if coded is None:
                coded = b""
                for x in pretokens(word, opened):
                    ids = seen.get(x)
                    if ids is None:
                        ids = fresh.get(x)
                        if ids is None:
                            ids = fresh[x] = array("i", [t.id for t in tokenize(x)]).tobytes()
                    coded = coded + ids if coded else ids
                new[word] = coded
            out.append(coded)
        for kept, found in ((known, new), (seen, fresh)):
            if (room := REMEMBERED - len(kept)) > 0:
                kept.update(islice(found.items(), room))
        return out

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text with the end id appended; null encodes as empty."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        firsts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        forms = self.pieces(words, self.joined)
        if self.joined:
            opening = np.unique(index[firsts])
            forms += self.pieces([words[i] for i in opening], False)
            index[firsts] = len(words) + np.searchsorted(opening, index[firsts])
        sizes = np.fromiter(map(len, forms), np.int64, len(forms)) // 4
        table = np.frombuffer(b"".join(forms), np.int32)
        at = np.cumsum(sizes) - sizes
        out, end = [], np.int32(self.end_id)
        for s in range(0, len(ends), 256):  # a few documents at a time, so that the gathered positions stay small
            piece = index[firsts[s]:ends[min(s + 256, len(ends)) - 1]]
            counts = sizes[piece]
            total = np.cumsum(counts)
            flat = table[np.repeat(at[piece] - (total - counts), counts) + np.arange(total[-1])]
            before = 0
            for i, bound in enumerate(total[ends[s:s + 256] - 1 - firsts[s]].tolist(), s):
                out.append(np.append(self.whole(texts[i].as_py()) if odd[i] else flat[before:bound], end))
                before = bound
        return out


@lru_cache(maxsize=4)
def coder(path: str, joined: bool, end_id: int) -> Coder:
    return Coder(path, joined, end_id)
