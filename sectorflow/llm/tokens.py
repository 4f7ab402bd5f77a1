"""Token ids of whole texts by public tokenizers, fast.

The ids are those that the tokenizers library gives for the whole text with the given file. Most texts take a shorter
way to the same ids, with byte-pair ranks read from that file (tests hold every merge of the files against the ranks):

- byte-level files: text whose characters are in long-settled blocks goes through a rank encoder with the same split
  pattern, as a whole.
- word-level files (white space dropped, `</w>` behind a word's last symbol): words repeat, so the texts of a group are
  split at spaces and line breaks and each distinct word is encoded once. Words of printable Latin-1 characters are cut into
  pieces of one kind and ranked all together, with the byte 0x01, which they do not hold, as the end mark; others go to the
  library. All of this works on Arrow buffers, not on words as objects.

Special tokens written out in a text, and anything unusual, go to the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 16 << 20  # bytes of text whose words are encoded together: what a worker holds is bounded by it
#: The split patterns of the two tokenizer files.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKED_SPLIT = "[^\x01]+\x01"  # a text of pieces with their end marks
_SETTLED = re.compile("[^\\x00-ԯ‐-‧‰-⁞぀-ヾ一-龥가-힣]")
MARKED_SPLIT = "[^\x01]+\x01"  # a text of pieces with their end marks
_SETTLED = re.compile("[^\\x00-ԯ‐-‧‰-⁞぀-ヾ一-龥가-힣]")
_PRINTABLE = re.compile("[!-~\xa1-\xff]+")
#: Letters are one piece, each number is one, anything else in a row is one: without an apostrophe that is all the file's pattern does.
_KIND = np.array([{"L": 0, "N": 1}.get(unicodedata.category(chr(c))[0], 2) for c in range(256)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)], np.uint8)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]]:
    """Byte strings of a tokenizer file with their ids, its merges in order, its special tokens. `</w>` becomes 0x01."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), [t["content"] for t in spec["added_tokens"]]

    def raw(token: str) -> bytes:
        end = token.endswith("</w>") and len(token) > 4
        return bytes(alphabet[c] for c in (token[:-4] if end else token)) + b"\x01" * end

    ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    return ranks, merges, special


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process, kept over its tasks."""
    return Encoder(path, kind)


class Encoder:
    def __init__(self, path: str, kind: str):
        """kind: "word" (white space is dropped and always separates) or "byte" (a space belongs to the next word)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        ranks, _, self.special = ranks_of(path)
        if len(ranks) + len(self.special) != self.tok.get_vocab_size():
            raise ValueError("the file's tokens are not told apart by their bytes")
        self.ranked = tiktoken.Encoding(kind, pat_str=BYTE_SPLIT if kind == "byte" else MARKED_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.final = np.zeros(max(ranks.values()) + 1, bool)
        self.final[[i for t, i in ranks.items() if t.endswith(b"\x01")]] = True

    def _library(self, parts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 2000):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(parts[i : i + 2000], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian integers of `dtype`. No text is null."""
        return self._bytes(texts if isinstance(texts, list) else texts.to_pylist()) if self.kind == "byte" else self._words(texts)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            try:
                settled = t.isascii() or bool(t.encode("latin-1")) or True
            except UnicodeEncodeError:
                settled = not _SETTLED.search(t)
            if settled and not any(s in t for s in self.special):
                out.append(self.ranked.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes())
            else:
                out += self._library([t])
        return out

    def _words(self, texts: pa.Array | list[str]) -> list[bytes]:
        col = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        size = pc.binary_length(col).to_numpy().astype(np.int64)
        upto, out, a = np.cumsum(size), [], 0
        while a < len(col):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GROUP, "right")))
            if size[a] <= GROUP:
                out += self._group(col.slice(a, b - a))
            else:
                out.append(b"".join(x for p in _parts(col[a].as_py()) for x in self._group(pa.array([p], pa.large_string()))))
            a = b
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        each = words.flatten().dictionary_encode()
        ids, start, size = self._distinct(each.dictionary)
        of = each.indices.to_numpy()
        end = np.cumsum(size[of])
        ids = ids[np.repeat(start[of] - end + size[of], size[of]) + np.arange(end[-1])].tobytes()
        cut = (np.r_[0, end][words.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one behind the other, and where those of each start and how many they are."""
        offs = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        before = np.r_[np.uint8(0), data[:-1]] if len(data) else data
        odd = (data < 0x21) | (data == 0x7F) | (data > 0xC3) | (data == ord("'")) | ((before == 0xC2) & (data < 0xA1)) | ((before == ord("<")) & (data == ord("|")))
        plain = np.diff(np.r_[0, np.cumsum(odd)][offs]) == 0
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        # the plain words as Latin-1, lower case
        of = np.repeat(plain, np.diff(offs))
        text, wide = data[of], before[of] == 0xC3
        text = text + np.uint8(0x40) * (wide & (text < 0xC0) & (text > 0x7F))
        solid = (data[of] != 0xC2) & (data[of] != 0xC3)
        long = np.diff(np.r_[0, np.cumsum(solid)][np.r_[0, np.cumsum(np.diff(offs)[plain])]])
        text = _LOWER[text[solid]]
        held = np.zeros(0, self.dtype)
        if len(text):
            kind, end = _KIND[text], np.cumsum(long)
            last = np.r_[kind[1:] != kind[:-1], True] | (kind == 1)  # of a piece: a mark goes behind it
            last[end[end > 0] - 1] = True
            place = np.arange(len(text)) + np.cumsum(last) - last
            marked = np.full(len(text) + int(last.sum()), 1, np.uint8)
            marked[place] = text
            ids = self.ranked.encode_to_numpy(marked.tobytes().decode("latin-1"), disallowed_special=())
            pieces = np.r_[0, np.flatnonzero(self.final[ids]) + 1]
            end = pieces[np.r_[0, np.cumsum(last)][end]]
            start[plain], size[plain] = np.r_[0, end[:-1]], np.diff(end, prepend=0)
            held = ids.astype(self.dtype)
        rest = self._library(words.filter(pa.array(~plain)).to_pylist())
        size[~plain] = [len(r) // self.dtype.itemsize for r in rest]
        start[~plain] = len(held) + np.cumsum(size[~plain]) - size[~plain]
        return np.r_[held, np.frombuffer(b"".join(rest), self.dtype)], start, size


def _parts(text: str) -> Iterator[str]:
    """A long text cut at spaces, which separate words, where it reaches GROUP / 4 characters."""
    a = 0
    while (b := text.find(" ", a + GROUP // 4)) >= 0:
        yield text[a:b]
        a = b + 1
    yield text[a:]
