"""Encoding whole texts by a public tokenizer file, through a cache of words.

A batch of texts is cut at white space, and its distinct words are found in Arrow; a text's ids are gathered from those
of its words.  A word that isn't cached is cut again: neither pre-tokenizer joins a non-space with white space after it,
nor a letter with a mark of MARKS after it, so its ids are those of its letters and of what follows them.  Most letters
of a large corpus come once; those of the whole batch are encoded as one text, which is cut at the word ends.  Texts
with white space that isn't a single space or line end, and those that don't lower-case alike everywhere, are cut into
pieces one by one by a pattern of the same two properties.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

#: White space as Unicode has it, Latin letters, marks (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?|#$%&*"
KEEP, LONGEST, SLICE = 250_000, 48, 200_000
#: Bytes of text that are encoded at once; a text of more than LONG characters is encoded by itself, slice by slice.
AT_ONCE, LONG = 8 << 20, 1 << 20

_loaded: dict[str, CachedTokenizer] = {}


def _alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the files: itself where it prints, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class CachedTokenizer:
    """Text -> its ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.np, self.tok, self.letters = np, Tokenizer.from_file(path), Tokenizer.from_file(path)
        # letters come to it in the file's own alphabet: its normalizer would not change them, and its pattern not cut them
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.alphabet = _alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.tok.get_vocab()
        self.bare = spec["model"].get("end_of_word_suffix") == "</w>"  # lower case, no white space, word ends marked
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.bare else t.startswith(self.alphabet[32]))]] = True
        word = f"[{LETTER}]+(?=[{SPACE}{MARKS}]|\\Z)"
        if self.bare:
            plain, many = "a-zß-öø-ÿ", "[^\t-\r -~\xa0-į]"
            self.pieces = re.compile(f"{word}|[^{SPACE}]+")
            self.many = re.compile(many).search  # texts without these lower-case alike everywhere
            self.odd = f"{many}|<\\|"
        else:
            plain = LETTER
            self.pieces = re.compile(f"[{SPACE}]*{word}|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
            other = SPACE.replace("\t-\r ", "\t\x0b-\r")  # all but space and line end
            self.odd = f"[ \n][ \n]| \\z|[{other}]|<\\|"
        self.cut = f"^(?P<letters>[{plain}]*)(?P<rest>(?:[{MARKS}].*)?)$"
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        np = self.np
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, stems: list[str], often) -> list[bytes]:
        """Ids of distinct words of letters only (byte-level files: each with a space before it); those that come often stay cached."""
        np, got = self.np, list(map(self.stems.get, stems))
        new = [k for k, b in enumerate(got) if b is None]
        if not new:
            return got
        words = [stems[k] for k in new]
        line = self.alphabet[10]
        text = "\n".join(words).encode().decode("latin-1").translate(self.alphabet)
        text = text.replace(line, " ") if self.bare else self.alphabet[32] + text.replace(line, " " + self.alphabet[32])
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) == len(new):
            cut = ((np.r_[0, at + 1] if self.bare else np.r_[at, len(ids)]) * 4).tolist()
            raw = ids.tobytes()
            parts = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        else:  # a vocabulary that isn't as these are
            parts = self._encoded(words if self.bare else [" " + w for w in words])
        if len(self.stems) > KEEP:
            self.stems.clear()
        for k, p in zip(new, parts, strict=True):
            got[k] = p
            if often[k]:
                self.stems[stems[k]] = p
        return got

    def _word_ids(self, words: list[str], counts) -> list[bytes]:
        """Ids of distinct words without white space inside (byte-level files: each with a space before it); those that come often stay cached."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np, got = self.np, list(map(self.words.get, words))
        new = [k for k, b in enumerate(got) if b is None]
        if not new:
            return got
        miss, times = [words[k] for k in new], counts[new]
        both = pc.extract_regex(pa.array(miss, pa.string()), self.cut)
        stem, rest = (pc.fill_null(pc.struct_field(both, [k]), "").dictionary_encode() for k in (0, 1))
        stems, rests, i, j = _strings(stem.dictionary), _strings(rest.dictionary), stem.indices.to_numpy(), rest.indices.to_numpy()
        first = [b""] * len(stems)
        own = [k for k, s in enumerate(stems) if s]
        of = np.bincount(i, times, len(stems))
        for k, p in zip(own, self._letters([stems[k] for k in own], (of > 1)[own].tolist()), strict=True):
            first[k] = p
        # marks without letters before them are joined by the space before them
        then = self._encoded(rests)
        parts = [first[a] + then[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        alone = np.isin(i, [k for k, s in enumerate(stems) if not s])  # no letters, or letters that something else follows
        alone = np.flatnonzero(alone).tolist()
        for k, p in zip(alone, self._encoded([miss[k] if self.bare else " " + miss[k] for k in alone]), strict=True):
            parts[k] = p
        if len(self.words) > KEEP:
            self.words.clear()
        for k, p, n in zip(new, parts, times.tolist(), strict=True):
            got[k] = p
            if n > 1 and len(words[k]) <= LONGEST:
                self.words[words[k]] = p
        return got

    def encode(self, text: str) -> bytes:
        """Ids of one whole text, whatever is in it; long ones are joined slice by slice."""
        if self.bare and "<|" not in text and not self.many(text):
            text = text.lower()
        found, out, know = (m[0] for m in self.pieces.finditer(text)), [], {}
        while part := list(islice(found, SLICE)):
            fresh = list(set(part).difference(know))
            if len(know) > KEEP:
                know, fresh = {}, list(set(part))
            know.update(zip(fresh, self._encoded(fresh), strict=True))
            out += map(know.__getitem__, part)
        return b"".join(out)

    def encode_many(self, texts, end: int):
        """(ids of all texts of an Arrow array one after the other, each with ``end`` after it; their lengths); null is empty."""
        import pyarrow.compute as pc

        np = self.np
        texts = pc.fill_null(texts, "")
        own = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.utf8_length(texts), LONG))
        alone = np.flatnonzero(own.to_numpy(zero_copy_only=False))
        extra = [self.encode(texts[k].as_py()) for k in alone.tolist()]
        if len(alone):
            texts = pc.if_else(own, "", texts)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts)) if self.bare else pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        idx, words = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
        if self.bare:
            parts = self._word_ids(words, np.bincount(idx, minlength=len(words)))
        else:  # words at the start of a text or a line have no space before them
            line = words.index("\n") if "\n" in words else -1
            start = np.r_[at[:-1], np.flatnonzero(idx == line) + 1]
            head, which = np.unique(idx[start], return_inverse=True)
            heads = self._encoded([words[k] for k in head.tolist()])
            if line >= 0:
                words[line] = ""
            parts = self._word_ids(words, np.bincount(idx, minlength=len(words))) + heads
            if line >= 0:
                parts[line] = self._encoded(["\n"])[0]
            idx[start] = len(words) + which
        idx[at[alone]] = len(parts) + np.arange(len(alone))
        parts += [*extra, np.array([end], "<u4").tobytes()]
        idx = np.insert(idx, at[1:], len(parts) - 1)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(parts), "<u4")
        n = size[idx]
        to = np.cumsum(n)
        kind = np.int32 if max(len(pool), int(n.sum())) < 1 << 31 else np.int64
        place = np.repeat((first[idx] - (to - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        return pool[place], np.diff(np.r_[0, to][at + np.arange(len(at))])

    def batches(self, batch, column: int, end: int):
        """(first row, rows, ids, lengths) of slices of a batch, each of about AT_ONCE bytes of text."""
        import pyarrow.compute as pc

        np, texts = self.np, batch.column(column)
        many = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
        cuts = [*np.flatnonzero(np.r_[True, many[1:] != many[:-1]]).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield a, b - a, *self.encode_many(texts.slice(a, b - a), end)


def _strings(array) -> list:
    return array.to_numpy(zero_copy_only=False).tolist()


def tokenizer(path: str) -> CachedTokenizer:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]
