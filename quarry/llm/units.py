"""Texts as units that byte-level BPE encodes independently of each other.

The pre-tokenizer's pattern lets a token start with one space and never continue over one: a
space between two characters that are not white space always begins a match. Cutting a text
there gives units whose encodings, put in a row, are the encoding of the text. Units repeat, so a
worker encodes each only once while it remembers it.
"""

from __future__ import annotations

import re

#: ``\\s`` here holds every character that the pre-tokenizers treat as white space, and more.
_DOUBLE = re.compile(r"\s\s")
_LONE = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text cut at every space between two non-space characters, these spaces left out.

    ``" ".join(units(text)) == text``; all units but the first are encoded with a space before
    them. Spaces at either end of the text may also be cut at, which changes no encoding.
    """
    return _LONE.split(text) if _DOUBLE.search(text) else text.split(" ")


MARKS = ".,;:!?"


class Memory:
    """What a task remembers of units.

    ``encode(list[str]) -> list[bytes]`` is called for units not remembered. Units live in two
    generations of at most ``most`` each: when the young one is full it becomes the old one, and
    old units that are met again move back. Frequent units stay, rare ones go, and memory doesn't
    grow with the vocabulary.
    """

    def __init__(self, encode, most: int = 200_000):
        self.encode, self.most, self.young, self.old, self.mark = encode, most, {}, {}, {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The encodings of whole texts, each as the bytes of its units put in a row."""
        cut = [units(t) for t in texts]
        firsts = [u.pop(0) for u in cut]
        met: set[str] = set()
        met.update(*cut)
        if len(self.young) + len(met) > self.most:
            self.old, self.young = self.young, {}
        met -= self.young.keys()
        again = met & self.old.keys()
        self.young.update((x, self.old[x]) for x in again)
        met -= again
        if not self.mark:
            self.mark = dict(zip(MARKS, self.encode(list(MARKS)), strict=True))
        new, ended = [], []
        for x in met:
            # Letters and the mark after them are two matches of the pattern.
            of = self.young.get(x[:-1]) if x[-1:] in self.mark else None
            if of is not None and x[:-1].isalpha():
                ended.append((x, of + self.mark[x[-1]]))
            else:
                new.append(x)
        self.young.update(ended)
        self.young.update(zip(new, self.encode([" " + x for x in new]), strict=True))
        # First units are cut off from few spellings; they are encoded as they come.
        distinct = list(set(firsts))
        first = dict(zip(distinct, self.encode(distinct), strict=True))
        known = self.young.__getitem__
        return [first[f] + b"".join(map(known, u)) for f, u in zip(firsts, cut, strict=True)]
