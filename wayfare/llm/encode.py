"""Byte-level BPE encoding inside tasks.

Ids are those of the `tokenizers` library with the same vocabulary: in its default setting with `added`, where the
literal of an added token is that token; else as with encode_special_tokens, where it is text like any other.  Texts are cut where the vocabulary's
pre-tokenizer cuts in any context (before a space or a line end between two words), and chunks are cached per
worker, so most of a text costs a dictionary lookup.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Chunks that a worker keeps; it starts afresh when there are more.
CACHED = 200_000


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY, added: bool = False):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.added: dict[str, bytes] = {}
        if added:
            with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")), encoding="utf-8") as f:
                self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(f)["added_tokens"]}
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @staticmethod
    def chunks(text: str) -> list[str]:
        words = text.split()
        if not words:
            return [text] if text else []
        if "\0" not in text and len(text) - len("".join(words)) == len(words) - 1:
            # One white-space character between words and none at the ends: cut before spaces and around line ends.
            return [c for c in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")]
        found = []
        before = None
        for part in text.split(" "):
            if before is None:
                found.append(part)
            elif not part or not before or part[0].isspace() or before[-1].isspace():
                found[-1] += " " + part
            else:
                found.append(" " + part)
            before = part
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned little-endian 32-bit numbers."""
        if any(t in text for t in self.added):
            return b"".join([self.added.get(part) or self.plain(part) for part in self.literal.split(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        chunks = self.chunks(text)
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = array("I", self.bpe.encode_ordinary(c)).tobytes()
            return b"".join([known[c] for c in chunks])


@cache
def encoder(vocabulary: str = VOCABULARY, added: bool = False) -> Encoder:
    """One for each worker process, vocabulary and way with added tokens."""
    return Encoder(vocabulary, added)
