"""Token ids of whole texts, exactly as the tokenizer's own library gives them.

A byte-level BPE without a normaliser never joins bytes across a single space that
stands between two visible characters, so a text falls apart into chunks that can be
encoded one by one and remembered.  Chunks are few compared with their occurrences.
Chunks of plain Latin text that are not yet known go through ``tiktoken`` on ranks taken
from the same JSON file, after a check that its merges are listed in rank order (then
both libraries merge alike); everything else, special strings included, goes through
``tokenizers`` itself.  Files of another kind are encoded whole by their own library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

# Fixed value: the splitting pattern of byte-level BPE (use_regex of the ByteLevel pre-tokenizer).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"[^\S \n]")
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÿ]+")
_REMEMBERED = 250_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        self.fast, self.special = None, []
        if path.endswith(".model"):
            import sentencepiece

            self.piece, self.chunked = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.piece, self.whole = None, Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.chunked = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added)
        )
        if self.chunked and sys.byteorder == "little" and array("I").itemsize == 4:
            self.special = [a["content"] for a in added]
            self.fast = self._ranked(spec["model"], {a["content"] for a in added})

    @staticmethod
    def _ranked(model: dict, added: set[str]):
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        first = len(vocab) - len(pairs) - len(added & vocab.keys())
        if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        of = _byte_letters()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if self.piece is not None:
            return [np.asarray(x, dtype="<u4").tobytes() for x in self.piece.encode(texts, num_threads=1)]
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if self.fast is not None and _PLAIN.fullmatch(whole := "".join(chunks)) and not any(s in whole for s in self.special):
            encode = self.fast._core_bpe.encode_ordinary  # without the wrapper's retry of lone surrogates, which plain text lacks
            return [array("I", encode(c)).tobytes() for c in chunks]
        out: list[bytes | None] = []
        slow = []
        for c in chunks:
            if self.fast is None or not _PLAIN.fullmatch(c) or any(s in c for s in self.special):
                slow.append(len(out))
                out.append(None)
            else:
                out.append(array("I", self.fast.encode_ordinary(c)).tobytes())
        for i, x in zip(slow, self._encode_whole([chunks[i] for i in slow]) if slow else [], strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return self._encode_whole(texts) if texts else []
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known, out = self.known, []  # known: of " " + chunk, by chunk
        for t in texts:
            odd = "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or _ODD_SPACE.search(t)
            first, *rest = _SAFE_SPACE.split(t) if odd else t.split(" ")
            if new := [c for c in set(rest) if c not in known]:
                known.update(zip(new, self._ids([" " + c for c in new]), strict=True))
            out.append(self._ids([first])[0] + b"".join(map(known.__getitem__, rest)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
